"""tessera: a PySpark-native engine for provenance-carrying knowledge corpora."""

from __future__ import annotations

import os


def ensure_importable(spark) -> None:
    """Let Python workers find this package where it is not installed: its folder joins their search path.

    On a cluster the package is shipped as usual (installed, or by --py-files); the entry is then without effect.
    """
    env, here = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])
