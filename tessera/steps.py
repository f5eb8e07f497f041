"""Steps that are written to a shared folder and read back, so that what follows neither recomputes them nor depends on an executor that may be lost."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Lets Spark delete the shuffle files of a query when it ends; of a step that is written nothing is read from them any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``, and without that setting this
    is an error. In local mode, where all run on one machine, a temporary folder
    per process stands in for it and goes when the process ends.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"{SETTING} must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return _own["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, path: str):
    """(file system, path) on the JVM, whatever store the path is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = folder(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = folder(spark, path)
    fs.delete(at, True)


class Steps:
    """The written steps of one run. Those that its answer does not read are deleted when the run is over.

    While a step is written, shuffle files of the session's queries go when these end: a session should run one query at a time.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.made: list[tuple[str, DataFrame]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path, conf = fresh_path(self.spark, name), self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((path, out))
        return out

    def over(self, *read: DataFrame) -> None:
        """Delete all steps but those in ``read``, which the answer still needs."""
        for path, frame in self.made:
            if not any(frame is r for r in read):
                delete(self.spark, path)
        self.made = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    return Steps(df.sparkSession).written(df, name)
