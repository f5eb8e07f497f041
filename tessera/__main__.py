"""python -m tessera list | run QUERY FOLDER [ROWS] | metrics FOLDER"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tessera import ensure_importable
from tessera.plans import registry


def main(args: list[str]) -> int:
    queries = registry.queries()
    if args[:1] == ["list"]:
        print("\n".join(queries))
        return 0
    if args[:1] == ["metrics"] and len(args) == 2:
        args = ["run", registry.FLAGSHIP, args[1]]
    if args[:1] != ["run"] or len(args) not in (3, 4) or args[1] not in queries:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ensure_importable(spark)
    queries[args[1]](spark, args[2]).show(int(args[3]) if len(args) > 3 else 20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
