"""Shared helpers of the training-data operators: tables, the shared work folder, written steps, bucketed tables, chosen rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.steps import Steps, delete, exists, folder, fresh_path, shared_folder, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has already."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        out.append(n)
    return out


def chosen_rows(docs: DataFrame, keys: dict[str, Column], stay: DataFrame) -> DataFrame:
    """Of docs one row for every row of stay, with all columns of docs.

    keys: columns of stay, and what they equal in docs (null-safe). stay also has
    n, the number of rows of docs with these keys. Where that is 1 the rows come
    by a semi-join whose keys no two rows share. Rows that share all keys are
    taken one of each by an aggregate, so that a hot one is reduced before it is
    shuffled.
    """
    names = dict(zip(keys, unused(docs, *[f"_key_{k}" for k in keys])))
    wanted = stay.select("n", *[F.col(k).alias(names[k]) for k in keys])
    same = None
    for k, c in keys.items():
        here = c.eqNullSafe(F.col(names[k]))
        same = here if same is None else same & here
    out = docs.join(wanted.filter("n = 1").drop("n"), same, "left_semi")
    many = wanted.filter("n > 1").drop("n")
    if many.limit(1).count() == 0:
        return out
    whole = docs.join(many, same, "left_semi").select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(names[k]) for k, c in keys.items()])
    each = whole.groupBy(*names.values()).agg(F.first("row").alias("row"))
    return out.unionByName(each.select("row.*"))


class BucketedTable:
    """A table at a shared path, bucketed and sorted by one column, so that a batch meets it in a sort-merge join without moving it.

    The number of buckets is fixed when the table is begun, and part of its
    folder's name; who opens it again need not know it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets = self._begun() or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{self.path}/buckets={self.buckets}"
        self.name = f"bucketed_{hashlib.md5(self.folder.encode()).hexdigest()}"
        quoted = self.folder.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{quoted}'"
        )

    def _begun(self) -> int | None:
        fs, at = folder(self.spark, self.path)
        if fs.exists(at):
            for status in fs.listStatus(at):
                if m := re.fullmatch(r"buckets=(\d+)", status.getPath().getName()):
                    return int(m[1])
        return None

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add rows, one file per bucket."""
        (
            rows.select(*self.read().columns)
            .repartition(self.buckets, self.key)
            .write.bucketBy(self.buckets, self.key)
            .sortBy(self.key)
            .mode("append")
            .format("parquet")
            .option("path", self.folder)
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Take the table out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def discard(self) -> None:
        """Close, and delete the files."""
        self.close()
        delete(self.spark, self.path)


def portions(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in portions of at most ``rows`` rows and about ``size`` bytes in a column of texts, so that long texts need no more memory than short ones."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = n = 0
    for i, x in enumerate(sizes):
        if i > start and (i - start >= rows or n + x > size):
            yield batch.slice(start, i - start)
            start, n = i, 0
        n += x
    if sizes:
        yield batch.slice(start)
