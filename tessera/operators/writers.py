"""Write rules: defaults of a new row, insert-if-absent, no-op guard, sealing, done marks. Tables are parquet folders, appended or replaced whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import RUNGS
from tessera.steps import folder


def minted(rows: DataFrame) -> DataFrame:
    """Rows with the defaults of a new artifact: live, cited and of the weakest rung unless they say otherwise."""
    have = set(rows.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return rows.withColumns({"state": F.coalesce(col("state"), F.lit("live")), "cited_from": F.coalesce(col("cited_from"), F.lit("unknown")), "provenance": F.coalesce(col("provenance"), F.lit("asserted"))})


def absent_edges(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges not stored yet, each once: one aggregate of both tables, which sorts neither. A stored edge with a null is like no other."""
    key = ["src", "dst", "label"]
    more = [c for c in new.columns if c not in key]
    known = stored.select(*key).dropna().select(*key, F.lit(True).alias("_held"), *[F.lit(None).cast(t).alias(c) for c, t in new.dtypes if c in more])
    both = new.select(*key, F.lit(False).alias("_held"), *more).unionByName(known).groupBy(*key)
    row = F.first(F.when(~F.col("_held"), F.struct(*more)), ignorenulls=True) if more else F.lit(None)
    lacking = both.agg(F.max("_held").alias("_held"), row.alias("_row")).filter("NOT _held")
    return lacking.select(*[F.col(f"_row.{c}").alias(c) if c in more else F.col(c) for c in new.columns])


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows with those of new put in their place."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def changed(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new that differ from the stored row of their key, a null being a value like any other; fields that begin with _ or @ are no difference."""
    fields = [c for c in new.columns if c[0] not in "_@" and c != key]
    old = stored.select(F.col(key).alias("_key"), F.struct(*fields).alias("_old"))
    same = F.struct(*[F.col(f"new.{c}") for c in fields]).eqNullSafe(F.col("_old"))
    return new.alias("new").join(old, F.col(f"new.{key}") == F.col("_key"), "left").filter(~same).select("new.*")


def sealed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with address and size in place of the body, bodies by address, each once)."""
    ref = F.concat(F.lit("cas/"), F.sha2(F.col("content").cast("binary"), 256))
    out = rows.withColumn("content_ref", ref).withColumn("size", F.octet_length("content").cast("long"))
    return out.drop("content"), out.select("content_ref", "content").dropDuplicates(["content_ref"])


def left_to_do(shards: DataFrame, done: DataFrame, key: str = "shard") -> DataFrame:
    """Keys not marked as done, each once."""
    return shards.select(key).distinct().join(done.select(key), key, "left_anti")


def source_rows(sources: DataFrame) -> DataFrame:
    """For each source (name, licence): its citation, its operator and its collection, as rows (id, kind, cited_from, state)."""
    name = F.col("name")
    one = lambda prefix, kind, cited: F.struct(F.concat(F.lit(prefix), name).alias("id"), F.lit(kind).alias("kind"), cited.alias("cited_from"))
    three = F.array(one("cite-", "citation", F.col("licence")), one("op.source.", "operator", F.concat(F.lit("cite-"), name)), one("col-", "collection", F.concat(F.lit("cite-"), name)))
    return sources.select(F.explode(three).alias("r")).select("r.*", F.lit("live").alias("state"))


#: The rows that a store begins with: (kind, name, above).
SEEDS = (
    ("type", "artifact", None), ("type", "concept", "artifact"), ("type", "document", "artifact"), ("type", "operator", "artifact"), ("type", "source", "operator"), ("type", "collection", "artifact"),
    ("label", "part_of", None), ("label", "consolidates", None), ("label", "aligns", None), ("label", "cites", None), ("label", "near_dup_candidate", "aligns"),
    *(("rung", r, None) for r in RUNGS),
)


def bootstrap(spark: SparkSession, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, edges) that a store (id) still lacks of its seeds: nothing when it has been begun already."""
    seeds = spark.createDataFrame([(f"{k}-{n}", k, f"{k}-{a}" if a else None) for k, n, a in SEEDS], "id string, kind string, above string")
    missing = seeds.join(stored.select("id"), "id", "left_anti")
    return missing.select("id", "kind"), missing.filter("above IS NOT NULL").select(F.col("id").alias("src"), F.col("above").alias("dst"), F.lit("is_a").alias("label"))


def answers_kept(pairs: DataFrame) -> DataFrame:
    """Questions with their answers (question, answer) as rows keyed by the question, of rung hypothesis; of several answers the last in order is kept."""
    key = F.concat(F.lit("qa-"), F.substring(F.sha2(F.lower(F.trim("question")).cast("binary"), 256), 1, 20))
    return pairs.groupBy(key.alias("id")).agg(F.max("answer").alias("answer"), F.count(F.lit(1)).alias("n")).withColumn("provenance", F.lit("hypothesis"))


def published(df: DataFrame, path: str) -> None:
    """Write rows as JSON beside path and put them in its place at once, so that no reader meets half of them."""
    spark, beside = df.sparkSession, f"{path}.next"
    df.coalesce(1).write.mode("overwrite").json(beside)
    fs, at = folder(spark, path)
    fs.delete(at, True)
    fs.rename(folder(spark, beside)[1], at)


def appended(df: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines."""
    df.coalesce(1).write.mode("append").json(path)
