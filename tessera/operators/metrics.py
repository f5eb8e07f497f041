"""Corpus health: bytes and compression ratio, keyed coverage, provenance audits, rates, consistency.

A null result means "not measured" and never 0. All are single-pass
aggregates; the only joins are semi-joins against the edge list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import utf8_bytes

#: Content types that are machinery, not content.
MACHINERY = ("operator", "source")


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))


def consolidated(artifacts: DataFrame) -> DataFrame:
    """(src, dst): from the least id of every group of equal content to its other members."""
    groups = artifacts.groupBy("content_ref").agg(F.min("id").alias("src"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return artifacts.join(groups, "content_ref").filter("id <> src").select("src", F.col("id").alias("dst"))


def generators(artifacts: DataFrame, merged: DataFrame) -> DataFrame:
    """Artifacts that no other one stands for."""
    return artifacts.join(merged.select(F.col("dst").alias("id")), "id", "left_anti")


def _measures() -> list[Column]:
    content = ~F.col("content_type").isin(*MACHINERY)
    size = F.col("bytes")
    total, made = F.sum(size), F.coalesce(F.sum(F.when(~F.col("merged"), size)), F.lit(0))
    n_content, n_keyed = count_if(content), count_if(content & F.col("keyed"))
    return [
        F.count(F.lit(1)).alias("artifacts"),
        total.alias("bytes"),
        made.alias("generator_bytes"),
        count_if(F.col("merged")).alias("consolidated"),
        (n_content - n_keyed).alias("dark_matter"),
        F.when(n_content > 0, F.round(n_keyed / n_content, 4)).alias("keyed_coverage"),
        F.when(total > 0, F.round(made / total, 4)).alias("rho"),
        count_if(F.col("cited_from").isNull()).alias("missing_cited_from"),
        count_if(F.col("provenance").isNull()).alias("missing_provenance"),
        ((count_if(F.col("cited_from").isNull()) + count_if(F.col("provenance").isNull())) == 0).alias("invariant"),
    ]


def _measured(artifacts: DataFrame, merged: DataFrame) -> DataFrame:
    dst = merged.select(F.col("dst").alias("id"), F.lit(True).alias("is_merged")).distinct()
    return artifacts.join(dst, "id", "left").select(
        "collection_id", "content_type", "keyed", "cited_from", "provenance",
        utf8_bytes(F.col("size"), F.col("content")).alias("bytes"), F.coalesce("is_merged", F.lit(False)).alias("merged"),
    )


def all_metrics(artifacts: DataFrame, merged: DataFrame) -> DataFrame:
    """Every measure per collection and for the whole corpus (collection_id null), in one pass."""
    return _measured(artifacts, merged).rollup("collection_id").agg(*_measures())


def collection_metrics(artifacts: DataFrame, merged: DataFrame, collection: str) -> DataFrame:
    return _measured(artifacts.filter(F.col("collection_id") == collection), merged).groupBy("collection_id").agg(*_measures())


def audit_provenance(artifacts: DataFrame) -> DataFrame:
    """Violators of the provenance invariant by content type, with up to 20 sample ids."""
    bad = artifacts.filter(F.col("cited_from").isNull() | F.col("provenance").isNull()).select("content_type", "id", "cited_from", "provenance")
    nth = F.row_number().over(W.partitionBy("content_type").orderBy("id"))
    sample = F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= 20, F.col("id")))), ",")
    return bad.withColumn("nth", nth).groupBy("content_type").agg(
        F.count(F.lit(1)).alias("violators"), count_if(F.col("cited_from").isNull()).alias("no_citation"),
        count_if(F.col("provenance").isNull()).alias("no_rung"), sample.alias("samples"),
    )


def backfill_provenance(artifacts: DataFrame) -> DataFrame:
    """Missing fields filled: machinery is observed from genesis, content is asserted from an unknown place."""
    system = F.col("content_type").isin(*MACHINERY)
    return artifacts.select(
        "id",
        F.coalesce("cited_from", F.when(system, "genesis").otherwise("unknown")).alias("cited_from"),
        F.coalesce("provenance", F.when(system, "observed").otherwise("asserted")).alias("provenance"),
        (F.col("cited_from").isNull() | F.col("provenance").isNull()).alias("changed"),
    )


def rate_per_minute(snapshots: DataFrame, cadence_s: float) -> DataFrame:
    """Rows a minute since the previous snapshot of the node; null unless the gap is within a quarter and four times the cadence and both counts are measured."""
    w = W.partitionBy("node").orderBy("ts", "n")
    dt = F.unix_micros(F.col("ts")) / 1e6 - F.unix_micros(F.lag("ts").over(w)) / 1e6
    ok = dt.between(cadence_s / 4, cadence_s * 4)
    return snapshots.withColumn("rate", F.when(ok, (F.col("n") - F.lag("n").over(w)) / dt * 60))


def ewma(samples: Column, keep: float = 0.7) -> Column:
    """keep * old + (1 - keep) * new over an array in order; the first sample starts it, none gives null."""
    start = F.struct(F.lit(None).cast("double").alias("r"))
    return F.aggregate(samples, start, lambda a, x: F.struct(F.when(a["r"].isNull(), x).otherwise(a["r"] * keep + x * (1 - keep)).alias("r")), lambda a: a["r"])


def flow(snapshots: DataFrame) -> DataFrame:
    """Per snapshot: minted = max(0, change of the dark + what was cleared), and cleared over minted (null when nothing was minted)."""
    w = W.partitionBy("node").orderBy("ts", "dark")
    minted = F.greatest(F.lit(0).cast("long"), F.col("dark") - F.lag("dark").over(w) + F.col("cleared"))
    return snapshots.withColumn("minted", minted).withColumn("validation_ratio", F.when(F.col("minted") > 0, F.col("cleared") / F.col("minted")))


def self_information(df: DataFrame, key: str) -> DataFrame:
    """(key, n, bits): -log2 of each value's share."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("bits", -F.log2(F.col("n") / F.col("_total"))).drop("_total")


def exact_median(df: DataFrame, x: str) -> DataFrame:
    """One row (median): the exact median of a column, null without values.

    A quantile sketch bounds the middle; only what lies within the bounds is
    sorted, a few ten-thousandths of the rows. Bounds that miss the middle, as of
    a handful of values, are widened to all.
    """
    values = df.select(F.col(x).cast("double").alias("x")).filter("x IS NOT NULL")
    n = values.count()
    if not n:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("median"))
    first, last = (n - 1) // 2, n // 2
    low, high = values.agg(F.approx_percentile("x", [0.4999, 0.5001], 100_000)).first()[0]
    below, within = values.agg(count_if(F.col("x") < low), count_if(F.col("x").between(low, high))).first()
    if not below <= first <= last < below + within:
        low, high, below = -math.inf, math.inf, 0
    nth = F.row_number().over(W.orderBy("x")) - 1 + below
    return values.filter(F.col("x").between(low, high)).withColumn("nth", nth).filter(F.col("nth").isin(first, last)).agg(F.avg("x").alias("median"))


def joint_entropies(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: H(X), H(Y), H(X,Y), I(X;Y), H(X|Y), H(Y|X) in bits, from one count of pairs."""
    pairs = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    # sum n log2 n over each margin; pairs are few next to rows
    def margin(keys: list[str], name: str) -> DataFrame:
        counts = pairs.groupBy(*keys).agg(F.sum("n").alias("n")) if len(keys) < 2 else pairs
        return counts.agg(F.sum(F.col("n") * F.log2("n")).alias(name), F.sum("n").alias(f"total_{name}"))

    one = margin([x], "sx").crossJoin(margin([y], "sy")).crossJoin(margin([x, y], "sxy"))
    h = lambda s: F.log2(F.col(f"total_{s}")) - F.col(s) / F.col(f"total_{s}")
    hx, hy, hxy = h("sx"), h("sy"), h("sxy")
    return one.select(hx.alias("h_x"), hy.alias("h_y"), hxy.alias("h_xy"), (hx + hy - hxy).alias("mutual"), (hxy - hy).alias("h_x_given_y"), (hxy - hx).alias("h_y_given_x"))


def types_and_fitness(artifacts: DataFrame) -> DataFrame:
    """(content_type, n, fitness): counts and the mean measured fitness (null where none is measured)."""
    return artifacts.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("fitness"))


def counts_by(df: DataFrame, key: str, live: Column) -> DataFrame:
    """(key, n, live): rows in all states, as a resuming ingest counts them, and the live ones."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), count_if(live).alias("live"))


def null_counts(df: DataFrame, fields: list[str], measured: bool = True, cap: int | None = None) -> DataFrame:
    """One row: how many rows lack each field. Null for "not measured": where a scan is not allowed, or the rows are more than cap."""
    n = df.limit(cap + 1).count() if cap is not None and measured else 0
    if not measured or (cap is not None and n > cap):
        return df.sparkSession.range(1).select(*[F.lit(None).cast("long").alias(f"no_{c}") for c in fields])
    return df.agg(*[count_if(F.col(c).isNull()).alias(f"no_{c}") for c in fields])


def page_after(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next n rows by key: those with a greater key than the last page's last, never an offset."""
    return df.filter(F.col(key) > after).orderBy(key).limit(n)


def queue_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("since").alias("last"))


def recent_terminal(tasks: DataFrame, n: int) -> DataFrame:
    return tasks.filter("status = 'done'").orderBy(F.desc("since"), "id").limit(n)


def pending_window(tasks: DataFrame, n: int = 24, most_attempts: int = 5) -> DataFrame:
    return tasks.filter((F.col("status") == "pending") & (F.col("attempts") < most_attempts)).orderBy("priority", "since", "id").limit(n)


def consistency(recorded: DataFrame, measured: DataFrame) -> DataFrame:
    """(check, holds): a recorded snapshot against what is measured now, null where a side has no reading.

    Both are rows of collections with artifacts, consolidated, bytes,
    generator_bytes, keyed, content; the recorded ones of an earlier time.
    """
    r = {c: F.col(f"r_{c}") for c in ("artifacts", "consolidated", "bytes", "generator_bytes", "keyed", "content")}
    now = {c: F.col(f"m_{c}") for c in r}
    total = lambda df, side: df.agg(*[F.sum(c).alias(f"{side}_{c}") for c in r])
    row = total(recorded, "r").crossJoin(total(measured, "m"))
    checks = {
        "artifacts_never_shrink": now["artifacts"] >= r["artifacts"],
        "merged_never_unmerge": now["consolidated"] >= r["consolidated"],
        "merged_within_all": now["consolidated"] <= now["artifacts"],
        "generators_within_bytes": now["generator_bytes"] <= now["bytes"],
        "ratio_never_rises": now["generator_bytes"] / F.nullif(now["bytes"], F.lit(0)) <= r["generator_bytes"] / F.nullif(r["bytes"], F.lit(0)),
        "keyed_within_content": now["keyed"] <= now["content"],
        "coverage_never_falls": now["keyed"] / F.nullif(now["content"], F.lit(0)) >= r["keyed"] / F.nullif(r["content"], F.lit(0)),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("holds")) for k, v in checks.items()])
    return row.select(F.explode(pairs).alias("c")).select("c.check", "c.holds")
