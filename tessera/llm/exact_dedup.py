"""Exact deduplication against a persistent digest index.

The index is a table of (digest, keep_id, batch), bucketed and sorted by
digest, so that a later batch meets it in a sort-merge join without moving the
index. New data is digested, grouped by digest with map-side combining,
anti-joined against what other batches have put into the index, and what is
left is appended to it.

A batch can be repeated: a job that dies after the append and is run again finds
its own rows under its own batch name and answers as the first time. Unless the
caller names it, a batch is named by its rows (their number and the sum of their
hashes), so the same rows are always the same batch.

Defined cases: a null text counts as the empty text, and empty texts equal one
another; texts of any length are digested whole. Of equal texts the row with the
largest doc_id stays (a null doc_id is smallest); of rows repeated whole exactly
one stays, and of rows equal in id and text alone the one whose other columns
hash highest. A text that another batch has put into the index is dropped in
favour of the indexed document. Columns other than the id and the text are
ignored by ``dedup_exact`` and kept by ``drop_copies``, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BucketedTable, Steps, chosen_rows, fresh_path

INDEX = "digest STRING, keep_id BIGINT, batch STRING"


def open_index(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> BucketedTable:
    """Open the index at path, or start one in the shared folder."""
    return BucketedTable(spark, path or fresh_path(spark, "digest-index"), INDEX, "digest", buckets)


def digest(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def batch_name(rows: DataFrame) -> str:
    """The same for the same rows (doc_id, digest) in any order."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)"))).first()
    return f"rows-{n}-{total or 0}"


def _settled(steps: Steps, groups: DataFrame, index: BucketedTable, batch: str) -> DataFrame:
    """groups (digest, last, group_size) with keep_id and fresh: whether no other batch holds the text. Extends the index."""
    groups = steps.written(groups, "digest-groups")
    held = index.read()
    others = held.filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("held_id"))
    own = held.filter(F.col("batch") == batch).select("digest")
    fresh = groups.join(others, "digest", "left_anti").withColumns({"keep_id": F.col("last.doc_id"), "fresh": F.lit(True)})
    seen = groups.join(others, "digest").withColumns({"keep_id": F.col("held_id"), "fresh": F.lit(False)}).drop("held_id")
    answers = steps.written(fresh.unionByName(seen), "digest-answers")
    new = answers.filter("fresh").select("digest", "keep_id").join(own, "digest", "left_anti")
    index.append(new.withColumn("batch", F.lit(batch)))
    return answers


def dedup_exact(docs: DataFrame, index: BucketedTable, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    group_size counts the rows of this batch with that text. The index is
    extended by the texts that it did not hold.
    """
    steps = Steps(docs.sparkSession)
    rows = steps.written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            digest(F.col(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    )
    groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row_no")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    answers = _settled(steps, groups, index, batch or batch_name(rows))
    steps.over(rows, answers)
    return rows.join(answers, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("fresh") & (F.col("row_no") == F.col("last.row_no"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: BucketedTable, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows meet the digests by (id, text, other columns), which only rows repeated
    whole share, so a text with any number of copies is no hot key.
    """
    steps = Steps(docs.sparkSession)
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    keys = {
        "digest": digest(docs["text"].cast("string")),
        "doc_id": docs["doc_id"].cast("long"),
        "tie": F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long"),
    }
    rows = steps.written(docs.select(*[c.alias(k) for k, c in keys.items()]), "digests")
    per = rows.groupBy("digest", "doc_id", "tie").agg(F.count(F.lit(1)).alias("n"))
    groups = per.groupBy("digest").agg(F.max(F.struct("doc_id", "tie", "n")).alias("last"), F.sum("n").alias("group_size"))
    answers = _settled(steps, groups, index, batch or batch_name(rows))
    stay = answers.filter("fresh").select("digest", "last.doc_id", "last.tie", "last.n")
    steps.over(answers)
    return chosen_rows(docs, keys, stay)
