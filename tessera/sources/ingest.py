"""Ingest: declared parquet sources with done marks, and the runtime that lands a stream in artifact and body tables."""

from __future__ import annotations

from dataclasses import dataclass

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import corpus_terms, kind_of_path
from tessera.operators.index import FieldIndex
from tessera.operators.writers import left_to_do, minted, sealed
from tessera.steps import exists, folder


@dataclass(frozen=True)
class Declared:
    """A source by its fields; rows with a shorter text are left out."""

    name: str
    title_field: str
    text_field: str
    id_field: str
    least: int = 120


def records(rows: DataFrame, source: Declared) -> DataFrame:
    """Artifacts of a declared source: id, title, content, collection and citation. Only its three columns are read."""
    text = F.trim(source.text_field)
    return minted(
        rows.filter(F.length(text) >= source.least).select(
            F.concat(F.lit(f"{source.name}-"), source.id_field).alias("id"),
            F.substring(source.title_field, 1, 200).alias("title"),
            F.concat_ws("\n\n", source.title_field, source.text_field).alias("content"),
            F.lit(source.name).alias("collection_id"),
            F.lit(f"source:{source.name}").alias("cited_from"),
            F.lit("fetched").alias("provenance"),
        )
    )


#: The two encyclopedia sources: from 120 and from 200 characters.
ENCYCLOPEDIAS = (Declared("simple", "title", "text", "doc_id", 120), Declared("full", "title", "text", "doc_id", 200))
#: Characters of a file that are kept.
FILE_CHARS = 20_000


def with_lemmas(rows: DataFrame) -> DataFrame:
    """Artifacts with the distinct terms of their content, in order."""
    return rows.withColumn("lemmas", F.array_distinct(corpus_terms(F.col("content"))))


def described(files: DataFrame) -> DataFrame:
    """Artifacts of files (path, content): id by path, kind by name, content cut."""
    key = F.concat(F.lit("file-"), F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 20))
    return minted(files.select(key.alias("id"), "path", kind_of_path(F.col("path")).alias("kind"), F.substring("content", 1, FILE_CHARS).alias("content")))


def concepts(terms: DataFrame) -> DataFrame:
    """Concept rows of terms (term), each once."""
    one = terms.select("term").distinct()
    key = F.concat(F.lit("concept-"), F.replace(F.lower("term"), F.lit(" "), F.lit("_")))
    return minted(one.select(key.alias("id"), F.col("term").alias("title"), F.lit("concept").alias("content_type"), F.lit("fetched").alias("provenance")))


def all_done(projects: DataFrame, marks: DataFrame) -> DataFrame:
    """(stage, projects, done) of projects (stage, project): a stage is done when all that it allows are marked (project)."""
    marked = marks.select("project", F.lit(1).alias("marked")).distinct()
    each = projects.distinct().join(marked, "project", "left")
    return each.groupBy("stage").agg(F.count(F.lit(1)).alias("projects"), (F.count("marked") == F.count(F.lit(1))).alias("done"))


def next_lines(lines: DataFrame, cursor: int, most: int) -> DataFrame:
    """(cursor, applied, held): of lines (line, ended) the next most after a cursor are applied, up to the first that has not ended; that one is held and read again later."""
    part = lines.filter(F.col("line") > cursor).orderBy("line").limit(most)
    open_ = part.agg(F.min(F.when(~F.col("ended"), F.col("line"))).alias("open"))
    taken = part.crossJoin(F.broadcast(open_)).withColumn("taken", F.col("open").isNull() | (F.col("line") < F.col("open")))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return taken.agg(F.coalesce(F.max(F.when(F.col("taken"), F.col("line"))), F.lit(cursor)).alias("cursor"), count(F.col("taken")).alias("applied"), count(~F.col("taken")).alias("held"))


def done_shards(spark: SparkSession, marks: str) -> DataFrame:
    return spark.read.schema("shard string").parquet(marks) if exists(spark, marks) else spark.range(0).select(F.lit(None).cast("string").alias("shard"))


def ingest_shards(spark: SparkSession, glob: str, source: Declared, out: str, marks: str) -> int:
    """Land the shards of a glob that carry no mark yet, then mark them; gives their number.

    The list of shards is a listing of files, not data. What is landed is named by
    the shards that it is of and replaces what an earlier try of the same has left,
    so that a run that dies before its marks lands nothing twice.
    """
    listed = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("shard"))
    todo = [r[0] for r in left_to_do(listed, done_shards(spark, marks)).orderBy("shard").collect()]
    if todo:
        name = hashlib.sha256("\n".join(todo).encode()).hexdigest()[:20]
        rows, bodies = sealed(records(spark.read.parquet(*todo), source))
        rows.write.mode("overwrite").parquet(f"{out}/artifacts/landing={name}")
        bodies.write.mode("overwrite").parquet(f"{out}/bodies/landing={name}")
        spark.createDataFrame([(s,) for s in todo], "shard string").coalesce(1).write.mode("append").parquet(marks)
    return len(todo)


def land_stream(observations: DataFrame, out: str, checkpoint: str):
    """Start landing a stream of observations (id, content, ...) micro-batch by micro-batch: bodies by address, those that are not there yet, and rows with their address.

    A batch is named by its epoch and replaces what an earlier try of it has left.
    """

    return observations.writeStream.foreachBatch(lambda batch, epoch: _put(batch, out, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _put(batch: DataFrame, out: str, epoch: int) -> None:
    spark = batch.sparkSession
    rows, bodies = sealed(minted(batch))
    rows.write.mode("overwrite").parquet(f"{out}/artifacts/epoch={epoch}")
    if exists(spark, f"{out}/bodies"):
        held = spark.read.schema("content_ref string, content string, epoch int").parquet(f"{out}/bodies").filter(F.col("epoch") != epoch)
        bodies = bodies.join(held.select("content_ref"), "content_ref", "left_anti")
    bodies.write.mode("overwrite").parquet(f"{out}/bodies/epoch={epoch}")


def ingest_stream(observations: DataFrame, out: str, index: FieldIndex, checkpoint: str):
    """Start observing, describing, putting and indexing a stream in one call: observations (id, content, and any of title, description, tags, state, sealed).

    Every micro-batch lands as in ``land_stream`` and is then indexed as the
    generation of its epoch. A batch that fails anywhere is run again by Spark with
    the same epoch and replaces what it had put and indexed, so that store and index
    hold every observation once, whenever the stream was stopped. Generations above
    those of the stream are left to other writers by giving them an index of their own.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            _put(batch, out, epoch)
            index.add(searchable(batch), gen=epoch + 1)
        finally:
            batch.unpersist()

    return observations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def searchable(rows: DataFrame) -> DataFrame:
    """(id, title, description, tags, content, state, sealed) of rows (id, content, ...): the title is the first line unless there is one, what else is absent is empty, live and open. Of one id the least content counts."""
    text = lambda c, absent: F.coalesce(F.col(c).cast("string"), absent) if c in rows.columns else absent
    content = F.coalesce("content", F.lit(""))
    first = F.substring(F.split(content, "\n")[0], 1, 200)
    named = rows.filter("id IS NOT NULL").select(
        F.col("id").cast("string").alias("id"), text("title", first).alias("title"), text("description", F.lit("")).alias("description"), text("tags", F.lit("")).alias("tags"), content.alias("content"),
        text("state", F.lit("live")).alias("state"), (F.coalesce(F.col("sealed").cast("boolean"), F.lit(False)) if "sealed" in rows.columns else F.lit(False)).alias("sealed"),
    )
    fields = [c for c in named.columns if c != "id"]
    return named.groupBy("id").agg(F.min(F.struct("content", *[c for c in fields if c != "content"])).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in fields])


def folder_bytes(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, files) under a folder of any store, from its file listing alone; (0, 0) if there is none."""
    fs, at = folder(spark, path)
    if not fs.exists(at):
        return 0, 0
    found = fs.getContentSummary(at)
    return found.getLength(), found.getFileCount()
