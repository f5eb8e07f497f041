"""Readers of lexical sources: LMF XML, Turtle concept lines, assertion lines, dumps of files and shards.

All are column expressions over Spark's own xml, text and parquet readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Values of an interlingual id that stand for "none", and sense relations that are lifted to their synsets: fixed values of the formats.
NO_ILI = ("", "in", "None")
SENSE_RELATIONS = ("antonym", "derivation", "pertainym")

_ENTRY = """_id string, Lemma struct<_writtenForm:string,_partOfSpeech:string>,
    Sense array<struct<_id:string,_synset:string,SenseRelation:array<struct<_relType:string,_target:string>>>>"""
_SYNSET = """_id string, _ili string, _partOfSpeech string, Definition array<string>, Example array<string>,
    SynsetRelation array<struct<_relType:string,_target:string>>"""


def lmf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(synsets, relations) of an LMF file: lemmas with their sense rank; relations between stored synsets only."""
    entries = spark.read.format("xml").option("rowTag", "LexicalEntry").schema(_ENTRY).load(path)
    synsets = spark.read.format("xml").option("rowTag", "Synset").schema(_SYNSET).load(path)
    senses = entries.select(F.col("Lemma._writtenForm").alias("lemma"), F.posexplode("Sense").alias("rank", "s"))
    words = senses.groupBy(F.col("s._synset").alias("id")).agg(F.array_sort(F.collect_set(F.struct("lemma", "rank"))).alias("lemmas"))
    ili = ili_or_none(F.col("_ili"))
    rows = synsets.select(
        F.col("_id").alias("id"), ili.alias("ili"), F.col("_partOfSpeech").alias("pos"), F.element_at("Definition", 1).alias("gloss"), F.col("Example").alias("examples")
    ).join(words, "id", "left")
    own = synsets.select(F.col("_id").alias("src"), F.explode("SynsetRelation").alias("r")).select("src", F.col("r._target").alias("dst"), F.col("r._relType").alias("label"))
    lifted = senses.select(F.col("s._synset").alias("src"), F.explode("s.SenseRelation").alias("r")).filter(F.col("r._relType").isin(*SENSE_RELATIONS))
    at = senses.select(F.col("s._id").alias("sense"), F.col("s._synset").alias("dst"))
    lifted = lifted.join(at, F.col("r._target") == F.col("sense")).select("src", "dst", F.col("r._relType").alias("label"))
    ids = synsets.select(F.col("_id").alias("known"))
    every = own.unionByName(lifted).filter("src <> dst").distinct()
    return rows, every.join(ids, F.col("dst") == F.col("known"), "left_semi")


def concept_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, definition, offset, pos) of Turtle records; a last record without its full stop is read too."""
    records = spark.read.option("lineSep", "\n<i").text(path).select(F.concat(F.lit("<i"), F.regexp_replace("value", r"^<i", "")).alias("v"))
    part = lambda pattern: F.nullif(F.regexp_extract("v", pattern, 1), F.lit(""))
    out = records.select(
        part(r"^<(i\d+)>").alias("id"), part(r'(?s)skos:definition\s+"((?:[^"\\]|\\.)*)"').alias("definition"),
        part(r"pwn30:(\d{8})-[nvars]").alias("offset"), part(r"pwn30:\d{8}-([nvars])").alias("pos"),
    )
    return out.filter(F.col("id").isNotNull())


def term(uri: Column) -> Column:
    """The words of /c/en/... without sense marks."""
    return F.regexp_replace(F.regexp_extract(uri, r"^/c/en/([^/]+)", 1), "_", " ")


def label(uri: Column) -> Column:
    """The relation of /r/... in lower case, its words and parts joined by underscores."""
    said = F.regexp_extract(uri, r"^/r/(.+)$", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(said, "([a-z0-9])([A-Z])", "$1_$2"), "/", "_"))


def ili_or_none(ili: Column) -> Column:
    """An interlingual id, null for what stands for none."""
    return F.when(~F.coalesce(ili, F.lit("")).isin(*NO_ILI), ili)


def assertions(lines: DataFrame, value: str = "value") -> DataFrame:
    """(src, dst, label, weight) of tab-separated assertion lines: both ends English, no self-loops, five fields; the weight defaults to 1."""
    f = F.split(value, "\t")
    parsed = lines.filter(F.size(f) == 5).select(
        term(f[2]).alias("src"), term(f[3]).alias("dst"), label(f[1]).alias("label"), F.get_json_object(f[4], "$.weight").cast("double").alias("w"), F.try_parse_json(f[4]).isNotNull().alias("ok")
    )
    return parsed.filter("ok AND src <> '' AND dst <> '' AND label <> '' AND src <> dst").select("src", "dst", "label", F.coalesce("w", F.lit(1.0)).alias("weight"))


def senses(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """(synset, lemma, nth, sense_rank, count) of entries (synset, lemmas in order): every lemma once, its sense rank the place of the synset among those with that lemma; counts (synset, count) where measured."""
    each = entries.select("synset", F.posexplode(F.array_distinct("lemmas")).alias("nth", "lemma"))
    rank = F.row_number().over(W.partitionBy("lemma").orderBy("synset")) - 1
    return each.withColumn("sense_rank", rank).join(counts, "synset", "left").select("synset", "lemma", "nth", "sense_rank", "count")


def articles(pages: DataFrame) -> DataFrame:
    """(title, lead, text) of encyclopedia pages (title, text), cleaned; pages about pages and redirects are left out."""
    some = pages.filter(~F.col("title").contains(":") & ~F.upper(F.ltrim("text")).startswith("#REDIRECT"))
    cleaned = some.select("title", T.clean_wikitext(F.col("text")).alias("text"))
    return cleaned.select("title", T.lead(F.col("text")).alias("lead"), "text")


def dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the pages of an XML dump, compressed or not."""
    schema = "title string, revision struct<text:struct<_VALUE:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.select("title", F.col("revision.text._VALUE").alias("text"))


def projects(index: DataFrame) -> DataFrame:
    """(project, licence, label, language) of rows (json): an object of projects, each with these fields."""
    each = F.explode(F.from_json("json", "map<string,struct<license:string,label:string,language:string>>"))
    return index.select(each.alias("project", "p")).select("project", F.col("p.license").alias("licence"), "p.label", "p.language")


def node_stats(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """(the snapshots of all nodes in a folder of JSON files, how many could not be read)."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").json(path).cache()
    bad = rows.filter("_corrupt_record IS NOT NULL").count()
    return rows.filter("_corrupt_record IS NULL").drop("_corrupt_record"), bad


def folder_poll(spark: SparkSession, path: str, seen: DataFrame, suffixes: tuple[str, ...] = ("md", "txt", "py"), skip: tuple[str, ...] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """(id, path, mtime, content) of the files that are new or changed since seen (path, mtime); a file that could not be taken down is not in seen and comes again."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
        .select("path", F.col("modificationTime").alias("mtime"), "content")
    )
    shown = files.filter(~F.exists(F.split("path", "/"), lambda p: p.isin(*skip)))
    return shown.join(seen, ["path", "mtime"], "left_anti").select(F.concat(F.lit("file-"), F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 20)).alias("id"), "path", "mtime", F.col("content").cast("string").alias("content"))


def licensed(index: DataFrame, allowed: list[str]) -> DataFrame:
    """Projects whose stated licence contains an allowed one."""
    ok = F.exists(F.array(*[F.lit(a.lower()) for a in allowed]), lambda a: F.contains(F.lower("license"), a))
    return index.filter(F.coalesce(ok, F.lit(False)))


def shards_left(shards: DataFrame, done: DataFrame) -> DataFrame:
    """(shard) not yet marked."""
    return shards.select("shard").distinct().join(done.select("shard"), "shard", "left_anti")


def folder_stream(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("md", "txt", "py")) -> DataFrame:
    """Files of a folder tree as a stream: id, path, mtime, content (text). A file is emitted when first seen."""
    files = (
        spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
        .schema("path string, modificationTime timestamp, length long, content binary").load(path)
    )
    return files.select(F.concat(F.lit("file-"), F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 20)).alias("id"), "path", F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("content"))


def jsonl_tail(spark: SparkSession, path: str, schema: str, n: int, order: str) -> DataFrame:
    """The last n readable records of a JSON-lines log."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc(order)).limit(n)
