"""The data model on the warehouse tables: artifacts, labelled edges, a taxonomy with counts, traces.

An artifact is a document with its provenance; an edge is (src, dst, label,
weight), unique on its first three columns; a taxonomy node has one parent and
an own count; a trace is one observation of a concept by an agent at a tick.
Each builder is lazy, reads only the columns it needs and filters natively.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Provenance rungs from weakest to strongest: fixed values.
RUNGS = ("asserted", "hypothesis", "derived", "span_cited", "fetched", "observed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as artifacts; a labelled document is keyed."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    n = F.col("doc_id")
    rung = F.element_at(F.array(*[F.lit(r) for r in RUNGS]), F.pmod(n, F.lit(7)).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc-"), n).alias("id"),
        "doc_id",
        F.when(n % 50 == 1, "operator").when(n % 50 == 2, "source").otherwise("text/markdown").alias("content_type"),
        F.when(n % 29 == 0, "archived").otherwise("live").alias("state"),
        F.col("source").alias("collection_id"),
        "lang",
        F.col("text").alias("content"),
        F.when(n % 2 == 0, F.octet_length("text").cast("long")).alias("size"),
        F.concat(F.lit("cas/"), F.sha2(F.col("text").cast("binary"), 256)).alias("content_ref"),
        F.when(F.col("n_chars") >= 20, F.concat(F.lit("lang:"), F.col("lang"))).alias("cited_from"),
        F.when(n % 7 != 0, rung).alias("provenance"),
        F.col("quality").isNotNull().alias("keyed"),
        "quality",
        "toxic",
    )


ARTIFACTS_SQL = """
    SELECT 'doc-' || d.doc_id AS id, d.doc_id,
           CASE d.doc_id % 50 WHEN 1 THEN 'operator' WHEN 2 THEN 'source' ELSE 'text/markdown' END AS content_type,
           CASE WHEN d.doc_id % 29 = 0 THEN 'archived' ELSE 'live' END AS state,
           source AS collection_id, lang, text AS content,
           CASE WHEN d.doc_id % 2 = 0 THEN strlen(text) END AS size,
           'cas/' || sha256(text) AS content_ref,
           CASE WHEN n_chars >= 20 THEN 'lang:' || lang END AS cited_from,
           CASE d.doc_id % 7 WHEN 1 THEN 'asserted' WHEN 2 THEN 'hypothesis' WHEN 3 THEN 'derived'
                WHEN 4 THEN 'span_cited' WHEN 5 THEN 'fetched' WHEN 6 THEN 'observed' END AS provenance,
           l.doc_id IS NOT NULL AS keyed, quality, toxic
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as labelled edges; weight counts the rows behind an edge."""

    def link(name: str, src: str, s, dst: str, d, label: str) -> DataFrame:
        return (
            table(spark, sf_dir, name)
            .groupBy(F.concat(F.lit(src), F.col(s)).alias("src"), F.concat(F.lit(dst), F.col(d)).alias("dst"))
            .agg(F.count(F.lit(1)).alias("weight"))
            .select("src", "dst", F.lit(label).alias("label"), "weight")
        )

    return (
        link("nation", "nation-", "n_nationkey", "region-", "n_regionkey", "part_of")
        .unionByName(link("customer", "customer-", "c_custkey", "nation-", "c_nationkey", "lives_in"))
        .unionByName(link("supplier", "supplier-", "s_suppkey", "nation-", "s_nationkey", "based_in"))
        .unionByName(link("lineitem", "supplier-", "l_suppkey", "part-", "l_partkey", "supplies"))
    )


EDGES_SQL = """
    SELECT 'nation-' || n_nationkey AS src, 'region-' || n_regionkey AS dst, 'part_of' AS label, count(*) AS weight FROM nation GROUP BY 1, 2
    UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey, 'lives_in', count(*) FROM customer GROUP BY 1, 2
    UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'based_in', count(*) FROM supplier GROUP BY 1, 2
    UNION ALL SELECT 'supplier-' || l_suppkey, 'part-' || l_partkey, 'supplies', count(*) FROM lineitem GROUP BY 1, 2"""


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, own): root > region > nation > customer, with the orders of each customer as own counts."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("own"))
    zero = F.lit(0).cast("long").alias("own")
    key = lambda name, c: F.concat(F.lit(f"{name}-"), F.col(c))
    return (
        spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), zero)
        .unionByName(table(spark, sf_dir, "region").select(key("region", "r_regionkey").alias("node"), F.lit("root").alias("parent"), zero))
        .unionByName(table(spark, sf_dir, "nation").select(key("nation", "n_nationkey").alias("node"), key("region", "n_regionkey").alias("parent"), zero))
        .unionByName(
            table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(key("customer", "c_custkey").alias("node"), key("nation", "c_nationkey").alias("parent"), F.coalesce("own", F.lit(0).cast("long")).alias("own"))
        )
    )


TAXONOMY_SQL = """
    SELECT 'root' AS node, NULL AS parent, 0 AS own
    UNION ALL SELECT 'region-' || r_regionkey, 'root', 0 FROM region
    UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey, 0 FROM nation
    UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey, coalesce(own, 0)
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS own FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


def taxonomy_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy with a second parent for every customer: its market segment, which stands under the root too."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("segment-"), "c_mktsegment").alias("segment"))
    tree = taxonomy(spark, sf_dir)
    own = tree.select(F.col("node").alias("known"), "own")
    second = c.select(F.concat(F.lit("customer-"), "c_custkey").alias("node"), F.col("segment").alias("parent")).join(own, F.col("node") == F.col("known")).select("node", "parent", "own")
    segments = c.select(F.col("segment").alias("node"), F.lit("root").alias("parent"), F.lit(0).cast("long").alias("own")).distinct()
    return tree.unionByName(second).unionByName(segments)


TAXONOMY_DAG_SQL = f"""
    SELECT * FROM ({TAXONOMY_SQL})
    UNION ALL SELECT t.node, 'segment-' || c_mktsegment, own FROM customer JOIN ({TAXONOMY_SQL}) t ON t.node = 'customer-' || c_custkey
    UNION ALL SELECT DISTINCT 'segment-' || c_mktsegment, 'root', 0 FROM customer"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(agent, concept, tick, energy): events in each user's own order; energy is the share of the value within the tick's day."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    own = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("agent"), F.col("event_type").alias("concept"), (F.row_number().over(own) - 1).cast("long").alias("tick"),
        F.abs("value").alias("energy"), "event_id",
    )


TRACES_SQL = """
    SELECT user_id AS agent, event_type AS concept, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick,
           abs(value) AS energy, event_id FROM events"""
