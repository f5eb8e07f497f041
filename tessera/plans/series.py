"""Queries of ordered series, single-field rules and the remaining joins and counts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import kind_of_path, tokens
from tessera.model import ARTIFACTS_SQL, EDGES_SQL, TRACES_SQL, artifacts, edges, table, traces
from tessera.operators import resolve, series, writers
from tessera.streaming import screens


def _daily(spark, sf):
    """Daily mean values per event type, numbered by day from 0."""
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("x"))
    return d.select("event_type", (F.row_number().over(W.partitionBy("event_type").orderBy("day")) - 1).alias("t"), "x")


_DAILY = "d AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE) - 1 AS t, avg(value) AS x FROM events GROUP BY event_type, ts::DATE)"


def a4_counters(spark, sf):
    a = artifacts(spark, sf).select("content_type", "collection_id")
    names = F.explode(F.array(F.lit("vertex"), F.concat(F.lit("ct:"), "content_type"), F.concat(F.lit("col:"), "collection_id")))
    return a.select(names.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def s24_unit_contexts(spark, sf):
    e = edges(spark, sf).filter(F.col("src").startswith("supplier-1") & F.col("label").isin("supplies", "based_in"))
    return e.groupBy("dst").agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("contexts"))


def a19_read_cloud(spark, sf):
    """Users by event type: each event adds the root of its type's information."""
    e = table(spark, sf, "events").select("user_id", "event_type")
    bits = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    bits = bits.select("event_type", F.sqrt(-F.log2(F.col("n") / F.sum("n").over(W.partitionBy()))).alias("w"))
    return e.join(F.broadcast(bits), "event_type").groupBy("user_id", "event_type").agg(F.round(F.sum("w"), 6).alias("cell"))


def f22_coverage(spark, sf):
    """How much of every benchmark item the lexicon of words in at least five documents places."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    lexicon = d.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df >= 5").select("term", F.lit(1).alias("placed"))
    t = table(spark, sf, "benchmark").select("item_id", F.explode_outer(tokens(F.col("text"))).alias("term")).join(lexicon, "term", "left")
    return t.groupBy("item_id").agg(F.count("term").alias("n_tokens"), F.round(F.when(F.count("term") > 0, F.count("placed") / F.count("term")), 6).alias("coverage"))


def g9_vertex_field(spark, sf):
    """Concepts by what screens hold of them and by their share of all events."""
    held = screens.read_screens(traces(spark, sf)).groupBy("concept").agg(F.max("present").alias("energy"))
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("concept")).agg(F.count(F.lit(1)).alias("n"))
    share = e.select("concept", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("energy"))
    return series.max_merged([held, share], "concept", "energy")


def w3_screen_leads(spark, sf):
    """The least amplitude in the signal of each agent's screen."""
    r = screens.read_screens(traces(spark, sf)).withColumn("present", F.round("present", 6))
    lead = resolve.leading(r, "agent", "present", "concept")
    return lead.groupBy("agent").agg(F.min("present").alias("lead"), F.count(F.lit(1)).alias("n"))


def w7_position_coherence(spark, sf):
    v = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("frame"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    z = series.position_coherence(v, "frame", "pos", "vec")
    return z.select("frame", "pos", F.round("z", 4).alias("z"))


def w10_lagged(spark, sf):
    x = series.lagged(_daily(spark, sf), "event_type", "t", "x", 3)
    return x.select("event_type", "t", *[F.round(c, 6).alias(c) for c in ("x", "lag_1", "lag_2", "lag_3")])


def w10_decay_profile(spark, sf):
    return series.decay_profile(_daily(spark, sf), "event_type", "t", "x", 5).select("event_type", "tau", F.round("c", 6).alias("c"))


def r4_decay_rates(spark, sf):
    return series.decay_rate(_daily(spark, sf), "event_type", "t", "x").select("event_type", "n", F.round("m", 6).alias("m"), F.round("tau", 4).alias("tau"))


def o18_horizons(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("contrast"), (F.pmod("c_custkey", F.lit(13)) / 10).alias("m"))
    return c.select("c_custkey", series.forecast_horizon(F.col("contrast"), F.col("m")).cast("long").alias("horizon"))


def o2_readable(spark, sf):
    v = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 7).alias("frame"), F.col("embedding").alias("vec"))
    return series.readable(v, "frame", "vec")


def c5_address_kinds(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    address = F.when(F.col("doc_id") % 4 == 0, F.col("h")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("op.host."), "doc_id")).when(F.col("doc_id") % 4 == 2, F.lit("op.measure")).otherwise(F.substring("h", 1, 63))
    return d.select("doc_id", series.address_kind(address).alias("kind"))


def f24_coerced_answers(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.element_at(F.array(F.lit("integer"), F.lit("boolean"), F.lit("text")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("kind"))
    answer = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_partkey") % 3)).otherwise(F.col("p_name"))
    return p.select("p_partkey", "kind", series.coerced(answer, F.col("kind")).alias("value"))


def k1_minted(spark, sf):
    return writers.minted(artifacts(spark, sf).select("id", "cited_from", "provenance")).select("id", "state", "cited_from", "provenance")


def k2_absent_edges(spark, sf):
    """Supply edges that are not stored, where those of suppliers with a positive balance are."""
    e = edges(spark, sf).filter("label = 'supplies'").select("src", "dst", "label")
    solvent = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("src"))
    return writers.absent_edges(e, e.join(solvent, "src", "left_semi"))


def k14_memory_ids(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    key = F.concat_ws("|", F.concat(F.lit("user-"), "conv_id"), "text")
    return c.select("conv_id", "turn", F.concat(F.lit("mem-"), F.substring(F.sha2(key.cast("binary"), 256), 1, 20)).alias("id"))


def k9_index_coverage(spark, sf):
    """Live artifacts that have tokens, against all live ones."""
    a = artifacts(spark, sf).filter("state = 'live'").select(F.size(tokens(F.col("content"))).alias("n"))
    return a.agg(F.sum((F.col("n") > 0).cast("long")).alias("indexed"), F.count(F.lit(1)).alias("vertices"), F.sum((F.col("n") == 0).cast("long")).alias("missing"))


def j7_pivots_missing(spark, sf):
    """Customers without a supplier in their nation, counted per nation."""
    s = table(spark, sf, "supplier").filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("pivot"))
    c = table(spark, sf, "customer").join(s, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pivot").isNull().cast("long")).alias("no_pivot"))


def j13_unreadable(spark, sf):
    """Cited customers without a grant (here: an order of 1997 or later)."""
    granted = table(spark, sf, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1997-01-01'").select("o_custkey")
    return table(spark, sf, "customer").select("c_custkey").join(granted, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def s22_kinds(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("a/"), F.when(F.col("page_id") % 3 == 0, "test_x.py").when(F.col("page_id") % 3 == 1, "x.MD").otherwise("x.bin")).alias("path"))
    return p.select("page_id", kind_of_path(F.col("path")).alias("kind"))


_QUERIES = (
    a4_counters, s24_unit_contexts, a19_read_cloud, f22_coverage, g9_vertex_field, w3_screen_leads, w7_position_coherence, w10_lagged, w10_decay_profile,
    r4_decay_rates, o18_horizons, o2_readable, c5_address_kinds, f24_coerced_answers, k1_minted, k2_absent_edges, k14_memory_ids, k9_index_coverage,
    j7_pivots_missing, j13_unreadable, s22_kinds,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    a = f"({ARTIFACTS_SQL})"
    curve = "[" + ", ".join(str(c) for c in screens.CURVE) + "]"
    held = f"""t AS ({TRACES_SQL}), r AS (SELECT agent, concept, round(sum(amp), 6) AS present FROM (
        SELECT *, energy * coalesce(({curve}::DOUBLE[])[max(tick) OVER (PARTITION BY agent) - tick + 1], 0) AS amp FROM t) GROUP BY 1, 2)"""
    token = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
    return {
        "a4_counters": f"SELECT name, count(*) AS n FROM (SELECT 'vertex' AS name FROM {a} UNION ALL SELECT 'ct:' || content_type FROM {a} UNION ALL SELECT 'col:' || collection_id FROM {a}) GROUP BY 1",
        "s24_unit_contexts": f"SELECT dst, string_agg(src, ',' ORDER BY src) AS contexts FROM ({EDGES_SQL}) WHERE src LIKE 'supplier-1%' AND label IN ('supplies', 'based_in') GROUP BY 1",
        "a19_read_cloud": """WITH b AS (SELECT event_type, sqrt(-log2(count(*) / (SELECT count(*) FROM events))) AS w FROM events GROUP BY 1)
            SELECT user_id, event_type, round(sum(w), 6) AS cell FROM events JOIN b USING (event_type) GROUP BY 1, 2""",
        "f22_coverage": f"""WITH l AS (SELECT term FROM (SELECT DISTINCT doc_id, unnest({token.format('text')}) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 5),
            t AS (SELECT item_id, unnest({token.format('text')}) AS term FROM benchmark), c AS (SELECT item_id, count(*) AS n, count(l.term) AS p FROM t LEFT JOIN l USING (term) GROUP BY 1)
            SELECT item_id, coalesce(n, 0) AS n_tokens, round(p / n, 6) AS coverage FROM benchmark LEFT JOIN c USING (item_id)""",
        "g9_vertex_field": f"""WITH {held}, f AS (SELECT concept, max(present) AS energy FROM r GROUP BY 1 UNION ALL SELECT event_type, count(*) / (SELECT count(*) FROM events) FROM events GROUP BY 1)
            SELECT concept, round(max(energy), 3) AS energy FROM f GROUP BY 1""",
        "w7_position_coherence": """WITH v AS (SELECT vec_id // 50 AS frame, vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings),
            r AS (SELECT a.frame, a.pos, b.pos AS j, list_cosine_similarity(a.v, b.v) AS r FROM v a JOIN v b ON a.frame = b.frame AND a.pos <> b.pos),
            s AS (SELECT frame, pos, count(*) AS n, avg(r) AS mean, var_pop(r) AS v, avg(r) FILTER (abs(pos - j) = 1) AS own, count(*) FILTER (abs(pos - j) = 1) AS m FROM r GROUP BY 1, 2)
            SELECT frame, pos, round((own - mean) / sqrt(v / m * (n - m) / (n - 1)), 4) AS z FROM s""",
        "w10_lagged": f"""WITH {_DAILY} SELECT event_type, t, round(x, 6) AS x, round(l1, 6) AS lag_1, round(l2, 6) AS lag_2, round(l3, 6) AS lag_3 FROM (
            SELECT *, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY t)) WHERE l3 IS NOT NULL""",
        "w10_decay_profile": f"""WITH {_DAILY}, z AS (SELECT event_type, t, x - avg(x) OVER (PARTITION BY event_type) AS z FROM d),
            k AS (SELECT unnest(range(0, 6)) AS tau), v AS (SELECT event_type, sum(z * z) AS v FROM z GROUP BY 1)
            SELECT a.event_type, tau::INT AS tau, round(sum(a.z * b.z) / any_value(v), 6) AS c FROM z a CROSS JOIN k JOIN z b ON b.event_type = a.event_type AND b.t = a.t + tau JOIN v ON v.event_type = a.event_type GROUP BY 1, 2""",
        "r4_decay_rates": f"""WITH {_DAILY}, s AS (SELECT event_type, x AS a, lead(x) OVER (PARTITION BY event_type ORDER BY t) AS b FROM d), m AS (SELECT event_type, count(*) AS n, sum(a * b) / sum(a * a) AS m FROM s WHERE b IS NOT NULL GROUP BY 1)
            SELECT event_type, n, round(m, 6) AS m, round(CASE WHEN n >= 2 AND m > 0 AND m < 1 THEN -1 / ln(m) END, 4) AS tau FROM m""",
        "o18_horizons": """WITH c AS (SELECT c_custkey, c_acctbal / 1000 AS k, (c_custkey % 13) / 10 AS m FROM customer)
            SELECT c_custkey, CASE WHEN k > 1 AND m > 0 AND m < 1 THEN ceil(ln(k) / -ln(m))::BIGINT END AS horizon FROM c""",
        "o2_readable": "SELECT vec_id // 7 AS frame, count(*) AS rows, count(*) >= 4 AS readable FROM embeddings GROUP BY 1",
        "c5_address_kinds": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'content' WHEN 1 THEN 'remote operator' WHEN 2 THEN 'local operator' ELSE 'unknown' END AS kind FROM documents",
        "f24_coerced_answers": """WITH p AS (SELECT p_partkey, ['integer', 'boolean', 'text'][p_partkey % 3 + 1] AS kind, trim(CASE WHEN p_partkey % 2 = 0 THEN ' ' || (p_partkey % 3) ELSE p_name END) AS t FROM part)
            SELECT p_partkey, kind, CASE kind WHEN 'integer' THEN TRY_CAST(t AS BIGINT)::VARCHAR WHEN 'boolean' THEN CASE WHEN lower(t) IN ('yes', 'true', '1') THEN 'true' WHEN lower(t) IN ('no', 'false', '0') THEN 'false' END ELSE nullif(t, '') END AS value FROM p""",
        "k1_minted": f"SELECT id, 'live' AS state, coalesce(cited_from, 'unknown') AS cited_from, coalesce(provenance, 'asserted') AS provenance FROM {a}",
        "k2_absent_edges": f"SELECT src, dst, label FROM ({EDGES_SQL}) WHERE label = 'supplies' AND src IN (SELECT 'supplier-' || s_suppkey FROM supplier WHERE s_acctbal <= 0)",
        "k14_memory_ids": "SELECT conv_id, turn, 'mem-' || sha256('user-' || conv_id || '|' || text)[1:20] AS id FROM conversations WHERE role = 'user'",
        "k9_index_coverage": f"SELECT count(*) FILTER (n > 0) AS indexed, count(*) AS vertices, count(*) FILTER (n = 0) AS missing FROM (SELECT len({token.format('content')}) AS n FROM {a} WHERE state = 'live')",
        "j7_pivots_missing": "SELECT c_nationkey, count(*) AS n, count(*) FILTER (s_nationkey IS NULL) AS no_pivot FROM customer LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 0) ON s_nationkey = c_nationkey GROUP BY 1",
        "j13_unreadable": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')",
        "s22_kinds": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'document' ELSE 'other' END AS kind FROM pages",
        "w3_screen_leads": f"""WITH {held},
            o AS (SELECT agent, present AS x, row_number() OVER (PARTITION BY agent ORDER BY present DESC, concept) AS k, count(*) OVER (PARTITION BY agent) AS n FROM r),
            s AS (SELECT *, sum(x) OVER (PARTITION BY agent ORDER BY k) AS s, sum(x) OVER (PARTITION BY agent) AS t, sum(x * x) OVER (PARTITION BY agent) AS q FROM o),
            e AS (SELECT agent, k, n, CASE WHEN q - t * t / n > 1e-12 * q THEN k * (n - k) / n * (s / k - (t - s) / (n - k)) ** 2 / (q - t * t / n) END AS e FROM s WHERE k < n),
            b AS (SELECT agent, max(e) AS e, arg_max(k, e) AS k, any_value(n) AS n FROM e GROUP BY 1),
            c AS (SELECT agent, CASE WHEN n >= 3 AND round(e, 12) > round((SELECT max(j * (b.n - j) / b.n * (b.n / 2) ** 2 / (b.n * (b.n * b.n - 1) / 12)) FROM (SELECT unnest(range(1, 60)) AS j) WHERE j < b.n), 12) THEN k ELSE n END AS k FROM b)
            SELECT o.agent, min(x) AS lead, count(*) AS n FROM o LEFT JOIN c USING (agent) WHERE o.k <= coalesce(c.k, o.n) GROUP BY 1""",
    }
