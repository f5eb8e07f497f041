"""Queries of memories and of the rules around a measured decay curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.model import TRACES_SQL, table, traces
from tessera.operators import graph as G
from tessera.operators import memory as M
from tessera.plans.sql import signal_ctes
from tessera.steps import written
from tessera.streaming import screens as S


def _event_tree(spark, sf):
    """Event types under words of even and odd length, under one root; their events as own counts."""
    n = table(spark, sf, "events").groupBy(F.col("event_type").alias("node")).agg(F.count(F.lit(1)).alias("own"))
    kind = F.when(F.length("node") % 2 == 0, "even").otherwise("odd")
    types = n.select("node", kind.alias("parent"), "own")
    return types.unionByName(spark.createDataFrame([("even", "root", 0), ("odd", "root", 0), ("root", None, 0)], "node string, parent string, own long"))


def _held(spark, sf):
    """Screens by agent; every tenth event was seen by another."""
    return M.held(traces(spark, sf), F.col("event_id") % 10 != 0)


def r3_read_by_lead(spark, sf):
    """What every agent's screen holds of every event type, present and past."""
    tree = written(_event_tree(spark, sf), "event-tree")
    above = G.closure(tree)
    ic = G.information_content(tree, above)
    types = tree.filter("own > 0").select("node")
    pairs = types.select(F.col("node").alias("a")).crossJoin(F.broadcast(types.select(F.col("node").alias("b"))))
    read = M.read_by_lead(_held(spark, sf), types.select(F.col("node").alias("query")), G.distances(pairs, above, ic).withColumnRenamed("jc", "d"))
    return read.select("agent", "query", F.round("present", 6).alias("present"), F.round("past", 6).alias("past"))


def n5_recall(spark, sf):
    """The same for one concept."""
    return r3_read_by_lead(spark, sf).filter("query = 'click'").select("agent", "present", "past")


def n20_foreign(spark, sf):
    return _held(spark, sf).groupBy("agent").agg(F.sum("n").alias("own"), F.sum("foreign").alias("foreign"))


def n4_observed(spark, sf):
    """What a user's turn of all events leaves; views were predicted."""
    e = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("concept")).agg((F.sum("value") - 100).alias("salience"))
    return M.observed(e.withColumn("predicted", F.col("concept") == "view"), "user_id").select("user_id", "concept", F.round("share", 6).alias("share"))


def r1_ticks(spark, sf):
    """A conversation's turns as ticks: all words of a turn on one, their shares adding up to one."""
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("concept")).filter("concept <> ''")
    n = w.groupBy("conv_id", "turn", "concept").agg(F.count(F.lit(1)).alias("salience")).withColumn("predicted", F.lit(False)).withColumn("at", F.concat_ws("/", "conv_id", "turn"))
    o = M.observed(n, "at")
    return o.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("share"), 6).alias("total"), F.round(F.max("share"), 6).alias("most"))


def t5k_evicted_counts(spark, sf):
    """How many traces fall out of screens of three."""
    t = traces(spark, sf)
    kept = S.evict(t, 3).groupBy("agent").agg(F.count(F.lit(1)).alias("kept"))
    return t.groupBy("agent").agg(F.count(F.lit(1)).alias("n")).join(kept, "agent").select("agent", "kept", (F.col("n") - F.col("kept")).alias("evicted"))


def a18_drop_reasons(spark, sf):
    """Vectors that a pooled state takes or leaves out, and why: some are too short, some have a hole, some are none."""
    v, k = F.col("embedding"), F.col("vec_id")
    hole = F.transform(v, lambda x, i: F.when(i != 3, x))
    bad = F.when(k % 23 == 0, None).when(k % 19 == 0, hole).when(k % 17 == 0, F.slice(v, 1, 63)).otherwise(v)
    p = M.pooled(table(spark, sf, "embeddings").select("label", bad.alias("vec")), 64, "label", "vec")
    return p.groupBy("label", F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _c(spark, sf):
    return table(spark, sf, "customer")


_K = F.col  # short in the expressions below


def n15_capacity(spark, sf):
    k = _K("c_custkey")
    return _c(spark, sf).select("c_custkey", M.capacity(F.when(k % 7 != 0, _K("c_acctbal")), _K("c_nationkey")).alias("capacity"))


def n16_curve_at(spark, sf):
    k = _K("c_custkey")
    curve = F.when(k % 11 != 0, F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25), F.lit(0.1)))
    return _c(spark, sf).select("c_custkey", M.curve_at(curve, k % 9 - 2).alias("value"))


def n17_measured_curve(spark, sf):
    k = _K("c_custkey")
    curve = M.measured_curve(F.array(_K("c_acctbal") / 1000, F.lit(0.5), F.lit(0.25)), F.when(k % 5 != 0, F.lit(0.1)))
    return _c(spark, sf).select("c_custkey", F.round(F.get(curve, F.lit(1)), 6).alias("second"), F.get(curve, F.lit(0)).alias("first"))


def n19_refit(spark, sf):
    k = _K("c_custkey")
    return _c(spark, sf).select("c_custkey", M.refit(k % 4, k % 3, F.when(k % 13 != 0, k % 4), F.when(k % 5 == 0, F.lit(1)).otherwise(k % 3)).alias("refit"))


def n21_tokens(spark, sf):
    k = _K("c_custkey")
    token = M.coordinate_id(F.lit("v1"), F.when(k % 7 != 0, _K("c_mktsegment")), _K("c_nationkey").cast("string"), F.when(k % 2 == 0, (k % 5).cast("string")), F.lit("64"))
    return _c(spark, sf).select("c_custkey", token.alias("token"))


def n11_bands(spark, sf):
    """Bands of modes, and what a stated zoom makes of them."""
    k = _K("c_custkey")
    lo, hi = M.band(k % 5, k % 7)
    return _c(spark, sf).select("c_custkey", lo.alias("lo"), hi.alias("hi"), M.zoomed(F.when(k % 3 != 0, k % 11 - 2), lo, hi).alias("k"))


def n8_accepted_reads(spark, sf):
    k = _K("r_regionkey")
    stored = table(spark, sf, "region").select(_K("r_name").alias("name"), (k / 2).alias("value"), F.when(k % 2 == 0, "a").otherwise("b").alias("basis"), F.when(k == 4, 6).otherwise(5).alias("n"))
    return M.accepted_read(stored, "a", 5)


_QUERIES = (
    r3_read_by_lead, n5_recall, n20_foreign, n4_observed, r1_ticks, t5k_evicted_counts, a18_drop_reasons, n15_capacity, n16_curve_at, n17_measured_curve, n19_refit, n21_tokens,
    n11_bands, n8_accepted_reads,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    curve = "[" + ", ".join(str(c) for c in S.CURVE) + "]"
    held = f"""t AS ({TRACES_SQL}), aged AS (SELECT *, max(tick) OVER (PARTITION BY agent) - tick AS age FROM t),
        held AS (SELECT agent, concept, round(coalesce(sum(CASE WHEN event_id % 10 <> 0 THEN energy * coalesce(({curve}::DOUBLE[])[age + 1], 0) END), 0), 9) AS amp, count(*) FILTER (event_id % 10 <> 0) AS n, count(*) FILTER (event_id % 10 = 0) AS foreign_ FROM aged GROUP BY 1, 2)"""
    read = f"""WITH {held}, live AS (SELECT agent, concept, amp FROM held WHERE amp > 0), {signal_ctes('live', 'agent', 'amp', 'concept')},
        lead_ AS (SELECT r.key AS agent, min(x) AS lead FROM rows r JOIN cut USING (key) WHERE r.nth <= k GROUP BY 1),
        own AS (SELECT event_type AS node, length(event_type) % 2 AS g, count(*) + 1 AS c FROM events GROUP BY 1, 2), grp AS (SELECT g, sum(c) + 1 AS c FROM own GROUP BY 1),
        total AS (SELECT sum(c) + 1 + (2 - count(*)) AS c FROM grp),
        jc AS (SELECT a.node AS q, b.node AS concept, ln(total.c / a.c) + ln(total.c / b.c) - 2 * CASE WHEN a.node = b.node THEN ln(total.c / a.c) WHEN a.g = b.g THEN ln(total.c / grp.c) ELSE 0 END AS d FROM own a, own b, total, grp WHERE grp.g = a.g)
        SELECT live.agent, q AS query, round(sum(CASE WHEN amp >= lead THEN amp * exp(-greatest(d, 0)) ELSE 0 END), 6) AS present, round(sum(CASE WHEN amp < lead THEN amp * exp(-greatest(d, 0)) ELSE 0 END), 6) AS past
        FROM live JOIN lead_ USING (agent) JOIN jc USING (concept) GROUP BY 1, 2"""
    return {
        "r3_read_by_lead": read,
        "n5_recall": f"SELECT agent, present, past FROM ({read}) WHERE query = 'click'",
        "n20_foreign": f"WITH {held} SELECT agent, sum(n)::BIGINT AS own, sum(foreign_)::BIGINT AS \"foreign\" FROM held GROUP BY 1",
        "n4_observed": """WITH s AS (SELECT user_id, event_type AS concept, sum(value) - 100 AS s FROM events WHERE event_type <> 'view' GROUP BY 1, 2 HAVING sum(value) > 100)
            SELECT user_id, concept, round(s / sum(s) OVER (PARTITION BY user_id), 6) AS share FROM s""",
        "r1_ticks": """WITH w AS (SELECT conv_id || '/' || turn AS at_, unnest(string_split(text, ' ')) AS w FROM conversations), n AS (SELECT at_, w, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2)
            SELECT at_ AS "at", count(*) AS n, 1.0::DOUBLE AS total, round(max(n) / sum(n), 6) AS most FROM n GROUP BY 1""",
        "t5k_evicted_counts": f"SELECT agent, least(count(*), 3) AS kept, greatest(count(*) - 3, 0) AS evicted FROM ({TRACES_SQL}) GROUP BY 1",
        "a18_drop_reasons": "SELECT label, CASE WHEN vec_id % 23 = 0 OR vec_id % 19 = 0 THEN 'malformed' WHEN vec_id % 17 = 0 THEN 'width' ELSE 'taken' END AS reason, count(*) AS n FROM embeddings GROUP BY 1, 2",
        "n15_capacity": "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_nationkey > 0 THEN floor(c_acctbal / c_nationkey)::BIGINT END AS capacity FROM customer",
        "n16_curve_at": "SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN coalesce(([1.0, 0.5, 0.25, 0.1]::DOUBLE[])[greatest(c_custkey % 9 - 2, 0) + 1], 0) END AS value FROM customer",
        "n17_measured_curve": "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_acctbal > 0 THEN round(0.5 / (c_acctbal / 1000), 6) END AS second, CASE WHEN c_custkey % 5 <> 0 AND c_acctbal > 0 THEN 1.0::DOUBLE END AS first FROM customer",
        "n19_refit": "SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 4 END IS DISTINCT FROM c_custkey % 4 OR CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE c_custkey % 3 END IS DISTINCT FROM c_custkey % 3 AS refit FROM customer",
        "n21_tokens": "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN 'v1/' || c_mktsegment || '/' || c_nationkey || '/' || CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 5)::VARCHAR ELSE '64' END END AS token FROM customer",
        "n11_bands": """WITH b AS (SELECT c_custkey, c_custkey % 5 AS lo, c_custkey % 7 AS hi, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 11 - 2 END AS z FROM customer)
            SELECT c_custkey, CASE WHEN lo >= 2 AND hi >= lo THEN lo END AS lo, CASE WHEN lo >= 2 AND hi >= lo THEN hi END AS hi, CASE WHEN lo >= 2 AND hi >= lo THEN CASE WHEN z IS NULL THEN hi ELSE greatest(1, least(z, hi)) END END AS k FROM b""",
        "n8_accepted_reads": "SELECT r_name AS name, CASE WHEN r_regionkey IN (0, 2) THEN r_regionkey / 2 END AS value FROM region",
    }
