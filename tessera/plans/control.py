"""Queries of the rules of a working node: orders are tasks, collections and customers are nodes, conversations are signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.model import EDGES_SQL, RUNGS, edges, table
from tessera.operators import control as C
from tessera.operators import writers
from tessera.plans.metrics import _TASKS, _tasks


def j12_claims(spark, sf):
    workers = table(spark, sf, "nation").select(F.concat(F.lit("w-"), "n_nationkey").alias("worker"))
    return C.claims(_tasks(spark, sf), workers)


def c14_transitions(spark, sf):
    """Every task after a verb of some caller."""
    t = _tasks(spark, sf).withColumn("owner", F.when(F.col("status") == "claimed", F.concat(F.lit("w-"), F.col("id") % 3)))
    verb = F.element_at(F.array(*[F.lit(v) for v in ("claim", "renew", "release", "complete")]), (F.col("id") % 4 + 1).cast("int"))
    return t.select("id", C.transition(F.col("status"), verb, F.col("owner"), F.concat(F.lit("w-"), F.col("id") % 2)).alias("status"))


def c15_outcomes(spark, sf):
    said = F.element_at(F.array(*[F.lit(x) for x in ('{"error": "x"}', '{"error": "x", "operator": "op.a"}', "no json", '{"n": 1}')]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", C.outcome(said).alias("outcome"))


def r12_fleet(spark, sf):
    """Workers for every collection: a tenth of its documents, five at most; unmeasured for small ones."""
    n = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", C.fleet(F.when(F.col("n") > 30, F.col("n")), F.lit(10), F.lit(5)).alias("fleet"))


def r14_curriculum(spark, sf):
    """Regions as stages, their customers as rows."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("have"))
    r = table(spark, sf, "region").join(c, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    left = F.when(F.col("r_regionkey") != 2, F.col("r_regionkey") - 4)
    stages = r.select(F.col("r_regionkey").alias("nth"), F.col("r_name").alias("stage"), "have", F.lit(10**9).alias("target"), (F.col("r_regionkey") == 0).alias("exhausted"), left.alias("shards_left"))
    return C.curriculum(stages)


def x4_stages(spark, sf):
    return spark.createDataFrame([(i, *s) for i, s in enumerate(C.STAGES)], "nth int, stage string, source string, target long")


def r15_scheduled(spark, sf):
    """Collections as shards, event types as recurring operators."""
    d, e = table(spark, sf, "documents"), table(spark, sf, "events")
    shards = d.select(F.col("source").alias("shard"), F.lit("ingest").alias("operator")).distinct()
    done = d.filter("lang = 'de'").groupBy(F.col("source").alias("shard")).agg(F.count(F.lit(1)).alias("n")).filter("n > 8").select("shard")
    now = e.agg(F.max("ts")).first()[0]
    recurring = e.groupBy(F.concat(F.lit("op."), "event_type").alias("operator")).agg(F.max("ts").alias("last")).withColumn("every_s", F.length("operator") * 200)
    queued = spark.createDataFrame([("ingest:src3",), ("op.none",)], "key string")
    return C.scheduled(shards, done, recurring, queued, F.lit(now))


def c25_due(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5 - 1).alias("every"), "c_acctbal")
    return c.select("c_custkey", C.due(F.col("c_custkey"), F.col("every")).alias("due"), F.round(C.sync_pause(F.col("c_acctbal") / 1000), 6).alias("pause_s"))


def r16_population(spark, sf):
    """Customers as processes, some unmeasured, with a tenth to all of the headroom."""
    k = F.col("c_custkey")
    energy = F.when(k % 17 != 0, F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", C.bred(energy, F.lit(1500.0), k % 4, k % 3, (k % 10) / 10, 0.5).alias("decision"))


def c16_inherited(spark, sf):
    k = F.col("p_partkey")
    child = F.concat_ws(" ", "p_name", "p_size")
    stated = F.when(k % 5 == 0, "x").otherwise(F.sha2(child.cast("binary"), 256))
    p = table(spark, sf, "part")
    return p.select("p_partkey", C.inherited(child, stated, F.when(k % 7 == 0, child).otherwise(F.col("p_brand")), F.when(k % 11 != 0, F.lit("a"))).alias("verdict"))


def r17_drained_fully(spark, sf):
    s = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.sum(F.when(F.col("lang") == "es", 1)).cast("long").alias("backlog"))
    return s.select("source", "backlog", C.drained(F.col("n") < 60, F.col("first") % 2 == 0, F.when(F.col("n") % 3 != 0, F.col("backlog"))).alias("done"))


def c8_gates(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", C.gate(F.col("o_orderkey") % 5000, F.col("o_orderstatus") == "O").alias("open"))


def c9_health(spark, sf):
    n = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    gate = F.when(F.col("n") % 3 != 0, F.col("n") % 2 == 0)
    reasons = C.health(gate, F.col("n") % 4, F.col("n") % 5 - 3, F.lit(0))
    return n.select("source", F.array_join(reasons, ", ").alias("reasons"))


def u5_new_rows(spark, sf):
    """A rewrite of the labels with toxic cleared: rows that are new, and rows that are only applied again."""
    old = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return C.newest_first(old.withColumn("toxic", F.lit(0).cast("int")), old, ["doc_id", "quality", "toxic"])


def c2_verified(spark, sf):
    c = table(spark, sf, "conversations")
    expected = F.sha2(F.concat_ws("|", F.lit("key"), "conv_id", "turn").cast("binary"), 256)
    n = F.col("conv_id") + F.col("turn")
    signed = F.when(n % 5 != 0, F.when(n % 7 == 0, "x").otherwise(expected))
    verdict = C.verified(F.when(n % 11 == 0, "y").otherwise(F.lit("z")), F.lit("z"), signed, F.when(F.col("turn") % 6 != 5, "key"), expected)
    return c.select("conv_id", "turn", verdict.alias("verdict"))


def c1_standing(spark, sf):
    claimed = F.element_at(F.array(F.lit("observed"), F.lit("rumour"), F.lit(None), F.lit("derived")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", C.standing(claimed, RUNGS).alias("rung"))


def c3_routed(spark, sf):
    c = table(spark, sf, "conversations")
    about = F.when(F.length("text") > 200, F.concat(F.lit("topic-"), F.col("conv_id") % 10))
    s = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("turn") % 7 == 6, "unsigned").otherwise("ok").alias("verdict"), (F.col("turn") % 4 != 3).alias("authorised"), (F.col("role") == "system").alias("authenticated"), about.alias("about"))
    return C.routed(s)


def c17_offered(spark, sf):
    """Languages as capabilities of collections: many documents true, few false, almost none unknown; French is declared off for some."""
    n = table(spark, sf, "documents").groupBy(F.col("source").alias("host"), F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    probed = n.select("host", "name", F.when(F.col("n") > 6, True).when(F.col("n") > 3, False).alias("present"))
    declared = table(spark, sf, "documents").filter("source LIKE '%1'").select(F.col("source").alias("host"), F.lit("fr").alias("name"), F.lit(False).alias("present")).distinct()
    return C.offered(probed, declared).select("host", *[F.array_join(c, ",").alias(c) for c in ("offers", "unknown", "absent")])


def k16_remote_operators(spark, sf):
    """Suppliers as hosts, the types of what they supply as operators."""
    made = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.collect_set("p_type").alias("operators"))
    hosts = table(spark, sf, "supplier").join(made, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_name").alias("host"), "operators")
    return C.remote_operators(hosts)


def c22_console(spark, sf):
    e = edges(spark, sf).filter("label = 'supplies'").select(F.col("src").alias("host"), F.col("dst").alias("operator"))
    hosts = table(spark, sf, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("host")).unionByName(spark.createDataFrame([("a-host",)], "host string"))
    return C.console(hosts, e, most_operators=5).select("host", "n", F.array_join("operators", ",").alias("operators"))


def c22_safe_paths(spark, sf):
    path = F.element_at(F.array(*[F.lit(x) for x in ("a/b.html", "../x", "/etc/x", "a/../b", "a..b/c")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", C.safe_path(path).alias("safe"))


def x10_intents(spark, sf):
    said = F.element_at(F.array(*[F.lit(x) for x in ("please REINDEX now", "what is the status", "statuses", "measure, then ingest", "hello")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", C.intent(said).alias("operator"))


def c23_last_lines(spark, sf):
    """The last error of every user."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "props")
    return C.last_lines(e, "user_id", "event_id", "props", F.col("event_type") == "error")


def c20_processes(spark, sf):
    """Customers answer two questions; one way round comes back to where it began."""
    routes = spark.createDataFrame([("a", "1", "b"), ("a", None, "c"), ("b", "x", "a"), ("b", None, "d"), ("c", None, "d")], "step string, answer string, to string")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("case"))
    first = c.select("case", F.lit("a").alias("step"), (F.col("case") % 3).cast("string").alias("answer"))
    second = c.select("case", F.lit("b").alias("step"), F.when(F.col("case") % 2 == 0, "x").otherwise("y").alias("answer"))
    return C.processes_run(routes, first.unionByName(second), "a")


def c11_changed_definitions(spark, sf):
    """Part definitions of which some sizes changed and some brands went: only those are written."""
    old = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    k = F.col("p_partkey")
    new = old.select("p_partkey", F.when(k % 10 != 0, F.col("p_brand")).alias("p_brand"), F.when(k % 9 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), F.lit("now").alias("_at"))
    return writers.changed(old, new, "p_partkey").select("p_partkey", "p_brand", "p_size")


def c10_served_counts(spark, sf):
    """Hourly counts of every user's events as readings, asked for at the hour of the last event: those of the last day are fresh."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("name"), F.date_trunc("hour", "ts").alias("at"))
    readings = e.groupBy("name", "at").agg(F.count(F.lit(1)).alias("n"))
    now = e.agg(F.max("at").alias("now")).first()["now"]
    names = e.select("name").unionByName(spark.createDataFrame([("never",)], "name string"))
    asked = lambda keep: C.served_counts(names, readings, F.lit(now), 86400, keep)
    both = asked(True).join(asked(False).select(F.col("name").alias("of"), F.col("n").alias("fresh_n")), F.col("name") == F.col("of"))
    return both.select("name", "n", "fresh_n", F.col("age").cast("long").alias("age"), "fresh")


_QUERIES = (
    j12_claims, c14_transitions, c15_outcomes, r12_fleet, r14_curriculum, x4_stages, r15_scheduled, c25_due, r16_population, c16_inherited, r17_drained_fully, c8_gates,
    c9_health, u5_new_rows, c2_verified, c1_standing, c3_routed, c17_offered, k16_remote_operators, c22_console, c22_safe_paths, x10_intents, c23_last_lines, c20_processes,
    c11_changed_definitions, c10_served_counts,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    slug = lambda x: f"left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 64)"
    return {
        "j12_claims": f"""WITH w AS (SELECT 'w-' || n_nationkey AS worker FROM nation), o AS (SELECT id FROM {_TASKS} WHERE status = 'pending' AND attempts < 5 ORDER BY priority, since, id LIMIT 24),
            q AS (SELECT worker, id, md5(worker || '|' || id) AS h FROM w, o), f AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY h, id) AS k FROM q)
            SELECT worker, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h, worker) AS j FROM f WHERE k = 1) WHERE j = 1""",
        "c14_transitions": f"""WITH t AS (SELECT id, status, CASE WHEN status = 'claimed' THEN id % 3 END = id % 2 AS mine, id % 4 AS verb FROM {_TASKS})
            SELECT id, CASE WHEN verb = 0 AND status = 'pending' THEN 'claimed' WHEN verb = 1 AND mine THEN 'claimed' WHEN verb = 2 AND mine THEN 'pending' WHEN verb = 3 AND mine THEN 'done' ELSE status END AS status FROM t""",
        "c15_outcomes": "SELECT o_orderkey, ['failed', 'done', 'unreadable', 'done'][o_orderkey % 4 + 1] AS outcome FROM orders",
        "r12_fleet": "SELECT source, CASE WHEN count(*) > 30 THEN least(5, ceil(count(*) / 10))::BIGINT END AS fleet FROM documents GROUP BY 1",
        "r14_curriculum": "SELECT r_regionkey AS nth, r_name AS stage, CASE r_regionkey WHEN 0 THEN 'promoted' WHEN 4 THEN 'promoted' WHEN 1 THEN 'current' ELSE 'waiting' END AS state FROM region",
        "x4_stages": "SELECT * FROM (VALUES (0, 'lexicon', 'lmf', 100000::BIGINT), (1, 'pivots', 'concept_lines', 100000), (2, 'assertions', 'assertions', 1000000), (3, 'encyclopedia', 'dump', 200000), (4, 'web', 'shards', NULL)) v(nth, stage, source, target)",
        "r15_scheduled": """WITH d AS (SELECT source FROM documents WHERE lang = 'de' GROUP BY 1 HAVING count(*) > 8), e AS (SELECT 'op.' || event_type AS operator, max(ts) AS last FROM events GROUP BY 1),
            k AS (SELECT DISTINCT 'ingest:' || source AS key, 'ingest' AS operator FROM documents WHERE source NOT IN (SELECT source FROM d)
                  UNION ALL SELECT operator, operator FROM e WHERE epoch((SELECT max(ts) FROM events)) - epoch(last) >= length(operator) * 200)
            SELECT key, operator FROM k WHERE key <> 'ingest:src3'""",
        "c25_due": "SELECT c_custkey, CASE WHEN c_nationkey % 5 - 1 > 0 THEN c_custkey % (c_nationkey % 5 - 1) = 0 ELSE false END AS due, round(greatest(c_acctbal / 1000, 1), 6) AS pause_s FROM customer",
        "r16_population": """SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_acctbal < 750 THEN 'die' WHEN c_acctbal >= 3000 AND c_custkey % 4 > 0 AND c_custkey % 3 >= 1 AND c_custkey % 10 >= 2.5 THEN 'breed' ELSE 'sustain' END AS decision FROM customer""",
        "c16_inherited": "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'unattributed' WHEN p_partkey % 5 = 0 THEN 'hash mismatch' WHEN p_partkey % 7 = 0 THEN 'identical' ELSE 'accepted' END AS verdict FROM part",
        "r17_drained_fully": """SELECT source, nullif(count(*) FILTER (lang = 'es'), 0) AS backlog, count(*) < 60 AND min(doc_id) % 2 = 0 AND (count(*) % 3 = 0 OR count(*) FILTER (lang = 'es') = 0) AS done FROM documents GROUP BY 1""",
        "c8_gates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5000 < 2700 THEN o_orderstatus = 'O' END AS open FROM orders",
        "c9_health": """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
            SELECT source, concat_ws(', ', CASE WHEN n % 3 = 0 THEN 'gate unknown' WHEN n % 2 = 1 THEN 'gate closed' END, CASE WHEN n % 4 > 0 THEN 'provenance incomplete' END, CASE WHEN n % 5 > 3 THEN 'anomalies' END) AS reasons FROM n""",
        "u5_new_rows": "SELECT CASE WHEN toxic = 0 THEN 'reapplied' ELSE 'new' END AS kind, count(*) AS n FROM labels GROUP BY 1",
        "c2_verified": """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'unsigned' WHEN turn % 6 = 5 THEN 'no key' WHEN (conv_id + turn) % 7 = 0 THEN 'bad signature' WHEN (conv_id + turn) % 11 = 0 THEN 'id mismatch' ELSE 'ok' END AS verdict FROM conversations""",
        "c1_standing": "SELECT doc_id, ['observed', 'hypothesis', 'hypothesis', 'derived'][doc_id % 4 + 1] AS rung FROM documents",
        "c3_routed": """WITH s AS (SELECT conv_id || '-' || turn AS id, role, CASE WHEN turn % 7 = 6 THEN 'unsigned' WHEN turn % 4 = 3 THEN 'unauthorised' ELSE 'delivered' END AS verdict, CASE WHEN length(text) > 200 THEN 'topic-' || conv_id % 10 END AS about FROM conversations),
            b AS (SELECT *, count(*) FILTER (verdict = 'delivered') OVER (PARTITION BY about) AS beside FROM s)
            SELECT id, verdict, CASE WHEN role = 'system' THEN 'SYSTEM' ELSE 'CLIENT' END AS channel, CASE WHEN verdict = 'delivered' THEN CASE WHEN about IS NOT NULL THEN 'EVENT' ELSE 'MESSAGE' END END AS regime,
                   CASE WHEN verdict = 'delivered' AND about IS NOT NULL THEN beside - 1 END AS stands_beside FROM b""",
        "c17_offered": """WITH p AS (SELECT source AS host, lang AS name, count(*) AS n FROM documents GROUP BY 1, 2), o AS (SELECT DISTINCT source AS host, 'fr' AS name FROM documents WHERE source LIKE '%1'),
            v AS (SELECT coalesce(p.host, o.host) AS host, coalesce(p.name, o.name) AS name, CASE WHEN o.host IS NOT NULL THEN false WHEN n > 6 THEN true WHEN n > 3 THEN false END AS v FROM p FULL JOIN o ON p.host = o.host AND p.name = o.name)
            SELECT host, coalesce(string_agg(name, ',' ORDER BY name) FILTER (v), '') AS offers, coalesce(string_agg(name, ',' ORDER BY name) FILTER (v IS NULL), '') AS unknown, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT v), '') AS absent FROM v GROUP BY 1""",
        "k16_remote_operators": f"SELECT DISTINCT 'op.host.' || {slug('s_name')} || '.' || {slug('p_type')} AS id, s_name AS host, 'inert' AS state FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey",
        "c22_console": f"""WITH h AS (SELECT host FROM (SELECT 'supplier-' || s_suppkey AS host FROM supplier UNION ALL SELECT 'a-host') ORDER BY host LIMIT 50),
            o AS (SELECT src AS host, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM ({EDGES_SQL}) WHERE label = 'supplies')
            SELECT h.host, count(dst) AS n, coalesce(string_agg(dst, ',' ORDER BY dst) FILTER (k <= 5), '') AS operators FROM h LEFT JOIN o ON o.host = h.host GROUP BY 1""",
        "c22_safe_paths": "SELECT page_id, page_id % 5 IN (0, 4) AS safe FROM pages",
        "x10_intents": "SELECT doc_id, ['op.reindex', 'op.status', NULL, 'op.ingest', NULL][doc_id % 5 + 1] AS operator FROM documents",
        "c23_last_lines": "SELECT user_id, arg_max(props, event_id) AS line FROM events WHERE event_type = 'error' GROUP BY 1",
        "c20_processes": """SELECT c_custkey AS "case", CASE WHEN c_custkey % 3 <> 1 THEN 'a>c>d' WHEN c_custkey % 2 = 0 THEN 'a>b' ELSE 'a>b>d' END AS path, CASE WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'cycle' ELSE 'end' END AS ended FROM customer""",
        "c10_served_counts": """WITH r AS (SELECT user_id::VARCHAR AS name, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT max(h) AS now FROM r),
            l AS (SELECT name, arg_max(n, h) AS n, date_diff('second', max(h), any_value(now)) AS age FROM r, m GROUP BY 1)
            SELECT name, n, CASE WHEN age <= 86400 THEN n END AS fresh_n, age, age <= 86400 AS fresh FROM l UNION ALL SELECT 'never', NULL, NULL, NULL, NULL""",
        "c11_changed_definitions": """SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 9 = 0""",
    }
