"""Queries of scans, projections, writers' rules and corpus metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.model import ARTIFACTS_SQL, artifacts, table
from tessera.operators import control, maintenance, writers
from tessera.operators import metrics as M


def s1_list_artifacts(spark, sf):
    """Live artifacts of two collections."""
    a = artifacts(spark, sf)
    return a.filter((F.col("state") == "live") & F.col("collection_id").isin("src1", "src2")).select("id", "content_type", "collection_id", "provenance")


def s2_point_get(spark, sf):
    return artifacts(spark, sf).filter(F.col("doc_id") == 7).select("id", "content_ref", "state", "keyed")


def s3_missing_fields(spark, sf):
    return M.null_counts(artifacts(spark, sf), ["cited_from", "provenance", "size", "quality"])


def s7_declared_source(spark, sf):
    """A declared source: text of at least 120 characters, titled by its first line."""
    title = F.substring(F.split("text", "\n")[0], 1, 200)
    return table(spark, sf, "documents").filter(F.length(F.trim("text")) >= 120).select(F.concat(F.lit("src-"), "doc_id").alias("id"), title.alias("title"), F.length("text").cast("long").alias("n"))


def p1_projected(spark, sf):
    """The four indexed fields, each with its fallbacks."""
    a = artifacts(spark, sf)
    title = F.substring(F.split("content", "\n")[0], 1, 200)
    description = F.coalesce(F.nullif(F.trim("cited_from"), F.lit("")), F.col("provenance"), F.lit(""))
    return a.select("id", title.alias("title"), description.alias("description"), F.coalesce(F.when(F.col("keyed"), F.col("lang")), F.lit("")).alias("tags"), F.md5("content").alias("content_md5"))


def p5_public(spark, sf):
    return artifacts(spark, sf).filter((F.col("state") != "archived") & (F.coalesce("toxic", F.lit(0)) == 0)).select("id")


def p6_bytes(spark, sf):
    return artifacts(spark, sf).select("id", T.utf8_bytes(F.col("size"), F.col("content")).alias("bytes"))


def p9_shard_range(spark, sf):
    """Shards 3 to 7 of the collections in order."""
    shards = table(spark, sf, "documents").select("source").distinct()
    nth = F.row_number().over(W.orderBy("source")) - 1
    return shards.withColumn("nth", nth).filter(F.col("nth").between(3, 7))


def a1_all_metrics(spark, sf):
    a = artifacts(spark, sf)
    return M.all_metrics(a, M.consolidated(a))


def a2_collection_metrics(spark, sf):
    a = artifacts(spark, sf)
    return M.collection_metrics(a, M.consolidated(a), "src3")


def a3_type_counts_and_fitness(spark, sf):
    return M.types_and_fitness(artifacts(spark, sf)).select("content_type", "n", F.round("fitness", 6).alias("fitness"))


def a5_counts_all_states(spark, sf):
    return M.counts_by(artifacts(spark, sf), "collection_id", F.col("state") == "live")


def a6_audit_provenance(spark, sf):
    return M.audit_provenance(artifacts(spark, sf))


def a7_backfill_provenance(spark, sf):
    return M.backfill_provenance(artifacts(spark, sf))


def a20_self_information(spark, sf):
    return M.self_information(table(spark, sf, "events").select("event_type"), "event_type").select("event_type", "n", F.round("bits", 6).alias("bits"))


def a20_joint_entropies(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.pmod("user_id", F.lit(7)).alias("u"))
    j = M.joint_entropies(e, "event_type", "u")
    return j.select(*[F.round(c, 6).alias(c) for c in j.columns])


def _tasks(spark, sf):
    """Orders as tasks: status, priority, attempts, claim and finish times."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "claimed").otherwise("done")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("priority"), F.pmod("o_orderkey", F.lit(6)).cast("int").alias("attempts"), F.col("o_orderdate").alias("since"))


_TASKS = """(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'claimed' ELSE 'done' END AS status,
    o_orderpriority AS priority, (o_orderkey % 6)::INT AS attempts, o_orderdate AS since FROM orders)"""


def a21_queue_stats(spark, sf):
    return M.queue_stats(_tasks(spark, sf))


def a21_recent_terminal(spark, sf):
    return M.recent_terminal(_tasks(spark, sf), 20).select("id", "since")


def t6k_pending_window(spark, sf):
    return M.pending_window(_tasks(spark, sf)).select("id", "priority")


def r11_leases(spark, sf):
    """What becomes of every claimed task at a given time: kept, given back with a growing pause, or dead after five attempts."""
    t = _tasks(spark, sf).filter("status = 'claimed'")
    age = F.unix_seconds(F.lit("1998-08-02 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp"))
    verdict, pause = control.lease(F.col("status"), age, F.col("attempts"))
    return t.select("id", verdict.alias("verdict"), pause.alias("backoff_s"))


def _snapshots(spark, sf):
    """Daily counts per event type as snapshots of nodes."""
    e = table(spark, sf, "events").select("event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"), "value")
    day = e.groupBy(F.col("event_type").alias("node"), "ts").agg(F.count(F.lit(1)).alias("day_n"), M.count_if(F.col("value") > 50).alias("dark"), M.count_if(F.col("value") < 20).alias("cleared"))
    total = F.sum("day_n").over(W.partitionBy("node").orderBy("ts"))
    return day.select("node", "ts", total.alias("n"), "dark", "cleared")


_SNAP = """snap AS (
    SELECT event_type AS node, date_trunc('day', ts) AS ts, count(*) AS day_n, count(*) FILTER (value > 50) AS dark, count(*) FILTER (value < 20) AS cleared
    FROM events GROUP BY 1, 2),
    s AS (SELECT node, ts, (sum(day_n) OVER (PARTITION BY node ORDER BY ts))::BIGINT AS n, dark, cleared FROM snap)"""


def a22_flow(spark, sf):
    f = M.flow(_snapshots(spark, sf))
    return f.select("node", F.col("ts").cast("timestamp_ntz").alias("ts"), "minted", F.round("validation_ratio", 6).alias("validation_ratio"))


def a23_rates(spark, sf):
    r = M.rate_per_minute(_snapshots(spark, sf), 86400.0)
    return r.select("node", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("rate", 9).alias("rate"))


def a24_ewma(spark, sf):
    """Smoothed daily gains of every node, of days on which it moved by over 3."""
    s = _snapshots(spark, sf)
    gain = s.withColumn("gain", F.col("n") - F.lag("n").over(W.partitionBy("node").orderBy("ts"))).filter("gain > 3")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "gain"))), lambda x: x["gain"].cast("double"))
    return gain.groupBy("node").agg(ordered.alias("g")).select("node", F.round(M.ewma(F.col("g")), 6).alias("rate"))


def a25_consistency(spark, sf):
    """A snapshot of the labelled documents, recorded before the others came, against all of them now."""
    a = artifacts(spark, sf)

    def state(rows):
        one = M.all_metrics(rows, M.consolidated(rows)).filter("collection_id IS NOT NULL")
        content = rows.filter(~F.col("content_type").isin(*M.MACHINERY)).groupBy("collection_id").agg(F.count(F.lit(1)).alias("content"))
        return one.join(content, "collection_id", "left").withColumn("keyed", F.col("content") - F.col("dark_matter"))

    return M.consistency(state(a.filter("keyed")), state(a))


def a26_progress(spark, sf):
    """Progress of every collection towards a target of 60: min(1, have / target), done or not."""
    n = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("have"))
    return n.select("source", "have", control.progress(F.col("have"), F.lit(60)).alias("progress"), (F.col("have") >= 60).alias("done"))


def a27_envelope(spark, sf):
    """Free and evictable amounts against a floor: shortfall and eviction."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("free"))
    shortfall, eviction = control.envelope(F.col("free"), F.lit(2000.0), F.lit(1500.0))
    return c.select("c_custkey", F.round(shortfall, 6).alias("shortfall"), F.round(eviction, 6).alias("eviction"))


def k3_changed_rows(spark, sf):
    """A rewrite of the labels with toxic cleared: only rows that really change are written."""
    old = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return writers.changed(old, old.withColumn("toxic", F.lit(0).cast("int")), "doc_id")


def k4_sealed(spark, sf):
    """Bodies by address, each once, with its size; rows keep the address."""
    rows, bodies = writers.sealed(artifacts(spark, sf).select("id", "content"))
    refs = rows.groupBy("content_ref").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("refs"))
    return bodies.select("content_ref").join(refs, "content_ref")


def k5_shards_left(spark, sf):
    """Collections not yet marked as done."""
    done = table(spark, sf, "documents").filter("lang = 'de'").groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n > 8").select("source")
    return writers.left_to_do(table(spark, sf, "documents"), done, "source")


def m4_blobs_missing(spark, sf):
    """Addresses that artifacts need and labelled documents do not hold, by blob shard (first byte of the hash modulo 16)."""
    a = artifacts(spark, sf)
    return maintenance.blobs_missing(a, a.filter("keyed"))


def r16_breeding(spark, sf):
    """Every customer as a process: dies below its cost, breeds with twice its cost and mass, else goes on."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", control.bred(F.col("c_acctbal"), F.lit(1500.0), k % 4, k % 3, F.lit(1.0)).alias("decision"))


def r17_drained(spark, sf):
    """Done only if all are exhausted, the backfill is done and the backlog is 0 or unmeasured."""
    s = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("lang") == "es", 1)).alias("backlog"))
    done = control.drained(F.col("n") < 60, F.lit(True), F.col("backlog"))
    return s.select("source", F.col("backlog").cast("long").alias("backlog"), done.alias("done"))


def c17_capabilities(spark, sf):
    """Three-valued capabilities: offers are the true ones, unknown the null ones."""
    a = artifacts(spark, sf).withColumn("present", F.when(F.col("quality").isNotNull(), F.col("quality") == 1))
    return a.groupBy("collection_id").agg(M.count_if(F.col("present")).alias("offers"), M.count_if(F.col("present").isNull()).alias("unknown"), M.count_if(~F.col("present")).alias("absent"))


def c18_slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("op.host."), control.slug(F.col("p_name"))).alias("operator_id"))


_QUERIES = (
    s1_list_artifacts, s2_point_get, s3_missing_fields, s7_declared_source, p1_projected, p5_public, p6_bytes, p9_shard_range, a1_all_metrics,
    a2_collection_metrics, a3_type_counts_and_fitness, a5_counts_all_states, a6_audit_provenance, a7_backfill_provenance, a20_self_information,
    a20_joint_entropies, a21_queue_stats, a21_recent_terminal, t6k_pending_window, r11_leases, a22_flow, a23_rates, a24_ewma, a25_consistency,
    a26_progress, a27_envelope, k3_changed_rows, k4_sealed, k5_shards_left, m4_blobs_missing, r16_breeding, r17_drained, c17_capabilities, c18_slugs,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


_BYTES = "CASE WHEN size > 0 THEN size ELSE coalesce(strlen(content), 0) END"
_METRICS = f"""
    WITH a AS ({ARTIFACTS_SQL}),
    m AS (SELECT id FROM (SELECT id, min(id) OVER (PARTITION BY content_ref) AS src FROM a) WHERE id <> src),
    r AS (SELECT a.*, {_BYTES} AS bytes, m.id IS NOT NULL AS merged, content_type NOT IN ('operator', 'source') AS content_row FROM a LEFT JOIN m USING (id))
    SELECT collection_id, count(*) AS artifacts, sum(bytes)::BIGINT AS bytes, coalesce(sum(bytes) FILTER (NOT merged), 0)::BIGINT AS generator_bytes,
           count(*) FILTER (merged) AS consolidated, count(*) FILTER (content_row AND NOT keyed) AS dark_matter,
           round(count(*) FILTER (content_row AND keyed) / nullif(count(*) FILTER (content_row), 0), 4) AS keyed_coverage,
           round(coalesce(sum(bytes) FILTER (NOT merged), 0) / nullif(sum(bytes), 0), 4) AS rho,
           count(*) FILTER (cited_from IS NULL) AS missing_cited_from, count(*) FILTER (provenance IS NULL) AS missing_provenance,
           count(*) FILTER (cited_from IS NULL OR provenance IS NULL) = 0 AS invariant
    FROM r"""


def oracle_sql():
    a = f"({ARTIFACTS_SQL})"
    return {
        "s1_list_artifacts": f"SELECT id, content_type, collection_id, provenance FROM {a} WHERE state = 'live' AND collection_id IN ('src1', 'src2')",
        "s2_point_get": f"SELECT id, content_ref, state, keyed FROM {a} WHERE id = 'doc-7'",
        "s3_missing_fields": f"SELECT count(*) - count(cited_from) AS no_cited_from, count(*) - count(provenance) AS no_provenance, count(*) - count(size) AS no_size, count(*) - count(quality) AS no_quality FROM {a}",
        "s7_declared_source": "SELECT 'src-' || doc_id AS id, left(string_split(text, chr(10))[1], 200) AS title, length(text) AS n FROM documents WHERE length(trim(text)) >= 120",
        "p1_projected": f"SELECT id, left(string_split(content, chr(10))[1], 200) AS title, coalesce(nullif(trim(cited_from), ''), provenance, '') AS description, CASE WHEN keyed THEN lang ELSE '' END AS tags, md5(content) AS content_md5 FROM {a}",
        "p5_public": f"SELECT id FROM {a} WHERE state <> 'archived' AND coalesce(toxic, 0) = 0",
        "p6_bytes": "SELECT 'doc-' || doc_id AS id, strlen(text) AS bytes FROM documents",
        "p9_shard_range": "SELECT source, nth FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS nth FROM (SELECT DISTINCT source FROM documents)) WHERE nth BETWEEN 3 AND 7",
        "a1_all_metrics": f"{_METRICS} GROUP BY ROLLUP (collection_id)",
        "a2_collection_metrics": f"{_METRICS.replace('FROM a LEFT JOIN m USING (id))', chr(32) + 'FROM a LEFT JOIN m2 USING (id) WHERE collection_id = ' + chr(39) + 'src3' + chr(39) + ')').replace('r AS (SELECT a.*', 'm2 AS (SELECT id FROM (SELECT id, min(id) OVER (PARTITION BY content_ref) AS src FROM a) WHERE id <> src), r AS (SELECT a.*').replace('m.id IS', 'm2.id IS')} GROUP BY collection_id",
        "a3_type_counts_and_fitness": f"SELECT content_type, count(*) AS n, round(avg(quality), 6) AS fitness FROM {a} GROUP BY content_type",
        "a5_counts_all_states": f"SELECT collection_id, count(*) AS n, count(*) FILTER (state = 'live') AS live FROM {a} GROUP BY 1",
        "a6_audit_provenance": f"""
            SELECT content_type, count(*) AS violators, count(*) FILTER (cited_from IS NULL) AS no_citation, count(*) FILTER (provenance IS NULL) AS no_rung,
                   string_agg(id, ',' ORDER BY id) FILTER (nth <= 20) AS samples
            FROM (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY id) AS nth FROM {a} WHERE cited_from IS NULL OR provenance IS NULL) GROUP BY 1""",
        "a7_backfill_provenance": f"""
            SELECT id, coalesce(cited_from, CASE WHEN content_type IN ('operator', 'source') THEN 'genesis' ELSE 'unknown' END) AS cited_from,
                   coalesce(provenance, CASE WHEN content_type IN ('operator', 'source') THEN 'observed' ELSE 'asserted' END) AS provenance,
                   cited_from IS NULL OR provenance IS NULL AS changed FROM {a}""",
        "a20_self_information": "SELECT event_type, n, round(-log2(n / sum(n) OVER ()), 6) AS bits FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)",
        "a20_joint_entropies": """
            WITH p AS (SELECT event_type AS x, user_id % 7 AS y, count(*) AS n FROM events GROUP BY 1, 2),
            t AS (SELECT sum(n) AS t FROM p),
            h AS (SELECT (SELECT -sum(n / t * log2(n / t)) FROM (SELECT sum(n) AS n FROM p GROUP BY x), t) AS hx, (SELECT -sum(n / t * log2(n / t)) FROM (SELECT sum(n) AS n FROM p GROUP BY y), t) AS hy,
                         (SELECT -sum(n / t * log2(n / t)) FROM p, t) AS hxy)
            SELECT round(hx, 6) AS h_x, round(hy, 6) AS h_y, round(hxy, 6) AS h_xy, round(hx + hy - hxy, 6) AS mutual, round(hxy - hy, 6) AS h_x_given_y, round(hxy - hx, 6) AS h_y_given_x FROM h""",
        "a21_queue_stats": f"SELECT status, count(*) AS n, max(since) AS last FROM {_TASKS} GROUP BY 1",
        "a21_recent_terminal": f"SELECT id, since FROM {_TASKS} WHERE status = 'done' ORDER BY since DESC, id LIMIT 20",
        "t6k_pending_window": f"SELECT id, priority FROM {_TASKS} WHERE status = 'pending' AND attempts < 5 ORDER BY priority, since, id LIMIT 24",
        "r11_leases": f"""
            SELECT id, verdict, CASE WHEN verdict = 'retry' THEN least(300, 15 * attempts) END AS backoff_s FROM (
            SELECT *, CASE WHEN TIMESTAMP '1998-08-02 00:00:00' - since <= INTERVAL 120 SECOND THEN 'kept' WHEN attempts >= 5 THEN 'dead' ELSE 'retry' END AS verdict FROM {_TASKS} WHERE status = 'claimed')""",
        "a22_flow": f"""WITH {_SNAP}, m AS (SELECT node, ts, cleared, greatest(0, dark - lag(dark) OVER (PARTITION BY node ORDER BY ts, dark) + cleared) AS m, lag(dark) OVER (PARTITION BY node ORDER BY ts, dark) AS d FROM s)
            SELECT node, ts, CASE WHEN d IS NULL THEN 0 ELSE m END AS minted, round(CASE WHEN d IS NOT NULL AND m > 0 THEN cleared / m END, 6) AS validation_ratio FROM m""",
        "a23_rates": f"""WITH {_SNAP} SELECT node, ts, round(CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) BETWEEN 21600 AND 345600 THEN (n - lag(n) OVER w) / (epoch(ts) - epoch(lag(ts) OVER w)) * 60 END, 9) AS rate
            FROM s WINDOW w AS (PARTITION BY node ORDER BY ts)""",
        "a24_ewma": f"""WITH {_SNAP}, g AS (SELECT node, ts, n - lag(n) OVER (PARTITION BY node ORDER BY ts) AS gain FROM s),
            l AS (SELECT node, list(gain::DOUBLE ORDER BY ts) AS g FROM g WHERE gain > 3 GROUP BY node)
            SELECT node, round(list_reduce(g, lambda x, y: x * 0.7 + y * 0.3), 6) AS rate FROM l""",
        "a25_consistency": f"""WITH a AS ({ARTIFACTS_SQL}), b AS (SELECT *, {_BYTES} AS bytes, content_type NOT IN ('operator', 'source') AS c FROM a),
            s AS (SELECT side, count(*) AS artifacts, count(*) FILTER (x) AS consolidated, sum(bytes) AS bytes, sum(bytes) FILTER (NOT x) AS generator_bytes, count(*) FILTER (c AND keyed) AS keyed, count(*) FILTER (c) AS content FROM (
                SELECT 'r' AS side, *, id <> min(id) OVER (PARTITION BY content_ref) AS x FROM b WHERE keyed UNION ALL SELECT 'm', *, id <> min(id) OVER (PARTITION BY content_ref) FROM b) GROUP BY 1)
            SELECT unnest(['artifacts_never_shrink', 'merged_never_unmerge', 'merged_within_all', 'generators_within_bytes', 'ratio_never_rises', 'keyed_within_content', 'coverage_never_falls']) AS "check",
                   unnest([m.artifacts >= r.artifacts, m.consolidated >= r.consolidated, m.consolidated <= m.artifacts, m.generator_bytes <= m.bytes, m.generator_bytes / m.bytes <= r.generator_bytes / r.bytes, m.keyed <= m.content, m.keyed / m.content >= r.keyed / r.content]) AS holds
            FROM s m, s r WHERE m.side = 'm' AND r.side = 'r'""",
        "a26_progress": "SELECT source, count(*) AS have, least(1.0, count(*) / 60) AS progress, count(*) >= 60 AS done FROM documents GROUP BY 1",
        "a27_envelope": "SELECT c_custkey, round(greatest(0.0, 2000.0 - c_acctbal), 6) AS shortfall, round(least(greatest(0.0, 2000.0 - c_acctbal), 1500.0), 6) AS eviction FROM customer",
        "k3_changed_rows": "SELECT doc_id, quality, 0 AS toxic FROM labels WHERE toxic <> 0 OR toxic IS NULL",
        "k4_sealed": f"SELECT content_ref, max(strlen(content)) AS size, count(*) AS refs FROM {a} GROUP BY 1",
        "k5_shards_left": "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'de' GROUP BY source HAVING count(*) > 8)",
        "m4_blobs_missing": f"""WITH a AS ({ARTIFACTS_SQL}) SELECT (('0x' || content_ref[5:6])::INT % 16) AS shard, count(*) AS missing
            FROM (SELECT DISTINCT content_ref FROM a WHERE content_ref NOT IN (SELECT content_ref FROM a WHERE keyed)) GROUP BY 1""",
        "r16_breeding": "SELECT c_custkey, CASE WHEN c_acctbal < 1500 THEN 'die' WHEN c_acctbal >= 3000 AND c_custkey % 4 > 0 AND c_custkey % 3 >= 1 THEN 'breed' ELSE 'sustain' END AS decision FROM customer",
        "r17_drained": "SELECT source, nullif(count(*) FILTER (lang = 'es'), 0) AS backlog, count(*) < 60 AND count(*) FILTER (lang = 'es') = 0 AS done FROM documents GROUP BY 1",
        "c17_capabilities": f"SELECT collection_id, count(*) FILTER (quality = 1) AS offers, count(*) FILTER (quality IS NULL) AS unknown, count(*) FILTER (quality <> 1) AS absent FROM {a} GROUP BY 1",
        "c18_slugs": "SELECT p_partkey, 'op.host.' || left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 64) AS operator_id FROM part",
    }
