"""Queries of screens, signals and event time; each is the batch result that its streaming form reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.model import TRACES_SQL, table, traces
from tessera.operators import control
from tessera.streaming import screens as S


def t5k_evicted(spark, sf):
    return S.evict(traces(spark, sf), 3).select("agent", "concept", "tick")


def r2_amplitudes(spark, sf):
    from pyspark.sql import Window as W

    now = F.max("tick").over(W.partitionBy("agent"))
    t = traces(spark, sf)
    return t.select("event_id", "agent", "tick", F.round(S.amplitude(F.col("energy"), now - F.col("tick")), 6).alias("amplitude"))


def r3_screens(spark, sf):
    r = S.read_screens(traces(spark, sf))
    return r.select("agent", "concept", F.round("present", 6).alias("present"), "n")


def n18_tenses(spark, sf):
    """The concepts of each agent: at or over half its greatest amplitude they are, below they were."""
    from pyspark.sql import Window as W

    r = S.read_screens(traces(spark, sf)).withColumn("present", F.round("present", 6))
    lead = F.max("present").over(W.partitionBy("agent")) / 2
    return r.select("agent", "concept", S.tense(F.col("present"), lead).alias("tense"))


def r1_turn_shares(spark, sf):
    """Energies of one turn (a conversation's turn number by role) as shares that sum to 1."""
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return c.select("conv_id", "turn", F.round(F.col("n") / F.sum("n").over(W.partitionBy("conv_id")), 6).alias("share"))


def _signals(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("turn") % 3 == 0, "*").otherwise(F.concat(F.lit("agent-"), F.col("conv_id") % 5)).alias("to"),
        F.concat(F.lit("agent-"), F.col("turn") % 5).alias("from"), F.when(F.length("text") > 200, F.lit("topic")).alias("about"), (F.col("role") == "system").alias("authenticated"), "role", "turn",
    )


def r9_delivered(spark, sf):
    return S.deliver(_signals(spark, sf), "agent-1", F.col("turn") % 7 != 6, F.col("role") != "tool")


def f25_addresses(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", S.content_address("conv_id", "role", "text", "turn").alias("address"))


def r10_once_each(spark, sf):
    """Conversations by the address of their text: replays dropped."""
    c = table(spark, sf, "conversations").select("text", S.content_address("text").alias("address"))
    return S.once(c, "address").select("address")


def r13_silent(spark, sf):
    """Users whose last event lies over four intervals before the end."""
    e = table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    end = e.agg(F.max("ts").alias("end"))
    return last.crossJoin(F.broadcast(end)).select("user_id", "last", ((F.col("end") - F.col("last")) > F.expr("INTERVAL 4 DAYS")).alias("silent"))


def r13_liveness(spark, sf):
    """Users silent for over four of their intervals, an interval counting twenty seconds at most."""
    e = table(spark, sf, "events")
    end = e.agg(F.max("ts").alias("end"))
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(end)).select("user_id", control.silent(F.col("last"), F.col("end"), 300).alias("silent"))


def x_daily_windows(spark, sf):
    """Extension: tumbling days per event type."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    w = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def x_sessions(spark, sf):
    """Extension: sessions of a user, closed by 30 minutes of silence."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    s = e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


_QUERIES = (t5k_evicted, r2_amplitudes, r3_screens, n18_tenses, r1_turn_shares, r9_delivered, f25_addresses, r10_once_each, r13_silent, r13_liveness, x_daily_windows, x_sessions)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    curve = "[" + ", ".join(str(c) for c in S.CURVE) + "]"
    amp = f"""t AS ({TRACES_SQL}), a AS (SELECT *, energy * coalesce(({curve}::DOUBLE[])[max(tick) OVER (PARTITION BY agent) - tick + 1], 0) AS amp FROM t),
        r AS (SELECT agent, concept, round(sum(amp), 6) AS present, count(*) AS n FROM a GROUP BY 1, 2)"""
    return {
        "t5k_evicted": f"WITH t AS ({TRACES_SQL}) SELECT agent, concept, tick FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY tick DESC, concept) AS k FROM t) WHERE k <= 3",
        "r2_amplitudes": f"WITH {amp} SELECT event_id, agent, tick, round(amp, 6) AS amplitude FROM a",
        "r3_screens": f"WITH {amp} SELECT agent, concept, present, n FROM r",
        "n18_tenses": f"WITH {amp} SELECT agent, concept, CASE WHEN present <= 0 THEN '-' WHEN present >= max(present) OVER (PARTITION BY agent) / 2 THEN 'is' ELSE 'was' END AS tense FROM r",
        "r1_turn_shares": "SELECT conv_id, turn, round(length(text) / sum(length(text)) OVER (PARTITION BY conv_id), 6) AS share FROM conversations",
        "r9_delivered": """
            SELECT id, verdict, CASE WHEN verdict = 'delivered' THEN CASE WHEN n > 200 THEN 'EVENT' ELSE 'MESSAGE' END END AS regime, CASE WHEN role = 'system' THEN 'SYSTEM' ELSE 'CLIENT' END AS channel
            FROM (SELECT conv_id || '-' || turn AS id, role, length(text) AS n, CASE WHEN turn % 7 = 6 THEN 'unverified' ELSE 'delivered' END AS verdict FROM conversations WHERE turn % 5 <> 1 AND (turn % 3 = 0 OR conv_id % 5 = 1))""",
        "f25_addresses": """SELECT conv_id, turn, sha256('{"conv_id":' || conv_id || ',"role":' || to_json(role) || ',"text":' || to_json(text) || ',"turn":' || turn || '}') AS address FROM conversations""",
        "r10_once_each": """SELECT DISTINCT sha256('{"text":' || to_json(text) || '}') AS address FROM conversations""",
        "r13_silent": "SELECT user_id, max(ts) AS last, (SELECT max(ts) FROM events) - max(ts) > INTERVAL 4 DAYS AS silent FROM events GROUP BY 1",
        "r13_liveness": "SELECT user_id, epoch((SELECT max(ts) FROM events)) - epoch(max(ts)) > 80 AS silent FROM events GROUP BY 1",
        "x_daily_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "x_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    }
