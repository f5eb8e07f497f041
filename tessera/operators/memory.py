"""What an agent's memory says of a question: traces by lead, distance and witness, and the rules of a measured decay curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.resolve import leading
from tessera.streaming.screens import CURVE, amplitude


def held(traces: DataFrame, own: Column | None = None, curve: tuple[float, ...] = CURVE) -> DataFrame:
    """(agent, concept, amp, n, foreign): amplitudes summed per concept at the agent's latest tick. Traces of other witnesses move the clock, but are counted instead of summed."""
    own = F.lit(True) if own is None else own
    now = F.max("tick").over(W.partitionBy("agent"))
    aged = traces.withColumn("amp", F.when(own, amplitude(F.col("energy"), now - F.col("tick"), curve))).withColumn("own", own)
    return aged.groupBy("agent", "concept").agg(
        F.coalesce(F.sum("amp"), F.lit(0.0)).alias("amp"), F.sum(F.col("own").cast("long")).alias("n"), F.sum((~F.col("own")).cast("long")).alias("foreign")
    )


def read_by_lead(screens: DataFrame, queries: DataFrame, distance: DataFrame) -> DataFrame:
    """(agent, query, present, past): what every screen holds of a concept, each of its concepts counting exp(-distance), those at or over the screen's lead as present.

    screens as ``held`` gives them; queries (query); distance (a, b, d), a pair
    without one does not count. Amplitudes are summed per concept before they
    meet the queries.
    """
    live = screens.filter("amp > 0").withColumn("amp", F.round("amp", 9))
    lead = leading(live.select("agent", "concept", "amp"), "agent", "amp", "concept").groupBy("agent").agg(F.min("amp").alias("lead"))
    near = distance.join(queries.select(F.col("query").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("query"), F.col("b").alias("concept"), F.exp(-F.greatest("d", F.lit(0.0))).alias("s"))
    met = live.join(lead, "agent").join(near, "concept").withColumn("now", F.col("amp") >= F.col("lead"))
    part = lambda c: F.sum(F.when(c, F.col("amp") * F.col("s")).otherwise(0.0))
    return met.groupBy("agent", "query").agg(part(F.col("now")).alias("present"), part(~F.col("now")).alias("past"))


def observed(ranked: DataFrame, group: str) -> DataFrame:
    """(group, concept, share): what a turn leaves in memory, the saliences as shares of 1; predicted rows and those without salience are left out."""
    some = ranked.filter(~F.coalesce("predicted", F.lit(False)) & (F.col("salience") > 0))
    return some.select(group, "concept", (F.col("salience") / F.sum("salience").over(W.partitionBy(group))).alias("share"))


def curve_at(curve: Column, dt: Column) -> Column:
    """A decay curve at a lag: its value there, the first for a lag under 0, nothing beyond its end; null for no curve."""
    return F.when(curve.isNotNull(), F.coalesce(F.get(curve, F.greatest(dt, F.lit(0)).cast("int")), F.lit(0.0)))


def measured_curve(curve: Column, margin: Column) -> Column:
    """A curve counts as measured only with its margin and a first value over 0; divided by that."""
    return F.when(margin.isNotNull() & (F.get(curve, F.lit(0)) > 0), F.transform(curve, lambda c: c / F.get(curve, F.lit(0))))


def capacity(envelope: Column, cost: Column) -> Column:
    """Traces that fit an envelope of bytes; null for no bound."""
    return F.when(envelope.isNotNull() & (cost > 0), F.floor(envelope / cost).cast("long"))


def refit(n: Column, evicted: Column, last_n: Column, last_evicted: Column) -> Column:
    """Whether rates are to be measured anew: only when traces came or went."""
    return ~(n.eqNullSafe(last_n) & evicted.eqNullSafe(last_evicted))


def coordinate_id(version: Column, corpus: Column, generation: Column, k: Column, width: Column) -> Column:
    """The token that readings must share to be comparable; a missing zoom is the whole width, an incomplete token null."""
    return F.when(version.isNotNull() & corpus.isNotNull() & generation.isNotNull(), F.concat_ws("/", version, corpus, generation, F.coalesce(k, width)))


def band(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A band of modes with both ends, 2 at least and in order; else none."""
    ok = (lo >= 2) & (hi >= lo)
    return F.when(ok, lo), F.when(ok, hi)


def zoomed(k: Column, lo: Column, hi: Column) -> Column:
    """Modes to read with: a stated number within 1 and the band's end, the whole band for none."""
    return F.when(hi.isNotNull(), F.coalesce(F.greatest(F.lit(1), F.least(k, hi)), hi))


def accepted_read(stored: DataFrame, basis: str, size: int) -> DataFrame:
    """(name, value): persisted scalars (name, value, basis, n), null where they are of another basis or of a corpus of another size."""
    return stored.select("name", F.when((F.col("basis") == basis) & (F.col("n") == size), F.col("value")).alias("value"))


def pooled(vectors: DataFrame, width: int, key: str, vec: str) -> DataFrame:
    """vectors with reason: null for those that a pooled state takes, else why not: malformed (null elements or none), width."""
    bad = F.col(vec).isNull() | F.coalesce(F.exists(vec, lambda x: x.isNull() | F.isnan(x)), F.lit(True))
    return vectors.withColumn("reason", F.when(bad, "malformed").when(F.size(vec) != width, "width"))
