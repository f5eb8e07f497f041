"""Ordered series and frames: lags, decay, coherence of a position, readability; and rules on single fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.resolve import dot, unit


def lagged(df: DataFrame, key: str, order: str, x: str, lags: int) -> DataFrame:
    """df with x's lagged copies lag_1 ... lag_n; rows without all of them fall out."""
    w = W.partitionBy(key).orderBy(order)
    out = df.withColumns({f"lag_{k}": F.lag(x, k).over(w) for k in range(1, lags + 1)})
    return out.filter(F.col(f"lag_{lags}").isNotNull())


def decay_profile(df: DataFrame, key: str, order: str, x: str, lags: int) -> DataFrame:
    """(key, tau, c): autocorrelation of each series for tau = 0 .. lags, against its own mean; null without variance. order is 0, 1, 2, ..."""
    w = W.partitionBy(key)
    z = df.select(key, order, (F.col(x) - F.avg(x).over(w)).alias("z"))
    var = z.groupBy(key).agg(F.sum(F.col("z") * F.col("z")).alias("var"))
    taus = z.withColumn("tau", F.explode(F.sequence(F.lit(0), F.lit(lags)))).select(key, "tau", (F.col(order) + F.col("tau")).alias("at"), F.col("z").alias("first"))
    later = z.select(key, F.col(order).alias("at"), F.col("z").alias("second"))
    c = taus.join(later, [key, "at"]).groupBy(key, "tau").agg(F.sum(F.col("first") * F.col("second")).alias("s"))
    return c.join(var, key).select(key, "tau", F.when(F.col("var") > 0, F.col("s") / F.col("var")).alias("c"))


def decay_rate(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """(key, n, m, tau): one-mode fit x[t+1] = m x[t]; tau = -1 / ln m, refused (null) for under two steps or m outside (0, 1)."""
    w = W.partitionBy(key).orderBy(order)
    s = df.select(key, F.col(x).alias("a"), F.lead(x).over(w).alias("b")).filter("b IS NOT NULL")
    m = F.sum(F.col("a") * F.col("b")) / F.nullif(F.sum(F.col("a") * F.col("a")), F.lit(0.0))
    got = s.groupBy(key).agg(F.count(F.lit(1)).alias("n"), m.alias("m"))
    ok = (F.col("n") >= 2) & (F.col("m") > 0) & (F.col("m") < 1)
    return got.withColumn("tau", F.when(ok, -1 / F.log("m")))


def forecast_horizon(contrast: Column, m: Column) -> Column:
    """Steps until a contrast is gone at rate m: ceil(ln contrast / -ln m); refused for contrast up to 1 or m outside (0, 1)."""
    return F.when((contrast > 1) & (m > 0) & (m < 1), F.ceil(F.log(contrast) / -F.log(m)))


def position_coherence(frames: DataFrame, key: str, order: str, vec: str, lag: int = 1) -> DataFrame:
    """(key, order, z): a row's mean cosine with its neighbours at the lag, against the exact moments of as many rows drawn at random from the others."""
    v = frames.select(key, order, unit(F.col(vec)).alias("v"))
    a, b = v.select(key, F.col(order).alias("i"), F.col("v").alias("x")), v.select(key, F.col(order).alias("j"), F.col("v").alias("y"))
    r = a.join(b, key).filter("i <> j").select(key, "i", "j", dot(F.col("x"), F.col("y")).alias("r"))
    near = F.abs(F.col("i") - F.col("j")) == lag
    s = r.groupBy(key, "i").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.var_pop("r").alias("var"), F.avg(F.when(near, F.col("r"))).alias("own"), F.sum(near.cast("int")).alias("m")
    )
    spread = F.col("var") / F.col("m") * (F.col("n") - F.col("m")) / (F.col("n") - 1)
    return s.select(key, F.col("i").alias(order), F.when((F.col("n") >= 3) & (spread > 1e-15), (F.col("own") - F.col("mean")) / F.sqrt(spread)).alias("z"))


def readable(frames: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, rows, readable): four rows, two features, and something that is not zero."""
    some = F.max(F.exists(vec, lambda x: x != 0).cast("int")) == 1
    return frames.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), ((F.count(F.lit(1)) >= 4) & (F.min(F.size(vec)) >= 2) & some).alias("readable"))


def address_kind(address: Column) -> Column:
    """What an address names: a content hash, a local or a remote operator, an observer, or nothing known."""
    return (
        F.when(address.rlike("^[0-9a-f]{64}$"), "content").when(address.startswith("op.host."), "remote operator").when(address.startswith("op."), "local operator")
        .when(address.startswith("agent-"), "observer").otherwise("unknown")
    )


def coerced(answer: Column, kind: Column) -> Column:
    """An answer as its stated kind, written canonically; null if it is none."""
    text = F.trim(answer)
    truth = F.when(F.lower(text).isin("yes", "true", "1"), "true").when(F.lower(text).isin("no", "false", "0"), "false")
    return (
        F.when(kind == "integer", text.try_cast("long").cast("string")).when(kind == "number", text.try_cast("double").cast("string")).when(kind == "boolean", truth)
        .when(kind == "date", text.try_cast("date").cast("string")).otherwise(F.nullif(text, F.lit("")))
    )


def max_merged(fields: list[DataFrame], concept: str, energy: str, digits: int = 3) -> DataFrame:
    """Several fields as one: of each concept the greatest energy, rounded."""
    out = fields[0].select(concept, energy)
    for f in fields[1:]:
        out = out.unionByName(f.select(concept, energy))
    return out.groupBy(concept).agg(F.round(F.max(energy), digits).alias(energy))
