"""Steps that kept whole tables in the driver or whole frames in a task, and their whole results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import consolidate
from tessera.operators import coordinates as K
from tessera.operators import frames as R


def _average_ranks(x):
    o = sorted(x)
    return [(o.index(v) + 1 + len(o) - o[::-1].index(v)) / 2 for v in x]


def test_rank_correlations_by_counts_without_a_plan_of_broadcasts(spark):
    rnd = random.Random(5)
    rows = [(float(rnd.randint(0, 30)), float(rnd.randint(0, 9)), rnd.random(), 1.0) for _ in range(400)] + [(None, 3.0, 0.5, 1.0), (2.0, None, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double, one double")
    rho = K.rank_correlations(df, "x", ["y", "z", "one"])
    got = {r.y: r.rho for r in rho.collect()}
    for i, y in ((1, "y"), (2, "z")):
        both = [r for r in rows if r[0] is not None and r[i] is not None]
        want = np.corrcoef(_average_ranks([r[0] for r in both]), _average_ranks([r[i] for r in both]))[0, 1]
        assert got[y] == pytest.approx(want, abs=1e-12)
    assert got["one"] is None and len(got) == 3
    plan = K.rank_correlation(df, "x", "y")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan") == 1 and "Broadcast" not in plan  # steps were written; nothing is read again or sent to all


def test_distances_in_several_spaces_meet_a_pair_once(spark):
    c = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 2.0), ("b", "q", 0.5), ("b", "r", 3.0)], "node string, axis string, weight double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "none"), (None, "b")], "a string, b string")
    two = K.distances_in(pairs, {"d2": (c, "axis"), "half": (c.withColumn("weight", F.col("weight") / 2), "axis")})
    got = {(r.a, r.b): (r.d2, r.half) for r in two.collect()}
    assert got == {("a", "b"): (12.25, 3.0625), ("a", "a"): (0.0, 0.0), ("a", "none"): (5.0, 1.25)}


def test_mode_readings_come_from_merged_sums(spark, monkeypatch):
    """As of whole frames, though no task has one: several modes, a null name, copies that tie at the peak, frames without a mode."""
    rnd = np.random.default_rng(7)
    waves = rnd.normal(size=(300, 2))
    mixed = np.hstack([waves[:, :1] * [1, 2, 3], waves[:, 1:] * [5, 7], rnd.normal(size=(300, 1))]) + rnd.normal(size=(300, 6)) * 0.05 + [1e4, 0, -3, 0, 0, 2]
    whole = {"two": mixed, None: np.vstack([mixed[:150, :4], mixed[:150, :4]]), "short": mixed[:3], "zero": np.zeros((9, 3)), "flat": np.hstack([np.ones((40, 1)), mixed[:40, :2]]), "narrow": mixed[:50, :1]}
    rows = [(k, i * 3, m[i].tolist()) for k, m in whole.items() for i in rnd.permutation(len(m)).tolist()]
    df = spark.createDataFrame(rows, "name string, at int, vec array<double>").repartition(5)
    monkeypatch.setattr(R, "HELD", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert R.frame_sums(df, "name", "vec").filter("name = 'two'").count() > 5
        told = R.mode_readings(df, "name", "at", "vec")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "InPandas" not in told._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.name, r.nth): r for r in told.collect()}
    want = {(k, i): r for k, m in whole.items() for i, r in enumerate(R.readings(m))}
    assert got.keys() == want.keys() and ("two", 1) in want and (None, 0) in want
    for k, r in want.items():
        assert got[k].energy == pytest.approx(r["energy"], abs=1e-9) and got[k].n_rows == len(r["rows"])
        p = (R.standardised(whole[k[0]]) @ R.principal_directions(whole[k[0]])) ** 2
        assert got[k].peak == 3 * int(np.flatnonzero(p[:, r["mode"]] > p[:, r["mode"]].max() * (1 - 1e-9))[0])
    with pytest.raises(Exception, match="finite"):
        R.mode_readings(spark.createDataFrame([("a", i, [1.0 * i, None]) for i in range(5)], "name string, at int, vec array<double>"), "name", "at", "vec")


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9])
def test_near_pairs_write_only_what_several_texts_have(spark, monkeypatch, threshold):
    rnd = random.Random(11)
    base = [[rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(40)] for _ in range(6)]
    texts = [b[:] for b in base for _ in range(6)]
    for i, t in enumerate(texts):
        for _ in range(i % 6):
            t[rnd.randrange(len(t))] = f"w{rnd.randrange(60)}"
    texts += [[f"own{i}x{k}" for k in range(30)] for i in range(5)] + [["a", "b"], []]  # share nothing, too short
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(99, None)]
    made = {}

    class Recorded(consolidate.Steps):
        def written(self, df, name):
            out = super().written(df, name)
            if "id" in out.columns:
                made[name] = {r.id for r in out.select("id").distinct().collect()}
            return out

    monkeypatch.setattr(consolidate, "Steps", Recorded)
    monkeypatch.setattr(consolidate, "PREFIX_BLOCK", 3)
    got = {(r.a, r.b): r.jaccard for r in consolidate.shingle_jaccard(spark.createDataFrame(rows, "id int, t string"), "id", T.tokens(F.col("t")), 3, threshold).collect()}
    sets = {i: {tuple(t[k : k + 3]) for k in range(len(t) - 2)} for i, t in enumerate(texts)}
    every = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b]}
    want = {p: j for p, j in every.items() if j >= threshold}
    assert got == pytest.approx(want) and want
    assert made and not any(ids & set(range(36, 43)) for ids in made.values())
