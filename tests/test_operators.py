"""Operators against brute force, and on nulls, ties, cycles and nothing at all."""

import json
import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import context, text as T
from tessera.model import artifacts, table
from tessera.operators import activation, consolidate, control, frames, graph, index, invoke, lexical, maintenance, memory, metrics, writers
from tessera.sources import ingest, parsers
from tessera.streaming import screens


def frame(spark, rows, shape):
    return spark.createDataFrame(rows, shape)


# --- texts


def test_tokens_stand_where_they_are_said_to(spark, monkeypatch):
    monkeypatch.setattr(T, "RUN", 3)
    texts = [None, "", "...", "Àé b1, x_y  İz!", "a " * 20, " lone "]
    got = frame(spark, list(enumerate(texts)), "i int, t string").select("i", "t", T.token_spans(F.col("t")).alias("s")).collect()
    for r in got:
        assert [(r.t or "")[s.start : s.stop].lower() for s in r.s] == [s.said for s in r.s]
        assert len(r.s) == {0: 0, 1: 0, 2: 0, 3: 5, 4: 20, 5: 1}[r.i]


def brute_span(text, terms, budget):
    import re

    hits = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in set(terms)]
    best = None
    for i, (s, _, _) in enumerate(hits):
        part = [h for h in hits[i:] if h[1] <= s + budget] or [hits[i]]
        value = 1000 * len({h[2] for h in part}) + len(part)
        if best is None or value > best[0]:
            best = (value, s, part[-1][1])
    return best


def test_densest_span_takes_the_best_stretch():
    rnd = random.Random(3)
    for _ in range(300):
        text = " ".join(rnd.choice(["alpha", "beta", "gamma", "filler", "other", "x"]) for _ in range(rnd.randint(40, 120)))
        value, s, e = brute_span(text, ["alpha", "beta", "gamma"], 60)
        got = T.densest_span(text, ["alpha", "beta", "gamma"], 60)
        assert got == T.cut_at_words(text, min(max(0, (s + e) // 2 - 30), len(text) - 60), 60) and len(got) <= 60
    assert T.densest_span("short", ["x"], 60) == "short"
    assert "running" in T.densest_span("filler " * 50 + "running " + "filler " * 50, ["run"], 60, T.Stemmer())
    assert T.cut_at_words("x" * 300, 10, 50) == "…" + "x" * 48 + "…" and T.cut_at_words("one two three", 0, 9) == "one two…"


def fts5(docs, queries):
    """Scores by SQLite's own index over four fields."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, description, tags, content, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, title, description, tags, content) VALUES (?, ?, ?, ?, ?)", docs)
    out = {}
    for q, said in queries:
        match = " OR ".join(f'"{w}"' for w in said.split())
        out[q] = {r: -s for r, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    return out


def test_stemmed_search_scores_as_the_full_text_engine(spark, tmp_path):
    rnd = random.Random(4)
    words = ["running", "runs", "cat", "cats", "nation", "national", "tree", "trees", "blue", "happily", "happy", "stone"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, say(3), say(4), say(1), say(rnd.randint(1, 40))) for i in range(60)]
    docs = frame(spark, [(str(i), *r, "live", False) for i, *r in rows], "id string, title string, description string, tags string, content string, state string, sealed boolean")
    asked = [(1, "run cats"), (2, "happily blue stones"), (3, "nowhere")]
    queries = frame(spark, asked, "query_id int, text string")
    want = fts5(rows, asked)
    ix = index.FieldIndex(spark, str(tmp_path / "ix"))
    assert not ix.is_built() and ix.search(queries, 5).count() == 0
    ix.add(docs.filter("id < '3'"))
    ix.add(docs)
    for hits in (ix.search(queries, 100).collect(), index.search(docs, queries, 100).collect()):
        got = {}
        for r in hits:
            got.setdefault(r.query_id, {})[int(r.id)] = r.score
        assert set(got) == {1, 2}
        for q in got:
            assert got[q] == pytest.approx({k: round(v, 6) for k, v in want[q].items()}, abs=2e-6)
    ix.retract(docs.filter("id = '5'"))
    ix.add(docs.filter("id = '6'").withColumn("state", F.lit("archived")))
    held = {r.id for r in ix.postings().select("id").distinct().collect()}
    assert held == {str(i) for i in range(60)} - {"5", "6"}
    assert tuple(ix.coverage(docs).first()) == (58, 60, 2)
    ix.rebuild(docs.filter("id < '2'"))
    assert ix.is_built() and ix.coverage(docs).first().indexed == len([i for i in range(60) if str(i) < "2"])


def test_top_k_is_limited_before_the_shuffle(spark):
    hits = frame(spark, [("q", i, float(i % 3)) for i in range(9)], "query_id string, id int, score double")
    top = lexical.top_k(hits, 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r["rank"], r.score) for r in top.orderBy("rank").collect()] == [(2, 0, 2.0), (5, 1, 2.0)]


def test_contexts(spark):
    one = json.dumps({"description": 'a "b" \\ c'})
    raws = [one, json.dumps(one), json.dumps(json.dumps(one)), json.dumps(json.dumps(json.dumps(one))), json.dumps(json.dumps(json.dumps(json.dumps(one)))), None, "no json", '"open']
    got = [r[0] for r in frame(spark, list(enumerate(raws)), "i int, r string").orderBy("i").select(F.get_json_object(context.unwrapped(F.col("r")), "$.description")).collect()]
    assert got == ['a "b" \\ c'] * 4 + [None] * 4


# --- graphs


def test_closure_of_several_parents_and_of_cycles(spark):
    t = frame(spark, [("r", None, 0), ("a", "r", 1), ("b", "r", 1), ("c", "a", 2), ("c", "b", 2), ("d", "c", 3), ("x", "y", 1), ("y", "x", 1)], "node string, parent string, own long")
    got = {(r.node, r.ancestor): r.up for r in graph.closure(t).collect()}
    assert got == {(n, n): 0 for n in "rabcdxy"} | {("a", "r"): 1, ("b", "r"): 1, ("c", "a"): 1, ("c", "b"): 1, ("c", "r"): 2, ("d", "c"): 1, ("d", "a"): 2, ("d", "b"): 2, ("d", "r"): 3, ("x", "y"): 1, ("y", "x"): 1}
    ic = {r.node: r["cum"] for r in graph.information_content(t, graph.closure(t)).collect()}
    assert ic["r"] == 1 + 2 + 2 + 3 + 4 and ic["c"] == 7  # a descendant counts once, whatever its ways up
    assert graph.closure(t.filter("false")).count() == 0


def test_spread_takes_the_cheapest_path_and_sums_over_seeds(spark):
    rnd = random.Random(7)
    edges = {(i, j): rnd.choice([0.0, 0.2, 0.7, 1.5]) for i in range(12) for j in range(i + 1, 12) if rnd.random() < 0.35}
    costs = frame(spark, [(str(a), str(b), c) for (a, b), c in edges.items()], "node string, parent string, cost double")
    seeds = [("0", 2.0), ("1", 0.5), ("1", 0.5), ("2", 0.01)]
    xi, gap = 1.5, 0.05
    for hops in (None, 2):
        want = {}
        for s, e in (("0", 2.0), ("1", 1.0), ("2", 0.01)):
            if hops is None and e < gap:
                continue
            limit = math.inf if hops else xi * math.log(e / gap)
            best, front = {int(s): 0.0}, {int(s): 0.0}
            for _ in range(hops or 50):
                step = {}
                for (a, b), c in edges.items():
                    if a in front and front[a] + c <= limit and front[a] + c < min(best.get(b, math.inf), step.get(b, math.inf)):
                        step[b] = front[a] + c
                best |= step
                front = step
            for n, d in best.items():
                want[str(n)] = want.get(str(n), 0) + e * math.exp(-d)
        got = {r.concept: r.energy for r in graph.spread_nearest(frame(spark, seeds, "concept string, energy double"), costs, xi, gap, hops).collect()}
        assert got == pytest.approx(want)


def test_propagation_is_of_pairs_that_reach_the_gap(spark):
    t = frame(spark, [("r", None, 0), ("p", "r", 4), ("q", "r", 9), ("a", "p", 3), ("b", "p", 2), ("c", "q", 5)], "node string, parent string, own long")
    above = graph.closure(t)
    ic = graph.information_content(t, above)
    fired = frame(spark, [("a", 1.0), ("b", 2.0), ("c", 4.0), ("gone", 9.0)], "concept string, energy double")
    targets = frame(spark, [("p", 1.0), ("c", 0.5), ("none", 1.0)], "target string, weight double")
    info = {r.node: r.ic for r in ic.collect()}
    lca = {("a", "p"): "p", ("b", "p"): "p", ("c", "p"): "r", ("a", "c"): "r", ("b", "c"): "r", ("c", "c"): "c"}
    got = {r.target: (r.energy, r.nearest) for r in graph.propagate(fired, targets, above, ic, 1.0, 0.12).collect()}
    for target, weight in (("p", 1.0), ("c", 0.5)):
        ds = {x: info[x] + info[target] - 2 * info[lca[x, target]] for x in "abc"}
        kept = {x: d for x, d in ds.items() if math.exp(-d) >= 0.12}
        assert got[target] == pytest.approx((weight * sum({"a": 1, "b": 2, "c": 4}[x] * math.exp(-d) for x, d in kept.items()), min(kept.values())))
    assert got["none"] == (0.0, math.inf)


@pytest.mark.parametrize("values", [[], [1.0], [3.0, 1.0], [2.0] * 9, [float(i) for i in range(1001)], [None, 5.0, 7.0, 6.0]])
def test_exact_median(spark, values):
    got = metrics.exact_median(frame(spark, [(v,) for v in values], "x double"), "x").first()[0]
    some = [v for v in values if v is not None]
    assert got == (float(np.median(some)) if some else None)


def test_names_and_seeds(spark):
    lexicon = frame(spark, [("blue_stone", "A", 1.0), ("blue_stone", "B", 0.5), ("stone", "C", 1.0), ("berry", "D", 1.0), ("run", "E", 1.0), ("make", "F", 1.0)], "name string, concept string, prior double")
    texts = frame(spark, [(1, "Blue stone, stones and berries"), (2, "running makes blue"), (3, None), (4, "stone blue stone")], "id int, text string")
    got = {(r.id, r["at"], r.name) for r in activation.names_in(texts, lexicon).collect()}
    assert got == {(1, 0, "blue_stone"), (1, 2, "stone"), (1, 4, "berry"), (2, 1, "make"), (4, 0, "stone"), (4, 1, "blue_stone")}
    bits = frame(spark, [("stone", 3.0)], "name string, bits double")
    e = {(r.id, r.concept): r.energy for r in activation.seeds_from_text(texts, lexicon, bits).collect()}
    assert e[1, "A"] == 1.0 and e[1, "B"] == 0.5 and e[1, "C"] == 3.0 and e[4, "C"] == 3.0


# --- consolidation


def test_separation_diagrams_and_superposition(spark):
    said = {"a": "xy", "b": "xy", "c": "xyz", "d": "uv", "e": "xu"}
    f = frame(spark, [(i, x, x, 1.0) for i, s in said.items() for x in s], "id string, row string, feature string, value double")
    pairs = frame(spark, [(a, b) for a in "abcde" for b in "abcdef" if a != b], "a string, b string")
    s = consolidate.separation(f, pairs)
    rows = {(r.a, r.b): r for r in s.collect()}
    assert rows["a", "b"].one_object and rows["a", "c"].subsumed and not rows["a", "c"].one_object and rows["a", "f"].one_object is None
    assert rows["a", "e"].a_outside_b == pytest.approx(0.5) and rows["c", "a"].a_outside_b == pytest.approx(1 / 3)
    assert {(r.id, r.member) for r in consolidate.diagrams(s).collect()} == {(x, x) for x in said} | {("a", "b"), ("b", "a")}
    got = {r.a: (r.n, r.lands) for r in consolidate.superposition(s).collect()}
    assert got["d"] == (1, None)  # a single candidate separates from nothing
    assert got["a"][0] == 3
    union = {(r.a, r.b): list(r.features) for r in consolidate.feature_union(f, pairs).collect()}
    assert union["a", "e"] == ["u", "x", "y"]


@pytest.mark.parametrize("block", [256, 2])
def test_near_pairs_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(consolidate, "PREFIX_BLOCK", block)
    rnd = random.Random(5)
    template = [f"t{i}" for i in range(30)]
    texts = []
    for i in range(60):
        w = list(template) + [f"u{rnd.randrange(40)}" for _ in range(15)] if i % 2 else [rnd.choice("abcde") for _ in range(rnd.randint(3, 30))]
        texts.append(" ".join(w))
    d = frame(spark, [(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, t string")
    got = {(r.a, r.b): r.jaccard for r in consolidate.shingle_jaccard(d, "id", T.tokens(F.col("t")), 3, 0.5).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and len(a & b) / len(a | b) >= 0.5}
    assert got == pytest.approx(want) and len(want) > 10


def test_merges_are_certified_and_applied(spark):
    m = frame(spark, [("g", "x", 2.0, "observed", "live"), ("g", "y", None, "derived", "archived"), ("h", "z", None, "asserted", "live")], "grp string, id string, mass double, provenance string, state string")
    merged = consolidate.merge(m, "grp")
    assert {r.grp: r.balanced for r in consolidate.certified(m, merged, "grp").collect()} == {"g": True, "h": None}
    false = merged.withColumn("mass", F.col("mass") + 1)
    assert {r.grp: r.balanced for r in consolidate.certified(m, false, "grp").collect()}["g"] is False
    rows, links = consolidate.applied(m.select("id", "state"), m.select("grp", "id"), merged.filter("grp = 'g'"), "grp")
    assert sorted(r.state for r in rows.collect()) == ["archived", "archived", "live", "live"] and links.count() == 2


def test_positions_give_back_their_members_when_they_are_apart(spark):
    v = frame(spark, [("g", [1.0, 0.0]), ("g", [0.0, 2.0]), ("h", [1.0, 1.0]), ("h", [1.0, 0.0]), ("z", [0.0, 0.0])], "k string, v array<double>")
    assert {r.k: r.worst for r in consolidate.position_error(v, "k", "v").collect()} == {"g": 0.0, "h": 1.0, "z": None}


# --- frames


def planted(rows, width, waves, seed=1, noise=1.0):
    rnd = np.random.default_rng(seed)
    m = rnd.normal(0, noise, (rows, width))
    for k in range(waves):
        m += np.outer(rnd.normal(0, 1, rows), rnd.normal(0, 1, width)) * 1.5
    return m


def test_frames_with_known_modes():
    for waves in (0, 1, 3):
        m = planted(400, 40, waves)
        assert frames.resolvable(m) == waves and frames.principal_directions(m).shape == (40, waves)
        assert sum(p < 1e-3 for p in frames.significance(m)) == waves
        assert len(frames.beam(m)) == waves and len(frames.readings(m)) == waves
    m = planted(400, 40, 3)
    read = frames.readings(m)
    assert sorted(i for r in read for i in r["rows"]) == list(range(400)) and read[0]["energy"] >= read[-1]["energy"]
    w, k = frames.accumulated(len(m), m.sum(axis=0), m.T @ m)
    assert np.allclose(w, frames.modes(m)[0]) and k == frames.interval(m)
    assert frames.correlated_null(m) < frames.modes(m)[0][2] and abs(frames.derived_null(400, 40, 0.5) - frames.noise_edge(400, 40)) < 0.1
    assert frames.resolvable(np.zeros((9, 3))) is None and frames.resolvable(m[:3]) is None
    assert frames.read(np.zeros((2, 3)))[2:] == (None,) * 15


def test_frames_have_an_order_and_finite_elements():
    assert frames.ordered([1.0, 2.0]).shape == (1, 2)
    for bad, error in (({1, 2}, TypeError), ([[1.0, float("nan")]], ValueError), (iter([1]), TypeError)):
        with pytest.raises(error):
            frames.ordered(bad)


def test_scales_decay_and_dynamics():
    m = np.vstack([planted(300, 10, 0, 2), planted(100, 10, 2, 3)])
    found = frames.scales(m, [2, 50, 100, 400, 900])
    assert [r["k"] is None for r in found] == [True, False, False, False, True] and found[1]["transition"] is None
    k = np.diag([0.9, 0.5])
    walk = frames.rolled(k, np.array([1.0, 1.0]), 30)
    assert frames.decay_times(walk) == pytest.approx([-1 / math.log(0.9), -1 / math.log(0.5)])
    assert frames.decay_times(frames.rolled(np.diag([1.1, 0.5]), np.array([1.0, 1.0]), 9)) is None and frames.decay_times(walk[:1]) is None
    assert frames.surrogate_significance(walk) < 0.05 and frames.surrogate_significance(walk[:2]) is None
    assert frames.delay_embedded(walk, 2).shape == (29, 6) and frames.delay_embedded(walk[:2], 3).shape == (0, 8)
    assert frames.correlation_length(np.cumsum(np.random.default_rng(0).normal(0, 1, (500, 1)), axis=0)) > 5
    assert frames.correlation_length(np.ones((5, 2))) is None and frames.certificate(np.ones((5, 2))) is None


def test_bases_and_alignment():
    rnd = np.random.default_rng(4)
    basis = frames.spanned(np.array([[1.0, 1, 0], [2, 2, 0], [0, 0, 1]]))
    assert basis.shape == (3, 2) and frames.zoomed(basis, 0).shape == (3, 1) and frames.zoomed(basis, 9).shape == (3, 2) and frames.zoomed(basis, None).shape == (3, 2)
    x, turn = rnd.normal(0, 1, (80, 5)), rnd.normal(0, 1, (5, 4))
    fit = frames.Alignment(x, x @ turn)
    assert np.allclose(fit.map, turn) and fit.carries_information() is True
    assert frames.Alignment(x, rnd.normal(0, 1, (80, 4))).carries_information() is False
    assert frames.Alignment(x, x).native and frames.Alignment(x[:3], x[:3] * 2).carries_information() is None


def test_frame_records_of_frames(spark):
    m = planted(60, 6, 1)
    rows = [("one", i, r.tolist()) for i, r in enumerate(m)] + [("short", i, [1.0, 2.0]) for i in range(3)]
    got = {r.k_: r for r in frames.frame_records(frame(spark, rows, "k_ string, ord int, vec array<double>"), "k_", "ord", "vec").collect()}
    assert got["one"].k == 1 and got["short"].k is None and got["short"]["rows"] == 3
    assert got["one"].coherence == pytest.approx(frames.coherence(m)) and got["one"].focus == pytest.approx(frames.concentration(m)[1])
    v = [(i, r.tolist()) for i, r in enumerate(m)]
    near = {(r.a, r.b) for r in frames.near_pairs(frame(spark, v, "id int, vec array<double>"), 2.0).collect()}
    assert near == {(i, j) for i in range(60) for j in range(i + 1, 60) if np.linalg.norm(m[i] - m[j]) <= 2.0}


# --- node rules, memory, upkeep


def test_claims_are_exclusive(spark):
    tasks = frame(spark, [(i, "pending" if i % 2 else "done", "1", i % 7, None) for i in range(40)], "id long, status string, priority string, attempts int, since timestamp")
    workers = frame(spark, [(f"w{i}",) for i in range(9)], "worker string")
    got = control.claims(tasks, workers).collect()
    assert len({r.id for r in got}) == len(got) == len({r.worker for r in got}) and all(r.id % 2 and r.id % 7 < 5 for r in got)
    assert control.claims(tasks.filter("false"), workers).count() == 0


def test_processes_end(spark):
    routes = frame(spark, [("a", None, "b"), ("b", None, "c"), ("c", "go", "d")], "step string, answer string, to string")
    answers = frame(spark, [(1, "c", "go"), (2, "c", "stay"), (3, "x", "y")], "case int, step string, answer string")
    assert {r.case: (r.path, r.ended) for r in control.processes_run(routes, answers, "a").collect()} == {1: ("a>b>c>d", "end"), 2: ("a>b>c", "end"), 3: ("a>b>c", "end")}
    assert {r.ended for r in control.processes_run(routes, answers, "a", 1).collect()} == {"limit"}


def test_memory_rules(spark):
    one = frame(spark, [(None, None)], "x double, c array<double>")
    assert one.select(memory.capacity(F.col("x"), F.lit(2)), memory.curve_at(F.col("c"), F.lit(1)), memory.measured_curve(F.array(F.lit(0.0)), F.lit(1.0))).first() == (None, None, None)
    r = frame(spark, [("t", "a", 0.0, False), ("t", "b", 2.0, True), ("t", "c", 3.0, None), ("t", "d", 1.0, False)], "t string, concept string, salience double, predicted boolean")
    assert {x.concept: x.share for x in memory.observed(r, "t").collect()} == {"c": 0.75, "d": 0.25}


def test_sketches_estimate_similarity(spark):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    other = [w if rnd.random() > 0.1 else f"v{i}" for i, w in enumerate(base)]
    blobs = frame(spark, [("a", " ".join(base)), ("a", " ".join(base)), ("b", " ".join(other)), ("c", "too short"), ("d", None)], "ref string, body string")
    s = maintenance.sketches(blobs, frame(spark, [("z",)], "ref string")).cache()
    assert s.count() == 4 and {r.ref for r in s.filter("degenerate").collect()} == {"c", "d"} and s.filter("ref = 'c'").first().sketch is None
    pair = s.filter("ref = 'a'").select(F.col("sketch").alias("x")).crossJoin(s.filter("ref = 'b'").select(F.col("sketch").alias("y")))
    grams = [{tuple(w[i : i + 3]) for i in range(198)} for w in (base, other)]
    true = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
    assert abs(pair.select(maintenance.sketch_similarity(F.col("x"), F.col("y"))).first()[0] - true) < 0.16


def test_tables_are_published_whole(spark, tmp_path):
    path = str(tmp_path / "stats")
    for n in (1, 2):
        writers.published(spark.range(n), path)
    assert spark.read.json(path).count() == 2 and not (tmp_path / "stats.next").exists()
    writers.appended(spark.range(1), str(tmp_path / "log"))
    writers.appended(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


# --- sources


def test_folders_are_polled_for_what_changed(spark, tmp_path):
    import os

    (tmp_path / "in" / ".git").mkdir(parents=True)
    for name in ("a.md", "b.txt", ".git/c.md"):
        (tmp_path / "in" / name).write_text(name)
    none = frame(spark, [], "path string, mtime timestamp")
    first = parsers.folder_poll(spark, str(tmp_path / "in"), none).collect()
    assert {r.content for r in first} == {"a.md", "b.txt"}
    seen = frame(spark, [(r.path, r.mtime) for r in first], "path string, mtime timestamp")
    assert parsers.folder_poll(spark, str(tmp_path / "in"), seen).count() == 0
    (tmp_path / "in" / "a.md").write_text("new")
    os.utime(tmp_path / "in" / "a.md", (10**9, 10**9))
    assert [r.content for r in parsers.folder_poll(spark, str(tmp_path / "in"), seen).collect()] == ["new"]


def test_dumps_projects_and_snapshots(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>Stone</title><revision><text>'''Stone''' is [[rock|hard matter]] that is found nearly everywhere.</text></revision></page><page><title>Talk:Stone</title><revision><text>no</text></revision></page><page><title>Rock</title><revision><text>#redirect [[Stone]]</text></revision></page></mediawiki>")
    got = parsers.articles(parsers.dump(spark, str(tmp_path / "d.xml"))).collect()
    assert [(r.title, r.lead) for r in got] == [("Stone", "Stone is hard matter that is found nearly everywhere.")]
    p = parsers.projects(frame(spark, [('{"x": {"license": "CC", "label": "X", "language": "en"}, "y": {}}',)], "json string")).collect()
    assert {(r.project, r.licence) for r in p} == {("x", "CC"), ("y", None)}
    (tmp_path / "stats").mkdir()
    (tmp_path / "stats" / "a.json").write_text('{"node": "a", "n": 1}')
    (tmp_path / "stats" / "b.json").write_text("{broken")
    rows, bad = parsers.node_stats(spark, str(tmp_path / "stats"), "node string, n long")
    assert [tuple(r) for r in rows.collect()] == [("a", 1)] and bad == 1


def test_line_cursors_hold_what_has_not_ended(spark):
    lines = frame(spark, [(i, i != 7) for i in range(1, 10)], "line long, ended boolean")
    assert tuple(ingest.next_lines(lines, 2, 3).first()) == (5, 3, 0)
    assert tuple(ingest.next_lines(lines, 5, 9).first()) == (6, 1, 3)
    assert tuple(ingest.next_lines(lines, 6, 1).first()) == (6, 0, 1) and tuple(ingest.next_lines(lines, 99, 5).first()) == (99, 0, 0)


def test_replays_are_dropped_by_address(spark, tmp_path):
    rows = frame(spark, [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:02")], "text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, ts timestamp").parquet(str(tmp_path / "in")).withColumn("address", screens.content_address("text"))
    got = screens.run_to_memory(screens.once_each(stream, "address", "ts"), "once_rows", "append", str(tmp_path / "cp"))
    assert sorted(r.text for r in got.collect()) == ["a", "b"] == sorted(r.text for r in screens.once(rows.withColumn("address", screens.content_address("text")), "address").collect())


def test_pooled_streams_read_as_the_whole_frame(spark, tmp_path):
    """Sums of products that a stream accumulates give the modes of all its rows."""
    m = planted(200, 5, 1)
    frame(spark, [(r.tolist(),) for r in m], "vec array<double>").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vec array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select(F.posexplode("vec").alias("i", "x"), "vec").select("i", "x", F.posexplode("vec").alias("j", "y"))
    sums = stream.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    rows = screens.run_to_memory(sums, "pooled_rows", "complete", str(tmp_path / "cp")).collect()
    outer, total = np.zeros((5, 5)), np.zeros(5)
    for r in rows:
        outer[r.i, r.j], total[r.i] = r.xy, r.x
    w, k = frames.accumulated(rows[0].n, total, outer)
    assert np.allclose(w, frames.modes(m)[0]) and k[1] == 1


def test_registries(spark, sf, tmp_path):
    r = invoke.standard()
    a = artifacts(spark, sf)
    assert r.invoke("op.metrics", df=a).filter("collection_id IS NULL").first().artifacts == a.count()
    r.define("twice", [("op.mint", {}), ("op.audit", {})])
    assert r.invoke("twice", df=a.drop("provenance")).filter("no_rung > 0").count() == 0
    frame(spark, [(1, "t", "x" * 200)], "i int, t string, x string").write.parquet(str(tmp_path / "p"))
    r.source(spark, "src", str(tmp_path / "p"), ingest.Declared("s", "t", "x", "i"))
    assert r.invoke("src").first().id == "s-1" and "src" in r.names()
    held = frame(spark, [(1, 1)], "id int, cell int")

    class From:
        def fetch(self, missing):
            return missing.select(F.lit(2).alias("id"), "cell")

    assert {tuple(x) for x in invoke.refilled(held, frame(spark, [(1,), (5,)], "cell int"), From()).collect()} == {(1, 1), (2, 5)}


def test_probed_search_finds_most_neighbours(spark, sf):
    from tessera.operators import resolve
    from tessera.plans import signals

    sf = sf.replace("0.001", "0.01")
    held = signals._vectors(spark, sf)
    q = held.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    near = lambda df: {(r.query_id, r.id) for r in df.select("query_id", "id").collect()}
    every, some = near(resolve.top_by_cosine(q, held, 5)), near(resolve.probed_top(q, held.select("id", "vec"), signals._anchors(spark, sf), 5, 9))
    assert len(every & some) / len(every) >= 0.9


def test_empty_tables(spark):
    none = lambda shape: frame(spark, [], shape)
    assert lexical.top_k(none("query_id int, id int, score double"), 3).count() == 0
    assert consolidate.separation(none("id string, row string, feature string, value double"), none("a string, b string")).count() == 0
    assert consolidate.shingle_jaccard(none("id int, t string"), "id", T.tokens(F.col("t")), 3, 0.5).count() == 0
    assert activation.names_in(none("id int, text string"), none("name string, concept string, prior double")).count() == 0
    assert maintenance.recovered(none("content_ref string"), none("content_ref string, body string")).count() == 0
    assert metrics.consistency(none("artifacts long, consolidated long, bytes long, generator_bytes long, keyed long, content long"), none("artifacts long, consolidated long, bytes long, generator_bytes long, keyed long, content long")).filter("holds IS NOT NULL").count() == 0
    assert graph.spread_nearest(none("concept string, energy double"), none("node string, parent string, cost double"), 1.0, 0.1).count() == 0


def test_stems_agree_where_the_full_text_engine_matches(spark, sf):
    """Two words have one stem exactly where a search for the one finds the other."""
    words = ["run", "running", "runs", "fly", "flies", "happy", "happily", "happiness", "nation", "national", "trees", "tree", "x", "caresses", "caress", "ponies", "pony", "relate", "relational"]
    stems = T.Stemmer()(words)
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(words))
    for i, w in enumerate(words):
        found = {r for (r,) in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (f'"{w}"',))}
        assert found == {j for j, s in enumerate(stems) if s == stems[i]}
    got = frame(spark, [(words,), (None,), ([],)], "w array<string>").select(T.stemmed_udf()("w")).collect()
    assert [r[0] for r in got] == [stems, None, []]
