"""Queries do their whole job: against brute force that knows no cut."""

import math
import re
from pathlib import Path

import numpy as np
import pytest

from tessera.model import table
from tessera.operators import consolidate, graph, resolve
from tessera.plans import lexical, registry, signals


@pytest.fixture(params=[(4_000, 20_000), (3, 70)])
def blocks(request, monkeypatch):
    monkeypatch.setattr(resolve, "QUERY_BLOCK", request.param[0])
    monkeypatch.setattr(resolve, "HELD_BLOCK", request.param[1])


def test_cosine_top_is_of_all_vectors(spark, sf, blocks):
    rows = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.round(m @ m[i], 6)
        want[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:5]]
    got = {}
    for r in signals.t2k_cosine_top(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got == want


def test_cosine_top_of_ties_zero_and_null_vectors(spark, blocks):
    v = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 1.0])]
    held = spark.createDataFrame(v, "id long, vec array<double>")
    got = resolve.top_by_cosine(held.selectExpr("id AS query_id", "vec AS qvec").filter("id IN (1, 2)"), held, 4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score) for r in got] == [(1, 1, 1.0), (1, 3, 1.0), (1, 5, 0.0), (1, 2, None), (2, 1, None), (2, 2, None), (2, 3, None), (2, 4, None)]


def whole_sql(name, sf):
    """Rows of the query's SQL on the small tables."""
    import duckdb

    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    rel = con.sql(registry.oracle_sql()[name])
    return rel.columns, rel.fetchall()


def same(df, columns, rows, digits=6):
    assert df.columns == list(columns)
    near = lambda r: (tuple(x for x in r if not isinstance(x, float)), [x for x in r if isinstance(x, float)])
    got, want = sorted(map(near, map(tuple, df.collect())), key=str), sorted(map(near, rows), key=str)
    assert len(got) == len(want) > 0
    for (a, x), (b, y) in zip(got, want):
        assert a == b and x == pytest.approx(y, rel=1e-9, abs=2 * 10**-digits)


@pytest.mark.parametrize("name", ["j10_propagate", "g1_spread", "g2_discharge", "w5_rank_fired", "g5_recognise", "g6_compose", "g3_associate", "j9_signed", "f23_coherent_core", "g4_fired_field"])
def test_geometry_starts_from_all(spark, sf, name):
    sf = sf.replace("0.001", "0.01") if name in ("g3_associate", "j9_signed", "f23_coherent_core") else sf
    same(registry.queries()[name](spark, sf), *whole_sql(name, sf))


def test_fired_field_of_shared_inner_and_unsupported_senses(spark):
    """Against the sum over all pairs; the words x and y have only senses of their own under the tree."""
    tree = spark.createDataFrame([("r", None, 0), ("p", "r", 1), ("q", "r", 4), ("a", "p", 3), ("b", "p", 2), ("c", "q", 5), ("d", "q", 1)], "node string, parent string, own long")
    above = graph.closure(tree, 2)
    ic = graph.information_content(tree, above)
    senses = [("u", "a", 1.0), ("u", "p", 0.5), ("v", "a", 0.7), ("v", "c", 1.0), ("w", "gone", 0.4), ("w", "away", 0.1)]
    got = {r.sense: r.energy for r in graph.fired_field(
        spark.createDataFrame([("u", 2.0), ("v", 3.0), ("w", 5.0)], "word string, bits double"), spark.createDataFrame(senses, "word string, sense string, prior double"), above, ic,
    ).collect()}
    info, ups = {r.node: r.ic for r in ic.collect()}, {}
    for r in above.collect():
        ups.setdefault(r.node, set()).add(r.ancestor)
    sim = lambda a, b: math.exp(-max(0, info[a] + info[b] - 2 * max(info[x] for x in ups[a] & ups[b]))) if a in ups and b in ups else 0.0
    want = {}
    for word, bits in (("u", 2.0), ("v", 3.0), ("w", 5.0)):
        own = [(s, p, sum(q * sim(s, t) for v, t, q in senses if v != word)) for w, s, p in senses if w == word]
        total, prior = sum(x[2] for x in own), sum(x[1] for x in own)
        for s, p, x in own:
            want[s] = want.get(s, 0) + bits * (x / total if total else p / prior)
    assert got == pytest.approx(want, rel=1e-9)


def test_signal_end_of_a_long_list(spark):
    scores = spark.range(15_000).selectExpr("0 AS q", "id", "CASE WHEN id < 7000 THEN 1.0D ELSE 0.0D END AS score")
    row = resolve.signal_end(scores, "q", "score", "id").first()
    assert (row.n, row.k, row.separated) == (15_000, 7_000, True) and row.null_eta2 == pytest.approx(0.75, abs=1e-6)


@pytest.mark.parametrize("size", [2_000, 60])
def test_candidates_of_all_anchors(spark, sf, monkeypatch, size):
    monkeypatch.setattr(consolidate, "ID_BLOCK", size)
    monkeypatch.setattr(consolidate, "ANCHORS", 7)
    same(registry.queries()["j3_candidates"](spark, sf), *whole_sql("j3_candidates", sf))


def test_absent_edges_of_all_parts(spark, sf):
    sf = sf.replace("0.001", "0.01")
    poor = {r.s_suppkey for r in table(spark, sf, "supplier").collect() if r.s_acctbal <= 0}
    pairs = {(r.l_suppkey, r.l_partkey) for r in table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").collect()}
    want = sorted((f"supplier-{s}", f"part-{p}", "supplies") for s, p in pairs if s in poor)
    assert want and sorted(map(tuple, registry.queries()["k2_absent_edges"](spark, sf).collect())) == want


@pytest.mark.parametrize("name", ["a18_pooled_gram", "o9_spectral_distance", "a17_vector_sum"])
def test_vectors_are_read_whole(spark, sf, name):
    same(registry.queries()[name](spark, sf), *whole_sql(name, sf), digits=4)


def test_frames_of_whole_vectors(spark, sf):
    by = {}
    for r in table(spark, sf, "embeddings").orderBy("vec_id").collect():
        by.setdefault(r.label, []).append(r.embedding)
    by = {k: np.array(v, float) for k, v in by.items()}
    reads = {r.label: r for r in registry.queries()["f15_frame_reads"](spark, sf).collect()}
    routed = registry.queries()["f18_route_by_coupling"](spark, sf).collect()
    assert set(reads) == {r.label for r in routed} == set(by)
    for label, m in by.items():
        s = np.linalg.svd(m, compute_uv=False) ** 2
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        own = np.linalg.eigvalsh(u @ u.T)
        corr = np.linalg.eigvalsh(np.corrcoef(m.T))
        edge = (1 + np.sqrt(64 / len(m))) ** 2
        r = reads[label]
        assert (r.rows, r.modes) == (len(m), (corr > edge).sum())
        assert (r.focus, r.coherence, r.edge) == pytest.approx((s[0] / s.sum(), own[-1] / own.sum(), edge), abs=2e-6)
        left, energy = (m**2).sum(), {n: (m[:, i : i + 2] ** 2).sum() for n, i in (("first", 0), ("second", 2), ("third", 4))}
        for x in sorted((x for x in routed if x.label == label), key=lambda x: x.step):
            assert x.basis == max(energy, key=energy.get)
            left -= energy[x.basis]
            assert (x.absorbed, x.residual) == pytest.approx((energy.pop(x.basis), left), abs=1e-5)


def test_all_terms_means_all_terms(spark, sf):
    words = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    docs = {r.doc_id: set(words(r.text)) for r in table(spark, sf, "documents").collect()}
    want = {(r.item_id, i) for r in table(spark, sf, "benchmark").collect() for i, w in docs.items() if w >= set(words(r.text))}
    got = {(r.query_id, r.id) for r in registry.queries()["g20_bm25_all_terms"](spark, sf).collect()}
    per = lambda pairs, q: {i for p, i in pairs if p == q}
    assert got <= want and all(len(per(got, q)) == min(10, len(per(want, q))) for q, _ in want)


def test_short_items_are_found_in_documents(spark):
    long = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"zero {long} twelve"), (2, "two three"), (3, "nine ten"), (4, None), (5, "three two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, "two three"), (3, "ten"), (4, "two four"), (5, ""), (6, None)], "item_id long, text string")
    assert {tuple(r) for r in lexical._holding(docs, items).collect()} == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 3)}
