"""Coordinates, proximity, fits from merged sums, stored signatures and the paged reader against plain versions."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.model import table, taxonomy
from tessera.operators import coordinates as K
from tessera.operators import graph as G
from tessera.operators import signatures as Z
from tessera.operators import spectrum as S
from tessera.operators.proximity import ProximityIndex
from tessera.plans import lattice


@pytest.fixture(scope="module")
def tree(spark, sf):
    t = taxonomy(spark, sf)
    above = G.closure(t)
    ic = G.information_content(t, above)
    return t, above, ic, K.sparse(t, ic)


def vectors(c, axis="axis"):
    out = defaultdict(dict)
    for r in c.collect():
        out[r.node][r[axis]] = r.weight
    return out


def square(a, b):
    return sum((a.get(k, 0.0) - b.get(k, 0.0)) ** 2 for k in {*a, *b})


def test_squared_distance_of_coordinates_is_the_taxonomys(spark, tree):
    t, above, ic, c = tree
    n = t.select("node").filter("node LIKE 'nation-%' OR node LIKE 'region-%' OR node = 'root'")
    pairs = t.select(F.col("node").alias("a")).crossJoin(n.select(F.col("node").alias("b"))).filter("a <> b")
    want = {(r.a, r.b): r.jc for r in G.distances(pairs, above, ic).collect()}
    got = {(r.a, r.b): r.d2 for r in K.distances(pairs, c).collect()}
    assert want.keys() == got.keys() and max(abs(want[k] - got[k]) for k in want) < 1e-12
    v = vectors(c)
    some = random.Random(1).sample(sorted(got), 300)
    assert max(abs(square(v[a], v[b]) - got[a, b]) for a, b in some) < 1e-12
    own = spark.createDataFrame([("root", "root"), ("nation-1", "nation-1"), (None, "root"), ("nobody", "nation-1")], "a string, b string")
    same = {(r.a, r.b): r.d2 for r in K.distances(own, c).collect()}
    assert same["root", "root"] == same["nation-1", "nation-1"] == 0 and len(same) == 3


def test_coordinates_tell_nodes_apart(tree):
    v = vectors(tree[3])
    assert len({json.dumps(sorted(x.items())) for x in v.values()}) == len(v) == tree[0].count() - 1  # the root counts everything and has none


def test_folds_are_the_signed_hash_and_get_better_with_width(spark, tree, sf):
    import hashlib

    c = tree[3]
    sparse, fold = vectors(c), vectors(K.folded(c, 8), "slot")
    for node in random.Random(2).sample(sorted(sparse), 40):
        want = defaultdict(float)
        for axis, w in sparse[node].items():
            h = hashlib.md5(f"axis|{axis}".encode()).hexdigest()
            want[int(h[:15], 16) % 8] += w if int(h[15], 16) % 2 else -w
        assert fold[node] == pytest.approx(dict(want))
    rho = [r.rho for r in lattice.kernel_fold_fidelity(spark, sf).orderBy("width").collect()]
    assert rho == sorted(rho) and rho[-1] > 0.97


def test_the_canonical_parent_is_the_one_of_greatest_information(spark):
    t = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("x", "a"), ("x", "b"), ("y", "b"), ("y", "a"), ("x", "a")], "node string, parent string")
    ic = spark.createDataFrame([("r", 0.0), ("a", 2.0), ("b", 1.0), ("x", 3.0), ("y", 3.0)], "node string, ic double")
    assert {(r.node, r.parent) for r in K.canonical(t, ic).collect()} == {("r", None), ("a", "r"), ("b", "r"), ("x", "a"), ("y", "a")}
    even = spark.createDataFrame([("r", 0.0), ("a", 1.0), ("b", 1.0), ("x", 3.0), ("y", 3.0)], "node string, ic double")
    assert {(r.node, r.parent) for r in K.canonical(t, even).collect()} >= {("x", "a"), ("y", "a")}
    assert sorted((r.node, round(r.weight, 9)) for r in K.sparse(t, ic).filter("axis = node").collect()) == [("a", round(math.sqrt(2), 9)), ("b", 1.0), ("x", 1.0), ("y", 1.0)]


def test_average_ranks(spark):
    rnd = random.Random(3)
    x = [(rnd.choice((1.0, 2.5, 2.5, -7.0, float(rnd.randint(0, 400)))),) for _ in range(900)]
    got = {r.v: r.k for r in K.average_ranks(spark.createDataFrame(x, "v double"), "v", "k", slices=7).collect()}
    ordered = sorted(v for (v,) in x)
    assert got == {v: (ordered.index(v) + 1 + len(ordered) - ordered[::-1].index(v)) / 2 for v in ordered}


def plain_distance(x, y):
    n = min(len(x), len(y))
    return math.dist(x[:n], y[:n])


def spectra(n, seed):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice("ab"), sorted((rnd.gauss(0, 1) for _ in range(rnd.randint(1, 6))), reverse=True)) for k in range(n)]
    return rows + [(n, "a", rows[0][2]), (n + 1, "a", [5.0] * 3), (n + 2, "a", [5.0] * 3), (n + 3, "b", None), (n + 4, "b", []), (n + 5, "b", [None, 1.0])]


def test_proximity_is_exact_and_reads_few_files(spark):
    rows = spectra(300, 4)
    usable = [r for r in rows if r[2] and r[2][0] is not None]
    digests = spark.createDataFrame(rows, "id long, instrument string, vec array<double>")
    index = ProximityIndex.build(digests, files=16)
    for q in usable[:3] + usable[-2:]:
        want = sorted((plain_distance(q[2], r[2]), r[0]) for r in usable if r[1] == q[1])
        got = sorted((r.d, r.id) for r in index.within(q[2], 0.5, q[1]).collect())
        assert [i for _, i in got] == [i for d, i in want if d <= 0.5]
        near = index.nearest(q[2], 5, q[1], radius=0.001).collect()
        assert [(round(r.d, 9), r.id) for r in near] == [(round(d, 9), i) for d, i in want[:5]]
    asked = sorted((r["query"], r.id) for r in index.within_of(digests, 0.4).collect())
    assert asked == sorted((p[0], r[0]) for p in usable for r in usable if p[1] == r[1] and p[0] != r[0] and plain_distance(p[2], r[2]) <= 0.4)
    told = defaultdict(list)
    for r in index.nearest_of(digests, 4, 0.01, but_self=False).orderBy("query", "rank").collect():
        told[r["query"]].append((round(r.d, 9), r.id))
    assert told == {p[0]: [(round(d, 9), i) for d, i in sorted((plain_distance(p[2], r[2]), r[0]) for r in usable if r[1] == p[1])[:4]] for p in usable}
    files = index.bounds().collect()
    assert len({f.file for f in files}) >= 12
    low, high = 0.2, 0.3
    met = {r.file for r in index._ranged("a", low, high).select(F.col("_metadata.file_name").alias("file")).collect()}
    assert met == {f.file for f in files if f.instrument == "a" and f.low <= high and f.high >= low} or met < {f.file for f in files}
    assert len(met) < len({f.file for f in files}) / 3
    plan = index._ranged("a", low, high)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan
    with pytest.raises(ValueError):
        index.within([1.0], 1.0, "c")
    assert index.nearest_of(spark.createDataFrame([(1, "c", [1.0])], digests.schema), 2, 1.0).collect() == []


def test_products_add_up(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 3, rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for k in range(200)]
    odd = [(1, [1.0, None, 2.0], [1.0, 1.0]), (1, None, [1.0, 1.0]), (None, [1.0] * 3, [1.0] * 2), (1, [1.0] * 4, [1.0] * 2), (1, [float("nan")] * 3, [1.0] * 2), (1, [float("inf")] * 3, [1.0] * 2)]
    df = spark.createDataFrame(rows + odd, "k int, x array<double>, y array<double>").repartition(5)
    for r in S.products(df, "k", "x", "y", 3, 2).collect():
        x, y = (np.array([row[j] for row in rows if row[0] == r.k]) for j in (1, 2))
        assert r.n == len(x) and r.x == pytest.approx(x[:, r.i].sum())
        assert np.allclose(r.y, y.sum(axis=0)) and np.allclose(r.xy, x[:, r.i] @ y)
    assert S.products(df.filter("false"), "k", "x", "y", 3, 2).collect() == []


def test_alignment_is_the_least_squares_map(spark, sf):
    rng = np.random.default_rng(6)
    x, a = rng.normal(size=(400, 4)), rng.normal(size=(4, 3))
    planted = [(k, v.tolist(), (v @ a + 0.01 * rng.normal(size=3)).tolist()) for k, v in enumerate(x)]
    noise = [(k, v.tolist(), rng.normal(size=3).tolist()) for k, v in enumerate(x)]
    for rows, carries in ((planted, True), (noise, False)):
        df = spark.createDataFrame(rows, "id long, source array<double>, target array<double>")
        found, verdict = S.alignment(df, 4, 3)
        held = {r.id for r in df.filter(F.pmod(F.xxhash64("id"), F.lit(4)) == 3).collect()}
        fit = [r for r in rows if r[0] not in held]
        want = np.linalg.lstsq(np.array([r[1] for r in fit]), np.array([r[2] for r in fit]), rcond=None)[0]
        v = verdict.first()
        assert np.allclose(found, want) and (v.n_fit, v.n_held) == (len(fit), len(held))
        rest = [r for r in rows if r[0] in held]
        t, mean = np.array([r[2] for r in rest]), np.array([r[2] for r in fit]).mean(axis=0)
        gain = ((t - mean) ** 2).sum(axis=1) - ((t - np.array([r[1] for r in rest]) @ want) ** 2).sum(axis=1)
        assert v.gain == pytest.approx(gain.mean()) and v.se == pytest.approx(gain.std(ddof=1) / math.sqrt(len(gain))) and v.carries is carries


def test_decay_finds_planted_modes_and_refuses(spark):
    rng = np.random.default_rng(7)
    rows = []
    for key, mu in (("two", (0.9, 0.5)), ("grows", (1.1, 0.5)), ("one", (0.6, 0.6))):
        v = np.linalg.qr(rng.normal(size=(2, 2)))[0] if key != "two" else np.array([[1.0, 0.4], [0.2, 1.0]])
        x = v @ np.array([1.0, 1.0])
        a = v @ np.diag(mu) @ np.linalg.inv(v)
        for t in range(12):
            rows.append((key, t, x.tolist()))
            x = a @ x
    rows += [("single", 0, [1.0, 2.0]), ("pair", 0, [1.0, 2.0]), ("pair", 1, [1.0, 2.0]), ("zero", 0, [0.0, 0.0]), ("gaps", 0, None)]
    got = {r.k: r for r in S.decay(spark.createDataFrame(rows, "k string, t int, v array<double>"), "k", "t", "v", 2).collect()}
    assert got["two"].tau_slow == pytest.approx(-1 / math.log(0.9)) and got["two"].tau_fast == pytest.approx(-1 / math.log(0.5)) and got["two"].n_modes == 2
    assert got["grows"].refusal == "growth" and got["one"].refusal == "one decay" and got["one"].tau_fast is None
    assert got["single"].refusal == got["pair"].refusal == "under two pairs" and got["single"].n_pairs == 0 and not {"zero", "gaps"} & set(got)


def test_read_basis_spans_what_numpy_finds(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(60, 12)) * (rng.random((60, 12)) < 0.4)
    m[:, 0] += 3
    cells = [(f"r{i}", f"c{j:02d}", float(m[i, j])) for i in range(60) for j in range(12) if m[i, j]]
    df = spark.createDataFrame([*cells[1:], (cells[0][0], cells[0][1], cells[0][2] - 1), (cells[0][0], cells[0][1], 1.0), ("r0", "c01", None)], "row string, col string, value double")
    basis, energies, refusal = S.leading(df, 3)
    _, s, v = np.linalg.svd(m)
    assert refusal is None and np.allclose(energies, s[:3] ** 2)
    b = np.zeros((12, 3))
    for r in basis.collect():
        b[int(r["col"][1:])] = r.v
    assert np.allclose(b.T @ b, np.eye(3), atol=1e-8) and np.allclose(np.abs(np.diag(v[:3] @ b)), 1, atol=1e-6)
    thin = spark.createDataFrame([("a", "x", 2.0), ("b", "x", 1.0)], "row string, col string, value double")
    assert S.leading(thin, 3)[1] == pytest.approx([5.0])
    none, energies, refusal = S.leading(df.filter("false"), 3)
    assert none.collect() == [] and energies == [] and refusal


def jaccard(a, b):
    s = [{" ".join(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_signatures_in_batches_tell_what_one_batch_tells(spark):
    rnd = random.Random(9)
    base = [" ".join(f"w{rnd.randint(0, 5000)}" for _ in range(60)) for _ in range(40)]
    texts = []
    for k, b in enumerate(base):
        words = b.split()
        words[rnd.randrange(60)] = "other"
        texts += [(3 * k, b), (3 * k + 1, " ".join(words))] + ([(3 * k + 2, b)] if k % 4 == 0 else [])
    odd = [(1000, ""), (1001, "two words"), (1002, None), (None, base[0])]
    df = spark.createDataFrame(texts + odd, "id long, text string")
    whole = Z.SignatureTable(spark).add(df, 0.5)
    one = {(r.a, r.b, r.score) for r in whole.pairs.collect()}
    assert (whole.signed, whole.skipped_no_signature, whole.known, whole.crowded) == (len(texts), 4, 0, 0)
    near = {(max(a, b), min(a, b)) for i, (a, x) in enumerate(texts) for b, y in texts[i + 1 :] if jaccard(x, y) >= 0.8}
    rep = {i: min(j for j, y in texts if y == x) for i, x in texts}  # what stands for a text
    near = {(a, b) if dict(texts)[a] == dict(texts)[b] else (max(rep[a], rep[b]), min(rep[a], rep[b])) for a, b in near if dict(texts)[a] != dict(texts)[b] or rep[a] == b}
    assert near <= {(a, b) for a, b, _ in one} and all(jaccard(dict(texts)[a], dict(texts)[b]) > 0.3 for a, b, _ in one)
    assert {(a, b): s for a, b, s in one}[(2, 0)] == 1.0
    stored, parts = Z.SignatureTable(spark), set()
    for batch in (0, 1, 2):
        c = stored.add(df.filter(f"id % 3 = {batch} OR id IS NULL"), 0.5)
        parts |= {(max(r.a, r.b), min(r.a, r.b), r.score) for r in c.pairs.collect()}
    assert parts == one and stored.signatures().count() == len(texts)
    again = stored.add(df, 0.5)
    assert again.pairs.collect() == [] and again.signed == 0 and again.known == len(texts) + 3 - 3 and stored.signatures().count() == len(texts)


def test_a_crowd_of_one_template_makes_no_pairs_by_itself(spark, monkeypatch):
    monkeypatch.setattr(Z, "CROWD", 8)
    rnd = random.Random(10)
    head = " ".join(f"t{k}" for k in range(40))
    rows = [(k, head + " " + " ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(40))) for k in range(80)] + [(100, None)]
    rows.append((101, rows[0][1]))
    got = Z.SignatureTable(spark).add(spark.createDataFrame(rows, "id long, text string"), 0.8)
    assert got.crowded > 0 and {(r.a, r.b) for r in got.pairs.collect()} == {(101, 0)}


def test_copies_are_told_once_each(spark):
    text = " ".join(f"w{k}" for k in range(30))
    table = Z.SignatureTable(spark)
    first = table.add(spark.createDataFrame([(k, text) for k in range(200)], "id long, text string"), 0.8)
    assert {(r.a, r.b, r.score) for r in first.pairs.collect()} == {(k, 0, 1.0) for k in range(1, 200)}
    more = table.add(spark.createDataFrame([(k, text) for k in range(-5, 0)], "id long, text string"), 0.8)
    assert {(r.a, r.b) for r in more.pairs.collect()} == {(k, 0) for k in range(-5, 0)} and table.bands().count() == Z.BANDS


def test_the_signature_query_equals_brute_force(spark, sf):
    got = {(r.a, r.b): r.score for r in lattice.m1_incremental_signatures(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    batch = {r.doc_id: r.b for r in table(spark, sf, "documents").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("b")).collect()}
    from tessera.operators.maintenance import sketches

    sketch = {r.ref: np.array(r.sketch) for r in sketches(spark.createDataFrame(list(texts.items()), "ref long, body string")).filter("NOT degenerate").collect()}
    ids = sorted(sketch)
    m = np.array([sketch[i] for i in ids])
    want, stands = {}, {}
    for i in sorted(ids, key=lambda i: (batch[i], i)):
        stands.setdefault(sketch[i].tobytes(), i)
    for k, i in enumerate(ids):
        first = stands[sketch[i].tobytes()]
        if i != first:
            if batch[i] == 1:
                want[i, first] = 1.0
            continue
        agree = (m == m[k]).mean(axis=1)
        for j in np.flatnonzero(agree >= 0.8):
            a, b = i, ids[j]
            if a != b and stands[sketch[b].tobytes()] == b and batch[a] == 1 and (batch[b] == 0 or b < a):
                want[a, b] = float(agree[j])
    assert got == want and want


ITEMS = [{"id": f"i{k}", "content": f"text {k}", "context": {"k": k}} for k in range(23)] + [{"content": "no id"}, "broken"]


def fetch(limit, offset, options):
    """A listing in a folder: a call fails the first time for a page, and hands out at most 4 items."""
    import os

    mark = os.path.join(options["folder"], f"tried-{offset}")
    if not os.path.exists(mark):
        open(mark, "w").close()
        raise OSError("no answer")
    said = {"items": ITEMS[offset : offset + min(limit, 4)]}
    return said | ({"total": len(ITEMS)} if options.get("total", "yes") == "yes" else {})


@pytest.mark.parametrize("total,parts", [("yes", 4), ("no", 1)])
def test_a_listing_is_read_page_by_page(spark, tmp_path, total, parts):
    from tessera.sources.paged import PagedReader, PagedSource

    spark.dataSource.register(PagedSource)
    reader = lambda **o: spark.read.format("paged").options(fetcher="tests.test_lattice:fetch", folder=str(tmp_path), page=7, wait=0, total=total, **o).load()
    got = reader()
    assert sorted((r.id, r.content, r.context) for r in got.collect()) == sorted((x["id"], x["content"], json.dumps(x["context"])) for x in ITEMS[:23])
    assert got.rdd.getNumPartitions() == parts
    assert reader(cap=9).count() == 9 and reader(cap=0).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        fresh = tmp_path / "other"
        fresh.mkdir()
        spark.read.format("paged").options(fetcher="tests.test_lattice:fetch", folder=str(fresh), page=7, wait=0, tries=1).load().collect()
    with pytest.raises(ValueError):
        PagedReader(got.schema, {"page": "0"})
