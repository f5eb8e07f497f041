import hashlib
from collections import Counter

import pytest

from tessera.llm import exact_dedup, minhash, sharding

DOCS = "doc_id long, text string, digest string, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)


def test_exact_dedup_keeps_the_largest_id_and_answers_every_row(spark):
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, None), (7, ""), (4, "x" * 200_000), (9, "b"), (9, "b"), (None, "a")]
    got = exact_dedup.dedup_exact(docs(spark, rows), exact_dedup.open_index(spark)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text_sha256): r for r in got}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert by[(1, sha("a"))].keep_id == 5 and by[(1, sha("a"))].group_size == 4 and not by[(1, sha("a"))].kept
    assert by[(7, sha(""))].kept and by[(2, sha(""))].keep_id == 7
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({sha(t or ""): 1 for _, t in rows})  # also of the repeated row one stays


def test_a_later_batch_meets_the_index(spark):
    index = exact_dedup.open_index(spark, buckets=3)
    exact_dedup.dedup_exact(docs(spark, [(1, "a"), (2, "b")]), index)
    got = {r.doc_id: r for r in exact_dedup.dedup_exact(docs(spark, [(3, "a"), (4, "c"), (5, "c")]), index).collect()}
    assert got[3].keep_id == 1 and not got[3].kept
    assert got[4].keep_id == 5 and got[5].kept
    again = exact_dedup.open_index(spark, index.path, 3)
    assert {r.keep_id for r in again.read().collect()} == {1, 2, 5}


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.dedup_exact(docs(spark, []), exact_dedup.open_index(spark)).collect() == []


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(spark):
    out = exact_dedup.drop_copies(docs(spark, [(1, "a"), (2, "a"), (3, "b"), (3, "b")]), exact_dedup.open_index(spark))
    assert out.columns == ["doc_id", "text", "digest", "kept"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]


def brute_classes(rows):
    hashes = minhash._WordHashes()
    sets = [minhash.shingles(t, hashes) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or minhash.jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def variants(n, edits, seed=3):
    """Chains of texts: each a copy of an earlier one with some words changed."""
    import random

    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    out = []
    for g in range(n):
        base = [word() for _ in range(120)]
        for _ in range(12):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(rnd.choice(edits)):
                base[rnd.randrange(len(base))] = word()
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = variants(10, (1, 3, 6, 9)) + ["", "", "one", "one two", "one two", "w " * 30_000, None, "!!!"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert {d: r.class_id for d, r in got.items()} == brute_classes(rows)
    sizes = Counter(r.class_id for r in got.values())
    assert all(r.class_size == sizes[r.class_id] for r in got.values())


def test_signatures_estimate_weighted_similarity():
    import numpy as np

    rnd = np.random.default_rng(1)
    for wa, wb in ((1, 1), (3, 2), (1, 9)):
        errors = []
        for _ in range(100):
            pool = np.sort(rnd.integers(1, 2**62, 200).astype(np.uint64))
            share = int(rnd.integers(60, 200))
            a, b = (pool[:share], np.full(share, wa)), (pool, np.full(200, wb))
            s = minhash.signatures([a, b])
            errors.append((s[0] == s[1]).mean() - minhash.jaccard(a, b))
        assert abs(np.mean(errors)) < 0.025


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert minhash.near_duplicates(docs(spark, [])).collect() == []
    got = minhash.near_duplicates(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert len(got) == 3 and {r.class_id for r in got} == {1} and {r.class_size for r in got} == {3}


def test_shards_take_turns_and_keys_are_placed_once(spark):
    names = [f"s{i}" for i in range(7)]
    owner = sharding.fill(names, 251)
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    fewer = sharding.fill(names[:-1], 251)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 6)
    assert moved < 251 * 0.35  # most keys of the shards that stay do not move
    d = docs(spark, [(i, "t") for i in range(500)] + [(None, "t"), (3, "t")])
    got = sharding.place(d, names, size=251).collect()
    assert len(got) == 502
    for r in got:
        text = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % 251
        assert (r.slot, r.shard) == (slot, names[owner[slot]])


def test_shard_column_replaces_a_clashing_one_and_bad_tables_fail(spark):
    d = spark.createDataFrame([(1, "old")], "doc_id long, shard string")
    row = sharding.with_shard(d, ["x"], size=251).collect()[0]
    assert row.asDict() == {"doc_id": 1, "shard": "x"}
    for bad in (lambda: sharding.fill([], 251), lambda: sharding.fill(["a"], 250), lambda: sharding.fill(["a"] * 300, 251)):
        with pytest.raises(ValueError):
            bad()
