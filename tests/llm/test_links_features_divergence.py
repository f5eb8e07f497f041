"""Operators 11 to 13 against plain versions of the same rules, on made rows and on the small tables."""

import datetime as dt
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import divergence, features, queries, simhash
from tessera.llm.common import Steps, table

TABLES = "documents clicks sales sale_lines".split()


def by_sql(sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    return [d[0] for d in got.description], got.fetchall()


@pytest.mark.parametrize("name", ["op12_features", "op13_divergence"])
def test_queries_equal_their_sql(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    columns, want = by_sql(sf, name)
    assert sorted(columns) == sorted(got.columns) and want
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r[c] for c in columns) for r in got.collect()) == order(want)


# --- 11


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    n = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """{(doc_id, fingerprint, component)} of (doc_id, fingerprint), every two compared."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    values = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4):
            root[find(f)] = find(fps[i + 1 + int(j)])
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=repr)


def test_simhash_equals_brute_force_on_the_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    got = sorted(map(tuple, simhash.report(simhash.near_duplicates(docs)).collect()), key=repr)
    assert got == plain_components(rows) and any(d != c for d, _, c in got)


def test_simhash_of_odd_rows(spark):
    long = " ".join(f"word{k % 977}" for k in range(120_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, "a\x0bb  c"), (8, long), (9, long + " end"), (9, long + " end"), (None, "one"), (None, "alone here"), (10, "Ä ä x İ y"), (11, "x\x00y z")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted(map(tuple, simhash.report(simhash.near_duplicates(docs)).collect()), key=repr)
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert simhash.report(simhash.near_duplicates(docs.filter("false"))).collect() == []


@pytest.mark.parametrize("bucket", [0, 3, 32])
def test_links_of_crowds_equal_brute_force(spark, bucket):
    """Chains and balls of fingerprints, by variants alone, by what lies beside them alone, and by both."""
    rnd, fps = random.Random(bucket), set()
    for _ in range(6):
        f = rnd.getrandbits(64)
        for _ in range(40):  # a walk of steps of up to five bits, so that links and near misses alternate
            fps.add(f)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                f ^= 1 << b
    one = rnd.getrandbits(64)
    fps |= {one ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)}  # a ball
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    values = simhash._segment_values(nodes)
    placed = values.join(simhash._crowded(values, bucket), ["segment", "value"], "left")
    few = simhash.variant_links(simhash.variants(placed.filter("own IS NULL OR NOT own"))).collect()
    crowd = placed.filter("own IS NOT NULL").select("fp").distinct()
    many = simhash.crowd_links(crowd).collect()
    links = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in few + many}
    assert {frozenset(x) for x in plain_parts(fps, links)} == {frozenset(x) for x in plain_parts(fps, want)}
    assert {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in few} <= want
    if bucket == 32:
        assert len(few) <= 3 * len({(r.a, r.b) for r in few})
    assert crowd.count() <= len(fps)


def plain_parts(nodes, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    seen, out = set(), []
    for n in nodes:
        if n not in seen:
            part, todo = set(), [n]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += near[x]
            seen |= part
            out.append(part)
    return out


def test_rows_made_by_a_crowd_grow_with_it_alone(spark):
    """A third of all nodes share a segment: rows filed double when nodes do."""
    made = []
    for n in (300, 600):
        rnd = random.Random(n)
        nodes = spark.createDataFrame([(rnd.getrandbits(40) << 22 | 5,) for _ in range(n)], "fp long")
        values = simhash._segment_values(nodes)
        placed = values.join(simhash._crowded(values, 32), ["segment", "value"], "left")
        crowd = placed.filter("own IS NOT NULL").select("fp").distinct()
        made.append(simhash.variants(placed.filter("own IS NULL OR NOT own")).count() + crowd.select(F.explode(simhash.beside(F.col("fp")))).count())
        assert crowd.count() == n
    assert made[1] == 2 * made[0]


# --- 12

DAY = 86_400_000_000
US = dt.timedelta(microseconds=1)
START = dt.datetime(2024, 1, 1)


def plain_features(clicks, sales, lines, windows=(2, 14)):
    us = lambda t: None if t is None else (t - START) // US
    cents = lambda x: 0 if x is None or x != x else int(np.floor(100 * x + 0.5))
    out = []
    for sale_id, client, _, _, sold, *_ in sales:
        if client is None or sold is None:
            continue
        t = us(sold) + zlib.crc32(str("" if sale_id is None else sale_id).encode()) % 259_200 * 1_000_000
        label = any(s[1] == client and s[4] is not None and t < us(s[4]) <= t + 7 * DAY for s in sales)
        for d in windows:
            fits = lambda at, got: at is not None and got is not None and t - d * DAY < us(at) <= t and us(got) + 240 * 60_000_000 <= t  # noqa: E731, B023
            c = [x for x in set(clicks) if x[3] == client and fits(x[1], x[2])]
            s = [x for x in sales if x[1] == client and fits(x[4], x[5])]
            n = [y for x in s for y in lines if x[0] is not None and y[0] == x[0] and y[8] is not None and us(y[8]) <= t]
            last = max(c, key=lambda x: (x[1], -1 if x[0] is None else x[0]))[0] if c else None
            out.append((
                sale_id, d, t + (START - dt.datetime(1970, 1, 1)) // US, label, len(c), sum(x[4] == "purchase" for x in c), sum(cents(x[5]) for x in c), last,
                len(s), sum(cents(x[3]) for x in s), len(n), len({y[2] for y in n} - {None}), sum(cents(y[5]) for y in n),
            ))
    return sorted(out, key=repr)


def made_shop(seed, n=60, clients=3):
    """A small shop with ties, bounds that are met to the microsecond, repeated, late, broken and null rows, one client of most rows."""
    rnd = random.Random(seed)
    when = lambda: START + dt.timedelta(hours=rnd.randint(0, 24 * 18), microseconds=rnd.choice((0, 0, 1, -1)))
    late = lambda t: rnd.choice((t, t, t + dt.timedelta(minutes=rnd.randint(0, 900)), t - dt.timedelta(days=1), None))
    who = lambda: rnd.choice((1, 1, 1, *range(clients), None))
    sales, lines, clicks = [], [], []
    for k in range(n):
        sold = rnd.choice((when(), when(), None)) if k % 9 == 0 else when()
        sales.append((k if k % 11 else None, who(), "done", rnd.choice((1.005, -3.5, None, float("nan"), 12.25)), sold, late(sold) if sold else None, 1))
    sales += sales[:2]
    for s in sales:
        if s[0] is None:
            continue
        probe = s[4] + dt.timedelta(seconds=zlib.crc32(str(s[0]).encode()) % 259_200) if s[4] else when()
        for _ in range(rnd.randint(0, 4)):
            lines.append((s[0], 1, rnd.choice((1, 2, 3, 7, 9, None)), 1, 1, rnd.choice((2.345, None, 10.0)), 0.0, "kept", rnd.choice((probe, probe + US, when(), None))))
        for shift in (0, 1, -1):
            at = probe - dt.timedelta(days=rnd.choice((2, 14, 0))) + shift * US
            clicks.append((rnd.randint(0, 200), at, rnd.choice((at, probe - dt.timedelta(minutes=240) + shift * US)), s[1], rnd.choice(("purchase", "view", None)), rnd.choice((0.125, None, -1.0)), "{}"))
    lines += lines[:3] + [(5, 1, 1, 1, 1, 1.0, 0.0, "kept", START)] * 40 + [(None, 1, 1, 1, 1, 1.0, 0.0, "kept", START)]
    clicks += clicks[:9] + [(None, START, START, 1, "view", 1.0, "{}")]
    return clicks, sales, lines


SCHEMAS = (
    "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string",
    "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int",
    "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz",
)


@pytest.mark.parametrize("seed,leaf", [(1, 5), (2, 1), (3, 0)])
def test_features_equal_brute_force(spark, monkeypatch, seed, leaf):
    """Low blocks of one or two places put nearly all windows into the tree."""
    monkeypatch.setattr(features, "LEAF", leaf)
    shop = made_shop(seed)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in zip(shop, SCHEMAS)]
    got = sorted(map(tuple, features.features(*frames).collect()), key=repr)
    assert got == plain_features(*shop)


def test_features_of_empty_tables_and_clashing_columns(spark):
    shop = made_shop(4, 12)
    clicks, sales, lines = [spark.createDataFrame(rows, schema) for rows, schema in zip(shop, SCHEMAS)]
    odd = lambda f: f.withColumn("rid", F.lit("x")).withColumn("client", F.lit("y")).withColumn("known", F.lit(1)).withColumn("at", F.lit(2))
    want = plain_features(*shop)
    assert sorted(map(tuple, features.features(odd(clicks), odd(sales), odd(lines)).collect()), key=repr) == want
    none = [f.filter("false") for f in (clicks, sales, lines)]
    assert features.features(none[0], none[1], lines).collect() == []
    alone = sorted(map(tuple, features.features(none[0], sales, none[2]).collect()), key=repr)
    assert alone == plain_features([], shop[1], [])


def test_running_sums_of_a_key_over_all_tasks(spark):
    rnd = random.Random(5)
    rows = [(0 if rnd.random() < 0.7 else rnd.randint(1, 4), rnd.randint(0, 50), k, rnd.randint(-9, 9), rnd.randint(-99, 99)) for k in range(5000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, "k long, t long, tie long, v long, w long")
        got = {r.tie: r for r in features.running(Steps(spark), df, ("k",), ("t", "tie"), {"v": lambda c: c("v")}, {"w": lambda c: c("w"), "tie": lambda c: c("tie")}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total, best = Counter(), {}
    assert len(got) == len(rows)
    for k, t, tie, v, w in sorted(rows):
        total[k] += v
        r = got[tie]
        assert r.before_w == (best[k][0] if k in best else features.NONE)
        best[k] = max(best.get(k, (features.NONE, 0)), (w, 0))
        assert (r.so_far_v, r.so_far_w) == (total[k], best[k][0])


def test_times_without_a_zone_do_not_follow_the_session(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 2, 30, 0, 7),), (dt.datetime(1969, 12, 31, 23, 59, 59, 999_999),)], "t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = [r[0] for r in df.select(features.micros(df, "t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1_711_852_200_000_007, -1]


# --- 13


def plain_audit(rows, least, top):
    found = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in found}:
        df = Counter(t for a, _, w in found if a == lang for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = {s: Counter(t for a, b, w in found if a == lang and b == s for t in w) for a, s, _ in found if a == lang}
        count[None] = sum(count.values(), Counter())
        share = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept} for s, c in count.items()}
        for s in set(count) - {None}:
            parts = {
                "pair": [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for o in count if o not in (s, None)],
                "term": [(share[None][t] - share[s][t], t.encode(), t) for t in kept if count[s][t] and share[s][t] > share[None][t]],
            }
            for part, items in parts.items():
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(sorted(items), 1) if part == "pair" or k <= top]
    return sorted(out)


def test_divergence_equals_a_plain_version(spark):
    rnd = random.Random(6)
    words = ["eins", "Zwei", "zwei", "drei4vier", "É", "é", "ÀB", "x\x00y", "\U0001f600", "z"]
    rows = [(rnd.choice(("de", "en", None, "")), rnd.choice(("a", "b", "é", "Z", None)), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for _ in range(120)]
    rows += [("de", "silent", None), ("xx", "one", "seldom"), ("xx", "two", ""), ("de", "long", "eins " * 50_000), *rows[:5]]
    docs = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "lang string, source string, text string, n int, term string, salt int")
    for least, top in ((3, 2), (1, 50)):
        assert sorted(map(tuple, divergence.audit(docs, least, top).collect())) == plain_audit(rows, least, top)
    assert divergence.audit(docs.filter("false")).collect() == []
