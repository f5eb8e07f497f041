"""Near-duplicate detection with dart-based weighted MinHash.

A text is a weighted set: its shingles of five words, each with its count. Over
every shingle lies a plane of (weight, rank) on which darts fall as a Poisson
process of density one, drawn from hashes of the shingle, so that equal shingles
see equal darts in all texts. A dart hits the text if its weight is under the
shingle's weight. Every dart belongs to one of K coordinates; the signature
keeps, for each coordinate, the hitting dart of least rank. Two texts agree in a
coordinate with the probability of their weighted Jaccard similarity. As only
darts up to rank T / (total weight) are thrown, about T darts are made per text,
whatever its length; texts with a coordinate left empty throw on at twice T.

Copies of a text are one node. Signatures are cut into bands; nodes that share
a band's value share a bucket. In every bucket all nodes are compared with one
centre, chosen by hash and so another one in each band. What is linked hangs
together as a part (connected components by contraction, every round written to
the shared folder). Buckets whose nodes are still of several parts are open. The
nodes of open buckets are then joined exactly, by prefixes: with the elements of
every text (shingles, a repeated one once for each time) in one order, rarest
first, two texts of similarity t share one of the first n - t n + 1 of each, and
the shorter one has it among its first n - 2 t / (1 + t) n + 1. So a node makes a
row for each element of its prefix, which are its rare ones, and however large a
bucket is, what all its texts have in common makes no pairs; the rest is weighed
by where in both texts the shared element stands. Of the pairs that this leaves
between parts, first a forest is compared, likeliest pairs first, so that near
copies of one another become one part by as many comparisons as they are; then,
with the parts that this gives, all pairs between parts are. A comparison is
exact: weighted Jaccard of all shingles of both whole texts.

Defined cases: null counts as empty; a text of one to four words has one shingle
of all its words; wordless texts have none and are near no other text, but
equal texts are always of one class; the class id is the least doc_id of the
class (null if it has only null ids); texts of any length are taken whole; rows
are answered one by one, so repeated rows each get their class; other columns are
ignored by ``near_duplicates`` and kept by ``one_of_each``, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, chosen_rows, portions
from .decontam import words

SHINGLE = 5
SIMILARITY = 0.8
#: Coordinates of a signature, and rows of a band: two texts at the threshold miss all 16 bands once in 4,500.
K, ROWS = 64, 4
BANDS = K // ROWS
#: Darts thrown per text at first: K ln K + 2 K leave a coordinate empty in one text of seven.
DARTS = int(K * np.log(K) + 2 * K)
#: Members compared with one copy of a centre's text in one group; hot centres are dealt to several groups.
GROUP = 256
#: Rows of one element's prefix table that meet in one piece of work, twice.
BLOCK = 256
#: Slots of the table of element frequencies, which is sent to all executors. Elements that share one are only ordered worse.
SLOT_BITS = 18
#: Words whose hashes a worker keeps; at the bound it starts anew.
CACHE_WORDS = 200_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_cdfs: dict[float, np.ndarray] = {}


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(text: str | None, hashes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the shingles of a text."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = min(SHINGLE, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s = mix(s * _GOLD + h[i : len(h) - n + 1 + i])
    return np.unique(s, return_counts=True)


def _poisson_cdf(area: float) -> np.ndarray:
    if area not in _cdfs:
        n = np.arange(int(area + 12 * np.sqrt(area) + 24))
        log_p = n * np.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(np.maximum(n[1:], 1)))])
        _cdfs[area] = np.cumsum(np.exp(log_p))
    return _cdfs[area]


#: Rank bands begin at 0 and then double from this rank on; weight bands are [0, 1), [1, 2), [2, 4), [4, 8) ...
_LEAST_RANK = -8


def darts(element: np.ndarray, weight: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into element, rank, dart hash) of all darts with weight under weight and rank under reach."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nu = 0
    while (low_w := 0.0 if nu == 0 else 2.0 ** (nu - 1)) < (weight.max() if len(weight) else 0):
        width_w, rho = (1.0 if nu == 0 else low_w), 0
        some = np.flatnonzero(weight > low_w)
        while len(some):
            low_r = 0.0 if rho == 0 else 2.0 ** (_LEAST_RANK + rho - 1)
            some = some[reach[some] > low_r]
            if not len(some):
                break
            width_r = 2.0**_LEAST_RANK if rho == 0 else low_r
            cell = mix(element[some] ^ mix(np.array([(nu << 32) + rho + 1], np.uint64) * _GOLD))
            n = np.searchsorted(_poisson_cdf(width_w * width_r), unit(cell), "right")
            hit = np.flatnonzero(n)
            n = n[hit]
            at = np.repeat(some[hit], n)
            serial = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(np.repeat(cell[hit], n) + (serial.astype(np.uint64) + np.uint64(1)) * _GOLD)
            rank = low_r + width_r * unit(mix(dart ^ _M1))
            keep = rank < reach[at]
            if nu:
                keep &= low_w + width_w * unit(mix(dart ^ _M2)) < weight[at]
            elif (weight[at] < 1).any():
                keep &= unit(mix(dart ^ _M2)) < weight[at]
            out.append((at[keep], rank[keep], dart[keep]))
            rho += 1
        nu += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of K dart hashes for each weighted set (zeros for an empty one)."""
    sig = np.zeros((len(sets), K), np.uint64)
    todo = np.array([i for i, (h, _) in enumerate(sets) if len(h)], np.int64)
    thrown = float(DARTS)
    while len(todo):
        sizes = np.array([len(sets[i][0]) for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        element = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        total = np.bincount(owner, weight, len(todo))
        at, rank, dart = darts(element, weight, thrown / total[owner])
        slot = owner[at] * K + (mix(dart) % np.uint64(K)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        found = np.zeros(len(todo) * K, np.uint64)
        found[slot[order]] = dart[order] | np.uint64(1)  # the last one written is the dart of least rank
        found = found.reshape(-1, K)
        full = (found != 0).all(axis=1)
        sig[todo[full]] = found[full]
        todo, thrown = todo[~full], thrown * 2
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """A row of BANDS values for each signature."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sig), b + 1, np.uint64) * _GOLD
        for j in range(b * ROWS, (b + 1) * ROWS):
            x = mix(x ^ sig[:, j]) + _GOLD
        out[:, b] = x
    return out.view(np.int64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle counts."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum()) if len(both) else 0
    most = int(a[1].sum() + b[1].sum()) - least
    return least / most if most else 0.0


def node_of(text: Column) -> Column:
    """128 bits of the text: equal texts are one node."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sign(texts: DataFrame) -> DataFrame:
    """doc_id, node, weight, bands of (doc_id, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for whole in batches:
            for b in portions(whole, 2):
                nodes = b.column(1).to_pylist()
                first = {n: i for i, n in reversed(list(enumerate(nodes)))}
                at = sorted(first.values())
                sets = [shingles(b.column(2)[i].as_py(), hashes) for i in at]
                sig = signatures(sets)
                row = {nodes[i]: k for k, i in enumerate(at)}
                back = np.array([row[n] for n in nodes])
                weight = np.array([int(c.sum()) for _, c in sets], np.int64)
                ends = lambda n: np.arange(0, (len(nodes) + 1) * n, n, dtype=np.int32)
                listed = lambda x: pa.ListArray.from_arrays(ends(x.shape[1]), pa.array(x[back].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(weight[back]), listed(bands(sig))],
                    ["doc_id", "node", "weight", "bands"],
                )

    return texts.mapInArrow(run, "doc_id long, node binary, weight long, bands array<long>")


def _with_centre(steps: Steps, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The similar ones of pairs (a, b): a's text meets the texts of its partners in groups of bounded size."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / GROUP).cast("int").alias("groups"))
    groups = steps.written(counts, "centres")  # then the join below meets two plain scans, and a hot centre's side can be split
    sized = pairs.join(groups, "a")
    group = F.pmod(F.xxhash64("b"), F.col("groups")).cast("int")
    members = sized.select(F.col("b").alias("of"), F.col("a").alias("centre"), group.alias("grp"), F.lit(1).alias("kind"))
    centres = groups.select(F.col("a").alias("of"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), F.lit(0).alias("kind"))
    wanted = steps.written(members.unionByName(centres), "comparisons")
    dealt = (
        texts.join(wanted, F.col("node") == F.col("of"))
        .select("centre", "grp", "kind", "node", "text")
        .repartition("centre", "grp")
        .sortWithinPartitions("centre", "grp", "kind")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, centre, own = _WordHashes(), None, None
        for b in batches:
            left, right = [], []
            for i in range(b.num_rows):
                key = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if b.column(2)[i].as_py() == 0:
                    if key != centre:
                        centre, own = key, shingles(b.column(4)[i].as_py(), hashes)
                elif jaccard(own, shingles(b.column(4)[i].as_py(), hashes)) >= SIMILARITY:
                    left.append(key[0])
                    right.append(b.column(3)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return steps.written(dealt.mapInArrow(run, "a binary, b binary"), "links")


def elements(text: str, hashes: dict[bytes, int]) -> np.ndarray:
    """The shingles of a text as a set: of one that stands there k times, k different elements."""
    h, c = shingles(text, hashes)
    if not len(h) or c.max() == 1:
        return h
    nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    each = np.repeat(h, c)
    return np.where(nth == 0, each, mix(each + nth.astype(np.uint64) * _GOLD))


def _slot(e: np.ndarray) -> np.ndarray:
    return (e >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How many elements of the texts fall into each slot: a table of fixed size, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            for t in b.column(0):
                seen += np.bincount(_slot(elements(t.as_py(), hashes)), minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["slot", "n"])

    counts = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << SLOT_BITS, np.int64)
    table[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    return table


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Elements that sets of these sizes share at least if they are similar."""
    return np.ceil(SIMILARITY / (1 + SIMILARITY) * (a + b) - 1e-9)


PREFIX = "element long, node binary, size long, at long, short boolean, sketch binary"
#: Four bits each of the least element in so many classes of elements: only says which pairs are compared first.
SKETCH = 64


def _sketch(e: np.ndarray) -> bytes:
    ordered = np.sort(e)
    slots, at = np.unique((ordered % np.uint64(SKETCH)).astype(np.int64), return_index=True)
    nibbles = np.zeros(SKETCH, np.uint8)
    nibbles[slots] = (ordered[at] >> np.uint64(8)).astype(np.uint8) & 15
    return (nibbles[0::2] | nibbles[1::2] << 4).tobytes()


def _prefixes(texts: DataFrame) -> DataFrame:
    """PREFIX rows of texts (node, text): elements of every prefix, where they stand in it, and whether the shorter of two similar texts could first share one there."""
    table = texts.sparkSession.sparkContext.broadcast(_frequencies(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for whole in batches:
            for b in portions(whole, 1):
                rows: list[tuple[np.ndarray, int, int, bytes]] = []
                for t in b.column(1):
                    e = elements(t.as_py(), hashes)
                    n = len(e)
                    order = np.lexsort((e, table.value[_slot(e)]))[: n - ceil(SIMILARITY * n - 1e-9) + 1]
                    rows.append((e[order], n, n - int(overlap(np.int64(n), np.int64(n))) + 1, _sketch(e)))
                lengths = [len(r[0]) for r in rows]
                back = pa.array(np.repeat(np.arange(len(rows)), lengths))
                at = np.concatenate([np.arange(n) for n in lengths])
                size, short = (pa.array([r[k] for r in rows], pa.int64()).take(back) for k in (1, 2))
                sketch = pa.array([r[3] for r in rows], pa.binary()).take(back)
                found = np.concatenate([r[0] for r in rows]).view(np.int64)
                arrays = [pa.array(found), b.column(0).take(back), size, pa.array(at), pa.array(at < short.to_numpy()), sketch]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PREFIX.split(", ")])

    return texts.select("node", "text").mapInArrow(run, PREFIX)


def _shared(steps: Steps, prefixes: DataFrame) -> DataFrame:
    """The rows of elements that several prefixes share, and a shorter text early enough; most elements are in one text alone."""
    counts = prefixes.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("short"))
    useful = counts.filter("n > 1 AND short").select(F.col("element").alias("key"))
    return steps.written(prefixes.join(useful, F.col("element") == F.col("key"), "left_semi"), "shared-prefixes")


def _prefix_pairs(steps: Steps, prefixes: DataFrame, label: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of nodes of different parts that may be similar: all, or of each piece of work a forest. label (node, part)."""
    part = label.select(F.col("node").alias("of"), F.xxhash64("part").alias("part"))
    rows = prefixes.join(part, F.col("node") == F.col("of")).drop("of")
    shared = rows.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("p"), F.max("part").alias("q"), F.max("short").alias("short"))
    open_ = steps.written(shared.filter("p != q AND short").select(F.col("element").alias("key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "shared-elements")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = rows.join(open_, F.col("element") == F.col("key")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["own", "node", "part", "size", "at", "short", *(["sketch"] if forest else [])]
    dealt = (
        met.select("element", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *columns)
        .repartition("element", "lo", "hi")
        .sortWithinPartitions("element", "lo", "hi")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = tuple(b.column(j)[b.num_rows - 1].as_py() for j in range(3))
            same = np.ones(b.num_rows, bool)
            for j in range(3):
                same &= b.column(j).to_numpy(zero_copy_only=False) == last[j]
            start = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if start or (held and tuple(held[-1].column(j)[0].as_py() for j in range(3)) != last):
                yield _near(pa.Table.from_batches([*held, b.slice(0, start)]))
                held = []
            held.append(b.slice(start))
        if held:
            yield _near(pa.Table.from_batches(held))

    return steps.written(dealt.mapInArrow(run, "a binary, b binary").distinct(), "prefix-pairs")


def _near(t: pa.Table) -> pa.RecordBatch:
    """Pairs within whole groups of rows that are sorted by (element, lo, hi); if there are sketches, a forest of them over the parts."""
    column = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    element, lo, hi, own, part, size, at, short = map(column, ("element", "lo", "hi", "own", "part", "size", "at", "short"))
    n = len(element)
    new = np.ones(n, bool)
    new[1:] = (element[1:] != element[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    group = np.cumsum(new)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, step = np.arange(n), 1
    while len(i := i[i + step < n]) and len(i := i[group[i] == group[i + step]]):
        j = i + step
        keep = (part[i] != part[j]) & (short[i] | short[j]) & ((lo[i] == hi[i]) | (own[i] != own[j]))
        x, y = i[keep], j[keep]
        reach = np.minimum(size[x] - at[x], size[y] - at[y])
        fits = (np.minimum(size[x], size[y]) >= SIMILARITY * np.maximum(size[x], size[y]) - 1e-9) & (reach >= overlap(size[x], size[y]))
        left.append(x[fits])
        right.append(y[fits])
        step += 1
    x, y = np.concatenate(left), np.concatenate(right)
    if "sketch" in t.column_names and len(x):
        chosen = _forest(part, np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(n, -1), x, y)
        x, y = x[chosen], y[chosen]
    nodes = t.column("node").combine_chunks()
    ends = zip(*(nodes.take(pa.array(k)).to_pylist() for k in (x, y)))
    ordered = [sorted(p) for p in ends]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in ordered], pa.binary()) for k in (0, 1)], ["a", "b"])


def _forest(part: np.ndarray, sketch: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[int]:
    """Which of the pairs join parts that no likelier pair has joined."""
    alike = np.concatenate([((a := sketch[x[k : k + 4096]] ^ sketch[y[k : k + 4096]]) & 15 == 0).sum(axis=1) + (a >> 4 == 0).sum(axis=1) for k in range(0, len(x), 4096)])
    root: dict[int, int] = {}

    def find(p: int) -> int:
        while (q := root.get(p, p)) != p:
            root[p] = p = root.get(q, q)
        return p

    out = []
    of_x, of_y = part[x].tolist(), part[y].tolist()
    for k in np.argsort(-alike, kind="stable").tolist():
        a, b = find(of_x[k]), find(of_y[k])
        if a != b:
            root[b] = a
            out.append(k)
    return out


def components(steps: Steps, links: DataFrame) -> DataFrame:
    """node, part: the parts that hang together by links (a, b); part is one of their nodes.

    In every round each node takes the least node within two steps, and the links
    are redrawn between what was taken; loops and repeats fall out, so that a round
    has a fraction of the links of the one before.
    """
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = steps.written(links.select(*ends).filter("a <> b").distinct(), "edges")
    label = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("near"))
        step = steps.written(both.join(steps.written(near, "near"), "b").groupBy("a").agg(F.min("near").alias("to")).withColumnRenamed("a", "node"), "steps")
        if label is None:
            label = step.select("node", F.col("to").alias("part"))
        else:
            on = step.select(F.col("node").alias("part"), "to")
            label = steps.written(label.join(on, "part", "left").select("node", F.coalesce("to", "part").alias("part")), "parts")
        redrawn = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = steps.written(redrawn.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a <> b").distinct(), "edges")
        if edges.limit(1).count() == 0:
            return label


def _linked(steps: Steps, label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, part) with the parts put together that links (a, b) of nodes join."""
    part_of = lambda end, name: label.select(F.col("node").alias(end), F.col("part").alias(name))
    joined = components(steps, links.join(part_of("a", "pa"), "a").join(part_of("b", "pb"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    whole = joined.select(F.col("node").alias("part"), F.col("part").alias("whole"))
    return steps.written(label.join(whole, "part", "left").select("node", F.coalesce("whole", "part").alias("part")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size (rows), text_copies (rows with the same text)."""
    signed, classes = _classed(docs, id_col, text_col)
    found = signed.select("doc_id", "node").join(classes, F.col("node") == F.col("of"))
    return found.select("doc_id", "class_id", "class_size", "text_copies")


def _classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(signed rows; of, class_id, class_size, text_copies, leads: whether the node stands for its class)."""
    steps = Steps(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = plain.select("doc_id", node_of(F.col("text")).alias("node"), "text")
    signed = steps.written(sign(texts), "signatures")
    reps = steps.written(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("text_copies")), "nodes")
    #: One row of every node stands for it. (Rows repeated whole stand twice, which makes no new link.)
    stands = (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    own = signed.filter("weight > 0").join(reps.select(F.col("node").alias("of"), "rep"), stands).drop("of", "rep")
    exploded = own.select("node", F.explode("bands").alias("bucket"))
    order = F.xxhash64("node", "bucket")
    centre = exploded.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "node")).alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = steps.written(centre.select(F.col("bucket").alias("key"), F.col("c.node").alias("centre")), "buckets")
    inside = steps.written(exploded.join(buckets, F.col("bucket") == F.col("key")).select("bucket", "node", "centre"), "bucket-members")
    first = steps.written(inside.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    compared = inside.select(F.col("node").alias("of")).distinct().join(reps.select(F.col("node").alias("of"), "rep"), "of")
    some = steps.written(texts.join(compared, stands).select("node", "text").dropDuplicates(["node"]), "compared-texts")
    label = _linked(steps, steps.written(some.select("node", F.col("node").alias("part")), "labels"), _with_centre(steps, some, first))
    labelled = inside.select("bucket", "node").join(label, "node")
    open_keys = labelled.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select(F.col("bucket").alias("key"))
    loose = inside.join(open_keys, F.col("bucket") == F.col("key"), "left_semi").select(F.col("node").alias("of")).distinct()
    open_texts = steps.written(some.join(loose, F.col("node") == F.col("of"), "left_semi"), "open-texts")
    prefixes = _shared(steps, steps.written(_prefixes(open_texts), "prefixes"))
    for forest in (True, False):
        label = _linked(steps, label, _with_centre(steps, some, _prefix_pairs(steps, prefixes, label, forest)))
    placed = reps.join(label, "node", "left").select("node", "rep", "text_copies", F.coalesce("part", "node").alias("part"))
    placed = steps.written(placed, "placed")
    classes = placed.groupBy("part").agg(F.min("rep").alias("class_id"), F.sum("text_copies").alias("class_size"), F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("lead"))
    known = steps.written(placed.join(classes, "part").select(F.col("node").alias("of"), "class_id", "class_size", "text_copies", (F.col("node") == F.col("lead.node")).alias("leads")), "classes")
    steps.over(signed, known)
    return signed, known


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every class, with all columns: that of its least id. Ids may be null or repeated; of rows that repeat both id and text one stays."""
    signed, classes = _classed(docs)
    led = classes.filter("leads").select("of", "class_id")
    stay = signed.join(led, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    keys = {"node": node_of(F.coalesce(docs["text"].cast("string"), F.lit(""))), "doc_id": docs["doc_id"].cast("long")}
    return chosen_rows(docs, keys, stay)
