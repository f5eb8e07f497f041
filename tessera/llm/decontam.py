"""Benchmark decontamination with a distributed positional inverted index.

Index. The training texts are cut into segments of whole documents; a segment
row holds its own term dictionary and, for every term, the list of token
positions (all terms, all positions). A segment is written where its documents
were read, so building takes no shuffle, and the table serves any number of
benchmarks.

Search. A phrase is looked up in a segment from its rarest term on: that term's
positions, less its offset in the phrase, are the possible starts; each next
rarer term's offset-adjusted list is intersected until no start is left. A
proximity search lets every term stand up to ``slop`` places from where the
phrase would have it.

The phrases of a benchmark item are its windows of ten consecutive words; an
item of fewer words, but not none, is one phrase. A benchmark of up to
``BLOCK_BYTES`` is sent to all segments. A larger one stays distributed: the
terms of the segments are joined with those of the phrases, every phrase is
dealt to the segments that hold its term of least frequency, and each segment
then meets its own phrases, one after the other. Both ways read the index once.

Defined cases: null and wordless texts have no words; texts of any length are
indexed whole; a wordless item never occurs; rows that share an item_id are one
item (a null id counts as the id "null"); documents are answered row by row, so
repeated doc_ids are answered each by itself; other columns are ignored,
whatever their names; empty tables give an empty result, and an empty benchmark
hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, unused, written
from .exact_dedup import digest

WINDOW = 10
#: Tokens after which a segment is closed; a longer document is a segment of its own.
SEGMENT_TOKENS = 2_000_000
#: Positions left free between two documents, so that no phrase or proximity match crosses them.
GAP = 64
#: Bytes of benchmark text that are broadcast; a larger benchmark is joined instead.
BLOCK_BYTES = 4_000_000
#: Rows of a batch that leaves a task.
ROWS = 50_000

#: A-Z lower-cased; every other ASCII character that is no letter or digit is a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
SEGMENT = "segment string, doc_ids array<{id}>, starts binary, lengths binary, terms binary, counts binary, positions binary"
HITS = "doc_id {id}, n_words long, spans array<struct<start:long,stop:long>>, item_ids array<string>"
ARROW = {"long": pa.int64(), "string": pa.string()}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


def _segment(name: str, ids: list, tokens: list[np.ndarray], terms: dict[bytes, int]) -> list:
    lengths = np.array([len(t) for t in tokens], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]]).astype(np.int64)
    term = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
    places = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(term))
    order = np.argsort(term, kind="stable")
    pack = zstandard.ZstdCompressor(level=1).compress
    counts = np.bincount(term, minlength=len(terms)).astype(np.int64)
    return [name, ids, starts.tobytes(), lengths.tobytes(), pack(b" ".join(terms)), pack(counts.tobytes()), pack(places[order].astype(np.int64).tobytes())]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """The index of docs, written to the shared folder: one row per segment. Ids are long or string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), count()
        schema = pa.schema(
            [("segment", pa.string()), ("doc_ids", pa.list_(ARROW[id_type]))]
            + [(n, pa.binary()) for n in ("starts", "lengths", "terms", "counts", "positions")]
        )

        def emit(ids, tokens, terms):
            row = _segment(f"{part}-{next(serial)}", ids, tokens, terms)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        def new():
            return [], [], defaultdict(count().__next__), 0

        ids, tokens, terms, n = new()
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                found = words(text.as_py())
                tokens.append(np.fromiter(map(terms.__getitem__, found), np.int32, len(found)))
                ids.append(doc_id.as_py())
                n += len(found) + 1
                if n >= SEGMENT_TOKENS:
                    yield emit(ids, tokens, terms)
                    ids, tokens, terms, n = new()
        if ids:
            yield emit(ids, tokens, terms)

    texts = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(texts.mapInArrow(run, SEGMENT.format(id=id_type)), "positional-index")


def windows_of(w: list[bytes], window: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """The phrases of an item with these words."""
    for i in range(max(1, len(w) - window + 1)) if w else ():
        yield tuple(w[i : i + window])


def phrases_of(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> dict[tuple[bytes, ...], set[str]]:
    """Every phrase of the items, with the ids of the items that it stands in."""
    out: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item_id, w in items:
        for phrase in windows_of(w, window):
            out[phrase].add(item_id)
    return out


def starts_of(lists: list[np.ndarray], slop: int = 0) -> np.ndarray:
    """Where a phrase begins whose terms have these positions: intersection of offset-adjusted lists, rarest term first.

    With slop, where it could begin so that every term stands within slop of its place.
    """
    order = sorted(range(len(lists)), key=lambda j: len(lists[j]))
    at = lists[order[0]] - order[0]
    if slop:
        at = np.unique((at[:, None] + np.arange(-slop, slop + 1)).ravel())
    for j in order[1:]:
        if not len(at):
            break
        have, want = lists[j], at + j - slop
        k = np.searchsorted(have, want)
        near = have[np.minimum(k, len(have) - 1)]
        at = at[(k < len(have)) & (near <= want + 2 * slop)]
    return at


class Segment:
    """A row of the index, and what has been hit in it."""

    def __init__(self, starts: bytes, lengths: bytes, terms: bytes, counts: bytes, positions: bytes):
        unpack = zstandard.ZstdDecompressor().decompress
        self.starts, self.lengths = np.frombuffer(starts, np.int64), np.frombuffer(lengths, np.int64)
        self.terms, self.counts, self.positions = unpack(terms).split(), np.frombuffer(unpack(counts), np.int64), np.frombuffer(unpack(positions), np.int64)
        self.ends = np.cumsum(self.counts)
        self.edge = np.zeros(int(self.starts[-1] + self.lengths[-1]) + 2, np.int32)
        self.found: dict[int, set] = defaultdict(set)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term] - self.counts[term] : self.ends[term]]

    def mark(self, at: np.ndarray, n: int, slop: int, what: Iterable) -> None:
        """A phrase of n terms begins at these places; the documents that it stands in have found what."""
        if not len(at):
            return
        begin, end = np.maximum(at - slop, 0), at + n + slop
        nth = np.searchsorted(self.starts, np.maximum(at, 0), "right") - 1
        np.add.at(self.edge, np.maximum(begin, self.starts[nth]), 1)
        np.add.at(self.edge, np.minimum(end, self.starts[nth] + self.lengths[nth]), -1)
        for d in np.unique(nth).tolist():
            self.found[d].update(what)

    def spans(self) -> dict[int, list]:
        """Per document the spans of hit words, sorted and apart."""
        hit = np.diff(np.concatenate([[0], (np.cumsum(self.edge) > 0).astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        of = np.searchsorted(self.starts, begins, "right") - 1
        out: dict[int, list] = defaultdict(list)
        for d, x, y in zip(of.tolist(), begins.tolist(), ends.tolist()):
            out[d].append({"start": x - int(self.starts[d]), "stop": y - int(self.starts[d])})
        return out


class Phrases:
    """Phrases by number of their terms, as matrices, so that hopeless ones fall out at once."""

    def __init__(self, phrases: dict[tuple[bytes, ...], set[str]]):
        said = list(phrases)
        self.items = [sorted(phrases[p]) for p in said]
        self.vocab = {t: i for i, t in enumerate(dict.fromkeys(t for p in said for t in p))}
        self.by_length: list[tuple[list[int], np.ndarray]] = []
        lengths = np.array([len(p) for p in said], int)
        for n in sorted(set(lengths.tolist())):
            at = np.flatnonzero(lengths == n).tolist()
            self.by_length.append((at, np.array([[self.vocab[t] for t in said[i]] for i in at], np.int32)))

    def search(self, segment: Segment, slop: int) -> None:
        """Mark all phrases in the segment."""
        lists: list[np.ndarray] = [np.zeros(0, np.int64)] * len(self.vocab)
        for i, t in enumerate(segment.terms):
            if (v := self.vocab.get(t)) is not None:
                lists[v] = segment.postings(i)
        n = np.array([len(x) for x in lists])
        for at, matrix in self.by_length:
            for k in np.flatnonzero(n[matrix].min(axis=1) > 0).tolist():  # phrases all of whose terms the segment has
                segment.mark(starts_of([lists[v] for v in matrix[k].tolist()], slop), matrix.shape[1], slop, self.items[at[k]])


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per indexed document: doc_id, n_words, spans of hit words (sorted), item_ids that they come from (sorted)."""
    if not 0 <= slop < GAP:
        raise ValueError("slop must be under the gap between documents")
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0]
    if size > BLOCK_BYTES:
        return _search_joined(index, items, window, slop)
    return _search_sent(index, Phrases(phrases_of([(r[0], words(r[1])) for r in items.collect()], window)), slop)


def _id_type(index: DataFrame) -> str:
    return "string" if dict(index.dtypes)["doc_ids"] == "array<string>" else "long"


def _search_sent(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    """The phrases, of bounded size, meet every segment where it is."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)
    id_type = _id_type(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, *parts = (b.column(j)[i].as_py() for j in range(6))
                segment = Segment(*parts)
                shared.value.search(segment, slop)
                spans, n = segment.spans(), len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, ARROW[id_type]),
                        pa.array(segment.lengths),
                        pa.array([spans.get(d, []) for d in range(n)], SPANS),
                        pa.array([sorted(segment.found[d]) if d in segment.found else [] for d in range(n)], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "spans", "item_ids"],
                )

    columns = ["doc_ids", "starts", "lengths", "terms", "counts", "positions"]
    return index.select(*columns).mapInArrow(run, HITS.format(id=id_type))


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _said(items: DataFrame, window: int) -> DataFrame:
    """phrase, item_id: every phrase of every item, as its words joined by blanks."""
    schema = pa.schema([("phrase", pa.string()), ("item_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b" ".join(p).decode(), b.column(0)[i].as_py()) for b in batches for i in range(b.num_rows) for p in windows_of(words(b.column(1)[i].as_py()), window))
        yield from _batched(rows, schema)

    return items.mapInArrow(run, "phrase string, item_id string")


def _held_terms(index: DataFrame) -> DataFrame:
    """segment, term, n: the term dictionaries of the segments."""
    schema = pa.schema([("segment", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i in range(b.num_rows):
                name, terms, counts = (b.column(j)[i].as_py() for j in range(3))
                found = zip(repeat(name), unpack(terms).decode().split(), np.frombuffer(unpack(counts), np.int64).tolist())
                yield from _batched(found, schema)

    return index.select("segment", "terms", "counts").mapInArrow(run, "segment string, term string, n long")


def _search_joined(index: DataFrame, items: DataFrame, window: int, slop: int) -> DataFrame:
    """The phrases, of any number, are dealt to the segments that hold their rarest term."""
    steps = Steps(index.sparkSession)
    said = steps.written(_said(items, window).distinct(), "phrases")
    terms = said.select("phrase").distinct().select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("term"))
    held = steps.written(_held_terms(index).join(terms.select("term").distinct(), "term", "left_semi"), "phrase-terms")
    seen = terms.join(held.groupBy("term").agg(F.sum("n").alias("n")), "term", "left")
    rarest = F.min(F.struct("n", "term")).getField("term").alias("term")
    keyed = seen.groupBy("phrase").agg(rarest, F.max(F.col("n").isNull()).alias("hopeless")).filter(~F.col("hopeless")).select("phrase", "term")
    dealt = steps.written(held.select("segment", "term").join(keyed, "term").select("segment", "phrase"), "dealt-phrases")
    parts = ["starts", "lengths", "terms", "counts", "positions"]
    some = index.join(dealt.select("segment").distinct(), "segment", "left_semi").select("segment", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("phrase"), *parts)
    asked = dealt.select("segment", F.lit(1).alias("kind"), "phrase", *[F.lit(None).cast("binary").alias(c) for c in parts])
    met = some.unionByName(asked).repartition("segment").sortWithinPartitions("segment", "kind")
    schema = pa.schema([("segment", pa.string()), ("nth", pa.int64()), ("spans", SPANS), ("phrases", pa.list_(pa.string()))])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        name, segment, at = None, None, {}

        def found() -> Iterator[tuple]:
            spans = segment.spans() if segment else {}
            for d in spans:
                yield name, d, spans[d], sorted(segment.found[d])

        for b in batches:
            for i in range(b.num_rows):
                if b.column(1)[i].as_py() == 0:
                    yield from found()
                    name, segment = b.column(0)[i].as_py(), Segment(*(b.column(j)[i].as_py() for j in range(3, 8)))
                    at = {t: k for k, t in enumerate(segment.terms)}
                else:
                    phrase = b.column(2)[i].as_py()
                    places = [at.get(t) for t in phrase.encode().split()]
                    if None not in places:
                        segment.mark(starts_of([segment.postings(k) for k in places], slop), len(places), slop, [phrase])
        yield from found()

    hit = steps.written(met.mapInArrow(lambda batches: _batched(hits(batches), schema), "segment string, nth long, spans array<struct<start:long,stop:long>>, phrases array<string>"), "hits")
    of = hit.select("segment", "nth", F.explode("phrases").alias("phrase")).join(said, "phrase").groupBy("segment", "nth").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    answers = steps.written(hit.drop("phrases").join(of, ["segment", "nth"]), "hit-documents")
    steps.over(answers)
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return _documents(index).join(answers, ["segment", "nth"], "left").select(
        "doc_id", "n_words", none("spans", "array<struct<start:long,stop:long>>"), none("item_ids", "array<string>")
    )


def _documents(index: DataFrame) -> DataFrame:
    """segment, nth, doc_id, n_words of all indexed documents."""
    id_type = _id_type(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, ids, lengths = (b.column(j)[i].as_py() for j in range(3))
                arrays = [pa.array([name] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, ARROW[id_type]), pa.array(np.frombuffer(lengths, np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["segment", "nth", "doc_id", "n_words"])

    return index.select("segment", "doc_ids", "lengths").mapInArrow(run, f"segment string, nth long, doc_id {id_type}, n_words long")


def n_covered(spans: Column) -> Column:
    """Words under sorted spans that may overlap."""

    def step(so_far: Column, s: Column) -> Column:
        reach = F.greatest(so_far["reach"], s["stop"])
        more = F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(so_far["reach"], s["start"]))
        return F.struct(reach.alias("reach"), (so_far["n"] + more).alias("n"))

    zero = F.lit(0).cast("long")
    return F.aggregate(spans, F.struct(zero.alias("reach"), zero.alias("n")), step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans, item_ids."""
    return search(build_index(docs), benchmark)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = n_covered(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a benchmark window, with all their columns.

    Each row is judged by its own text, so ids may be null or repeated.
    """
    text = digest(docs["text"].cast("string"))
    found = search(build_index(docs.select(text.alias("doc_id"), "text"), id_type="string"), benchmark)
    (bad,) = unused(docs, "_bad_text")
    hit = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(written(hit, "contaminated"), text == F.col(bad), "left_anti")
