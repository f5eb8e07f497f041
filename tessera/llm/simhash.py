"""Near-duplicate detection with SimHash fingerprints and deletion variants.

A text's fingerprint has 64 bits: a bit is 1 if it is 1 in more than half of the
hashes (XXH64, seed 42) of its shingles of four words. Two fingerprints are linked
if they differ in at most FAR = 4 bits, and the answer is what hangs together.

Equal fingerprints are one node. A fingerprint is cut into three segments: of two
that are linked, one segment differs by at most one bit. So every node is filed
under all variants of its segments with one bit left out, 64 in all; nodes that
share a variant are joined by equality and verified, and a pair is told once for
every segment that brings it together, not once for every bit.

A segment value that more than BUCKET nodes have would make pairs with the square
of their number. Such values, and those one bit beside them, take another exact
way: all their nodes are filed under every value that lies within two bits of
them (2,081 in all). Two fingerprints share one of these exactly if they differ in
at most four bits, so what shares one hangs together without any pairs being
formed; at most 2,081 nodes can share one, and each is linked to the least. What
is filed is thus at most 64 and 2,081 rows a node, however nodes are crowded: with
random fingerprints all nodes take the second way from some 67 million on.

No join sends a table to all: Spark sizes one by its files, and neither the rows
that an explode makes of them nor what compression hides count there.

Defined cases: null counts as empty; a text of one to three words has one shingle
of all its words; wordless texts have fingerprint zero and are linked like any
other; component_id is the least doc_id of the component (null if it has only
null ids); texts of any length are taken whole, their hashes counted in blocks;
rows are answered one by one, so repeated rows each get their component; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, portions
from .minhash import components

SHINGLE, SEED = 4, 42
#: Bits in which linked fingerprints differ at most.
FAR = 4
#: (lowest bit, bits) of the segments: FAR // 3 = 1.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Nodes with one value of a segment that still meet by variants; a variant joins two values.
BUCKET = 32
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII blanks and letters alone
    if not w:
        return 0
    said, n = b" ".join(w), min(SHINGLE, len(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = (ends - np.fromiter(map(len, w), np.int64, len(w)) - 1)[: len(w) - n + 1].tolist()
    stops = (ends - 1)[n - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), BLOCK):
        part = [digest(said[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK])]
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, 1):
                found = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _segment_values(nodes: DataFrame) -> DataFrame:
    """fp, segment, value: three rows a node."""
    cut = F.array(*[F.struct(F.lit(k).alias("segment"), F.expr(f"shiftrightunsigned(fp, {low}) & {(1 << n) - 1}L").cast("int").alias("value")) for k, (low, n) in enumerate(SEGMENTS)])
    return nodes.select("fp", F.explode(cut).alias("s")).select("fp", "s.*")


def _crowded(values: DataFrame, bucket: int) -> DataFrame:
    """segment, value, own: values of more than ``bucket`` nodes (own true), and those one bit beside them."""
    many = values.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("segment", "value")
    width = F.element_at(F.array(*[F.lit(n) for _, n in SEGMENTS]), F.col("segment") + 1)
    beside = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(F.expr("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1), i)).alias("v"), F.lit(False).alias("own")))
    each = many.select("segment", F.explode(F.concat(F.array(F.struct(F.col("value").alias("v"), F.lit(True).alias("own"))), beside)).alias("m"))
    return each.groupBy("segment", F.col("m.v").alias("value")).agg(F.max("m.own").alias("own"))


def variants(values: DataFrame) -> DataFrame:
    """fp, variant: a segment value with one bit left out, and which one, in one number; as many rows as the segment has bits."""
    low = F.element_at(F.array(*[F.lit(a) for a, _ in SEGMENTS]), F.col("segment") + 1)
    width = F.element_at(F.array(*[F.lit(n) for _, n in SEGMENTS]), F.col("segment") + 1)
    one = lambda i: F.call_function("shiftleft", F.lit(1), i)
    left_out = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.col("value").bitwiseAND(F.bitwise_not(one(i))).bitwiseOR(F.call_function("shiftleft", low + i, F.lit(24))))
    return values.select("fp", F.explode(left_out).alias("variant"))


def variant_links(filed: DataFrame) -> DataFrame:
    """a, b: nodes that share a variant and differ in at most FAR bits, of filed (fp, variant)."""
    left, right = filed.select("variant", F.col("fp").alias("a")), filed.select("variant", F.col("fp").alias("b"))
    bit = F.call_function("shiftrightunsigned", F.col("variant"), F.lit(24))
    differs = F.call_function("shiftrightunsigned", F.col("a").bitwiseXOR(F.col("b")), bit).bitwiseAND(F.lit(1)) == 1
    told = bit.isin(*[low for low, _ in SEGMENTS]) | differs  # equal segments share all variants: their first counts
    return left.join(right.hint("merge"), "variant").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= FAR) & told).select("a", "b")


def beside(fp: Column) -> Column:
    """All values within two bits of fp, itself included."""
    one = lambda i: F.when(i < 64, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    two = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform(F.sequence(i + 1, F.lit(64)), lambda j: fp.bitwiseXOR(one(i)).bitwiseXOR(one(j))))
    return F.concat(F.array(fp), F.flatten(two))


def crowd_links(nodes: DataFrame) -> DataFrame:
    """a, b: every node, and the least node of each value within two bits that it shares."""
    filed = nodes.select("fp", F.explode(beside(F.col("fp"))).alias("middle"))
    met = filed.groupBy("middle").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # 2,081 at most
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id."""
    steps = Steps(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = steps.written(sign(plain), "fingerprints")
    nodes = steps.written(signed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    values = steps.written(_segment_values(nodes), "segments")
    crowded = steps.written(_crowded(values, bucket), "crowded")
    placed = steps.written(values.join(crowded.hint("merge"), ["segment", "value"], "left"), "placed")
    few = variant_links(variants(placed.filter("own IS NULL OR NOT own")))
    many = crowd_links(placed.filter("own IS NOT NULL").select("fp").distinct())
    links = steps.written(few.unionByName(many).distinct(), "links")
    label = components(steps, links).select(F.col("node").alias("fp"), "part")
    parts = steps.written(nodes.join(label.hint("merge"), "fp", "left").select("fp", "rep", F.coalesce("part", "fp").alias("part")), "parts")
    least = parts.groupBy("part").agg(F.min("rep").alias("component_id"))
    known = steps.written(parts.join(least.hint("merge"), "part").select("fp", "component_id"), "components")
    steps.over(signed, known)
    return signed.join(known.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def report(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
