"""BPE encoding and decoding with a public tokenizer file.

A text is cut at the special tokens, normalised, split into words, and every
word is merged: its symbols stand in a doubly linked list, candidate pairs in a
priority queue by (merge rank, position); a popped pair whose symbols have
changed since is stale and skipped. Decoding looks every id up and joins the
vocabulary strings, as the file's missing decoder asks, with one space.

Map-only: one pass over the rows in Arrow batches, no shuffle. The texts of a
portion are cut at blanks at once, every distinct piece is encoded once, and the
results are put together per text by Arrow. The vocabulary (a file of fixed size,
read by path on the executors) and caches of bounded size are all a worker holds.

Defined cases: a null text counts as empty and gives no ids and the empty
decoding; texts of any length are taken whole; repeated rows are answered one
by one; other columns are ignored, whatever their names; an empty table gives an
empty result. The library's tables are of several versions of Unicode; the few
characters on which Python's differ are listed below and treated as it does.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

#: Pieces (texts between blanks) and words that are kept merged per worker; at its bound a cache starts anew, which changes no result.
CACHE_PIECES = 300_000
CACHE_WORDS = 400_000
#: Longer ones are merged each time and not kept.
CACHE_LENGTH = 64
#: Rows and bytes of a portion; a text of more than LONG bytes is encoded by itself, piece after piece.
PORTION_ROWS, PORTION_BYTES, LONG = 1024, 8_000_000, 64_000_000

#: Characters on which the library's Unicode tables differ from this Python's: fixed values.
#: Letters and numbers of later versions, which are symbols to the library.
NO_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE"
    " 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2"
    " 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4"
    " 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Combining marks that the library's normaliser does not know, so that nothing composes or is reordered across them.
NO_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50"
    " 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42"
    " 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
#: Capitals that the library lowers and this Python may not know: first, last, first small letter.
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


def _class(ranges: str) -> str:
    """The ranges as the inside of a character class."""
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())


_LOWER = {c: small + c - first for first, last, small in CAPITALS for c in range(first, last + 1)}
_NO_MARKS = regex.compile(f"([{_class(NO_MARKS)}])")
_ODD = regex.compile(f"[{_class(NO_LETTERS)}{''.join(map(chr, _LOWER))}]")

_loaded: dict[str, "WordBpe"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """Byte -> letter of byte-level BPE: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class WordBpe:
    """The encoder and decoder of one word-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges]
        self.ranks = {a << 20 | b: rank for rank, (a, b, _) in enumerate(pairs)}
        self.made = [c for _, _, c in pairs]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        #: The same for texts with characters that are letters here and not to the library; slower, so used for these alone.
        less = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{_class(NO_LETTERS)}]]")
        for kind in (r"\p{L}", r"\p{N}"):
            less = less.replace(f"[{kind}]", f"[{kind}--[{_class(NO_LETTERS)}]]")
        self.odd_words = regex.compile(f"(?V1){less}").findall
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        letters = byte_letters()
        self.first = [self.vocab[letters[b]] for b in range(256)]
        self.last = [self.vocab[letters[b] + self.suffix] for b in range(256)]
        self.cache: dict[str, tuple[str, str, int]] = {}
        self.word_cache: dict[str, tuple[str, str, int]] = {}

    @staticmethod
    def normalise(text: str) -> str:
        """NFC and lower case letter by letter (a final capital sigma is no special case)."""
        if not text.isascii():
            nfc = lambda s: unicodedata.normalize("NFC", s)
            text = "".join(map(nfc, _NO_MARKS.split(text))) if _NO_MARKS.search(text) else nfc(text)
            text = text.replace("Σ", "σ")
        return text.lower()

    def split(self, piece: str) -> list[str]:
        """The words of a text between blanks, as the library cuts them."""
        text = self.normalise(piece)
        if text.isascii() or not _ODD.search(text):
            return self.words(text)
        return self.odd_words(text.translate(_LOWER))

    def merge(self, word: str) -> list[int]:
        """Ids of a word after all merges.

        A queue entry is rank * 2**32 + position: equal ranks merge from the left,
        and an entry is stale if the pair that now starts there has another rank.
        """
        first, last, ranks, made = self.first, self.last, self.ranks, self.made
        raw = word.encode("utf-8")
        n = len(raw)
        ids = [first[c] for c in raw]
        ids[-1] = last[raw[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << 32 | i for i in range(n - 1) if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            left, j = ids[i], after[i]
            if left < 0 or j >= n or ranks.get(left << 20 | ids[j]) != rank:
                continue
            ids[i] = new = made[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(new << 20 | ids[k])) is not None:
                    heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(ids[h] << 20 | new)) is not None:
                heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> tuple[str, str, int]:
        ids = self.merge(word)
        found = (" ".join(map(str, ids)), " ".join([self.names[i] for i in ids]), len(ids))
        if len(word) <= CACHE_LENGTH:
            if len(self.word_cache) >= CACHE_WORDS:
                self.word_cache.clear()
            self.word_cache[word] = found
        return found

    def entry(self, piece: str) -> tuple[str, str, int]:
        """Ids as text, vocabulary strings and number of tokens of a text between blanks."""
        found = self.cache.get(piece)
        if found is None:
            words, cached = self.split(piece), self.word_cache.get
            parts = [cached(w) or self.word(w) for w in words]
            if len(parts) == 1:
                found = parts[0]
            else:
                found = (" ".join([e[0] for e in parts]), " ".join([e[1] for e in parts]), sum([e[2] for e in parts]))
            if len(piece) <= CACHE_LENGTH:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def forget(self) -> None:
        """Empty the caches. Python workers outlive a task, and what they keep would add up over the stages of a job."""
        self.cache.clear()
        self.word_cache.clear()

    def entries(self, text: str) -> list[tuple[str, str, int]]:
        """Entries of the pieces that have tokens. No word, no composition of letters and no special token crosses a blank."""
        out: list[tuple[str, str, int]] = []
        at = 0
        if self.special and "<" in text:
            for m in self.special.finditer(text):
                out += self.plain(text[at : m.start()])
                out.append((str(self.specials[m[0]]), m[0], 1))
                at = m.end()
        return out + self.plain(text[at:] if at else text)

    def plain(self, text: str) -> list[tuple[str, str, int]]:
        pieces, cached = text.replace("\n", " ").split(" "), self.cache.get
        return [e for p in pieces if (e := cached(p) or self.entry(p))[2]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.entries(text) for i in ids.split(" ") if i]

    def encode_all(self, texts: pa.Array) -> "Encoded":
        """The texts of a portion (none null)."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        pieces = lists.flatten().dictionary_encode()
        cached = self.cache.get
        entries = [cached(p) or self.entry(p) for p in pieces.dictionary.to_pylist()]
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        return Encoded(entries, pieces.indices.to_numpy(zero_copy_only=False), ends)

    def apart(self, texts: pa.Array) -> np.ndarray:
        """Which texts are encoded by themselves: those with a special token, and very long ones."""
        apart = pc.greater(pc.binary_length(texts), LONG)
        for s in self.specials:
            apart = pc.or_(apart, pc.match_substring(texts, s))
        return apart.to_numpy(zero_copy_only=False)

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text of a portion (none null)."""
        apart = self.apart(texts)
        n = np.zeros(len(texts), np.int64)
        if not apart.all():
            n[~apart] = self.encode_all(texts.filter(pa.array(~apart))).n_tokens
        for i in np.flatnonzero(apart):
            n[i] = self.count(texts[i].as_py())
        return n

    def count(self, text: str) -> int:
        return sum(n for _, _, n in self.entries(text))

    def decode(self, ids: list[int]) -> str:
        names = self.names
        return " ".join(names[i] for i in ids if i in names)


class Encoded:
    """The entries of a portion's distinct pieces, and which of them stand in which text."""

    def __init__(self, entries: list[tuple[str, str, int]], codes: np.ndarray, ends: np.ndarray):
        self.entries = entries
        n = np.array([e[2] for e in entries], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        some = n > 0
        self.codes = pa.array(codes[some])
        self.ends = np.concatenate([[0], np.cumsum(some)])[ends].astype(np.int32)
        self.n_tokens = np.diff(np.concatenate([[0], np.cumsum(n)])[ends])

    def joined(self, part: int) -> pa.Array:
        """Per text the ids (0) or the vocabulary strings (1), joined by blanks."""
        said = pa.array([e[part] for e in self.entries], pa.string()).take(self.codes)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.ends), said), " ")

    def ids(self) -> pa.Array:
        """Per text the list of its ids."""
        flat = " ".join([e[0] for e in self.entries if e[2]])
        values = np.fromstring(flat, np.int32, sep=" ") if flat else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum([e[2] for e in self.entries])]).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(starts), pa.array(values)).take(self.codes)
        ends = np.concatenate([[0], np.cumsum(self.n_tokens)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), each.flatten())


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(batch.column(1), "")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, token_ids array<int>, n_tokens long."""
    file = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)

        def out(ids: pa.Array, lists: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, lists, pa.array(n, pa.int64())], ["doc_id", "token_ids", "n_tokens"])

        try:
            for whole in batches:
                for b in portions(whole, 1, PORTION_ROWS, PORTION_BYTES):
                    texts = _texts(b)
                    apart = bpe.apart(texts)
                    if not apart.all():
                        found = bpe.encode_all(texts.filter(pa.array(~apart)))
                        yield out(b.column(0).filter(pa.array(~apart)), found.ids(), found.n_tokens)
                    for i in np.flatnonzero(apart):
                        ids = bpe.encode(texts[i].as_py())
                        yield out(b.column(0).slice(i, 1), pa.array([ids], pa.list_(pa.int32())), np.array([len(ids)]))
        finally:
            bpe.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, token_ids array<int>, n_tokens long"
    )


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """doc_id, text: the vocabulary strings of the ids; null ids count as none, unknown ids give nothing."""
    file = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for b in batches:
            texts = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string"
    )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the round trip in one pass, only its digests kept."""
    file = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        hexed = lambda x: hashlib.sha256(x).hexdigest()

        def out(doc_ids: pa.Array, n, ids: list[str], decoded: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        try:
            for whole in batches:
                for b in portions(whole, 1, PORTION_ROWS, PORTION_BYTES):
                    texts = _texts(b)
                    apart = bpe.apart(texts)
                    if not apart.all():
                        found = bpe.encode_all(texts.filter(pa.array(~apart)))
                        ids, decoded = ([hexed(x.as_buffer()) for x in found.joined(part)] for part in (0, 1))
                        yield out(b.column(0).filter(pa.array(~apart)), found.n_tokens, ids, decoded)
                    for i in np.flatnonzero(apart):
                        each = bpe.entries(texts[i].as_py())
                        ids, decoded = (hexed(" ".join([e[part] for e in each]).encode("utf-8")) for part in (0, 1))
                        yield out(b.column(0).slice(i, 1), [sum([e[2] for e in each])], [ids], [decoded])
        finally:
            bpe.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
