"""Quality classifier learnt from positive and unlabelled texts.

Trusted positives are the texts labelled 1, unlabelled are texts of the whole
corpus. The class prior is estimated from these two alone: a network is fitted to
tell half of the positives from half of the unlabelled; among the texts of the
other halves that score above a threshold, the share of the unlabelled over that
of the positives is at least the prior, and comes nearest to it at the threshold
where that ratio, with its sampling error, is least. A small network is then
fitted to the non-negative unbiased risk

    prior * R+(P)  +  max(0, R-(U) - prior * R-(P))

by mini-batches; where the part in max() turns negative, which it cannot do but
by over-fitting, the step goes against it instead. Texts labelled 0 are no
input of anything. The features are counts and ratios of the whole text; no
label, language, source or id is among them.

Learning reads only rows whose crc32(id as text) mod 5 is not 0, and of those a
bounded sample, the first by hash: POSITIVES positive and UNLABELLED unlabelled
texts. Scoring is one map-only pass over all rows with whole texts.

Defined cases: a null text counts as empty and gets a score like any text; with
no positives or no documents to learn from every score is 0.5; texts of any
length are read whole; repeated rows are scored one by one, and an id counts once
among the texts to learn from; null labels count as unlabelled, and of ids labelled
twice a 1 counts; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that is brought to the driver (as features, some 150 bytes each).
POSITIVES, UNLABELLED = 6000, 12000
THRESHOLD = 0.3
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 60, 256, 0.01, 1e-4, 7
#: Of the sampling error in the estimate of the prior.
CONFIDENCE = 0.1

_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_BLANK = b" \t\n\r\f\v"
_MARKS = b"#$%&*|!<>{}[]=_~^\\/@+"


def features(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8")
    w = text.split()
    n, size = max(1, len(w)), max(1, len(raw))
    without = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    seen = Counter(w)
    lines = text.split("\n")
    pairs = len(set(zip(w, w[1:])))
    lengths = list(map(len, w))
    high = sum(1 for x in seen if x.isupper() and len(x) > 1)
    return [
        np.log1p(len(raw)),
        np.log1p(len(w)),
        sum(lengths) / n,
        sum(1 for x in lengths if x <= 3) / n,
        (max(lengths) if lengths else 0) ** 0.5,
        len(seen) / n,
        (max(seen.values()) if seen else 0) / n,
        pairs / max(1, len(w) - 1),
        high / max(1, len(seen)),
        without(_DIGITS),
        without(_UPPER),
        without(_LOWER),
        without(_BLANK),
        without(_MARKS),
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        raw.count(b".") / n,
        raw.count(b",") / n,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        sum(1 for x in seen if x[-1] in ".,;:!?") / max(1, len(seen)),
        sum(1 for x in seen if not x[-1].isalnum() and x[-1] not in ".,;:!?") / max(1, len(seen)),
    ]


class Network:
    """Standardised features, one hidden layer, one output; fitted to the non-negative risk."""

    def __init__(self, prior: float):
        self.prior = prior
        self.w: list[np.ndarray] | None = None
        self.mean = self.scale = np.zeros(0)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, apart: bool = False) -> "Network":
        """Minimise the non-negative risk; or, to tell positives and unlabelled ``apart``, the plain one of two equal classes."""
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        p, u = self.standard(positive), self.standard(unlabelled)
        rnd = np.random.default_rng(SEED)
        d = p.shape[1]
        w = [rnd.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
        steps = max(1, len(u) // BATCH)
        for _ in range(EPOCHS):
            order, chosen = rnd.permutation(len(u)), rnd.integers(0, len(p), (steps, BATCH))
            for k in range(steps):
                grads = self.slopes(w, p[chosen[k]], u[order[k * BATCH : (k + 1) * BATCH]], apart)
                t += 1
                for i, g in enumerate(grads):
                    g = g + DECAY * w[i]
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    w[i] = w[i] - RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        self.w = w
        return self

    def risk(self, w, xp, xu, apart: bool = False) -> float:
        """The risk that is minimised: sigmoid losses of P as positive, of U and P as negative."""
        sp, su = self._sigmoid(self._out(w, xp)), self._sigmoid(self._out(w, xu))
        if apart:
            return float((1 - sp).mean() + su.mean())
        return float(self.prior * (1 - sp).mean() + max(0.0, su.mean() - self.prior * sp.mean()))

    def slopes(self, w, xp, xu, apart: bool = False) -> list[np.ndarray]:
        """Its gradient; where the part in max() is negative, the step against that part."""
        sp, su = self._sigmoid(self._out(w, xp)), self._sigmoid(self._out(w, xu))
        dp, du = sp * (1 - sp), su * (1 - su)
        if apart:
            at_p, at_u = -dp, du
        elif su.mean() - self.prior * sp.mean() >= 0:
            at_p, at_u = -2 * self.prior * dp, du
        else:
            at_p, at_u = self.prior * dp, -du
        return [a + b for a, b in zip(self._back(w, xp, at_p / len(xp)), self._back(w, xu, at_u / len(xu)))]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    @staticmethod
    def _out(w: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3][0]

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    @staticmethod
    def _back(w: list[np.ndarray], x: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        h = np.tanh(x @ w[0] + w[1])
        gh = np.outer(g, w[2]) * (1 - h * h)
        return [x.T @ gh, gh.sum(axis=0), h.T @ g, np.array([g.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        return self._sigmoid(self._out(self.w, self.standard(x)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from these two samples alone; 0.5 where there are under two of either."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    judge = Network(0.5).fit(positive[::2], unlabelled[::2], apart=True)
    p, u = np.sort(judge.score(positive[1::2])), np.sort(judge.score(unlabelled[1::2]))
    above = lambda x, c: (len(x) - np.searchsorted(x, c)) / len(x)
    cuts = np.unique(p)
    of_p, of_u = above(p, cuts), above(u, cuts)
    error = np.sqrt(np.log(4 / CONFIDENCE) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)
    best = np.argmin((of_u + error) / of_p)
    return float(np.clip(of_u[best] / of_p[best], 0.02, 0.98))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featured(texts: DataFrame) -> np.ndarray:
    """Features of the texts (doc_id, text) of a bounded number of ids, on the driver, in a fixed order; of several texts of one id that of least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "hash", "x"])

    each = texts.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, x array<double>")
    rows = each.groupBy("doc_id").agg(F.min(F.struct("hash", "x")).alias("least")).select("doc_id", "least.x").collect()
    return np.array([r[1] for r in sorted(map(tuple, rows))])


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Network:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = lambda ids: ids.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).distinct()

    def sample(ids: DataFrame, k: int) -> np.ndarray:
        """Ids alone are ordered and cut; a set of bounded size then meets the texts as a broadcast."""
        chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(k).withColumnRenamed("doc_id", "chosen")
        return _featured(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"), "left_semi"))

    p = sample(fold(labels.filter(F.col("quality").cast("int") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))), positives)
    u = sample(fold(texts.select("doc_id")), unlabelled)
    network = Network(class_prior(p, u) if len(p) and len(u) else 0.5)
    return network.fit(p, u) if len(p) and len(u) else network


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                x = np.array([features(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(network.score(x))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    return score(docs, learn(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns; each row by its own text, in one map-only pass."""
    network = learn(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                x = np.array([features(t.as_py()) for t in part.column(at)])
                yield part.filter(pa.array(network.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
