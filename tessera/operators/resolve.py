"""Constant-free cuts, vector routing and neighbourhood statistics.

signal_end splits ranked scores in two by the greatest between-class share of
the variance (eta squared) and keeps the leading group only if that share beats
the one of a uniform ramp of the same length. Everything is window sums over one
list of scores; lists are short (hits, readings), keyed and independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors in a block of a cosine search.
QUERY_BLOCK, HELD_BLOCK = 4_000, 20_000


def _eta(df: DataFrame, key: str, x: str, rank: str, n: Column) -> DataFrame:
    """(key, k, eta2) for every split after the k-th value; a variance within rounding of null gives no split."""
    run = W.partitionBy(key).orderBy(rank).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(key)
    s = df.withColumn("_n", n.over(whole)).withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(rank))).withColumn("_s", F.sum(x).over(run)).withColumn("_t", F.sum(x).over(whole)).withColumn("_q", F.sum(F.col(x) * F.col(x)).over(whole))
    total = F.col("_q") - F.col("_t") * F.col("_t") / F.col("_n")
    mean_gap = F.col("_s") / F.col("_k") - (F.col("_t") - F.col("_s")) / (F.col("_n") - F.col("_k"))
    between = F.col("_k") * (F.col("_n") - F.col("_k")) / F.col("_n") * mean_gap * mean_gap
    return s.filter(F.col("_k") < F.col("_n")).select(key, F.col("_k").alias("k"), F.col("_n").alias("n"), F.when(total > 1e-12 * F.col("_q"), between / total).alias("eta2"))


def ramp_eta(n: Column) -> Column:
    """The greatest eta squared of the ramp n, n - 1, ..., 1, over all splits."""
    def at(k: Column) -> Column:
        # means of the two parts of a ramp differ by n / 2 whatever the split is
        x = n.cast("double")
        return k * (x - k) / x * (x / 2) * (x / 2) / (x * (x * x - 1) / 12)

    return F.array_max(F.transform(F.sequence(F.lit(1), n - 1), lambda k: at(k.cast("double"))))


def signal_end(scores: DataFrame, key: str, score: str, ident: str) -> DataFrame:
    """(key, n, k, eta2, null_eta2, separated): how many leading values are signal.

    Of one value, or of two, nothing is measured (separated null, all kept); a
    split that does not beat the ramp keeps all.
    """
    ranked = scores.select(key, F.col(score).cast("double").alias("x"), ident).withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("x"), ident)))
    sizes = ranked.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n"))
    best = _eta(ranked, key, "x", "_r", F.count(F.lit(1))).groupBy(key).agg(F.max(F.struct(F.col("eta2"), (-F.col("k")).alias("neg"))).alias("b"))
    got = sizes.join(best, key, "left").withColumn("null_eta2", F.when(F.col("n") >= 3, ramp_eta(F.col("n"))))
    separated = F.when((F.col("n") >= 3) & F.col("b.eta2").isNotNull(), F.round(F.col("b.eta2"), 12) > F.round(F.col("null_eta2"), 12))
    return got.select(key, "n", F.when(separated, -F.col("b.neg")).otherwise(F.col("n")).alias("k"), F.col("b.eta2").alias("eta2"), "null_eta2", separated.alias("separated"))


def signal_of_counts(scores: DataFrame, keys: list[str], score: str, count: str) -> DataFrame:
    """(keys, n, separated) as of ``signal_end``, of values that stand for as many as their count: the best split never parts equal values, since between two of their ends the share is convex."""
    each = scores.groupBy(*keys, F.col(score).cast("double").alias("_x")).agg(F.sum(count).alias("_w"))
    whole = W.partitionBy(*keys)
    run = whole.orderBy(F.desc("_x")).rowsBetween(W.unboundedPreceding, W.currentRow)
    wx = F.col("_w") * F.col("_x")
    s = each.select("*", F.sum("_w").over(run).alias("_k"), F.sum("_w").over(whole).alias("_n"), F.sum(wx).over(run).alias("_s"), F.sum(wx).over(whole).alias("_t"), F.sum(wx * F.col("_x")).over(whole).alias("_q"))
    total = F.col("_q") - F.col("_t") * F.col("_t") / F.col("_n")
    gap = F.col("_s") / F.col("_k") - (F.col("_t") - F.col("_s")) / (F.col("_n") - F.col("_k"))
    eta2 = F.when((F.col("_k") < F.col("_n")) & (total > 1e-12 * F.col("_q")), F.col("_k") * (F.col("_n") - F.col("_k")) / F.col("_n") * gap * gap / total)
    got = s.withColumn("_eta2", eta2).groupBy(*keys).agg(F.max("_n").cast("int").alias("_n"), F.max("_eta2").alias("_eta2"))
    half = F.floor(F.col("_n") / 2).cast("double")  # where a ramp's share is greatest
    ramp = 3 * half * (F.col("_n") - half) / (F.col("_n").cast("double") * F.col("_n") - 1)
    return got.select(*keys, F.col("_n").alias("n"), F.when((F.col("_n") >= 3) & F.col("_eta2").isNotNull(), F.round("_eta2", 12) > F.round(ramp, 12)).alias("separated"))


def leading(scores: DataFrame, key: str, score: str, ident: str) -> DataFrame:
    """The rows of each list that are signal, with their rank from 0. Lists of one key each: hits, readings, the concepts of one question."""
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), ident)) - 1
    ends = signal_end(scores, key, score, ident).select(F.col(key).alias("_key"), F.col("k").alias("_k"))
    return scores.withColumn("rank", r).join(ends, F.col(key) == F.col("_key")).filter(F.col("rank") < F.col("_k")).drop("_key", "_k")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """A vector of length 1; null for a zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


#: Anchors of cells, at most: they are sent to all.
MOST_ANCHORS = 4_096


def cells(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """vectors (id, vec) with cell, the nearest anchor by cosine, ties to the least cell. Every row finds its own; anchors (cell, anchor) are sent to all, at most MOST_ANCHORS."""
    held = anchors.select("cell", unit(F.col("anchor")).alias("u")).orderBy("cell").limit(MOST_ANCHORS + 1).collect()
    if len(held) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    kind = dict(anchors.dtypes)["cell"]
    names = [r[0] for r in held]
    shared = vectors.sparkSession.sparkContext.broadcast(np.array([r[1] for r in held], float))

    @F.pandas_udf("int")
    def nearest(vs: pd.Series) -> pd.Series:
        m = np.array(vs.tolist(), float)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return pd.Series(np.round(m / np.where(length > 0, length, 1) @ shared.value.T, 9).argmax(axis=1).astype(np.int32))

    which = F.array(*[F.lit(n) for n in names]).cast(f"array<{kind}>")
    return vectors.withColumn("cell", F.get(which, nearest("vec")))


def probed_top(queries: DataFrame, held: DataFrame, anchors: DataFrame, k: int, nprobe: int) -> DataFrame:
    """top_by_cosine over the nprobe cells nearest to each query only: (query_id, id, score, rank); held (id, vec)."""
    near = queries.select("query_id", "qvec").crossJoin(F.broadcast(anchors.limit(MOST_ANCHORS)))
    best = W.partitionBy("query_id").orderBy(F.desc("s"), "cell")
    probes = near.withColumn("s", F.round(dot(unit(F.col("qvec")), unit(F.col("anchor"))), 9)).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= nprobe)
    hits = probes.select("query_id", "qvec", "cell").join(cells(held, anchors), "cell")
    scored = hits.withColumn("score", F.round(dot(unit(F.col("qvec")), unit(F.col("vec"))), 6))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("query_id", "id", "score", (F.col("nth") - 1).alias("rank"))


def top_by_cosine(queries: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): per query the k nearest of all held vectors by cosine; ties by id, vectors without a cosine last. queries (query_id, qvec); held (id, vec).

    Every block of queries meets every block of held vectors in a task of its
    own, which gives the k best of that block, so no row is made per pair.
    """
    n_q, n_h = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (held, HELD_BLOCK)))
    deal = lambda ident, n: F.pmod(F.xxhash64(ident), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", unit(F.col("qvec")).alias("q"), deal("query_id", n_q).alias("qb"), every(n_h).alias("hb"))
    h = held.select("id", unit(F.col("vec")).alias("v"), deal("id", n_h).alias("hb"), every(n_q).alias("qb"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id")
        out = {"query_id": [], "id": [], "score": []}
        ids = right["id"].to_numpy()
        width = next((len(v) for v in [*left["q"], *right["v"]] if v is not None), 1)
        matrix = lambda vs: np.array([np.full(width, np.nan) if v is None else v for v in vs], float).reshape(-1, width)
        names, x, y = left["query_id"].to_numpy(), matrix(left["q"]), matrix(right["v"]).T
        for at in range(0, len(x) if len(ids) else 0, 256):
            s = np.round(x[at : at + 256] @ y, 6)
            s[np.isnan(s)] = -2
            rows = np.arange(len(s))
            for _ in range(min(k, len(ids))):
                j = s.argmax(axis=1)  # the first of equal ones, so the least id
                out["query_id"].append(names[at : at + 256])
                out["id"].append(ids[j])
                out["score"].append(np.where(s[rows, j] < -1.5, np.nan, s[rows, j]))
                s[rows, j] = -3
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    kinds = [f"{n} {dict(df.dtypes)[n]}" for df, n in ((q, "query_id"), (h, "id"))]
    near = q.groupBy("qb", "hb").cogroup(h.groupBy("qb", "hb")).applyInPandas(best, f"{kinds[0]}, {kinds[1]}, score double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = near.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).withColumn("nth", nth).filter(F.col("nth") <= k)
    return ranked.withColumn("rank", F.col("nth") - 1).drop("nth")


def belonging(frames: DataFrame, key: str, ident: str, vec: str) -> DataFrame:
    """(key, ident, agreement, z): each row's mean squared cosine with the other rows of its frame, against those of all rows. Frames of under four rows, or without spread, read null."""
    v = frames.select(key, ident, unit(F.col(vec)).alias("v"))
    a, b = v.select(key, F.col(ident).alias("i"), F.col("v").alias("x")), v.select(key, F.col(ident).alias("j"), F.col("v").alias("y"))
    each = a.join(b, key).filter("i <> j").groupBy(key, "i").agg(F.avg(F.pow(dot(F.col("x"), F.col("y")), 2)).alias("agreement"), (F.count(F.lit(1)) + 1).alias("n"))
    w = W.partitionBy(key)
    spread = F.stddev_pop("agreement").over(w)
    z = F.when((F.col("n") >= 4) & (spread > 1e-12), (F.col("agreement") - F.avg("agreement").over(w)) / spread)
    return each.select(key, F.col("i").alias(ident), "agreement", z.alias("z"))


def monotone_hull(curve: DataFrame, key: str, lag: str, value: str) -> DataFrame:
    """(key, lag, hull, clipped): the greatest value clipped to [0, 1] at this or any later lag, and whether clipping changed the value."""
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value)))
    later = W.partitionBy(key).orderBy(lag).rowsBetween(W.currentRow, W.unboundedFollowing)
    return curve.select(key, lag, F.max(clip).over(later).alias("hull"), (clip != F.col(value)).alias("clipped"))


def hash_embed(dim: int):
    """Signed feature hashing of blank-separated words into unit vectors, Arrow-batched.

    A text whose words cancel in every place (two words of one place and opposite
    signs, say) is hashed without signs, so that only a text of no words is zero.
    """
    import hashlib

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, tuple[int, float]] = {}
        for texts in parts:
            out = []
            for t in texts:
                v, at = np.zeros(dim), np.zeros(dim)
                for w in (t or "").lower().split():
                    if w not in places:
                        if len(places) > 200_000:
                            places.clear()
                        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                        places[w] = int.from_bytes(h[:4], "big") % dim, 1.0 if h[4] & 1 else -1.0
                    i, sign = places[w]
                    v[i] += sign
                    at[i] += 1.0
                v = v if v.any() else at
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return embed


def gram(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, n, i, j, xx): sums of products of elements, i <= j: a covariance that merges by adding."""
    e = vectors.select(key, F.transform(vec, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b["i"] >= a["i"]), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["x"] * b["x"]).alias("p")))))
    return e.select(key, F.explode(pairs).alias("p")).groupBy(key, F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("p.p").alias("xx"), F.count(F.lit(1)).alias("n"))


def frame_reads(frames: DataFrame, key: str, order: str, vec: str) -> DataFrame:
    """Per frame: rows, focus (share of the first singular value's energy), coherence (first eigenvalue's share of the row correlation), resolvable modes, residual noise edge.

    A mode counts if its eigenvalue of the feature correlation exceeds
    (1 + sqrt(F / T)) squared. Unreadable frames (under four rows, under two
    features, or all zero) read null.
    """

    def read(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf.sort_values(order)[vec].tolist(), float)
        t, f = m.shape if m.ndim == 2 else (len(m), 0)
        if t < 4 or f < 2 or not m.any():
            return pd.DataFrame([(k[0], t, None, None, None, None)], columns=[key, "rows", "focus", "coherence", "modes", "edge"])
        s = np.linalg.svd(m, compute_uv=False) ** 2
        rows = m[np.linalg.norm(m, axis=1) > 0]
        rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        own = np.linalg.eigvalsh(rows.T @ rows if len(rows) > f else rows @ rows.T)  # both have the same positive eigenvalues
        z = m - m.mean(axis=0)
        sd = z.std(axis=0)
        z = z[:, sd > 0] / sd[sd > 0]
        edge = (1 + np.sqrt(f / t)) ** 2
        modes = int((np.linalg.svd(z, compute_uv=False) ** 2 / t > edge).sum()) if z.size else 0
        return pd.DataFrame([(k[0], t, s[0] / s.sum(), own[-1] / own.sum(), modes, edge)], columns=[key, "rows", "focus", "coherence", "modes", "edge"])

    kind = dict(frames.dtypes)[key]
    return frames.select(key, order, vec).groupBy(key).applyInPandas(read, f"{key} {kind}, rows int, focus double, coherence double, modes int, edge double")


def absorb(rows: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(absorbed, residual) of rows against the span of basis rows; their energies add up to the input's."""
    if not basis.size:
        return np.zeros_like(rows), rows
    _, s, v = np.linalg.svd(basis, full_matrices=False)
    v = v[s > 1e-9 * s.max()]
    inside = (rows @ v.T) @ v
    return inside, rows - inside


def route_by_coupling(frames: DataFrame, bases: dict[str, list[list[float]]], key: str, order: str, vec: str) -> DataFrame:
    """Per frame, the bases in the order in which each takes the most of what the others left: (key, step, basis, absorbed, residual). bases is a fixed small set."""
    held = {name: np.array(b, float) for name, b in sorted(bases.items())}

    def route(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rest = np.array(pdf.sort_values(order)[vec].tolist(), float)
        left, out = dict(held), []
        floor = np.finfo(float).eps * rest.size * float((rest * rest).sum())
        while left:
            taken = {n: float((absorb(rest, b)[0] ** 2).sum()) for n, b in left.items()}
            name = max(sorted(taken), key=taken.get)
            if taken[name] <= floor:
                break
            _, rest = absorb(rest, left.pop(name))
            out.append((k[0], len(out), name, taken[name], float((rest * rest).sum())))
        return pd.DataFrame(out, columns=[key, "step", "basis", "absorbed", "residual"])

    kind = dict(frames.dtypes)[key]
    return frames.select(key, order, vec).groupBy(key).applyInPandas(route, f"{key} {kind}, step int, basis string, absorbed double, residual double")


def jackknife(values: DataFrame, key: str, x: str) -> DataFrame:
    """(key, n, value, se): the mean and its delete-one standard error; null for under two values."""
    w = W.partitionBy(key)
    loo = values.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("t", F.sum(x).over(w)).withColumn("theta", F.when(F.col("n") >= 2, (F.col("t") - F.col(x)) / (F.col("n") - 1)))
    return loo.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("value"), F.sqrt((F.max("n") - 1) * F.var_pop("theta")).alias("se"))


def mad_whitened(values: DataFrame, key: str, x: str) -> DataFrame:
    """values with white = (x - median) / median absolute deviation; null where there is no deviation."""
    med = values.groupBy(key).agg(F.percentile(x, F.lit(0.5)).alias("med"))
    dev = values.join(med, key).withColumn("dev", F.abs(F.col(x) - F.col("med")))
    mad = dev.groupBy(key).agg(F.percentile("dev", F.lit(0.5)).alias("mad"))
    return dev.join(mad, key).withColumn("white", F.when(F.col("mad") > 0, (F.col(x) - F.col("med")) / F.col("mad")))


def revisions_that_answer(z: DataFrame, root: str, ident: str) -> DataFrame:
    """Of each root's revisions those with its greatest positive z; all of them where none is positive or measured."""
    best = F.max("z").over(W.partitionBy(root))
    return z.withColumn("best", best).filter(F.col("best").isNull() | (F.col("best") <= 0) | (F.col("z") == F.col("best"))).select(root, ident, "z")
