"""Fits from merged sums: products that add up over tasks, and what is solved from them once.

``products`` is the one pass: every task adds up n, x, y and x y' of the rows of each
key in one matrix, and gives a row per key and element of x; those are added up per
element. What is shuffled is d rows per key and task, however many rows there are,
and no group of rows is gathered. On these sums stand

* ``alignment``: the least-squares map from one vector space to another, with its
  held-out verdict;
* ``decay``: the linear operator that carries an observation to the next of its
  key, and its fastest and slowest decay;
* ``leading``: the directions of a sparse matrix of rows that carry most, by block
  power iteration, where every product with the matrix is a join and a sum.

Only matrices of the width of a vector, or of the number of directions, come to the
driver. Defined cases: rows with a null, with an element that is null or not finite,
or whose vectors differ in width from ``width`` are left out, and counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.steps import Steps

#: Keys whose sums a task holds at once.
HELD = 256


def products(df: DataFrame, key: str, x: str, y: str, width: int, width_y: int | None = None) -> DataFrame:
    """(key, i, n, x, y, xy): per key and element i of x the rows counted, the sum of that element, the sums of y, and of that element times y."""
    m = width_y or width
    kind = dict(df.dtypes)[key]
    finite = lambda c, n: F.col(c).isNotNull() & (F.size(c) == n) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(key).alias("key"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")).filter("key IS NOT NULL")
    rows = rows.filter(finite("x", width) & finite("y", m))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        of = None

        def told() -> pa.RecordBatch:
            keys, total = list(held), np.stack(list(held.values()))  # key, 1 + x, 1 + y
            each = np.repeat(np.arange(len(keys)), width)
            whole = pa.array(total[each, 0, 0].astype(np.int64))
            lists = lambda a: pa.array(list(a), pa.list_(pa.float64()))
            out = [pa.array(keys, of).take(pa.array(each)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(keys))), whole]
            out += [pa.array(total[:, 1:, 0].ravel()), lists(total[each, 0, 1:]), lists(total[:, 1:, 1:].reshape(-1, m))]
            return pa.RecordBatch.from_arrays(out, ["key", "i", "n", "x", "y", "xy"])

        for b in batches:
            if not b.num_rows:
                continue
            of, one = b.column(0).type, np.ones((b.num_rows, 1))
            left = np.hstack([one, b.column(1).flatten().to_numpy().reshape(-1, width)])
            right = np.hstack([one, b.column(2).flatten().to_numpy().reshape(-1, m)])
            code, keys = pd.factorize(pd.Series(b.column(0).to_pylist(), dtype=object))
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                k = keys[code[part[0]]]
                held[k] = held.get(k, 0) + left[part].T @ right[part]
            if len(held) > HELD:
                yield told()
                held.clear()
        if held:
            yield told()

    parts = rows.mapInArrow(add, f"key {kind}, i int, n long, x double, y array<double>, xy array<double>")
    added = lambda c: F.array(*[F.sum(F.col(c)[j]) for j in range(m)]).alias(c)
    return parts.groupBy("key", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), added("y"), added("xy")).withColumnRenamed("key", key)


def _matrices(sums: DataFrame, key: str) -> dict:
    """{key: (n, sum x, sum y, sum x y')} on the driver: as many matrices as there are keys."""
    out: dict = {}
    for r in sums.orderBy(key, "i").collect():
        n, x, y, xy = out.setdefault(r[key], (r.n, [], r.y, []))
        x.append(r.x)
        xy.append(r.xy)
    return {k: (n, np.array(x), np.array(y), np.array(xy)) for k, (n, x, y, xy) in out.items()}


def alignment(pairs: DataFrame, width: int, width_y: int, every: int = 4) -> tuple[np.ndarray, DataFrame]:
    """(map, verdict): the least-squares map from source to target, pairs (id, source, target), and how rows that it has not seen are met.

    Rows whose hash of id is the last of ``every`` are held out. verdict has one row:
    n_fit, n_held, gain (mean of the squared distance from the fitted rows' mean less
    that from the mapped row, over the held ones), se, and carries: whether gain exceeds
    two standard errors; null for under two held rows.
    """
    held = F.pmod(F.xxhash64("id"), F.lit(every)) == every - 1
    steps = Steps(pairs.sparkSession)
    split = steps.written(pairs.select("id", F.col("source").cast("array<double>").alias("source"), F.col("target").cast("array<double>").alias("target"), held.alias("held")), "pairs")
    fit = split.filter("NOT held")
    xx = _matrices(products(fit.withColumn("k", F.lit(0)), "k", "source", "source", width), "k")
    xy = _matrices(products(fit.withColumn("k", F.lit(0)), "k", "source", "target", width, width_y), "k")
    if not xy:
        raise ValueError("no rows to fit")
    n, _, total, cross = xy[0]
    found = np.linalg.lstsq(xx[0][3], cross, rcond=None)[0]
    walk, mean = found.T.tolist(), (total / n).tolist()
    literal = lambda rows: F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])
    dot = lambda row: F.aggregate(F.zip_with(row, F.col("source"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    mapped = F.transform(literal(walk), dot)
    off = lambda a: F.aggregate(F.zip_with(a, F.col("target"), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    gain = off(F.array(*[F.lit(float(v)) for v in mean])) - off(mapped)
    told = split.filter("held").select(gain.alias("g")).agg(F.count("g").alias("n_held"), F.avg("g").alias("gain"), (F.stddev_samp("g") / F.sqrt(F.count("g"))).alias("se"))
    return found, told.select(F.lit(n).alias("n_fit"), "n_held", "gain", "se", F.when(F.col("n_held") >= 2, F.col("gain") > 2 * F.col("se")).alias("carries"))


DECAY = "n_pairs long, n_modes int, tau_fast double, tau_slow double, refusal string"


def decay(rows: DataFrame, key: str, order: str, vec: str, width: int) -> DataFrame:
    """(key, n_pairs, n_modes, tau_fast, tau_slow, refusal): how fast the observations of every key let go of what they were.

    The operator A of least squares x(t + 1) = A x(t) comes from the sums of x x' and
    of x(t) x(t + 1)'; over the directions that the observations span, the decays are
    -ln |eigenvalue|. Refused are under two pairs of observations, growth (a decay of
    0 or less) and one decay alone, as there is no fast one beside a slow one.
    Observations whose vec is null or of length 0 are no rows of the sequence.
    """
    usable = rows.filter(F.col(vec).isNotNull() & (F.size(vec) == width)).select(key, order, F.col(vec).cast("array<double>").alias("now"))
    usable = usable.filter(F.exists("now", lambda v: v != 0))
    paired = usable.withColumn("then", F.lead("now").over(W.partitionBy(key).orderBy(order))).filter("then IS NOT NULL")
    steps = Steps(rows.sparkSession)
    paired = steps.written(paired, "pairs")
    now, then = products(paired, key, "now", "now", width), products(paired, key, "now", "then", width)
    both = now.select(key, "i", "n", "xy").join(then.select(key, "i", F.col("xy").alias("next")), [key, "i"])
    # A group is width rows of width numbers.
    gathered = both.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "xy", "next"))).alias("m"))
    first = usable.select(key).distinct().join(gathered, key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("m.xy").alias("xx"), F.col("m.next").alias("xy"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, n, *_decays(n, xx, xy)) for k, n, xx, xy in zip(b[key], b["n"], b["xx"], b["xy"])], columns=[key, "n_pairs", "n_modes", "tau_fast", "tau_slow", "refusal"]).astype({"n_modes": "Int32"})

    return first.mapInPandas(solve, f"{key} {dict(rows.dtypes)[key]}, {DECAY}")


def _decays(n: int, xx, xy) -> tuple:
    if n < 2:
        return None, None, None, "under two pairs"
    a, b = (np.array([list(r) for r in m], float) for m in (xx, xy))
    w, v = np.linalg.eigh(a)
    some = w > max(w.max(), 0) * len(a) * np.finfo(float).eps * max(n, 1)
    if not some.any():
        return None, None, None, "no direction"
    root = v[:, some] / np.sqrt(w[some])
    mu = np.abs(np.linalg.eigvals(root.T @ b.T @ root))  # the operator over the spanned directions, whitened
    mu = mu[mu > sqrt(np.finfo(float).eps)]
    if not len(mu):
        return 0, None, None, "no decay is left after one step"
    rates = -np.log(mu)
    fast, slow = float(rates.max()), float(rates.min())
    if slow <= 0:
        return len(mu), None, None, "growth"
    if not slow < fast * (1 - 1e-9):
        return len(mu), None, None, "one decay"
    return len(mu), 1 / fast, 1 / slow, None


#: Directions that the block carries beyond those asked for, so that it settles in few rounds.
MORE = 6


def leading(cells: DataFrame, k: int, rounds: int = 60, tolerance: float = 1e-10, seed: int = 1) -> tuple[DataFrame, list[float], str | None]:
    """(basis, energies, refusal): the first k right singular directions of a sparse matrix, cells (row, col, value), as basis (col, v array of k).

    Block power iteration: W = M' (M V), each product a join on the shared index and
    a sum of arrays of k, then V = W R^-1 with R from the k x k Gram matrix of W, all
    that comes to the driver. It ends when the energies (squared singular values) move
    by less than tolerance of the greatest. Equal (row, col) add up. k is cut to what
    the matrix has; with nothing over rounding, k is 0 and refusal says so.
    """
    spark, steps = cells.sparkSession, Steps(cells.sparkSession)
    m = steps.written(cells.filter("value IS NOT NULL").groupBy("row", "col").agg(F.sum("value").alias("value")).filter("value <> 0"), "cells")
    columns = m.select("col").distinct()
    known = columns.limit(k + MORE).count()
    empty = spark.createDataFrame([], f"col {dict(cells.dtypes)['col']}, v array<double>")
    if not known:
        return empty, [], "the cloud resolved no direction"
    asked, k = k, min(k + MORE, known)
    start = F.array(*[F.hash(F.col("col"), F.lit(f"{seed}-{j}")) / 2.0**31 for j in range(k)])
    basis = steps.written(columns.select("col", start.alias("v")), "directions")
    energies = np.zeros(k)
    for turn in range(rounds):
        basis, _ = _orthonormal(steps, basis, k)
        scaled = lambda c: F.transform("v", lambda e: e * F.col(c))
        summed = [F.sum(F.col("v")[j]) for j in range(k)]
        images = m.join(basis, "col").select("row", scaled("value").alias("v")).groupBy("row").agg(F.array(*summed).alias("v"))
        moved = steps.written(m.join(images, "row").select("col", scaled("value").alias("v")).groupBy("col").agg(F.array(*summed).alias("v")), "directions")
        cross = _gram(moved.join(basis.select("col", F.col("v").alias("u")), "col"), "u", "v", k)
        values, rotate = np.linalg.eigh((cross + cross.T) / 2)
        values, rotate = values[::-1], rotate[:, ::-1]
        settled = np.abs(values - energies)[:asked].max() <= tolerance * max(values[0], 1e-300)
        energies = values
        if settled or turn == rounds - 1:
            live = min(asked, int((values > values[0] * len(values) * np.finfo(float).eps).sum()))
            basis = steps.written(_times(basis, rotate[:, :live]), "basis")
            steps.over(basis)
            return basis, [float(x) for x in values[:live]], None
        basis = moved
    raise AssertionError("unreachable")


def _gram(df: DataFrame, a: str, b: str, k: int) -> np.ndarray:
    row = df.agg(*[F.sum(F.col(a)[i] * F.col(b)[j]) for i in range(k) for j in range(k)]).first()
    return np.array([x or 0.0 for x in row], float).reshape(k, k)


def _times(basis: DataFrame, matrix: np.ndarray) -> DataFrame:
    """basis (col, v) times a small matrix."""
    k, n = matrix.shape
    return basis.select("col", F.array(*[sum((F.col("v")[i] * float(matrix[i, j]) for i in range(1, k)), F.col("v")[0] * float(matrix[0, j])) for j in range(n)]).alias("v"))


def _orthonormal(steps: Steps, basis: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The same span with orthonormal columns; twice, as once leaves rounding. Columns beyond the rank become 0."""
    rank = k
    for _ in range(2):
        w, v = np.linalg.eigh(_gram(basis, "v", "v", k))
        some = w > max(w.max(), 0) * k * np.finfo(float).eps
        rank = int(some.sum())
        basis = steps.written(_times(basis, v @ np.diag(np.where(some, 1 / np.sqrt(np.where(some, w, 1.0)), 0.0))), "directions")
    return basis, rank
