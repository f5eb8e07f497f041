"""Pooled states over a stream: per node the merged sums of all that it has been observed to be, and what they certify.

A state is (n, sum x, sum x x') in one coordinate system, which the node's first
observation pins; sums merge, so a micro-batch is first added up in parallel, per
node and task, and only those sums meet the state: a hot node's observations are never
gathered. The state is kept by ``transformWithState`` and outlives a restart. Read
from the sums, a node has between k_lo and k_hi modes over the noise edge, and the
read is certified where the two agree.

Defined cases: an observation in another coordinate system is dropped as "other
coordinate", one whose vector is null or of another width than the node's as "width",
one with an element that is null or not finite, or of length 0, as "unreadable"; drops
are counted by reason. Of the observations of a node's first batch that of the least
tick pins the system (of equal ticks the least name). Observations without a node are
no node's. A state of under four observations or two columns is not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import frames

PARTIAL = "node string, coordinate string, first long, width int, n long, total array<double>, outer array<double>, reason string, dropped long"
READ = "node string, coordinate string, n long, k int, k_lo int, k_hi int, certified boolean, total array<double>, outer array<double>, drops map<string,long>"
#: Sums that a task holds at once.
HELD = 256


def partial_sums(observations: DataFrame) -> DataFrame:
    """PARTIAL of observations (node, coordinate, tick, vec): a row per task, node, coordinate system and width, and one for what is unreadable."""
    rows = observations.filter("node IS NOT NULL").select(
        F.col("node").cast("string").alias("node"), F.coalesce(F.col("coordinate").cast("string"), F.lit("")).alias("coordinate"), F.coalesce(F.col("tick").cast("long"), F.lit(0)).alias("tick"), F.col("vec").cast("array<double>").alias("vec")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good: dict[tuple, list] = {}
        bad: dict[tuple, int] = {}

        def told() -> pa.RecordBatch:
            out = [(*k, v[0], len(v[2]), v[1], v[2].tolist(), v[3].ravel().tolist(), None, 0) for k, v in good.items()]
            rows = [(node, c, first, w, n, t, o, r, d) for node, c, _, first, w, n, t, o, r, d in out] + [(node, None, None, None, 0, None, None, r, d) for (node, r), d in bad.items()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in PARTIAL.split(", ")])

        for b in batches:
            for node, coordinate, tick, vec in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not vec:
                    bad[node, "width"] = bad.get((node, "width"), 0) + 1
                    continue
                x = np.array([np.nan if v is None else v for v in vec])
                if not np.isfinite(x).all() or not x.any():
                    bad[node, "unreadable"] = bad.get((node, "unreadable"), 0) + 1
                    continue
                at = good.setdefault((node, coordinate, len(x)), [tick, 0, np.zeros(len(x)), np.zeros((len(x), len(x)))])
                at[0], at[1] = min(at[0], tick), at[1] + 1
                at[2] += x
                at[3] += np.outer(x, x)
            if len(good) + len(bad) > HELD:
                yield told()
                good.clear()
                bad.clear()
        if good or bad:
            yield told()

    return rows.mapInArrow(run, PARTIAL)


def certified(n: int, total: np.ndarray, outer: np.ndarray) -> tuple[int | None, int | None, int | None, bool]:
    if n < 4 or len(total) < 2:
        return None, None, None, False
    lo, k, hi = frames.accumulated(n, total, outer)[1]
    return k, lo, hi, lo == k == hi


class _Pool(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pool = handle.getValueState("pool", "coordinate string, n long, total array<double>, outer array<double>")
        self.drops = handle.getMapState("drops", "reason string", "n long")

    def _drop(self, reason: str, n: int) -> None:
        held = self.drops.getValue((reason,))[0] if self.drops.containsKey((reason,)) else 0
        self.drops.updateValue((reason,), (int(held + n),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))  # a row per task, coordinate system and width
        for r in new[new["reason"].notna()].itertuples():
            self._drop(r.reason, r.dropped)
        good = new[new["reason"].isna()].sort_values(["first", "coordinate", "width"])
        state = None
        if self.pool.exists():
            coordinate, n, total, outer = self.pool.get()
            state = [coordinate, n, np.array(total, float), np.array(outer, float)]
        for r in good.itertuples():
            if state is None:
                state = [r.coordinate, 0, np.zeros(int(r.width)), np.zeros(int(r.width) ** 2)]
            if r.coordinate != state[0]:
                self._drop("other coordinate", r.n)
            elif int(r.width) != len(state[2]):
                self._drop("width", r.n)
            else:
                state[1], state[2], state[3] = int(state[1] + r.n), state[2] + np.array(r.total), state[3] + np.array(r.outer)
        drops = {k[0]: int(v[0]) for k, v in self.drops.iterator()}
        if state is None:
            yield pd.DataFrame([(key[0], None, 0, None, None, None, False, None, None, drops)], columns=_COLUMNS).astype(_KINDS)
            return
        coordinate, n, total, outer = state
        self.pool.update((coordinate, n, total.tolist(), outer.tolist()))
        k, lo, hi, sure = certified(n, total, outer.reshape(len(total), -1))
        yield pd.DataFrame([(key[0], coordinate, n, k, lo, hi, sure, total.tolist(), outer.tolist(), drops)], columns=_COLUMNS).astype(_KINDS)

    def close(self) -> None:
        pass


_COLUMNS = [c.split()[0] for c in READ.split(", ")]
_KINDS = {"k": "Int32", "k_lo": "Int32", "k_hi": "Int32"}


def pooled(observations: DataFrame) -> DataFrame:
    """READ of a stream of observations (node, coordinate, tick, vec): a node is told whenever it has been observed. Needs the RocksDB state store."""
    return partial_sums(observations).groupBy("node").transformWithStateInPandas(statefulProcessor=_Pool(), outputStructType=READ, outputMode="update", timeMode="none")
