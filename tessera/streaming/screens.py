"""Agents' memories over observation streams, signals, and event-time extensions.

A screen is an agent's bag of traces (concept, tick, energy); a trace's
amplitude is its energy times a decay curve at its age in ticks. Batch forms are
window and aggregate expressions; the streaming forms keep the same state per
agent in transformWithState and give the batch result when the stream has been
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Decay by age in ticks; beyond its end nothing is left. A measured curve takes its place where there is one.
CURVE = (1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05, 0.03)


def amplitude(energy: Column, age: Column, curve: tuple[float, ...] = CURVE) -> Column:
    """energy * curve[age], age clamped to 0; the energy itself where the curve is unmeasured."""
    if not curve:
        return energy
    at = F.greatest(age, F.lit(0)).cast("int")
    return energy * F.coalesce(F.get(F.array(*[F.lit(float(c)) for c in curve]), at), F.lit(0.0))


def evict(traces: DataFrame, capacity: int) -> DataFrame:
    """The newest traces of each agent, up to capacity."""
    nth = F.row_number().over(W.partitionBy("agent").orderBy(F.desc("tick"), "concept"))
    return traces.withColumn("nth", nth).filter(F.col("nth") <= capacity).drop("nth")


def read_screens(traces: DataFrame, curve: tuple[float, ...] = CURVE) -> DataFrame:
    """(agent, concept, present, n): summed amplitudes at each agent's own latest tick."""
    now = F.max("tick").over(W.partitionBy("agent"))
    aged = traces.withColumn("amp", amplitude(F.col("energy"), now - F.col("tick"), curve))
    return aged.groupBy("agent", "concept").agg(F.sum("amp").alias("present"), F.count(F.lit(1)).alias("n"))


def tense(amp: Column, lead: Column) -> Column:
    """is, was, or - for nothing left; without a lead all that is left is."""
    return F.when(amp <= 0, "-").when(lead.isNull() | (amp >= lead), "is").otherwise("was")


class _Screen(StatefulProcessor):
    """Per agent: its tick, and for every concept the ticks and energies that still count."""

    def __init__(self, curve: tuple[float, ...]):
        self.curve = curve

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticks = handle.getValueState("ticks", "tick long")
        self.traces = handle.getListState("traces", "concept string, tick long, energy double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        tick = self.ticks.get()[0] if self.ticks.exists() else -1
        held = [tuple(t) for t in self.traces.get()] if self.traces.exists() else []
        for concept, energy in zip(new["concept"], new["energy"]):
            tick += 1
            held.append((concept, tick, float(energy)))
        self.ticks.update((tick,))
        held = [t for t in held if tick - t[1] < len(self.curve)]
        self.traces.put(held) if held else self.traces.clear()
        present: dict[str, float] = {}
        for concept, at, energy in held:
            present[concept] = present.get(concept, 0.0) + energy * self.curve[tick - at]
        rows_out = [(key[0], c, tick, v) for c, v in sorted(present.items())]
        yield pd.DataFrame(rows_out, columns=["agent", "concept", "tick", "present"])

    def close(self) -> None:
        pass


def stream_screens(observations: DataFrame, curve: tuple[float, ...] = CURVE) -> DataFrame:
    """Streaming form of read_screens: observations (agent, concept, energy, ts, event_id); an agent's screen is put out whenever it changes.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    return observations.groupBy("agent").transformWithStateInPandas(
        statefulProcessor=_Screen(curve), outputStructType="agent long, concept string, tick long, present double", outputMode="update", timeMode="none"
    )


def deliver(signals: DataFrame, me: str, verified: Column, authorised: Column) -> DataFrame:
    """Signals addressed to me or to all, not my own: their channel, and EVENT for what is about something, else MESSAGE. Unverified or unauthorised ones say why."""
    mine = signals.filter((F.col("to").isin(me, "*", "all", "broadcast")) & (F.col("from") != me))
    verdict = F.when(~F.coalesce(verified, F.lit(False)), "unverified").when(~F.coalesce(authorised, F.lit(False)), "unauthorised").otherwise("delivered")
    regime = F.when(F.col("about").isNotNull(), "EVENT").otherwise("MESSAGE")
    channel = F.when(F.col("authenticated"), "SYSTEM").otherwise("CLIENT")
    return mine.select("id", verdict.alias("verdict"), F.when(verdict == "delivered", regime).alias("regime"), channel.alias("channel"))


def content_address(*fields: str) -> Column:
    """SHA-256 over the fields as canonical JSON: in the order of their names, nulls kept, no blanks."""
    said = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return F.sha2(said.cast("binary"), 256)


def once(rows: DataFrame, key: str) -> DataFrame:
    """The batch form of once_each: one row of every address."""
    return rows.dropDuplicates([key])


def once_each(stream: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Replays dropped by content address, remembered for the watermark's delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drive a stream over what there is now and give its result table; for tests and small streams."""
    spark: SparkSession = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
