"""Pooled states over a stream that stops and starts, and an ingest that is killed between put and index."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.index import SLICES, FieldIndex, slice_of
from tessera.sources import ingest
from tessera.streaming import pooled

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_a_stream_of_sums_equals_the_batch_after_a_restart(rocks, tmp_path):
    spark, rng = rocks, np.random.default_rng(11)
    strong = rng.normal(size=(90, 1)) @ np.array([[3.0, 3.0, 3.0, 3.0]]) + 0.05 * rng.normal(size=(90, 4))
    noise = rng.normal(size=(40, 3))
    rows = [("s", "c1", t, v.tolist()) for t, v in enumerate(strong)] + [("n", "c1", t, v.tolist()) for t, v in enumerate(noise)]
    odd = [("s", "c2", 95, [1.0] * 4), ("s", "c1", 96, [1.0] * 3), ("s", "c1", 97, [1.0, float("nan"), 1.0, 1.0]), ("s", "c1", 98, [0.0] * 4), ("n", "c1", 99, None), (None, "c1", 1, [1.0]), ("few", "c1", 1, [1.0, 2.0]), ("none", "c1", 1, None)]
    every = rows + odd
    random.Random(3).shuffle(every)
    (tmp_path / "in").mkdir()
    schema = "node string, coordinate string, tick long, vec array<double>"
    stream = lambda: pooled.pooled(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in")))
    last = {}
    # the first run sees the first observations, so that they pin the coordinates
    parts = [[r for r in every if r[2] < 30], [r for r in every if 30 <= r[2] < 60], [r for r in every if r[2] >= 60]]
    for k, part in enumerate(parts):
        for j in range(2):
            lines = [json.dumps({a: b for a, b in zip(("node", "coordinate", "tick", "vec"), r) if b is not None}) for r in part[j::2]]
            (tmp_path / "in" / f"{k}-{j}.json").write_text("\n".join(lines).replace("NaN", "null"))
        keep = lambda batch, _: last.update({r.node: r for r in batch.collect()})
        stream().writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    for node, x in (("s", strong), ("n", noise)):
        r = last[node]
        assert r.coordinate == "c1" and r.n == len(x)
        assert np.allclose(r.total, x.sum(axis=0)) and np.allclose(np.array(r.outer).reshape(x.shape[1], -1), x.T @ x)
    assert last["s"].certified and last["s"].k == 1 and last["s"].drops == {"other coordinate": 1, "width": 1, "unreadable": 2}
    assert last["n"].drops == {"width": 1} and last["few"].n == 1 and not last["few"].certified and last["few"].k is None
    assert last["none"].n == 0 and last["none"].coordinate is None and None not in last


def test_sums_of_a_hot_node_are_merged_before_they_meet(spark):
    rows = [("hot", "c", t, [1.0, float(t)]) for t in range(5000)]
    got = pooled.partial_sums(spark.createDataFrame(rows, "node string, coordinate string, tick long, vec array<double>").repartition(6)).collect()
    assert len(got) <= 6 and sum(r.n for r in got) == 5000 and sum(r.total[1] for r in got) == sum(range(5000))


def test_an_ingest_killed_between_put_and_index_holds_everything_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    text = lambda k: f"Title {k}\nthe common words and word{k}"
    for k in range(6):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"id": f"a{k}", "content": text(k)}))
    stream = lambda: spark.readStream.schema("id string, content string, sealed boolean").option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    index, real, calls = FieldIndex(spark, str(tmp_path / "index"), stemmed=False), FieldIndex.add, []

    def dies(self, docs, gen=None):
        calls.append(gen)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(self, docs, gen)

    monkeypatch.setattr(FieldIndex, "add", dies)
    with pytest.raises(Exception, match="killed"):
        ingest.ingest_stream(stream(), str(tmp_path / "out"), index, str(tmp_path / "cp")).awaitTermination()
    ingest.ingest_stream(stream(), str(tmp_path / "out"), index, str(tmp_path / "cp")).awaitTermination()
    assert calls == [1, 2, 2, 3]
    (tmp_path / "in" / "9.json").write_text(json.dumps({"id": "a9", "content": text(0), "sealed": True}))
    ingest.ingest_stream(stream(), str(tmp_path / "out"), index, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out/artifacts")).collect()) == [*[f"a{k}" for k in range(6)], "a9"]
    assert spark.read.parquet(str(tmp_path / "out/bodies")).count() == 6
    clean = FieldIndex(spark, str(tmp_path / "clean"), stemmed=False)
    real(clean, ingest.searchable(spark.createDataFrame([(f"a{k}", text(k)) for k in range(6)], "id string, content string")))
    rows = lambda x: sorted(map(tuple, x.postings().collect()))
    assert rows(index) == rows(clean) and index.heads().count() == 7
    asked = spark.createDataFrame([(1, "word3 common")], "query_id int, text string")
    assert [tuple(r) for r in index.search(asked, 9).orderBy("rank").collect()] == [tuple(r) for r in clean.search(asked, 9).orderBy("rank").collect()]


def test_searches_read_the_slices_of_their_terms_and_compaction_changes_nothing(spark, tmp_path):
    docs = ingest.searchable(spark.createDataFrame([(f"d{k}", f"t{k % 9} " * (k % 5 + 1) + f"u{k}") for k in range(60)], "id string, content string"))
    index = FieldIndex(spark, str(tmp_path / "ix"), stemmed=False)
    for part in range(3):
        index.add(docs.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == part))
    index.add(docs.filter("id = 'd7'").withColumn("state", F.lit("archived")))
    asked = spark.createDataFrame([(1, "t3 u12"), (2, "nothing")], "query_id int, text string")
    before = sorted(map(tuple, index.search(asked, 20).collect()))
    assert before
    slices = {r[0] for r in asked.select(F.explode(F.split("text", " ")).alias("t")).select(slice_of(F.col("t"))).collect()}
    whole = index.postings()
    assert whole.select("term").distinct().count() > SLICES / 2 and slices and len(slices) <= 3
    files = spark.read.schema("term string, slice int").parquet(f"{index.path}/postings").filter(F.col("slice").isin(sorted(slices))).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert {r.f.split("slice=")[1].split("/")[0] for r in files} <= {str(s) for s in slices}
    kept = sorted(map(tuple, whole.collect()))
    index.compact()
    assert sorted(map(tuple, index.postings().collect())) == kept and sorted(map(tuple, index.search(asked, 20).collect())) == before
    assert index.heads().filter("NOT live").count() == 1
    index.add(docs.filter("id = 'd7'"))
    assert index.coverage(docs).first().indexed == 60
