from pyspark.sql import functions as F

from tessera.llm import url_filter


def test_block_rates_are_of_all_labelled_urls(spark, monkeypatch):
    """A sample of 20 of 400 labelled hosts: the features of an unlabelled URL still know its own host's section."""
    rows = spark.range(400).selectExpr("id AS page_id", "CASE WHEN id % 2 = 0 THEN concat('http://w', id, '.net/s', id, '/x') ELSE concat('http://w', id, '.org/fr/', id) END AS url")
    asked = spark.range(1000, 1200).selectExpr("id AS page_id", "concat('http://w', id, '.info/s', (id - 1000) * 2, '/x') AS url")
    seen = []
    fit = url_filter.VectorAssembler.transform
    monkeypatch.setattr(url_filter.VectorAssembler, "transform", lambda self, df, *a: seen.append(df) or fit(self, df, *a))
    got = url_filter.judge(rows.unionByName(asked), sample=20)
    assert got.count() == 600
    rates = {r.section_block for r in seen[-1].filter(F.col("suffix") == "info").select("section_block").distinct().collect()}
    assert rates == {(1 + 0.5) / 2}
