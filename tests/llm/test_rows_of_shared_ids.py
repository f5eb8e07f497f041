from tessera.llm import decontam, minhash

DOCS = "doc_id long, text string, digest string"


def test_contamination_drops_rows_not_ids(spark):
    leak = "one two three four five six seven eight nine ten"
    rows = [(None, f"so {leak} so"), (None, "clean"), (None, None), (1, leak), (1, "also clean"), (2, "clean")]
    b = spark.createDataFrame([(1, leak)], "item_id long, text string")
    out = decontam.drop_contaminated(spark.createDataFrame([(*r, "x") for r in rows], DOCS), b)
    assert out.columns == ["doc_id", "text", "digest"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, "clean"), (None, None), (1, "also clean"), (2, "clean")], key=str)


def test_one_text_of_each_class_stays_whatever_its_ids(spark):
    a = " ".join(f"a{i}" for i in range(300))
    b = " ".join(f"b{i}" for i in range(300))
    c = " ".join(f"c{i}" for i in range(300))
    rows = [(3, a), (3, a + " x"), (5, b), (3, b + " x"), (5, c), (None, c + " x"), (None, "p " + b), (None, "lone"), (None, None)]
    out = minhash.one_of_each(spark.createDataFrame([(*r, "x") for r in rows], DOCS)).collect()
    assert len(out) == 5 and {(r.doc_id, r.text) for r in out if r.doc_id != 3} == {(5, c), (None, "lone"), (None, None)}
    assert sorted(r.text[0] for r in out if r.doc_id == 3) == ["a", "b"]


def test_classes_of_null_ids_leave_one(spark):
    a = " ".join(f"a{i}" for i in range(300))
    out = minhash.one_of_each(spark.createDataFrame([(None, a, "x"), (None, a + " x", "x")], DOCS))
    assert out.count() == 1
