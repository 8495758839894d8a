import corpus_pipeline as cp
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, clashing):
    docs = clashing
    tox = cp.drop_toxic(spark, docs, SF)
    assert tox.columns == docs.columns and tox.count() <= docs.count()
    one = cp.one_of_each_group(spark, docs, SF)
    ids = [r["doc_id"] for r in one.select("doc_id").collect()]
    assert one.columns == docs.columns and not {9009} & set(ids) and 9008 in ids and None in ids
    assert len({9006, 9007} & set(ids)) == 0
    cut = cp.cut_repeats(spark, docs, SF).cache()
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.filter("doc_id = 9004").first()["n_chars"] == len("own start of this text and an end")
    clean = cp.drop_contaminated(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()


def test_one_row_of_each_group_with_repeated_and_null_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text("a"), "en"), (1, text("b"), "en"), (2, text("b"), "fr"), (3, text("c"), "en"), (3, text("d"), "en"),
            (0, text("d"), "en"), (None, text("e"), "en"), (None, text("e"), "fr"), (None, text("a"), "en"), (4, text("f"), "en"),
            (4, text("f"), "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sorted((r["text"], r["doc_id"]) for r in cp.one_of_each_group(spark, docs, SF).collect())
    assert got == [(text("a"), 1), (text("b"), 1), (text("c"), 3), (text("d"), 0), (text("e"), None), (text("f"), 4)]


def test_run(spark):
    out = cp.run(spark, SF)
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert full <= 1024 and out.count() > 50


def test_empty(spark, empty):
    docs = empty
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
