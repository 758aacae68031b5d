"""Rows that repeat an id in the pipeline, page ids of any type, and samples that repeated ids can't exceed."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as CP
from upkeep.llm import language_id, toxicity, warc


def test_near_copies_are_dropped_by_row(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(500)]
    t = r.choices(words, k=120)
    near, other = " ".join([*t, "end"]), " ".join(r.choices(words, k=90))
    rows = [(3, " ".join(t), "x"), (7, near, "x"), (7, other, "x"), (None, near + " more", "x"), (None, "alone in the world", "x"), (9, None, "x"), (9, "", "x"), (9, "!", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_name_ string")
    got = sorted(((g.doc_id, g.text) for g in CP.drop_near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, " ".join(t)), (7, other), (None, "alone in the world"), (9, None), (9, ""), (9, "!")], key=str)
    assert CP.drop_near_copies(spark, docs, "").columns == docs.columns
    assert [g.doc_id for g in CP.drop_near_copies(spark, docs.where("doc_id = 3 or text like '%end'").where("doc_id is not null"), "").collect()] == [3]


def test_exact_copies_with_repeated_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c d"), (2, "a b"), (3, None), (3, ""), (None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((g.doc_id, g.text or "") for g in CP.drop_exact_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, "c d"), (2, "a b"), (3, ""), (None, "e")], key=str)


def test_page_ids_of_any_type(spark):
    big = "x" * 200
    rows = [("c:7", big), ("b 2\r\nx", big), ("c:7", big), ("", "small"), (None, big), ("null", "é" * 80)]
    got = {(g.page_id, g.record_type, g.refers_to) for g in warc.revisit_pages(spark.createDataFrame([(i, "http://a.org", h) for i, h in rows], "page_id string, url string, html string")).collect()}
    assert got == {("b 2\r\nx", "response", None), ("c:7", "revisit", "b 2\r\nx"), ("", "response", None), (None, "revisit", "b 2\r\nx"), ("null", "response", None)}
    ids = [g.record_id for g in warc.pages_to_records(spark.createDataFrame([(2, "u", "h")] * 3, "page_id int, url string, html string")).collect()]
    assert len(set(ids)) == 3


def test_repeated_ids_dont_exceed_the_samples(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "train", lambda parts, langs, n: seen.append(len(parts)))
    docs = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    language_id.fit(docs, F.lit(True), sample=30)
    assert seen == [30]
    monkeypatch.setattr(toxicity, "fit", lambda rows, grades: seen.append(len(grades)))
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, labels, sample=20)
    assert seen[1] <= 40
    assert toxicity.score_toxicity(docs.where("false"), toxicity.Model(*(toxicity.np.zeros(0), toxicity.np.zeros(0), toxicity.np.array([30.0])))).count() == 0
