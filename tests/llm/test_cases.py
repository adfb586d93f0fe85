"""Nulls, repeats, long texts, clashes and empty tables, and the quality score against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import quality, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_scores_equal_plain_python(spark):
    """Every row of a table with repeats, nulls and a very long text, by the rules one at a time."""
    draw = np.random.default_rng(7)
    words = ["".join(draw.choice(list("abcdef"), 5)) for _ in range(300)]
    text = lambda i: (" " if i % 3 else "!! ").join(x if i % 3 else x.upper() for x in draw.choice(words, 60))
    rows = [(i, text(i), 0.5) for i in range(180)]
    docs = spark.createDataFrame(rows + [(7, rows[7][1], 0.5), (7, rows[9][1], 0.5), (None, "a b", 0.5), (500, None, 0.5), (501, "", 0.5), (502, "long words " * 200_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(180)], "doc_id long, quality int")
    model = quality.learn(docs, labels, F.col("doc_id") < 120)
    texts = sorted((str(r.doc_id), r.text or "") for r in docs.collect())

    def plain(t):
        x = quality.statistics_of(t.encode())
        z = model.intercept + sum(w for rule, w in model.rules if all((x[k] > at) == above for k, above, at in rule))
        return 1 / (1 + math.exp(-z))

    got = quality.score(docs.withColumn("size", F.col("text")), model)  # a column with a statistic's name
    assert got.columns == ["doc_id", "score", "size", "score_"]
    mine = sorted((str(r.doc_id), r.size or "", r.score_) for r in got.collect())
    assert [m[:2] for m in mine] == texts and all(abs(s - plain(t)) < 1e-9 for _, t, s in mine)
    assert quality.score(docs.limit(0), model).count() == 0


def test_near_copies_with_repeated_and_null_ids(spark):
    """Each row stands for itself: of two unlike texts with one id only the near copy goes."""
    draw = np.random.default_rng(3)
    words = lambda n: " ".join(f"x{i}" for i in draw.integers(0, 1 << 40, n))
    a, b, c = words(60), words(60), words(60)
    rows = [(1, a), (5, a + " end"), (5, b), (6, b + " end"), (7, c), (7, c), (None, c + " end"), (None, words(40)), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = simhash.keep_dissimilar(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a), (5, b), (7, c), (None, rows[7][1]), (8, None)]))


def test_simhash_of_repeats_long_texts_and_clashes(spark):
    text = "one two three four five six seven " * 60_000
    docs = spark.createDataFrame([(3, text, 1), (3, text, 1), (2, text + "eight", 1), (9, None, 1)], "doc_id long, text string, fp int")
    got = simhash.near_dedup(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 2), (3, 2), (9, 9)] and all(r.fp == simhash.np.array(simhash.fingerprint((text if r.doc_id == 3 else text + "eight" if r.doc_id == 2 else "").encode()), "u8").view("i8") for r in got)


def test_stages_on_an_empty_table(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_stages_with_nulls_and_repeats(spark, tmp_path):
    """Rows without an id, a language or a source, and repeated rows, go through all stages."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    draw = np.random.default_rng(5)
    words = lambda n: " ".join(draw.choice(["lorem", "ipsum", "dolor", "sit", "amet", "con", "elit", "sed"], n))
    rows = [(i if i % 5 else None, words(50), "la" if i % 3 else None, None if i % 4 == 0 else "src1", None) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:9] + [(99, None, None, None, None), (98, "", "la", "src1", 0)], DOCS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert docs.count() > 0, name
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
