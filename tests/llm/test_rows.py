"""Odd rows: columns that are named like inner ones, repeated ids, rows that are all alike."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from bazaarlens.llm import features, language, line_dedup, mixing, packing, quality, simhash, topk

INNER = ["key_doc", "gone_at", "m_id", "kept_id", "row", "key", "copies", "rows", "doc", "digest", "node", "root", "place", "bucket", "n_removed", "turn", "n", "body", "number", "c0", "sha", "chunk", "label", "lang_pred", "score"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in INNER]])
LINE = "ten words are in this line of text as they say"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [f"{LINE}\nthe first of all these texts", f"{LINE}\nthe second one is not like the first", "the third has other words in a line", None, ""]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c} {i}" for c in INNER]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_keep_other_columns(spark, odd, stage):
    got = corpus_pipeline.STAGES[stage][1](spark, odd, "")
    assert got.columns == SCHEMA.names
    for r in got.collect():
        assert all(r[c] == f"{c} {r.doc_id}" for c in INNER)


def test_operators_do_not_read_other_columns(odd):
    model = packing.default_tokenizer()
    assert {r.doc_id for r in packing.pack(odd, model).collect()} == set(range(5))
    assert simhash.near_duplicates(odd).count() == 5
    assert line_dedup.drop_repeated_lines(odd, counts=True).where("n_removed = 1").count() == 1
    assert sum(r.copies for r in mixing.mixed(odd).collect()) == 5


def test_rows_alike_are_dealt_to_many_groups(spark):
    rows = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a few words of one text").alias("text"))
    got = packing.pack(rows, packing.default_tokenizer(), group_docs=50).collect()
    sizes = Counter(r.sequence_id >> 32 for r in got)
    assert len(sizes) > 6 and max(sizes.values()) < 200 and sum(r.length for r in got) == 600 * got[0].doc_tokens


def test_sample_has_distinct_texts_of_each_label(spark):
    rows = spark.createDataFrame([(1, f"text {i}", "a") for i in range(400)] + [(2, "same", "b")] * 3000 + [(3, None, "a"), (4, "x", None)], "doc_id long, text string, lang string")
    got = Counter((r.lang, r.text) for r in features.sample(rows, "lang", 50).collect())
    assert set(got.values()) == {1} and Counter(k for k, _ in got) == {"a": 50, "b": 1}


def test_training_with_one_id_for_all(spark):
    rows = spark.createDataFrame([(1, f"der die das und ein {i % 50}", "de") for i in range(500)] + [(1, f"the a of and to {i}", "en") for i in range(50)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame([(1, "the and of"), (2, "und der das")], "doc_id long, text string"), language.train(rows)).collect()}
    assert got == {1: "en", 2: "de"}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)] * 20, "doc_id long, quality int")
    texts = spark.createDataFrame([(1, "a"), (2, "junk junk"), (3, "fine words")] * 30, "doc_id long, text string")
    assert quality.score_quality(texts, quality.train(texts, labels)).count() == 90


def test_repeated_queries(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (None, [9.0, 9.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.exact_topk(rows, F.col("vec_id") == 0).collect()]
    assert {(q, v, s) for q, _, v, s in got} == {(0, 1, 65536)}


def test_quality_learns_without_its_vectors_at_the_driver(spark, monkeypatch):
    """Every turn over the sample in one pass: equal to turns by themselves, and no model is broadcast between them."""
    texts = [f"good words of text number {i} and {i % 7}" if i % 3 else f"junk {i} !! buy junk {i % 5}" for i in range(75)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(75)], "doc_id long, quality int")
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value))
    scores, bias = quality.train(rows, labels)
    assert not sent
    order = [r.doc_id for r in rows.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").collect()]
    model = quality.Embeddings()
    for _ in range(quality.EPOCHS):
        sizes = [np.full(x.shape, 1e-6) for x in (model.vectors, model.layer, model.bias)]
        for at in range(0, 75, quality.BATCH):
            some = order[at : at + quality.BATCH]
            model.step([quality.counts(pa.array([texts[i]]), model.buckets) for i in some], np.array([int(i % 3 > 0) for i in some]), sizes)
    np.testing.assert_allclose(scores, model.flattened(), atol=1e-9)
    assert bias == pytest.approx(model.bias[1] - model.bias[0], abs=1e-9)
