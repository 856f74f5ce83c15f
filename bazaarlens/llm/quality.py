"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its words, its word pairs and its words' byte n-grams, each hashed into a
bucket; a softmax layer on the mean gives the classes.  Vectors and layer are learned together by stochastic gradient
descent in numpy, on a bounded sample of labelled documents: shards of it learn in tasks, and their scores per bucket are
averaged.  One shard is what is set, as averages of several learn less from a sample of this size.

As the mean and the layer are linear, a bucket's vector times the layer is one number per class: scoring a text of any
length is a sum of such numbers over its features, in the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, buffers, encoded, mix2, saved, split_words, table, training_rows, word_hashes
from .features import gram_sums, grams, pieces, sample

#: Bound of the training sample: documents over both classes.
TRAIN_DOCS = 3000
SIZES, BUCKETS, DIMENSION = (3, 4, 5), 1 << 16, 16
EPOCHS, BATCH, RATE = 6, 32, 0.1
#: Tasks that learn.
SHARDS = 1
STEP = 8 << 20


class Embeddings:
    """``vectors`` per bucket, and the softmax ``layer`` with a ``bias`` per class."""

    def __init__(self, buckets: int = BUCKETS, dimension: int = DIMENSION, classes: int = 2, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.buckets, self.classes = buckets, classes
        self.vectors = rng.uniform(-0.5, 0.5, (buckets, dimension)) / dimension
        self.layer = rng.normal(size=(dimension, classes)) / np.sqrt(dimension)
        self.bias = np.zeros(classes)

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = mean @ self.layer + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def step(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, sizes: list[np.ndarray], rate: float = RATE) -> None:
        """``docs``: buckets and their counts.  Steps are scaled per number by the squares of the gradients so far."""
        index, where = np.unique(np.concatenate([d[0] for d in docs]), return_inverse=True)
        share = np.concatenate([d[1] / max(d[1].sum(), 1) for d in docs])
        owner = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
        weight = np.zeros((len(docs), len(index)))
        weight[owner, where] = share
        mean = weight @ self.vectors[index]
        error = self.probabilities(mean)
        error[np.arange(len(docs)), labels] -= 1
        grads = weight.T @ (error @ self.layer.T), mean.T @ error, error.sum(0)
        sizes[0][index] += grads[0] ** 2
        self.vectors[index] -= rate * grads[0] / np.sqrt(sizes[0][index])
        for x, s, g in ((self.layer, sizes[1], grads[1]), (self.bias, sizes[2], grads[2])):
            s += g**2
            x -= rate * g / np.sqrt(s)

    def flattened(self) -> np.ndarray:
        """Per bucket the difference of the two class scores."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0])


def _parts(text: pa.Array, buckets: int):
    """Word codes, distinct words with their n-grams, and word and pair buckets, and the word range of each text."""
    flat, offsets = split_words(text)
    code, distinct = encoded(flat)
    hashes = word_hashes(distinct)
    own = (hashes % U64(buckets)).astype(np.int64)
    here = hashes[code]
    inside = np.ones(max(0, len(code) - 1), bool)
    ends = offsets[1:-1]
    inside[ends[(ends > 0) & (ends < len(code))] - 1] = False
    pair = (mix2(here[:-1], here[1:], 5) % U64(buckets)).astype(np.int64) if len(code) else np.zeros(0, np.int64)
    return code, distinct, own, pair, inside, offsets


def counts(text: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text's features, and how often they come."""
    code, distinct, own, pair, inside, _ = _parts(text, buckets)
    times = np.bincount(code, minlength=len(distinct))
    found = grams(distinct, SIZES, buckets)
    rows = np.concatenate([own, pair[inside], *(x for x, _ in found)])
    each = np.concatenate([times, np.ones(int(inside.sum()), np.int64), *(np.repeat(times, np.diff(at)) for _, at in found)])
    used, where = np.unique(rows, return_inverse=True)
    return used, np.bincount(where, each, len(used))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gradient steps on BATCH documents at a time, of which only the features are held; rows come turn by turn.

    What leaves the task is a number per bucket, not the vectors.
    """
    model, n, turn = Embeddings(), 0, -1
    held: list[tuple[np.ndarray, np.ndarray]] = []
    labels: list[int] = []
    sizes: list[np.ndarray] = []
    for batch in batches:
        for i in range(batch.num_rows):
            now = batch.column(2)[i].as_py()
            if held and (len(held) == BATCH or now != turn):
                model.step(held, np.array(labels), sizes)
                held, labels = [], []
            if now != turn:
                turn, sizes = now, [np.full(x.shape, 1e-6) for x in (model.vectors, model.layer, model.bias)]
            held.append(counts(batch.column(0).slice(i, 1), model.buckets))
            labels.append(batch.column(1)[i].as_py())
            n += 1
    if held:
        model.step(held, np.array(labels), sizes)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([model.flattened().tobytes()]), pa.array([float(model.bias[1] - model.bias[0])])], names=["n", "scores", "bias"])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, label: str = "quality") -> tuple[np.ndarray, float]:
    """(score per bucket, bias), fitted on at most ``train_docs`` texts with a row in ``labels``, as many of each class.

    The bias is set back to the classes' true proportion, counted over all given labels.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
    seen = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(seen) < 2:
        return np.zeros(BUCKETS), (1.0 if next(iter(seen)) else -1.0) if seen else 0.0
    # an id that is repeated, on either side, stands for one text and label: no id multiplies the sample
    first = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*by))).where("n = 1").drop("n")
    texts = docs.where("text is not null").select("doc_id", "text")
    ids = sample(known.withColumn("text", F.col("doc_id").cast("string")), "label", train_docs // 2)
    ids = first(ids.select(F.col("text").cast("long").alias("doc_id"), "label"), "label")
    # at most train_docs rows: the broadcast has a fixed bound
    some = first(texts.join(F.broadcast(ids), "doc_id"), F.xxhash64("text"), "text")
    rows = saved(some.withColumn("key", F.xxhash64("doc_id", F.lit(9))).repartition(SHARDS, "key").select("text", "label", "key", "doc_id"))
    drawn = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    # every turn reads the shard again, in one pass of its task: vectors don't travel by the driver from turn to turn
    turns = rows.withColumn("turn", F.explode(F.array(*[F.lit(k) for k in range(EPOCHS)]))).sortWithinPartitions("turn", "key", "doc_id")
    total, scores, bias = 0.0, np.zeros(BUCKETS), 0.0
    for r in turns.select("text", "label", "turn").mapInArrow(_learn, "n double, scores binary, bias double").toLocalIterator():
        total, scores, bias = total + r["n"], scores + r["n"] * np.frombuffer(bytes(r["scores"])), bias + r["n"] * r["bias"]
    total = max(total, 1.0)
    bias = bias / total + np.log(seen[1] / seen[0]) - np.log(max(1, drawn.get(1, 0)) / max(1, drawn.get(0, 0)))
    return scores / total, float(bias)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, bias = model.value
        for batch in pieces(batches, STEP):
            code, distinct, own, pair, inside, offsets = _parts(batch.column(1), len(values))
            lengths = np.diff(buffers(distinct)[1]) + 2
            score = (values[own] + gram_sums(distinct, SIZES, values))[code]
            number = (1 + sum(np.maximum(lengths - size + 1, 0) for size in SIZES))[code]
            pairs = np.append(np.where(inside, values[pair[: len(inside)]], 0.0), 0.0)[: len(code)]
            counted = np.append(inside, False)[: len(code)]
            total = [np.concatenate([[0.0], np.cumsum(x)]) for x in (score + pairs, number + counted)]
            z, n = (x[offsets[1:]] - x[offsets[:-1]] for x in total)
            p = 1 / (1 + np.exp(-np.clip(z / np.maximum(n, 1) + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score (the probability of class 1), predicted (1 from 0.5 up).

    A null or empty text has no features: its score is that of the bias alone.  Texts are read whole; repeated rows are
    rows of their own; other columns are not read.  An empty table gives an empty result; without labels scores are 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scored(shared), "doc_id long, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = training_rows(3, 1)
    return score_quality(docs, train(docs, labels.where(~held))).withColumn("held_out", held)
