"""Language identification with a linear-chain conditional random field over words.

A word's state scores come from its affixes, its byte n-grams and a lexicon learned from the training rows; learned
transition scores tie neighbouring words.  Forward-backward gives every word a distribution over languages, so that
code-switched texts are labelled word by word; a document's language is the one with most of the expected words.

The field is fitted on a bounded sample of labelled documents, of which every word is learned from: spans of different
documents are strung together, several languages to a sequence, and the exact gradient (expected minus observed features)
is followed by Adagrad.  Shards of the sample learn in tasks and their fields are averaged.  Scoring runs in the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, encoded, saved, split_words, table, training_rows, word_hashes
from .features import MOST_LABELS, SHARDS, averaged, gram_sums, grams, pieces, sample, summed

UNKNOWN = "und"
#: Training documents over all languages: the bound of the sample.
TRAIN_DOCS = 2400
SIZES, BUCKETS = (1, 2, 3, 4), 1 << 15
#: Words in a sequence, sequences in a gradient step, passes over the sample, learning rate.
LENGTH, BATCH, EPOCHS, RATE = 48, 32, 2, 0.2
#: A word is in the lexicon of a language if it was seen so often and so purely there; the lexicon has the most frequent ones.
SEEN, PURITY, LEXICON = 3, 0.9, 1 << 17
#: Bytes of text that are scored at once, and that sequences are made of at once.
STEP, LEARNED = 2 << 20, 1 << 19
LETTER = regex.compile(r"\p{L}")


class Field:
    """Parameters: ``weights`` per n-gram bucket, ``lexical`` per lexicon, ``transition`` and ``initial``, each per language."""

    def __init__(self, labels: list[str], buckets: int = BUCKETS):
        n = len(labels)
        self.labels, self.buckets = labels, buckets
        self.weights = np.zeros((buckets, n))
        self.lexical = np.zeros((n, n))
        self.transition = np.zeros((n, n))
        self.initial = np.zeros(n)
        self.known, self.of = np.zeros(0, np.uint64), np.zeros((0, n))

    def lexicon(self, hashes: np.ndarray) -> np.ndarray:
        """(words, languages): 1 where the word is in the language's lexicon."""
        if not len(self.known):
            return np.zeros((len(hashes), len(self.labels)))
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return self.of[at] * (self.known[at] == hashes)[:, None]

    def states(self, words: pa.Array) -> np.ndarray:
        """Scores of distinct words in each language."""
        return gram_sums(words, SIZES, self.weights) + self.lexicon(word_hashes(words)) @ self.lexical

    def marginals(self, states: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Forward-backward over all sequences of a batch at once: step t is taken by those longer than t."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        first, lengths = offsets[:-1][order], lengths[order]
        longest = int(lengths.max(initial=0))
        active = np.searchsorted(-lengths, -np.arange(longest), "left")  # sequences longer than t
        local = np.exp(states - states.max(1, keepdims=True, initial=-np.inf)) if len(states) else states
        move = np.exp(self.transition).astype(local.dtype)
        initial = np.exp(self.initial).astype(local.dtype)
        forward, backward = np.empty_like(local), np.ones_like(local)
        a = None
        for t in range(longest):
            at = first[: active[t]] + t
            a = local[at] * (initial if t == 0 else a[: active[t]] @ move)
            a /= a.sum(1, keepdims=True)
            forward[at] = a
        for t in range(longest - 2, -1, -1):
            at = first[: active[t + 1]] + t  # those that have a word t + 1
            b = (local[at + 1] * backward[at + 1]) @ move.T
            backward[at] = b / b.sum(1, keepdims=True)
        forward *= backward
        return forward / forward.sum(1, keepdims=True) if len(forward) else forward


def lower_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of each text in lower case (of all alphabets): learned from and scored alike."""
    return split_words(pa.array([x.lower() if x else None for x in text.to_pylist()], pa.large_string()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, label, n) of each piece of (text, label)."""
    for batch in pieces(batches, LEARNED, 0):
        flat, offsets = lower_words(batch.column(0))
        code, distinct = encoded(flat)
        label = np.repeat(batch.column(1).to_numpy(), np.diff(offsets))
        key, n = np.unique(label.astype(np.int64) * len(distinct) + code, return_counts=True)
        words = word_hashes(distinct).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(words[key % max(len(distinct), 1)]), pa.array((key // max(len(distinct), 1)).astype(np.int32)), pa.array(n)], names=["word", "label", "n"])


def learn_lexicon(rows: DataFrame, field: Field) -> None:
    """The words of ``rows`` (text, label) that nearly always are of one language."""
    counts = rows.mapInArrow(_counted, "word long, label int, n long").groupBy("word", "label").agg(F.sum("n").alias("n"))
    words = counts.groupBy("word").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("most"))
    kept = words.where((F.col("total") >= SEEN) & (F.col("most.n") >= PURITY * F.col("total")))
    found = kept.orderBy(F.desc("total"), "word").limit(LEXICON).select("word", "most.label").toPandas()
    known = found["word"].to_numpy(np.int64).view(U64)
    order = np.argsort(known)
    field.known, field.of = known[order], np.eye(len(field.labels))[found["label"].to_numpy(np.int64)[order]]


def sequences(offsets: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """All words, each once, in sequences of LENGTH: documents are cut into spans, and the spans are shuffled.

    What the last sequence lacks is taken from the beginning.
    """
    spans = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while a < b:
            to = min(b, a + int(rng.integers(LENGTH // 4, LENGTH + 1)))
            spans.append(np.arange(a, to))
            a = to
    if not spans:
        return np.zeros((0, LENGTH), np.int64)
    order = np.concatenate([spans[i] for i in rng.permutation(len(spans))])
    return np.resize(order, (-(-len(order) // LENGTH), LENGTH))


def _learn(labels: list[str], known: np.ndarray, of: np.ndarray, buckets: int):
    """Adagrad over the words of some rows (text, label): the arrays are the field's parameters."""

    def run(batches: Iterator[pa.RecordBatch], arrays: list[np.ndarray], turn: int) -> int:
        field = Field(labels, buckets)
        field.known, field.of = known, of
        field.weights, field.lexical, field.transition, field.initial = arrays
        sizes = [np.full(x.shape, 1e-8) for x in arrays]
        rng, n = np.random.default_rng(3 + turn), 0
        for batch in pieces(batches, LEARNED, 0):
            flat, offsets = lower_words(batch.column(0))
            truth = np.repeat(batch.column(1).to_numpy(), np.diff(offsets))
            rows = sequences(offsets, rng)
            n += len(flat)
            if not len(rows):
                continue
            code, distinct = encoded(flat)
            found, lexicon = grams(distinct, SIZES, buckets), field.lexicon(word_hashes(distinct))
            for part in range(0, len(rows), BATCH):
                at = rows[part : part + BATCH].ravel()
                _step(field, sizes, code[at], truth[at], found, lexicon)
        return n

    return run


def _step(field: Field, sizes: list[np.ndarray], code: np.ndarray, truth: np.ndarray, found: list, lexicon: np.ndarray) -> None:
    """One step on sequences of LENGTH words: expected features under the field minus those seen."""
    n = len(field.labels)
    used, here = np.unique(code, return_inverse=True)
    counts = [o[used + 1] - o[used] for _, o in found]
    index = [i[np.repeat(o[used] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))] for (i, o), c in zip(found, counts, strict=True)]
    own = [(i, np.concatenate([[0], np.cumsum(c)])) for i, c in zip(index, counts, strict=True)]
    states = (summed(own, field.weights) + lexicon[used] @ field.lexical)[here]
    p = field.marginals(states, np.arange(0, len(code) + 1, LENGTH))
    want = np.zeros_like(p)
    want[np.arange(len(code)), truth] = 1
    by_word = np.zeros((len(used), n))
    np.add.at(by_word, here, p - want)
    rows, grad = np.concatenate(index), np.concatenate([np.repeat(by_word, c, axis=0) for c in counts])
    touched, where = np.unique(rows, return_inverse=True)
    step = np.stack([np.bincount(where, grad[:, k], len(touched)) for k in range(n)], 1)
    sizes[0][touched] += step**2
    field.weights[touched] -= RATE * step / np.sqrt(sizes[0][touched])
    grid, wants = p.reshape(-1, LENGTH, n), want.reshape(-1, LENGTH, n)
    local = np.exp(states - states.max(1, keepdims=True)).reshape(-1, LENGTH, n)
    pair = _pairs(local, np.exp(field.transition), np.exp(field.initial))
    grads = lexicon[used].T @ by_word, pair - np.einsum("stk,stl->kl", wants[:, :-1], wants[:, 1:]), (grid[:, 0] - wants[:, 0]).sum(0)
    for x, size, g in zip((field.lexical, field.transition, field.initial), sizes[1:], grads, strict=True):
        size += g**2
        x -= RATE * g / np.sqrt(size)


def _pairs(local: np.ndarray, move: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """Expected transitions (from, to) over a block of sequences of one length."""
    forward, backward = np.empty_like(local), np.ones_like(local)
    for t in range(local.shape[1]):
        a = local[:, t] * (initial if t == 0 else forward[:, t - 1] @ move)
        forward[:, t] = a / a.sum(1, keepdims=True)
    for t in range(local.shape[1] - 2, -1, -1):
        b = (local[:, t + 1] * backward[:, t + 1]) @ move.T
        backward[:, t] = b / b.sum(1, keepdims=True)
    joint = forward[:, :-1, :, None] * move * (local[:, 1:] * backward[:, 1:])[:, :, None, :]
    return (joint / joint.sum((2, 3), keepdims=True)).sum((0, 1))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """Fit a field on at most ``train_docs`` distinct texts of the rows (text, lang), as many of each language."""
    languages = [r[0] for r in docs.where("lang is not null and text is not null").select("lang").distinct().orderBy("lang").limit(MOST_LABELS + 1).collect()]
    field = Field(languages)
    if not languages:
        return field
    some = sample(docs, "lang", max(1, train_docs // len(languages)))
    # names are few (the sample checks it); an index of -1 is none
    label = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
    rows = some.select("key", "text", label.alias("label")).repartition(SHARDS, "key").sortWithinPartitions("key").select("text", "label")
    rows = saved(rows)
    learn_lexicon(rows, field)
    arrays = averaged(rows, _learn(languages, field.known, field.of, field.buckets), [field.weights, field.lexical, field.transition, field.initial], EPOCHS)
    field.weights, field.lexical, field.transition, field.initial = arrays
    return field


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = model.value
        for batch in pieces(batches, STEP):
            flat, offsets = lower_words(batch.column(1))
            code, distinct = encoded(flat)
            n = len(offsets) - 1
            lettered = np.array([bool(x and LETTER.search(x)) for x in batch.column(1).to_pylist()], bool)
            names, scores = [UNKNOWN] * n, np.zeros(n)
            if field.labels and len(code):
                p = field.marginals(field.states(distinct).astype(np.float32)[code], offsets)
                running = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0, dtype=np.float64)])
                share = (running[offsets[1:]] - running[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)[:, None]
                best = share.argmax(1)
                scores = np.where(lettered, np.clip(share[np.arange(n), best], 0, 1), 0.0)
                names = [field.labels[i] if x else UNKNOWN for i, x in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), *batch.columns[2:]], names=["doc_id", "lang_pred", "score", *batch.schema.names[2:]])

    return run


def identify(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (expected share of the words in that language, 0 to 1).

    ``und`` with score 0 for a text that is null or has no letter, and for all if nothing was learned.  Texts of any length
    are read whole; repeated rows are rows of their own; other columns are not read.  An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = training_rows(5, 0)
    field = train(docs.where(~held).select("text", "lang"))
    return identify(docs, field).withColumn("held_out", held)


#: A document whose best language explains less of its words than this is rejected by the pipeline.
LEAST_SCORE = 0.5


def keep_identified(docs: DataFrame, field: Field, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least the given score; their columns are those of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(field)
    schema = "key long, lang_pred string, score double, " + ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    named = docs.select(F.lit(0).cast("long").alias("key"), F.col("text").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = named.mapInArrow(_predict(model), schema).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
