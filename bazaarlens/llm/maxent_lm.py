"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

A token's probability is P(class | history) P(token | class, last token), two softmaxes.

* Classes.  Tokens are hashed by their last bytes into buckets; buckets are clustered by the company they keep into
  features, and features into classes, so every token, known or not, has both.  P(class | history) is a softmax over the
  weights of the features that are on: the last token's (n-gram), the class before it (skip), both as a hashed pair, and a
  bias.  Its tables have a fixed size; each gradient round broadcasts the weights, tasks add up observed minus expected
  features and curvature over their histories in numpy, and a bounded, damped Newton step is taken (halved where the
  likelihood falls).
* Tokens.  Within a class a token has a bias, by its training count, and a weight for every word pair that occurs in the
  training texts, under a hashed name.  The pairs are counted over the whole corpus and grow with it: each chunk of
  documents sends its distinct pairs to buckets by (last word, class), so that all weights that share a normaliser meet in
  one task.  There the discounted log-likelihood with a Gaussian prior is climbed by gradient steps, for all histories of
  a bucket at once, and every chunk gets its pairs' log weights, less the log normaliser, back.

Weights of pairs of which a word occurs only once are not told apart from the class's other rare words, as such a pair can't
be seen again.  Token counts are exact: chunks send their distinct tokens to buckets, which add them up and send them back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, buckets_for, buffers, by_bucket, chunked, encoded, in_doc_order, mix, mix2, partitions_for, saved, split_words, table, text_bytes, training_rows, word_hashes
from .features import pieces

#: Buckets of token endings (the last is the end token's), features, classes (the last of each is the end token's), and
#: buckets of hashed pairs.
SUFFIX, ENDINGS, FEATURES, CLASSES, PAIRS = 3, 1024, 193, 49, 1024
ROUNDS, RIDGE, RATE, LONGEST = 14, 1.0, 0.25, 1.0
STEP = 4 << 20
#: Rows of counts in a shuffled block.
BLOCK = 64
#: Raw text bytes of a chunk: larger chunks name fewer pairs twice.
CHUNK = 6 << 20
#: The least training count of both words of a pair.
COMMON = 2
#: What is taken off each pair's count, the weight of the prior, and gradient steps.
DISCOUNT, PRIOR, STEPS = 0.6, 0.1, 10
#: Bits of the hashed last word and of the hashed word in a pair's name; its class stands above them.
WORD_BITS, ITEM_BITS = 26, 18
#: Pair values are returned as multiples of 1 / SCALE.
SCALE = 2048.0


def endings(words: pa.Array) -> np.ndarray:
    """The bucket of each word: a hash of its last bytes."""
    raw, at = buffers(words)
    key = np.zeros(len(at) - 1, U64)
    with np.errstate(over="ignore"):
        for back in range(1, SUFFIX + 1):
            here = at[1:] - back >= at[:-1]
            byte = np.where(here, raw[np.maximum(at[1:] - back, 0)] if len(raw) else 0, 0).astype(U64)
            key = key * U64(257) + byte + here.astype(U64)
    return (mix(key) % U64(ENDINGS - 1)).astype(np.int64)


class Tokens:
    """The token stream of some texts: each text's words, in lower case, then an end token (code ``len(distinct)``)."""

    def __init__(self, text: pa.Array):
        flat, offsets = split_words(text, lower=True)
        code, self.distinct = encoded(flat)
        self.bounds = offsets + np.arange(len(offsets))
        self.code = np.full(int(self.bounds[-1]), len(self.distinct), np.int64)
        word = np.ones(len(self.code), bool)
        word[self.bounds[1:] - 1] = False
        self.code[word] = code
        self.end = ~word

    def buckets(self) -> np.ndarray:
        return np.append(endings(self.distinct), ENDINGS - 1)[self.code]

    def before(self, values: np.ndarray, boundary: int, back: int) -> np.ndarray:
        """The value ``back`` tokens earlier in the same text, or the boundary's."""
        out = np.full(len(values), boundary, values.dtype)
        out[back:] = values[:-back] if back < len(values) else out[back:]
        for k in range(back):
            first = self.bounds[:-1] + k
            out[first[first < self.bounds[1:]]] = boundary
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of each text's tokens, by itself: a difference of running sums would round by the whole chunk's."""
        if not len(values):
            return np.zeros(0)
        return np.add.reduceat(values, self.bounds[:-1], dtype=np.float64)  # no text is without a token


def _blocks(counts: np.ndarray) -> pa.RecordBatch:
    """A table of counts as rows (block, cells, counts) of what isn't zero."""
    rows = []
    for b in range(0, len(counts), BLOCK):
        part = counts[b : b + BLOCK].ravel()
        cells = np.flatnonzero(part)
        if len(cells):
            rows.append((b // BLOCK, cells.astype(np.int32).tobytes(), part[cells].astype(np.int64).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["block", "cells", "counts"])


BLOCKS = "block int, cells binary, counts binary"


def _merged(shape: tuple[int, ...]):
    width = int(np.prod(shape[1:]))

    def run(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK * width, np.int64)
        for cells, counts in zip(group["cells"].to_pylist(), group["counts"].to_pylist(), strict=True):
            total[np.frombuffer(cells, np.int32)] += np.frombuffer(counts, np.int64)
        cells = np.flatnonzero(total)
        return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int32()), "cells": [cells.astype(np.int32).tobytes()], "counts": [total[cells].tobytes()]})

    return run


def _collected(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of tables of counts of one fixed shape: that many numbers reach the driver, however large the corpus."""
    out = np.zeros((-(-shape[0] // BLOCK) * BLOCK, int(np.prod(shape[1:]))), np.int64)
    flat = out.ravel()
    for r in rows.groupBy("block").applyInArrow(_merged(shape), BLOCKS).toLocalIterator():
        flat[r["block"] * BLOCK * out.shape[1] + np.frombuffer(bytes(r["cells"]), np.int32)] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out[: shape[0]].reshape(shape)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ENDINGS * ENDINGS, np.int64)
    for batch in pieces(batches, STEP, 0):
        tokens = Tokens(batch.column(0))
        here = tokens.buckets()
        total += np.bincount(tokens.before(here, ENDINGS - 1, 1) * ENDINGS + here, minlength=len(total))
    yield _blocks(total.reshape(ENDINGS, ENDINGS))


def _histories(groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, cls = groups.value
        total = np.zeros(FEATURES * CLASSES * CLASSES, np.int64)
        for batch in pieces(batches, STEP, 0):
            tokens = Tokens(batch.column(0))
            f = feature[tokens.buckets()]
            c = cls[f]
            at = (tokens.before(f, FEATURES - 1, 1) * CLASSES + tokens.before(c, CLASSES - 1, 2)) * CLASSES + c
            total += np.bincount(at, minlength=len(total))
        yield _blocks(total.reshape(FEATURES, CLASSES * CLASSES))

    return run


def _cluster(points: np.ndarray, weight: np.ndarray, k: int, rounds: int = 15, seed: int = 4) -> np.ndarray:
    """Weighted k-means, from centres drawn by distance."""
    rng = np.random.default_rng(seed)
    live = np.flatnonzero(weight > 0)
    if len(live) <= k:
        out = np.zeros(len(points), np.int64)
        out[live] = np.arange(len(live))
        return out
    centres = points[[live[weight[live].argmax()]]]
    for _ in range(k - 1):
        near = weight * ((points - centres[-1]) ** 2).sum(1)
        d = near if len(centres) == 1 else np.minimum(d, near)
        centres = np.vstack([centres, points[rng.choice(len(points), p=d / d.sum()) if d.sum() > 0 else rng.choice(live)]])
    for _ in range(rounds):
        own = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)).argmin(1)
        mass = np.bincount(own, weight, k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points * weight[:, None])
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1)[:, None], centres)
    return own


def groups_of(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each bucket, and class of each feature, from counts of (bucket before, bucket)."""
    weight = pairs.sum(0).astype(float)[:-1]
    around = np.hstack([pairs.T[:-1], pairs[:-1]]).astype(float)
    around = np.sqrt(around / np.maximum(around.sum(1, keepdims=True), 1))
    # a random projection keeps distances and makes the clustering cheap
    points = around @ np.random.default_rng(1).normal(size=(around.shape[1], 96)) / np.sqrt(96)
    own = _cluster(points, weight, FEATURES - 1)
    mass = np.bincount(own, weight, FEATURES - 1)
    middle = np.zeros((FEATURES - 1, points.shape[1]))
    np.add.at(middle, own, points * weight[:, None])
    cls = _cluster(middle / np.maximum(mass, 1)[:, None], mass, CLASSES - 1)
    return np.append(own, FEATURES - 1), np.append(cls, CLASSES - 1)


def _pair(c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    return (mix2(np.asarray(c1).astype(U64), np.asarray(c2).astype(U64), 3) % U64(PAIRS)).astype(np.int64)


PARAMETERS = FEATURES + CLASSES + PAIRS + 1


def _active(f1: np.ndarray, c2: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of the parameter table that a history turns on."""
    return f1, FEATURES + c2, FEATURES + CLASSES + _pair(cls[f1], c2), np.full(len(f1), PARAMETERS - 1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _gradient(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cls = shared.value
        gain, bend, fit_ = np.zeros_like(w), np.zeros_like(w), 0.0
        for batch in batches:
            n = np.array([np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]).reshape(-1, CLASSES).astype(float)
            on = _active(batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int64), cls)
            logs = _log_softmax(sum(w[i] for i in on))
            p, total = np.exp(logs), n.sum(1, keepdims=True)
            fit_ += float((n * logs).sum())
            for i in on:
                np.add.at(gain, i, n - total * p)
                np.add.at(bend, i, total * p * (1 - p))
        yield pa.RecordBatch.from_arrays([pa.array([fit_]), pa.array([gain.tobytes()]), pa.array([bend.tobytes()])], names=["fit", "gain", "bend"])

    return run


def fit(histories: np.ndarray, cls: np.ndarray, spark: SparkSession, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (parameters, classes) from counts (feature before, class before that, class)."""
    seen = np.argwhere(histories.sum(2) > 0)
    schema = "f1 int, c2 int, n binary"
    rows = spark.createDataFrame(pa.table({"f1": pa.array(seen[:, 0], pa.int32()), "c2": pa.array(seen[:, 1], pa.int32()), "n": pa.array([histories[a, b].tobytes() for a, b in seen], pa.binary())}), schema) if len(seen) else None
    w = np.zeros((PARAMETERS, CLASSES))
    if rows is None:
        return w
    # the start: what the last token alone says
    alone = histories.sum(1) + 0.1
    w[:FEATURES] = np.log(alone / alone.sum(1, keepdims=True))
    w[:FEATURES][histories.sum((1, 2)) == 0] = 0
    rows = saved(rows.repartition(8))
    context = spark.sparkContext
    rate, step, best, kept = RATE, np.zeros_like(w), -np.inf, w
    for _ in range(rounds):
        shared = context.broadcast((w, cls))
        gain, bend, reached = np.zeros_like(w), np.zeros_like(w), 0.0
        for r in rows.mapInArrow(_gradient(shared), "fit double, gain binary, bend binary").toLocalIterator():
            reached += r["fit"]
            gain += np.frombuffer(bytes(r["gain"])).reshape(w.shape)
            bend += np.frombuffer(bytes(r["bend"])).reshape(w.shape)
        shared.unpersist()
        reached -= RIDGE / 2 * float((w[FEATURES:] ** 2).sum())
        if reached < best:
            rate /= 2
            step /= 2
        else:
            best, kept = reached, w
            pull = RIDGE * w * (np.arange(len(w)) >= FEATURES)[:, None]
            step = rate * np.clip((gain - pull) / (bend + RIDGE), -LONGEST, LONGEST)
        w = kept + step
    return kept


def history_table(w: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log10 P(class | history) for every history: (feature before, class before that, class)."""
    f1, c2 = (x.ravel() for x in np.meshgrid(np.arange(FEATURES), np.arange(CLASSES), indexing="ij"))
    return (_log_softmax(sum(w[i] for i in _active(f1, c2, cls))) / np.log(10)).reshape(FEATURES, CLASSES, CLASSES).astype(np.float32)


SENT = "bucket int, chunk int, hashes binary, counts binary, classes binary"
BACK = "chunk int, bucket int, payload binary, kinds array<long>, mass array<double>"
PAIRS_SENT = "bucket int, chunk int, names binary, seen binary, bias binary, mass array<double>"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    columns = [x.split() for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(columns)], names=[name for name, _ in columns])


def bias(count: np.ndarray) -> np.ndarray:
    """A token's bias within its class: eight times the binary logarithm of its count with one added, rounded."""
    return np.rint(8 * np.log2(np.asarray(count, float) + 1)).astype(np.uint8)


def weight_of(bias_: np.ndarray) -> np.ndarray:
    return np.exp2(np.asarray(bias_, float) / 8)


def _send(groups, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        feature, cls = groups.value
        group = in_doc_order(group)
        tokens = Tokens(group["text"])
        learned = np.repeat(group["learned"].to_numpy(), np.diff(tokens.bounds)) & ~tokens.end
        counts = np.bincount(tokens.code[learned], minlength=len(tokens.distinct))
        hashes, c = word_hashes(tokens.distinct), cls[feature[endings(tokens.distinct)]]
        order, bounds = by_bucket(hashes, buckets)
        chunk = group["chunk"][0].as_py()
        # one bucket answers every chunk, even one without words
        asked = [i for i in range(buckets) if bounds[i] < bounds[i + 1] or i == chunk % buckets]
        parts = ((i, order[bounds[i] : bounds[i + 1]]) for i in asked)
        return _table(SENT, [(i, chunk, hashes[o].tobytes(), counts[o].astype(np.int32).tobytes(), c[o].astype(np.uint8).tobytes()) for i, o in parts])

    return run


def _count(group: pa.Table) -> pa.Table:
    """Exact counts of a bucket's tokens, sent back in the order in which each chunk named them.

    One more row has, for each class, the number of its trained tokens and the sum of their weights.
    """
    sent = [np.frombuffer(x, U64) for x in group["hashes"].to_pylist()]
    counts = [np.frombuffer(x, np.int32) for x in group["counts"].to_pylist()]
    names, first, at = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(names)).astype(np.int64)
    classes = np.concatenate([np.frombuffer(x, np.uint8) for x in group["classes"].to_pylist()])[first]
    kinds = np.bincount(classes[total > 0], minlength=CLASSES)
    mass = np.bincount(classes[total > 0], weight_of(bias(total[total > 0])), minlength=CLASSES)
    answers = np.split(total[at], np.cumsum([len(x) for x in sent])[:-1])
    bucket = group["bucket"][0].as_py()
    rows = [(chunk, bucket, x.tobytes(), None, None) for chunk, x in zip(group["chunk"].to_pylist(), answers, strict=True)]
    return _table(BACK, [*rows, (-1, bucket, None, kinds.tolist(), mass.tolist())])


class Chunk:
    """A chunk's token stream with what the buckets know of its words; the end token stands before each text."""

    def __init__(self, group: pa.Table, back: pa.Table, shared, buckets: int):
        feature, cls, documents = shared
        self.group = in_doc_order(group)
        self.tokens = Tokens(self.group["text"])
        self.hashes = np.append(word_hashes(self.tokens.distinct), U64(1))
        order, bounds = by_bucket(self.hashes[:-1], buckets)
        self.count = np.zeros(len(self.hashes), np.int64)
        for bucket, x in zip(back["bucket"].to_pylist(), back["payload"].to_pylist(), strict=True):
            self.count[order[bounds[bucket] : bounds[bucket + 1]]] = np.frombuffer(x, np.int64)
        self.count[-1] = documents
        self.kinds, self.mass = (np.array(back[k][0].as_py()) for k in ("kinds", "mass"))
        if documents:
            self.kinds[-1] += 1
            self.mass[-1] += weight_of(bias([documents]))[0]
        self.feature = np.append(feature[endings(self.tokens.distinct)], FEATURES - 1)
        self.cls = cls[self.feature]

    def pairs(self, buckets: int) -> tuple[np.ndarray, ...]:
        """The distinct pairs by bucket and name: (name, bucket bounds, an example's word, which tokens have one, their pair).

        A pair is a last word and a word that both have COMMON training tokens at least; rarer words of one class count as
        one word.  The end token is alone in its class and has no pair.
        """
        tokens, n = self.tokens, len(self.hashes)
        last = tokens.before(tokens.code, n - 1, 1)
        with_pair = np.flatnonzero((self.count[last] >= COMMON) & ~tokens.end)
        item = np.where(self.count >= COMMON, np.arange(n), n + self.cls)[tokens.code[with_pair]]
        distinct, at = np.unique(last[with_pair] * (n + CLASSES) + item, return_inverse=True)
        last, item = distinct // (n + CLASSES), distinct % (n + CLASSES)
        rare = item >= n
        word = np.minimum(item, n - 1)
        c = np.where(rare, item - n, self.cls[word]).astype(np.int64)
        history = mix2(self.hashes[last], c.astype(U64), 11)
        name = np.where(rare, U64(0), U64(1) + mix(self.hashes[word] + U64(5)) % U64((1 << ITEM_BITS) - 1))
        name |= (c.astype(U64) << U64(WORD_BITS + ITEM_BITS)) | ((history & U64((1 << WORD_BITS) - 1)) << U64(ITEM_BITS))
        bucket = ((history >> U64(32)) % U64(buckets)).astype(np.int64)
        order = np.lexsort((name, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return name[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), np.where(rare, -1, word)[order], with_pair, place[at]


def _planes(names: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte: the high bytes are alike and compress."""
    steps = np.diff(names, prepend=U64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    steps = np.zeros((len(data) // 7, 8), np.uint8)
    steps[:, :7] = np.frombuffer(data, np.uint8).reshape(7, -1).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=U64)


def _send_pairs(shared, buckets: int, pair_buckets: int):
    def run(group: pa.Table, back: pa.Table) -> pa.Table:
        if not len(group):
            return _table(PAIRS_SENT, [])
        chunk = Chunk(group, back, shared.value, buckets)
        names, bounds, words, with_pair, at = chunk.pairs(pair_buckets)
        learned = np.repeat(chunk.group["learned"].to_numpy(), np.diff(chunk.tokens.bounds))
        seen = np.bincount(at[learned[with_pair]], minlength=len(names)).astype(np.int32)
        biases = np.where(words < 0, 0, bias(chunk.count[words])).astype(np.uint8)
        number, mass = group["chunk"][0].as_py(), chunk.mass.tolist()
        return _table(PAIRS_SENT, [(i, number, _planes(names[a:b]), seen[a:b].tobytes(), biases[a:b].tobytes(), mass) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b])

    return run


def pair_weights(history: np.ndarray, seen: np.ndarray, chance: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each pair, log normaliser of its history): for pairs by history, from 0 without gaps.

    ``seen``: training tokens; ``chance``: the word's chance within the class without the pair; ``own``: whether the pair
    has a weight.  The log-likelihood of the counts, DISCOUNT less each, with the prior PRIOR w^2 / 2 is climbed from the
    point that would fit them without a prior; the curvature is bounded from above, so no step overshoots.
    """
    groups = int(history.max(initial=-1)) + 1
    total = np.bincount(history, seen, groups)
    want = np.where(own, seen - DISCOUNT, 0.0)
    left = np.maximum(total - np.bincount(history, want, groups), 1e-9)
    rest = np.maximum(1 - np.bincount(history, np.where(own, chance, 0), groups), 1e-9)
    scale = np.where(total > 0, rest / left, 1.0)
    weight = np.where(own, np.log(np.maximum(want * scale[history], 1e-300)) - np.log(chance), 0.0)
    for step in range(STEPS + 1):
        z = 1 + np.bincount(history, np.where(own, chance * np.expm1(weight), 0), groups)
        if step < STEPS:
            expected = (total / z)[history] * chance * np.exp(weight)
            weight = np.where(own, weight + np.clip((want - expected - PRIOR * weight) / (expected + PRIOR), -1, 1), 0.0)
    return weight, np.log(z)


def _solve(group: pa.Table) -> pa.Table:
    """The pairs' log10 weights, less the log10 normaliser of their history, in the order in which each chunk named them."""
    sent = [_unplanes(x) for x in group["names"].to_pylist()]
    seen = np.concatenate([np.frombuffer(x, np.int32) for x in group["seen"].to_pylist()])
    biases = np.concatenate([np.frombuffer(x, np.uint8) for x in group["bias"].to_pylist()])
    names, first, at = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
    total = np.bincount(at, seen, len(names))
    mass = np.array(group["mass"][0].as_py()) + 1  # one more for the words that no training text has
    c = (names >> U64(WORD_BITS + ITEM_BITS)).astype(np.int64)
    history = np.cumsum(np.diff(names >> U64(ITEM_BITS), prepend=U64(0)) != 0)
    history -= history[0]
    own = ((names & U64((1 << ITEM_BITS) - 1)) != 0) & (total > 0)
    weight, z = pair_weights(history, total, weight_of(biases[first]) / mass[c], own)
    values = np.clip(np.rint((weight - z[history]) / np.log(10) * SCALE), -32767, 32767).astype(np.int16)[at]
    answers = np.split(values, np.cumsum([len(x) for x in sent])[:-1])
    bucket = group["bucket"][0].as_py()
    return _table("chunk int, bucket int, payload binary", [(chunk, bucket, x.tobytes()) for chunk, x in zip(group["chunk"].to_pylist(), answers, strict=True)])


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(shared, buckets: int, pair_buckets: int):
    names = [x.split()[0] for x in SCORES.split(", ")]

    def run(group: pa.Table, back: pa.Table) -> pa.Table:
        feature, cls, documents, chances, n = shared.value
        if not len(group):
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())] * 2, names=names)
        counted = back.filter(pc.equal(back["kind"], 0))
        chunk = Chunk(group, counted, (feature, cls, documents), buckets)
        tokens, count = chunk.tokens, chunk.count
        base = tokens.sums((np.log10(count + 1.0) - np.log10(n + int(chunk.kinds.sum()) + 1))[tokens.code])
        f, c = chunk.feature[tokens.code], chunk.cls[tokens.code]
        given = chances[tokens.before(f, FEATURES - 1, 1), tokens.before(c, CLASSES - 1, 2), c].astype(np.float64)
        given += (np.log10(weight_of(bias(count))) - np.log10(chunk.mass + 1)[chunk.cls])[tokens.code]
        pairs, bounds, _, with_pair, at = chunk.pairs(pair_buckets)
        values = np.zeros(len(pairs))
        answers = back.filter(pc.equal(back["kind"], 1))
        for bucket, x in zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist(), strict=True):
            values[bounds[bucket] : bounds[bucket + 1]] = np.frombuffer(x, np.int16) / SCALE
        given[with_pair] += values[at]
        known = tokens.sums((count > 0)[tokens.code]).astype(np.int64)
        return pa.Table.from_arrays([chunk.group["doc_id"].cast(pa.int64()), pa.array(np.diff(tokens.bounds)), pa.array(known), pa.array(base), pa.array(tokens.sums(given))], names=names)

    return run


def score_texts(docs: DataFrame, learned, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``learned`` is a condition: the rows to learn from.  Tokens are words in ASCII lower case and one end token per text (a
    null text is empty).  base_score sums log10((c + 1) / (N + V + 1)) over the text's tokens, score is the log10 probability
    under the model.  Repeated rows are rows of their own; a null id is kept.  An empty table gives an empty result; with
    nothing to learn from every token of a class has the same chance.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), learned.alias("learned"))
    training = rows.where("learned").select("text")
    pairs = _collected(training.mapInArrow(_neighbours, BLOCKS), (ENDINGS, ENDINGS))
    feature, cls = groups_of(pairs)
    groups = spark.sparkContext.broadcast((feature, cls))
    histories = _collected(training.mapInArrow(_histories(groups), BLOCKS), (FEATURES, CLASSES * CLASSES)).reshape(FEATURES, CLASSES, CLASSES)
    chances = history_table(fit(histories, cls, spark), cls)
    n, documents = int(histories.sum()), int(pairs[:, -1].sum())
    known = spark.sparkContext.broadcast((feature, cls, documents))
    model = spark.sparkContext.broadcast((feature, cls, documents, chances, n))
    total = text_bytes(rows)
    buckets, parts = buckets_for(total), partitions_for(spark, total)
    # one plan from here to the scores: the documents are shuffled by chunk once
    dealt = chunked(rows, total, CHUNK)
    chunks = dealt.groupBy("chunk")
    back = chunks.applyInArrow(_send(groups, buckets), SENT).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_count, BACK)
    sums = [F.array(*[F.sum(F.element_at(c, i + 1)) for i in range(CLASSES)]).alias(c) for c in ("kinds", "mass")]
    totals = back.where("chunk = -1").agg(*sums)  # one row
    counted = back.where("chunk >= 0").select("chunk", "bucket", "payload").crossJoin(F.broadcast(totals))
    sent = chunks.cogroup(counted.groupBy("chunk")).applyInArrow(_send_pairs(known, buckets, 2 * buckets), PAIRS_SENT)
    solved = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_solve, "chunk int, bucket int, payload binary")
    both = counted.withColumn("kind", F.lit(0)).unionByName(solved.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    scored = chunks.cogroup(both.groupBy("chunk")).applyInArrow(_score(model, buckets, 2 * buckets), SCORES)
    return scored.withColumn("train_tokens", F.lit(n))


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = training_rows(7, 2)
    return score_texts(table(spark, sf_dir, "documents"), ~held).withColumn("held_out", held)
