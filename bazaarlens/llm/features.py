"""Hashed features of words, for arrays of distinct words at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, buffers, mix

START, END = 2, 3
_C = ctypes.CDLL(None)
#: Distinct words whose n-grams are laid out at once.
SLICE = 1 << 15


def grams(words: pa.Array, sizes: tuple[int, ...], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the buckets of all byte n-grams, and each word's range in them.

    Words stand between a start and an end byte, so that n-grams at the edges are affixes.
    """
    raw, at = buffers(words)
    n = len(at) - 1
    lengths = np.diff(at) + 2
    first = np.concatenate([[0], np.cumsum(lengths)])
    padded = np.empty(int(first[-1]), np.uint8)
    padded[first[:-1]], padded[first[1:] - 1] = START, END
    inner = np.ones(len(padded), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    padded[inner] = raw
    left = np.repeat(first[1:], lengths) - np.arange(len(padded))  # bytes from here to the word's end
    out = []
    rolled = np.zeros(len(padded), U64)
    with np.errstate(over="ignore"):
        for size in range(1, max(sizes) + 1):
            reach = len(padded) - size + 1
            if reach > 0:
                rolled[:reach] = rolled[:reach] * U64(0x100000001B3) + padded[size - 1 :].astype(U64) + U64(1)
            if size in sizes:
                whole = left >= size
                index = (mix(rolled[whole] + U64(size << 56)) % U64(buckets)).astype(np.int64)
                out.append((index, np.concatenate([[0], np.cumsum(np.maximum(lengths - size + 1, 0))])))
    assert all(len(o) == n + 1 for _, o in out)
    return out


def summed(found: list[tuple[np.ndarray, np.ndarray]], values: np.ndarray) -> np.ndarray:
    """For each word the sum of the values (a number or a row) of its n-grams."""
    total = 0
    for index, at in found:
        running = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values[index], axis=0, dtype=np.float64)])
        total = total + running[at[1:]] - running[at[:-1]]
    return total


def gram_sums(words: pa.Array, sizes: tuple[int, ...], values: np.ndarray) -> np.ndarray:
    """``summed`` over the n-grams of each word, some words at a time: what it holds doesn't grow with their number."""
    parts = [summed(grams(words.slice(at, SLICE), sizes, len(values)), values) for at in range(0, len(words), SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, *values.shape[1:]))


def give_back() -> None:
    """Free memory goes back to the system, as a worker stays for other tasks beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_C, "malloc_trim", None)
    if trim is not None:  # the GNU library
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], step: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``step`` bytes of text, or one row."""
    for whole in batches:
        lengths = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False)
        sizes, at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + step, "right")) - 1)
            yield whole.slice(at, to - at)
            at = to
        give_back()


def sample(rows: DataFrame, label: str, each: int, text: str = "text", seed: int = 5) -> DataFrame:
    """(key, label, text): for each label the distinct texts with the least keyed hashes, at most ``each`` of them.

    Rows alike in label and text count once.  The cut by hash that each label needs is found first and applied in the scan, so
    that about four times the wanted rows are ordered within their label, and a label with most rows sends no more than others.
    """
    keyed = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(text, F.lit(seed)).alias("key"), label, text)
    # one row per label, and a label has a model of its own to hold in memory: a fixed bound
    counts = keyed.select("key", label).distinct().groupBy(label).count().limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}")
    spark = rows.sparkSession
    shares = spark.createDataFrame([(r[0], min(1.0, 4.0 * each / r[1])) for r in counts], rows.select(F.col(label).alias("of"), F.lit(0.0).alias("share")).schema)
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    cut = keyed.join(F.broadcast(shares), F.col(label) == F.col("of")).where(place < F.col("share") * (1 << 30))
    order = Window.partitionBy(label).orderBy(F.xxhash64("key", F.lit(seed + 1)), "key")
    chosen = cut.select("key", label).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).drop("n")
    # at most ``each`` keys of at most MOST_LABELS labels
    return keyed.join(F.broadcast(chosen), ["key", label]).dropDuplicates(["key", label])


#: Labels of which a sample can be drawn at most.
MOST_LABELS = 1000
#: Shards in which a sample is learned from.
SHARDS = 8


def averaged(sample_: DataFrame, learn, model: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Stochastic gradient descent with parameter mixing.

    In each round every shard of ``sample_`` starts from the same arrays and learns from its rows; the arrays are averaged,
    weighted by what was learned from.  ``learn(batches, arrays, turn)`` changes the arrays and returns that weight.  Only
    arrays of the model's fixed size reach the driver.
    """
    context = sample_.sparkSession.sparkContext
    for turn in range(rounds):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            arrays = [x.copy() for x in shared.value]
            n = float(learn(batches, arrays, turn))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[x.tobytes() for x in arrays]], pa.list_(pa.binary()))], names=["n", "arrays"])

        total, sums = 0.0, [np.zeros(x.shape) for x in model]
        for r in sample_.mapInArrow(run, "n double, arrays array<binary>").toLocalIterator():
            total += r["n"]
            for s, x in zip(sums, r["arrays"], strict=True):
                s += r["n"] * np.frombuffer(bytes(x), np.float64).reshape(s.shape)
        shared.unpersist()
        if total:
            model = [s / total for s in sums]
    return model
