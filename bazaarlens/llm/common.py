"""Helpers shared by the training-data operators.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  Inside tasks the words of many documents are held
as one flat Arrow array plus row offsets, and every word has a 64-bit hash that depends on nothing but its bytes, so
that two tasks that never meet give one word the same name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.plans.lineage import saved, shared_folder  # noqa: F401

#: Raw text bytes that one chunk of documents holds on average: a unit of work that fits in a Python worker many times.
CHUNK_BYTES = 2 << 20
#: Raw text bytes behind one bucket of a shuffled census.
BUCKET_BYTES = 32 << 20

#: Raw text bytes behind one partition of a shuffle, until there are so many partitions; a task takes its groups one by one, so
#: that a large partition needs no more memory.
PARTITION_BYTES, MOST_PARTITIONS = 64 << 20, 100_000

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_rows(divisor: int, held: int, doc_id: str = "doc_id"):
    """Whether a document is held out: crc32 of its id as text leaves the remainder ``held``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor == held, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (two multiply-xorshift steps)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def mix2(a: np.ndarray, b: np.ndarray, tag: int = 0) -> np.ndarray:
    """A name for an ordered pair of names."""
    with np.errstate(over="ignore"):
        return mix(mix(a + U64(0x9E3779B97F4A7C15 + tag)) + b * U64(0xD6E8FEB86659FD93))


def split_words(text: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and for each text the range [offsets[i], offsets[i+1]) of its words.

    Nulls count as empty.  ``lower`` turns A-Z, and nothing else, into lower case.
    """
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    # lower-cased before any cast: pyarrow's ascii_lower misreads a slice that was cast to large_string
    text = pc.fill_null((pc.ascii_lower(text) if lower else text).cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(text)
    flat, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    flat, offsets = flat.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(filled)])
    return (flat if filled.all() else flat.filter(pa.array(filled))), before[offsets]


def encoded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words as indices into the array of distinct words."""
    d = pc.dictionary_encode(flat)
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and the offsets of each string in them."""
    words = words.cast(pa.large_binary())
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string: the sum of scrambled (byte, position) pairs, scrambled again with the length."""
    raw, at = buffers(words)
    lengths = np.diff(at)
    if not len(lengths):
        return np.zeros(0, U64)
    position = np.arange(len(raw), dtype=np.int64) - np.repeat(at[:-1], lengths)
    with np.errstate(over="ignore"):
        terms = mix((raw.astype(U64) | (position.astype(U64) << U64(8))) + U64(0x632BE59BD9B4E019 + (seed << 40)))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])
        return mix(total[at[1:]] - total[at[:-1]] + lengths.astype(U64) * U64(0xA24BAED4963EE407))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def chunked(docs: DataFrame, total: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text and what else there is) with their chunk, dealt by it: a chunk is a set of documents picked by a hash of the id.

    Used more than once in a plan, the one exchange below it is reused.
    """
    chunks = max(1, math.ceil(total / chunk_bytes))
    # salted, so that the chunk number is not the hash by which Spark deals rows to partitions
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(chunks)), F.lit(chunks)).cast("int")
    return docs.select(chunk.alias("chunk"), *docs.columns).repartition(partitions_for(docs.sparkSession, total), "chunk")


def partitions_for(spark: SparkSession, total: int) -> int:
    """Shuffle partitions for work that grows with ``total`` bytes of text: the session's number, or more for large inputs."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, math.ceil(total / PARTITION_BYTES)))


def buckets_for(total: int) -> int:
    return max(32, math.ceil(total / BUCKET_BYTES))


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that groups hashes by bucket, and the bounds of each bucket in it."""
    bucket = ((hashes >> U64(32)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def in_doc_order(group: pa.Table) -> pa.Table:
    """A chunk's documents by id, then text: the order by which one of equal windows comes first."""
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
