"""Sets of word shingles: their names, minima, SimHash fingerprints, and the exact Jaccard similarity of two texts.

A shingle is a run of ``WORDS`` words, A-Z lower-cased; a text of fewer words is one shingle.  Texts of one shingle set
have one name and are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import encoded, mix, mix2, saved, split_words, word_hashes
from .features import pieces

WORDS = 5
#: Pairs whose shingle sets have in common at least this part of their union, as a fraction of whole numbers, are linked.
SIMILARITY = (4, 5)
BANDS, ROWS = 40, 5
#: Bytes of text that are hashed at once, and shingles whose minima are taken at once.
STEP, SLICE = 2 << 20, 4096

#: Bits of a sketch, each of one more minimum, and those that sketches of sets of SIMILARITY may differ in: 102 on average, and
#: five standard deviations of 9.6.
SKETCH, APART = 1024, 150


def _permutations(first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    turns = (mix(np.arange(first, first + 2 * count, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return turns[:count] | np.uint32(1), turns[count:]


MINIMA, SKETCHED = _permutations(1, BANDS * ROWS), _permutations(1 << 20, SKETCH)


def shingle_sets(text: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; never none."""
    # lower-cased before any cast: pyarrow's ascii_lower misreads a slice that was cast to large_string
    flat, offsets = split_words(pc.ascii_lower(text))
    code, distinct = encoded(flat)
    names = word_hashes(distinct)[code]
    runs = names[: max(0, len(names) - words + 1)]
    for k in range(1, words):
        runs = mix2(runs, names[k : len(names) - words + 1 + k], k)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
            continue
        whole = np.zeros(1, np.uint64)  # tags apart from those of runs
        for k in range(a, b):
            whole = mix2(whole, names[k : k + 1], words + b - a)
        out.append(whole)
    return out


def name(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7)


def minima(shingles: np.ndarray, permutations: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    factors, addends = permutations
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), SLICE):
        least = np.minimum(least, (low[None, at : at + SLICE] * factors[:, None] + addends[:, None]).min(1))
    return least


def sketch(shingles: np.ndarray) -> bytes:
    """SKETCH bits, of which the part (1 + s) / 2 is alike on average for sets of similarity s."""
    least = minima(shingles, SKETCHED)
    return np.packbits(((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(31) == 1).tobytes()


def bands(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit name for each band of minima."""
    wide = minima(shingles, MINIMA).astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix2(out, wide[:, k])
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if it is in over half of the shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), SLICE):
        ones += np.unpackbits(shingles[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces([batch], STEP, 0):
            sets = shingle_sets(part.column(0))
            nodes = np.array([name(s) for s in sets], np.uint64).view(np.int64)
            flat = np.concatenate([bands(s) for s in sets]).view(np.int64) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            prints = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(prints), lists], names=["node", "fp", "bands"])


def signed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, fp, bands): one row per distinct shingle set."""
    return docs.select(F.col(text).alias("text")).mapInArrow(_signed, "node long, fp long, bands array<long>").dropDuplicates(["node"])


def _named(at: int, schema: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces([batch], STEP, at):
                nodes = np.array([name(s) for s in shingle_sets(part.column(at))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes)], names=schema)

    return run


def named(docs: DataFrame, text: str = "text", node: str = "node") -> DataFrame:
    """``docs`` and the name of each row's shingle set."""
    schema = T.StructType([*docs.schema.fields, T.StructField(node, T.LongType())])
    return docs.mapInArrow(_named(docs.columns.index(text), schema.names), schema)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(pieces([batch], STEP, 2), STEP, 3):
            near = np.zeros(part.num_rows, bool)
            for i, (a, b) in enumerate(zip(shingle_sets(part.column(2)), shingle_sets(part.column(3)), strict=True)):
                common = len(np.intersect1d(a, b, assume_unique=True))
                near[i] = common * SIMILARITY[1] >= (len(a) + len(b) - common) * SIMILARITY[0]
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["u", "v"])


def texts(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """(node, text): one text of each node in ``nodes``."""
    rows = named(docs.select(F.col(text).alias("text"))).join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return saved(rows.select("node", "text"))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces([batch], STEP, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sketch(s) for s in shingle_sets(part.column(1))], pa.binary())], names=["node", "sketch"])


def sketches(texts_: DataFrame) -> DataFrame:
    """(node, sketch)."""
    return texts_.mapInArrow(_sketched, "node long, sketch binary")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
        keep = pa.array(np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= APART)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def near(pairs: DataFrame, sketches_: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches differ in at most APART bits."""
    both = pairs.join(sketches_.toDF("u", "a"), "u").join(sketches_.toDF("v", "b"), "v").select("u", "v", "a", "b")
    return both.mapInArrow(_near, "u long, v long")


def similar(pairs: DataFrame, texts_: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose texts are as similar as SIMILARITY says."""
    left, right = texts_.toDF("u", "a"), texts_.toDF("v", "b")
    return saved(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_similar, "u long, v long"))
