"""Removal of long repeated word runs by recompression.

Each round names maximal runs of one symbol, then pairs of a left and a right symbol (which a symbol is, a hash of its name
decides), and puts the new symbol in their place.  A name is a 64-bit hash of what it stands for, so every task gives one
string the same name and a round needs no dictionary.  Equal windows of words have equal interior symbols in every round;
what may differ is near their two ends, and the ``core`` of a window is the range of symbols that its own words settle.

1. Census: the window's anchor is the longest symbol of its last core that isn't empty.  Each chunk of documents sends the
   anchors it has to buckets by name, and the buckets send back those that several chunks have.
2. Verification: windows whose anchor occurs more than once are compared by two 64-bit hashes of all their words, each by
   bucket; the first occurrence (smallest document, then position) stands, later ones go back to their chunk.
3. Words under such a window are removed.

Work is dealt by chunks of documents and by buckets of hashes; no group is larger than a chunk or a bucket, however often
a passage repeats, because a chunk sends a name once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, buckets_for, by_bucket, chunked, encoded, in_doc_order, mix, mix2, partitions_for, split_words, table, text_bytes, word_hashes

WINDOW = 20
ROUNDS = 3
#: Words that are compressed at once.
STEP = 1 << 18

SENT = "bucket int, chunk int, kind int, a binary, b binary, c binary, d binary"
BACK = "chunk int, a binary"


class Sequence:
    """One round's symbols: their names, where each begins, and per window the range [lo, hi) of its core."""

    def __init__(self, names: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.names, self.starts, self.lo, self.hi = names, starts, lo, hi

    def runs(self, tag: int) -> Sequence:
        """Runs of one symbol become a symbol.  A core loses the runs that its end symbols are in."""
        x = self.names
        head = np.concatenate([[True], x[1:] != x[:-1]])
        run = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(x)))
        names = np.where(count > 1, mix2(x[first], count.astype(U64), tag), x[first])
        filled = self.hi > self.lo
        lo = np.where(filled, run[np.minimum(self.lo, len(x) - 1)] + 1, 0)
        hi = np.where(filled, run[np.maximum(self.hi - 1, 0)], 0)
        return Sequence(names, self.starts[first], lo, hi)

    def pairs(self, tag: int) -> Sequence:
        """A left symbol and the right one after it become a symbol.  A core loses an end that may pair outwards."""
        x = self.names
        left = (mix(x + U64(tag)) & U64(1)) == 0
        second = np.concatenate([[False], left[:-1] & ~left[1:]])
        paired = np.append(second[1:], False)
        after = np.append(x[1:], U64(0))
        names = np.where(paired, mix2(x, after, tag), x)[~second]
        at = np.cumsum(~second) - 1
        filled = self.hi > self.lo
        a, b = np.minimum(self.lo, len(x) - 1), np.maximum(self.hi - 1, 0)
        lo = np.where(filled, at[a] + ~left[a], 0)
        hi = np.where(filled, at[b] + ~left[b], 0)
        return Sequence(names, self.starts[~second], lo, hi)


def _range_argmax(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first index of the largest value in each range [lo, hi)."""
    best, width = np.arange(len(value)), 1
    out = np.zeros(len(lo), np.int64)
    size = hi - lo
    while True:
        now = (size >= width) & (size < 2 * width)
        if now.any():
            a, b = best[lo[now]], best[hi[now] - width]
            out[now] = np.where(value[b] > value[a], b, a)
        if 2 * width > len(value) or not (size >= 2 * width).any():
            return out
        a, b = best[: len(best) - width], best[width:]
        best, width = np.where(value[b] > value[a], b, a), 2 * width


def anchors(words: np.ndarray, windows: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows (index of their first word): the name of the anchor, and where it begins."""
    now = Sequence(words, np.arange(len(words)), windows, windows + width)
    key, at = np.zeros(len(windows), U64), np.zeros(len(windows), np.int64)
    for level in range(rounds + 1):
        if level:
            now = now.runs(2 * level).pairs(2 * level + 1)
        some = np.flatnonzero(now.hi > now.lo)
        if not len(some):
            break
        length = np.minimum(np.diff(np.append(now.starts, len(words))), 255).astype(U64)
        chosen = _range_argmax((length << U64(56)) | (now.names >> U64(8)), now.lo[some], now.hi[some])
        key[some], at[some] = mix2(now.names[chosen], np.full(len(some), level, U64), 77), now.starts[chosen]
    return key, at


class Chunk:
    """The documents of one chunk in order of id, their words as hashes, and the windows in them."""

    def __init__(self, group: pa.Table, width: int):
        self.group = in_doc_order(group)
        flat, self.offsets = split_words(self.group["text"])
        code, distinct = encoded(flat)
        self.words = word_hashes(distinct)[code]
        self.second = word_hashes(distinct, 1)[code]
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))
        self.windows = np.flatnonzero(np.arange(len(self.words)) + width <= ends)
        self.width = width

    def anchors(self, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece by piece: each piece has some whole windows and the words they cover."""
        keys, ats = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for at in range(0, len(self.words), STEP):
            some = self.windows[np.searchsorted(self.windows, at) : np.searchsorted(self.windows, at + STEP)]
            if len(some):
                key, where = anchors(self.words[at : at + STEP + self.width], some - at, self.width, rounds)
                keys.append(key)
                ats.append(where + at)
        return np.concatenate(keys), np.concatenate(ats)

    def hashes(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.zeros(len(windows), U64), np.zeros(len(windows), U64)
        with np.errstate(over="ignore"):
            for i in range(self.width):
                a = (a * U64(0x9E3779B97F4A7C15)) + self.words[windows + i]
                b = (b * U64(0xC2B2AE3D27D4EB4F)) + self.second[windows + i]
        return mix(a), mix(b)

    def ids(self) -> np.ndarray:
        return self.group["doc_id"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x.endswith("int") else pa.binary() for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _census(width: int, rounds: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        chunk = group["chunk"][0].as_py()
        keys = np.unique(Chunk(group, width).anchors(rounds)[0])
        order, bounds = by_bucket(keys, buckets)
        keys = keys[order]
        return _rows(SENT, [(i, chunk, 0, keys[a:b].tobytes(), None, None, None) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b])

    return run


def _shared(group: pa.Table) -> pa.Table:
    """The names in a bucket that several chunks sent, for each of those chunks."""
    sent = [np.frombuffer(x, U64) for x in group["a"].to_pylist()]
    names, count = np.unique(np.concatenate(sent), return_counts=True)
    names = names[count > 1]
    rows = []
    for chunk, x in zip(group["chunk"].to_pylist(), sent, strict=True):
        mine = x[np.isin(x, names, assume_unique=True)]
        if len(mine):
            rows.append((chunk, mine.tobytes()))
    return _rows(BACK, rows)


def _joined(parts: pa.Table, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in parts["a"].to_pylist())])


def _candidates(width: int, rounds: int, buckets: int):
    def run(group: pa.Table, back: pa.Table) -> pa.Table:
        if not len(group):
            return _rows(SENT, [])
        number = group["chunk"][0].as_py()
        chunk = Chunk(group, width)
        key, at = chunk.anchors(rounds)
        order = np.lexsort((at, key))
        k, a = key[order], at[order]
        twice = np.unique(k[1:][(k[1:] == k[:-1]) & (a[1:] != a[:-1])])
        windows = chunk.windows[np.isin(key, np.union1d(twice, _joined(back, U64)))]
        h1, h2 = chunk.hashes(windows)
        order = np.lexsort((windows, h2, h1))
        again = np.concatenate([[False], (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])])[: len(order)]
        later, first = np.sort(windows[order[again]]), np.sort(order[~again])
        h1, h2, windows = h1[first], h2[first], windows[first]
        doc = chunk.ids()[np.searchsorted(chunk.offsets, windows, "right") - 1]
        order, bounds = by_bucket(h1, buckets)
        rows = [(number % buckets, number, 1, later.astype(np.int32).tobytes(), None, None, None)] if len(later) else []
        for i, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if x < y:
                o = order[x:y]
                rows.append((i, number, 0, h1[o].tobytes(), h2[o].tobytes(), doc[o].tobytes(), windows[o].astype(np.int32).tobytes()))
        return _rows(SENT, rows)

    return run


def _later(group: pa.Table) -> pa.Table:
    """Of windows with equal words all but the one in the smallest document; a document is in one chunk only."""
    rows = group.to_pylist()
    back = [(r["chunk"], r["a"]) for r in rows if r["kind"] == 1]
    rows = [r for r in rows if r["kind"] == 0]
    if rows:
        sizes = [len(r["a"]) // 8 for r in rows]
        of = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows])
        h1, h2, doc = of("a", U64), of("b", U64), of("c", np.int64)
        order = np.lexsort((doc, h2, h1))
        again = np.concatenate([[False], (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])])
        gone = np.zeros(len(h1), bool)
        gone[order[again]] = True
        for r, mask in zip(rows, np.split(gone, np.cumsum(sizes)[:-1]), strict=True):
            if mask.any():
                back.append((r["chunk"], np.frombuffer(r["d"], np.int32)[mask].tobytes()))
    return _rows(BACK, back)


def _removed(width: int, texts: bool):
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def run(group: pa.Table, back: pa.Table) -> pa.Table:
        if not len(group):
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())], names=names)
        group = in_doc_order(group)
        texts_ = [(x or "").encode().split() for x in group["text"].to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts_])])
        edge = np.zeros(offsets[-1] + 1, np.int64)
        gone = _joined(back, np.int32).astype(np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + width, -1)
        covered = np.cumsum(edge)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(covered)])
        removed = before[offsets[1:]] - before[offsets[:-1]]
        kept = []
        for words, a, n in zip(texts_, offsets, removed, strict=False):
            if n:
                words = [w for w, c in zip(words, covered[a : a + len(words)].tolist(), strict=True) if not c]
            text = b" ".join(words)
            kept.append(text.decode() if texts else hashlib.sha256(text).hexdigest())
        return pa.Table.from_arrays([group["doc_id"], pa.array(np.diff(offsets)), pa.array(removed), pa.array(kept, pa.string())], names=names)

    return run


def drop_repeats(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by spaces; or their SHA-256).

    A word goes if some ``width`` consecutive words around it occur earlier too: in a document of smaller id, or earlier in
    the same one; windows are judged on the input.  A null text has no words; fewer words than a window stay whole.  Rows
    that repeat an id are ordered by their text.  A null id counts as the smallest id.  An empty table gives none.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text).alias("text"))
    total = text_bytes(rows)
    buckets, parts = buckets_for(total), partitions_for(docs.sparkSession, total)
    dealt = chunked(rows, total)
    chunks = dealt.groupBy("chunk")
    names = chunks.applyInArrow(_census(width, rounds, buckets), SENT)
    shared = names.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_shared, BACK)
    windows = chunks.cogroup(shared.groupBy("chunk")).applyInArrow(_candidates(width, rounds, buckets), SENT)
    later = windows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_later, BACK)
    found = chunks.cogroup(later.groupBy("chunk")).applyInArrow(_removed(width, not digests), "doc_id long, n_words long, n_removed long, kept string")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"), digests=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20
), h AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i+19], ' ') ORDER BY doc_id, i) AS n FROM p
), gone AS (
  SELECT DISTINCT doc_id, i + j AS k FROM h, range(0, 20) t(j) WHERE n > 1
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d
), kept AS (
  SELECT w.doc_id, count(g.k) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.k) FILTER (WHERE g.k IS NULL), '') AS text
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.k = g.k GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
