"""Ranked lexical search by range-maximum tables over posting lists.

``write_index`` cuts the documents into segments of a bounded number of bytes and documents.  A segment is one row: its
documents in order of their number of terms, so that documents of like impact stand together, and for each term (a 64-bit
hash of its bytes) the posting list of documents and counts.  Every document is in the index.

``search`` answers a block of queries at a time.  Within a segment the impacts of a block's posting lists are laid end to end
under one sparse table of range maxima, two look-ups a range.  A query starts with all the segment's documents as one
interval, whose bound is the sum of its terms' range maxima.  The intervals of the highest bounds are taken first, each is
split at the document of its largest single impact, that document is scored exactly, and the two halves get bounds of their
own; intervals whose bound is below the k-th score so far are left.  A sixteenth of the segments, picked by a hash, is
searched first, and its k-th scores are the floors from which the others start, so that most of them return no row.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, shared_folder, split_words, table, word_hashes

#: Text bytes and documents that a segment holds at most (a longer document is a segment of its own).
SEGMENT_BYTES, SEGMENT_DOCS = 8 << 20, 8192
#: Text bytes of the queries that one pass over the index answers.
BLOCK_BYTES = 2 << 20
#: One segment in so many is searched first.
SEED_SHARE = 16
#: Stands for a null document id, which comes last among equal scores.
NO_ID = 2**63 - 1

#: A-Z become a-z, ASCII bytes that aren't letters or digits become spaces, bytes of other characters stay.
_BYTES = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _BYTES[_low:_high] = np.arange(_low, _high)
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)

SEGMENTS = "seed boolean, n_docs int, filled long, n_terms long, doc_ids binary, sizes binary, terms binary, counts binary, docs binary, tfs binary"


def split_terms(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts in order, and for each text the range of its terms; nulls count as empty."""
    text = pc.fill_null((text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text).cast(pa.large_string()), "")
    if not len(text):
        return split_words(text)
    _, offsets, data = text.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    body = _BYTES[raw[at[0] : at[-1]]]
    return split_words(pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(body.tobytes())]))


def portions(batches: Iterator[pa.RecordBatch], most_bytes: int, most_rows: int, text: str = "text") -> Iterator[pa.Table]:
    """The rows again, in tables of at most so many bytes of text and rows (one row at least)."""
    held, size, rows = [], 0, 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths):
            if rows and (size + n > most_bytes or rows >= most_rows):
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, rows, start = [], 0, 0, i
            size, rows = size + int(n), rows + 1
        held.append(batch.slice(start))
    if rows:
        yield pa.Table.from_batches(held)


def _segment(part: pa.Table) -> dict:
    ids = pc.fill_null(part.column("doc_id"), NO_ID).to_numpy().astype(np.int64)
    flat, offsets = split_terms(part.column("text"))
    sizes = np.diff(offsets)
    order = np.lexsort((ids, sizes))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    coded = pc.dictionary_encode(flat)
    hashes = word_hashes(coded.dictionary)
    terms, rank = np.unique(hashes, return_inverse=True)
    key = rank[coded.indices.to_numpy().astype(np.int64)] * len(ids) + np.repeat(place, sizes)
    key, tfs = np.unique(key, return_counts=True)
    counts = np.bincount(key // len(ids), minlength=len(terms))
    ids = ids[order]
    return {
        "seed": int(word_hashes(pa.array([ids.tobytes()], pa.large_binary()))[0] % np.uint64(SEED_SHARE)) == 0, "n_docs": len(ids), "filled": int((sizes > 0).sum()), "n_terms": int(sizes.sum()),
        "doc_ids": ids.tobytes(), "sizes": sizes[order].astype(np.int64).tobytes(), "terms": terms.tobytes(), "counts": counts.astype(np.uint32).tobytes(),
        "docs": (key % len(ids)).astype(np.uint16).tobytes(), "tfs": tfs.astype(np.uint32).tobytes(),
    }


def _arrow(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]))


def write_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """Writes the segments of all documents as Parquet under ``path`` and returns them.

    Each row is a document, repeated rows too.  Null and empty texts are documents without terms.  A term's name is a 64-bit
    hash: two terms share one with a chance of 2^-64.
    """
    most_docs = min(segment_docs, 1 << 16)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, segment_bytes, most_docs):
            yield _arrow(SEGMENTS, [_segment(part)])

    docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(segments, SEGMENTS).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


class RangeMaxima:
    """A sparse table over values laid end to end: the place of the largest value of any range, by two look-ups."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        levels = [np.arange(len(values), dtype=np.int32)]
        while 2 << (len(levels) - 1) <= longest:
            half, last = 1 << (len(levels) - 1), levels[-1]
            a, b = last[:-half], last[half:]
            level = last.copy()
            level[: len(a)] = np.where(values[a] >= values[b], a, b)
            levels.append(level)
        self.levels = np.stack(levels)

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For ranges [a, b) that aren't empty."""
        k = np.frexp(b - a)[1] - 1  # the largest power of two in the length
        i, j = self.levels[k, a], self.levels[k, b - (1 << k)]
        return np.where(self.values[i] >= self.values[j], i, j)


class Postings:
    """The posting lists of a segment for a block's terms, with the impact of every posting."""

    def __init__(self, row: dict, wanted: np.ndarray, weights: np.ndarray, n_all: int, l_all: int):
        number = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, sizes = number("doc_ids", np.int64), number("sizes", np.int64)
        terms, counts = number("terms", np.uint64), number("counts", np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(terms, wanted), max(0, len(terms) - 1))
        here = np.flatnonzero((terms[at] == wanted) & (weights > 0)) if len(terms) else np.zeros(0, np.int64)
        first, lengths = (np.cumsum(counts) - counts)[at[here]], counts[at[here]]
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        #: By number of the wanted term the number of its list, or -1.
        self.lists = np.full(len(wanted), -1)
        self.lists[here] = np.arange(len(here))
        take = np.repeat(first - self.start[:-1], lengths) + np.arange(self.start[-1])
        self.docs, tf = number("docs", np.uint16)[take].astype(np.int64), number("tfs", np.uint32)[take].astype(np.int64)
        self.n = len(self.ids)
        self.key = np.repeat(np.arange(len(here)), lengths) * self.n + self.docs
        m = 10 + 90 * sizes * n_all // max(1, l_all)
        self.impact = np.repeat(weights[here], lengths) * (10**9 * tf // (1000 * tf + 8 * m[self.docs]))
        self.maxima = RangeMaxima(self.impact, int(lengths.max(initial=1)))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


def best_first(postings: Postings, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores of the segment's k best documents among those that score ``floor`` (1 at least) or more."""
    lists = postings.lists[terms]
    lists = lists[lists >= 0]
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(lists):
        return ids, scores
    least, width, base = max(1, floor), 4, lists * postings.n

    def intervals(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Ranges of postings, one row for an interval: with the bound, and the posting of the largest single impact."""
        full = b > a
        some = full.any(1)
        a, b, full = a[some], b[some], full[some]
        place = np.zeros(a.shape, np.int64)
        place[full] = postings.maxima.place(a[full], b[full])
        value = np.where(full, postings.impact[place], 0)
        rows = np.arange(len(a))
        return [value.sum(1), a, b, place[rows, value.argmax(1)]]

    pool = intervals(postings.start[lists][None, :], postings.start[lists + 1][None, :])
    while True:
        live = pool[0] >= least
        pool = [x[live] for x in pool]
        if not len(pool[0]):
            return ids, scores
        if len(pool[0]) > width:
            order = np.argpartition(-pool[0], width - 1)
            taken, left = [x[order[:width]] for x in pool], [x[order[width:]] for x in pool]
        else:
            taken, left = pool, [x[:0] for x in pool]
        _, a, b, top = taken
        split = base[None, :] + postings.docs[top][:, None]
        c = np.searchsorted(postings.key, split)
        at = np.minimum(c, len(postings.key) - 1)
        holds = postings.key[at] == split
        ids, scores = _best(np.concatenate([ids, postings.ids[postings.docs[top]]]), np.concatenate([scores, np.where(holds, postings.impact[at], 0).sum(1)]), k)
        if len(ids) == k:
            least = max(least, int(scores[-1]))
        halves = intervals(np.concatenate([a, c + holds]), np.concatenate([c, b]))
        pool = [np.concatenate(x) for x in zip(left, halves, strict=True)]
        width = min(256, 2 * width)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct queries in blocks of a bounded number of bytes."""
    rows = saved(items.distinct().withColumn("size", F.octet_length("text")))
    blocks = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for number in range(blocks):
        found = [(i, t) for i, t in rows.where(block == number).select("item_id", "text").collect()]
        if found:
            yield found


def _answers(index: DataFrame, queries: list[tuple[int | None, str]], n_all: int, l_all: int, k: int) -> DataFrame:
    """(number, item_id, doc_id, score): a block's candidates of all segments."""
    flat, offsets = split_terms(pa.array([t for _, t in queries], pa.large_string()))
    hashes = word_hashes(flat)
    wanted = np.unique(hashes)
    own = [np.unique(np.searchsorted(wanted, hashes[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    numbers = [i for i, _ in queries]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                terms, counts = np.frombuffer(terms.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.uint32)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    total += np.where(terms[at] == wanted, counts[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    df = np.zeros(len(wanted), np.int64)
    for t, n in index.select("terms", "counts").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    out = "number int, doc_id long, score long"

    def searched(segments: DataFrame, floors: dict[int, int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    postings = Postings(batch.slice(i, 1).to_pylist()[0], wanted, weights, n_all, l_all)
                    found = [best_first(postings, terms, k, floors.get(q, 1)) for q, terms in enumerate(own)]
                    number = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(number), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], names=["number", "doc_id", "score"])

        return segments.select("doc_ids", "sizes", "terms", "counts", "docs", "tfs").mapInArrow(run, out)

    first = saved(_ranked(searched(index.where("seed"), {}), k))
    floors = {r[0]: r[1] for r in first.where(F.col("rank") == k).select("number", "score").collect()}
    both = first.drop("rank").unionAll(searched(index.where("not seed"), floors))
    names = index.sparkSession.createDataFrame(list(enumerate(numbers)), "number int, item_id long")
    return _ranked(both, k).join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index for each query that score above 0.

    Equal scores come by ascending document id, a null id last.  Queries alike in id and text count once; two texts under one
    id are two queries.  A query without terms, and any query to an empty index, has no row.  A term that nearly every
    document has weighs nothing.
    """
    n_all, l_all = index.agg(F.sum("filled"), F.sum("n_terms")).first()
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = None
    for block in _blocks(asked, block_bytes):
        part = saved(_answers(index, block, n_all or 0, l_all or 0, k))
        found = part if found is None else found.unionAll(part)
    if found is None:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, **options) -> DataFrame:
    """Index and search in one go; the index is written to the session's shared folder."""
    path = f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    return search(write_index(docs, path, **options), items, k)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (
  SELECT doc_id, unnest({_TERMS}) AS term FROM documents
), t AS (
  SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL
), n AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY ALL
), g AS (
  SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM n
), i AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, g GROUP BY term
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN w USING (term) JOIN n USING (doc_id), g GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS "rank", doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
