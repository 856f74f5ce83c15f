"""Exact top-k inner product search over integer vectors, by descending norm.

Components become floor(256 x).  Candidates are sorted by descending length and packed into blocks; a query stops at the
first block whose longest vector can't reach its k-th score.  Within a block the first rotated coordinates (the axes of
the second-moment matrix, found by a symmetric eigenproblem of the bounded d x d sums, i.e. the right singular vectors)
give a partial product, and the Cauchy-Schwarz bound on the rest, |rest of q| * |rest of x|, rules out most candidates.
What is left is scored exactly in integers.

Two Spark passes: the block of the longest vectors gives every query a first threshold; a block of candidates is then sent to
those blocks of queries alone of which the longest vector can reach the lowest threshold, and each (stripe of candidate
blocks, block of queries) is a task that walks its blocks in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Candidates in a block, queries in a block, blocks that one task walks.
BLOCK, QUERIES, STRIPE = 4096, 1024, 2
#: The bytes of minus infinity, in hexadecimal digits.
NOTHING = np.array([-np.inf], "<f8").tobytes().hex()
#: Rotated coordinates of the partial product.
LEADING = 16
EXACT_FLOAT = 2.0**53


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double> of whole numbers, norm); vectors that are null or hold null or non-finite parts go."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256).cast("double"))
    sound = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    found = rows.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null")
    return found.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def _stack(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


def _moments(width: int):
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            m = _stack(frame["v"].tolist(), width)
            total += m.T @ m
        yield pd.DataFrame({"row": np.arange(width), "sums": list(total)})

    return sums


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes by descending share of the squared length; d x d numbers reach the driver whatever the number of rows."""
    parts = vectors.select("v").mapInPandas(_moments(width), "row int, sums array<double>")
    parts = parts.select("row", F.posexplode("sums").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x"))
    m = np.zeros((width, width))
    for r, c, x in parts.collect():
        m[r, c] = x
    _, axes = np.linalg.eigh((m + m.T) / 2)
    return axes[:, ::-1]


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: ids and vectors as bytes, the longest vector first."""
    frame = frame.sort_values(["norm", "vec_id"], ascending=[False, True])
    width = max(map(len, frame["v"]), default=0)
    first = frame.iloc[0]
    return pd.DataFrame({"block": [first["block"]], "n": [len(frame)], "width": [width], "top": [float(first["norm"])], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "data": [_stack(frame["v"].tolist(), width).tobytes()]})


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(pairs: pd.DataFrame, axes: np.ndarray, k: int, leading: int) -> pd.DataFrame:
    """One block of queries against the candidate blocks of one stripe, walked by descending length."""
    width = len(axes)
    out_q, out_v, out_s = [], [], []
    row = pairs.iloc[0]
    qids = np.frombuffer(row["q_ids"], np.int64)
    queries = np.zeros((len(qids), width))
    queries[:, : row["q_width"]] = np.frombuffer(row["q_data"], np.float64).reshape(len(qids), -1)
    floor_ = np.frombuffer(row["q_floor"], np.float64).copy()
    length = np.sqrt((queries**2).sum(1))
    turned = queries @ axes
    rest_q = np.sqrt(np.maximum((turned[:, leading:] ** 2).sum(1), 0))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qids]
    for block in pairs.sort_values(["top", "block"], ascending=[False, True]).itertuples():
        ids = np.frombuffer(block.ids, np.int64)
        x = np.zeros((len(ids), width))
        x[:, : block.width] = np.frombuffer(block.data, np.float64).reshape(len(ids), -1)
        if float(length.max(initial=0)) * block.top >= 2.0**63:
            raise OverflowError("an inner product doesn't fit in 64 bits")
        exact = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1) < EXACT_FLOAT
        slack = 1e-6 * (1 + length * block.top)  # for rounding in the rotated sums
        live = np.flatnonzero(length * block.top + slack >= floor_)
        if not len(live):
            break
        turned_x = x @ axes[:, :leading]
        rest_x = np.sqrt(np.maximum((x**2).sum(1) - (turned_x**2).sum(1), 0)) + 1e-6 * (1 + np.sqrt((x**2).sum(1)))
        for part in np.array_split(live, max(1, len(live) * len(ids) // 2_000_000)):
            bound = turned[part][:, :leading] @ turned_x.T
            bound += np.outer(rest_q[part], rest_x)
            bound += slack[part, None]
            for i, q in enumerate(part):
                close = np.flatnonzero(bound[i] >= floor_[q])
                close = close[ids[close] != qids[q]]
                if not len(close):
                    continue
                if exact:
                    score = (x[close] @ queries[q]).astype(np.int64)
                else:
                    score = (x[close].astype(np.int64) * queries[q].astype(np.int64)).sum(1)
                v, s = np.concatenate([found[q][0], ids[close]]), np.concatenate([found[q][1], score])
                top = _best(s, v, k)
                found[q] = v[top], s[top]
                if len(top) == k:
                    floor_[q] = max(floor_[q], float(s[top[-1]]))
    for q, (v, s) in zip(qids, found, strict=True):
        out_q.append(np.full(len(v), q))
        out_v.append(v)
        out_s.append(s)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pd.DataFrame({"query_id": join(out_q), "vec_id": join(out_v), "score": join(out_s)})


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(rows: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", leading: int = LEADING, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query, ties to the smaller vec_id.

    ``is_query`` is a condition on ``vec_id``; every row but the query's own is a candidate.  Fewer candidates than k give
    fewer rows; an empty table gives none.  Shorter vectors count as filled up with zeros.  Repeated rows are one each;
    a repeated id is never its own candidate.  Vectors so long that a product may not fit in 64 bits raise an error.
    """
    rows_ = integer_vectors(rows, vec_id, vector)
    vectors = saved(rows_)
    count, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    empty = vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    if not count or not width:
        return empty
    axes = rotation(vectors, width)
    # ranges of the norm, longest first: a sample finds the bounds, so blocks hold about as many rows each
    blocks = max(1, -(-count // block))
    ranged = vectors.repartitionByRange(blocks, F.desc("norm"), "vec_id").withColumn("block", F.spark_partition_id())
    schema = "block int, n int, width int, top double, ids binary, data binary"
    candidates = saved(ranged.groupBy("block").applyInPandas(_pack, schema))
    asked = vectors.where(is_query)
    query_blocks = max(1, -(-asked.count() // QUERIES))
    queries = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).groupBy("block").applyInPandas(_pack, schema)
    queries = saved(queries.select(F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("width").alias("q_width"), F.col("top").alias("q_top"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")))

    joined = "stripe int, query_id long, vec_id long, score long"

    def scored(c: DataFrame, q: DataFrame) -> DataFrame:
        # numbers of blocks and bounds first: a pair of blocks that can't hold a result is not sent
        reach = q.select("q_block", "q_top", "q_least")
        sent = c.select("block", "top", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q_block")).join(reach, "q_block")
        sent = sent.where(F.col("top") * F.col("q_top") * (1 + 1e-6) + 1e-6 >= F.col("q_least")).select("block", "q_block")
        pairs = sent.join(c, "block").join(q, "q_block").groupBy("q_block", "stripe")
        return pairs.applyInPandas(lambda frame: _search(frame, axes, k, leading).assign(stripe=int(frame["stripe"].iloc[0])), joined).drop("stripe")

    striped = candidates.withColumn("stripe", F.floor(F.col("block") / STRIPE).cast("int"))
    longest = candidates.agg(F.max(F.struct("top", -F.col("block"))).alias("m")).select((-F.col("m.col2")).alias("block"))
    first = striped.join(F.broadcast(longest), "block", "left_semi").withColumn("stripe", F.lit(0))
    seed = _top(scored(first, queries.withColumn("q_floor", F.unhex(F.expr(f"repeat('{NOTHING}', q_n)"))).withColumn("q_least", F.lit(float("-inf")))), k)
    seed = seed.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))

    def floors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return left.assign(q_floor=[], q_least=[])
        known = dict(zip(right["query_id"], right["floor"], strict=True))
        ids = np.frombuffer(left["q_ids"].iloc[0], np.int64)
        least = np.array([known.get(i, np.nan) for i in ids], float)
        least = np.where(np.isnan(least), -np.inf, least)
        return left.assign(q_floor=[least.tobytes()], q_least=[float(least.min())])

    seed = seed.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    asked_ = queries.groupBy("q_block").cogroup(seed.groupBy("q_block")).applyInPandas(floors, "q_block int, q_n int, q_width int, q_top double, q_ids binary, q_data binary, q_floor binary, q_least double")
    asked_ = saved(asked_)
    return _top(scored(striped, asked_), k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
