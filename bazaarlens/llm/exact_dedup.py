"""Exact deduplication by skew-safe combining.

1. Locally: within each Arrow batch of the scan, equal texts meet in a content dictionary; only the one with the largest
   id carries its text on, the others carry that id instead.
2. Salted merge: rows are dealt by (SHA-256, salt), a hot digest having as many salts as its rows need, and stream past in order; a text is compared in full with the texts
   of the same digest, so a collision of digests can't join different texts.  Only hot digests have more than one salt.
3. Globally: the salt winners of hot digests are dealt by digest alone and compared in full again.

No stage holds a group: each keeps the texts that share the digest now passing, normally one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: A digest is hot if it has more than this share of all rows (1 / HOT_SHARE), so there are at most HOT_SHARE hot ones.
HOT_SHARE = 10_000
#: and at least this many rows.
HOT_ROWS = 64
#: Rows of a hot digest that one salt has on average, and the salts of all hot digests at most (apart from one each).
SALT_ROWS, MOST_SALTS = 1 << 14, 100_000

LOCAL = "doc_id long, sha binary, local_keep long, body string"
MERGED = "doc_id long, sha binary, salt_keep long, lead boolean, body string"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        text = pc.fill_null(batch.column(1), "")
        coded = pc.dictionary_encode(text)
        group = coded.indices.to_numpy().astype(np.int64)
        shas = [hashlib.sha256(x).digest() for x in coded.dictionary.cast(pa.binary()).to_pylist()]
        order = np.lexsort((np.arange(len(ids)), -ids, group))
        lead = np.zeros(len(ids), bool)
        lead[order[np.concatenate([[True], np.diff(group[order]) > 0])]] = True if len(ids) else False
        winner = np.zeros(len(shas), np.int64)
        winner[group[lead]] = ids[lead]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(shas, pa.binary()).take(pa.array(group)), pa.array(winner[group]), pc.if_else(pa.array(lead), text, pa.scalar(None, text.type)).cast(pa.string())],
            names=["doc_id", "sha", "local_keep", "body"],
        )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (sha, salt), the largest local_keep first and the row that carries the text before those that don't."""
    key, texts, at, keep = None, [], None, None
    for batch in batches:
        keeps, leads, bodies = [], [], []
        columns = (batch.column(i).to_pylist() for i in range(5))
        for sha, salt, local, body, hot in zip(*columns, strict=True):
            if (sha, salt) != key:
                key, texts, at, keep = (sha, salt), [], None, None
            lead = False
            if body is not None:
                keep = next((k for t, k in texts if t == body), None)
                if lead := keep is None:
                    texts.append((body, local))
                    keep = local
                at = local
            elif local != at:  # can't be: its text passed just before
                raise ValueError(f"document {local} came without its text")
            keeps.append(keep)
            leads.append(lead)
            bodies.append(body if lead and hot else None)
        yield pa.RecordBatch.from_arrays([batch.column(5), batch.column(0), pa.array(keeps, pa.int64()), pa.array(leads, pa.bool_()), pa.array(bodies, pa.string())], names=["doc_id", "sha", "salt_keep", "lead", "body"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Salt winners come by sha, the largest first."""
    key, texts = None, []
    for batch in batches:
        keeps = []
        for sha, mine, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if sha != key:
                key, texts = sha, []
            keep = next((k for t, k in texts if t == body), None)
            if keep is None:
                texts.append((body, mine))
                keep = mine
            keeps.append(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keeps, pa.int64())], names=["sha", "salt_keep", "keep_id"])


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_share: int = HOT_SHARE, hot_rows: int = HOT_ROWS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text is an empty one.  The row with the largest id of a group stays.
    Rows that repeat id and text count each; one of them stays.  A null id takes part as the smallest.  An empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text).alias("text"))
    digests = rows.groupBy(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sha")).count()
    digests = digests.where(F.col("count") > hot_rows)
    total = docs.count()
    # at most hot_share digests can have more than total / hot_share rows each: the broadcast has a fixed bound
    each = max(salt_rows, math.ceil(total / MOST_SALTS))
    hot = digests.where(F.col("count") * hot_share > total).select("sha", F.ceil(F.col("count") / each).cast("int").alias("salts"))
    local = rows.mapInArrow(_local, LOCAL).join(F.broadcast(hot), "sha", "left")
    salted = local.select("sha", F.coalesce(F.pmod(F.xxhash64("local_keep"), "salts"), F.lit(0)).cast("int").alias("salt"), "local_keep", "body", F.col("salts").isNotNull().alias("hot"), "doc_id")
    dealt = salted.repartition("sha", "salt").sortWithinPartitions("sha", "salt", F.desc("local_keep"), F.col("body").isNull())
    merged = saved(dealt.mapInArrow(_merge, MERGED))
    winners = merged.where(F.col("body").isNotNull()).select("sha", "salt_keep", "body")
    winners = winners.repartition("sha").sortWithinPartitions("sha", F.desc("salt_keep")).mapInArrow(_combine, "sha binary, salt_keep long, keep_id long")
    moved = saved(winners.where("keep_id != salt_keep").select("sha", "salt_keep", "keep_id").distinct())
    # one row per salt of a hot digest (and per text, where digests collide): a fixed bound
    named = merged.select("doc_id", "sha", "salt_keep", "lead").join(F.broadcast(moved), ["sha", "salt_keep"], "left")
    named = saved(named.select("doc_id", "sha", F.coalesce("keep_id", "salt_keep").alias("keep_id"), "lead"))
    key = ["sha", "keep_id"]
    sizes = saved(named.groupBy(*key).agg(F.count("*").alias("group_size")).where("group_size > 1"))
    # the sizes of large groups, at most hot_share of them, are broadcast: their rows don't meet in a task
    large = named.join(F.broadcast(sizes.where(F.col("group_size") * hot_share > total)), key, "left")
    others = large.where("group_size is null").drop("group_size").join(sizes.where(F.col("group_size") * hot_share <= total), key, "left")
    null = lambda c: F.when(F.col(c) != -(2**63), F.col(c)).alias(c)
    return large.where("group_size is not null").unionByName(others).select(
        null("doc_id"), null("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("lead") & (F.col("doc_id") == F.col("keep_id"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
