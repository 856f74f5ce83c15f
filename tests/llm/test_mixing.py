"""The permutation by blocks against a plain walk over it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import mixing
from tests.llm.test_text_operators import docs


@pytest.mark.parametrize(("budget", "most"), [(None, 100_000), (None, 0), (900.0, 100_000)])
def test_copies_equal_a_walk_over_the_blocks(spark, monkeypatch, budget, most):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    rng = np.random.default_rng(9)
    sources = ["big"] * 150 + ["mid"] * 40 + ["low"] * 25 + [None] * 12 + ["none"]
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(1, 30, len(sources) - 1)] + [""]
    rows = docs(spark, texts, sources=sources)
    got = {r.doc_id: r for r in mixing.mixed(rows, target=0.9, repeats=3.0, budget=budget).collect()}
    assert len(got) == len(texts)
    for source in set(sources):
        mine = [r for r in got.values() if r.source == source]
        tokens, epochs = sum(r.n_tokens for r in mine), mine[0].epochs
        whole = math.floor(epochs)
        rest = math.floor((epochs - whole) * tokens)
        blocks = math.ceil(tokens / 60) + 1
        own = rows.where(F.col("source").eqNullSafe(F.lit(source)))
        placed = own.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(mixing.SEED)), F.lit(blocks)).cast("int"))
        keyed = placed.select("doc_id", "block", F.xxhash64(F.lit(mixing.SEED), "source", "block").alias("turn"), F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("own")).collect()
        left, more = rest, set()
        for turn, block in sorted({(r.turn, r.block) for r in keyed}):
            inside = sorted((r.own, r.doc_id) for r in keyed if r.block == block)
            size = sum(got[i].n_tokens for _, i in inside)
            if left <= 0:
                break
            spent = 0
            for _, i in inside:
                spent += got[i].n_tokens
                if size and spent <= left:
                    more.add(i)
            left -= size
        assert {r.doc_id: r.copies for r in mine} == {r.doc_id: whole + (r.doc_id in more) for r in mine}, source
