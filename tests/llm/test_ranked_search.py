"""Ranked search against scoring every document: nulls, empty and long texts, ties, repeated rows and ids, small segments and blocks."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bazaarlens.llm import ranked_search

SCHEMA = "doc_id long, text string, terms string, rank int, score long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_all = sum(1 for _, c in counted if c)
    l_all = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counted:
            n = sum(c.values())
            m = 10 + 90 * n * n_all // max(1, l_all)
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=2, n=90):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "Ünder", "straße", "x1", "naïve", "co-op", *[f"w{i}" for i in range(60)]]
    p = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum())) for _ in range(n)]
    texts += [None, "", "...", "THE the The", " ".join(f"z{i % 50}" for i in range(4000)), "same text twice", "same text twice", "w1 " * 400]
    return list(zip([*range(n), 900, 901, 902, 903, 904, 7, None, 905], texts, strict=True)) + [(5, texts[3])] * 3


ITEMS = [(1, "The of w3 w50"), (2, "z3 z49 unknown"), (3, None), (4, "..."), (5, "same text"), (5, "w59 W58 w59"), (5, "w59 W58 w59"), (None, "naïve STRASSE straße")]


@pytest.mark.parametrize(("bytes_", "docs_", "k"), [(1 << 20, 1000, 4), (300, 7, 3), (10, 1, 200)])
def test_against_brute_force(spark, tmp_path, bytes_, docs_, k):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    items = spark.createDataFrame([(i, t, "d", 3, 4) for i, t in ITEMS], "item_id long, text string, term string, doc_id int, number long")
    index = ranked_search.write_index(docs, str(tmp_path / "index"), segment_bytes=bytes_, segment_docs=docs_)
    got = sorted((tuple(r) for r in ranked_search.search(index, items, k).collect()), key=str)
    assert got == brute(rows, ITEMS, k)


def test_blocks_of_queries(spark, tmp_path):
    rows = corpus(4, 40)
    index = ranked_search.write_index(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "index"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in ranked_search.search(index, items, 5, block_bytes=8).collect()), key=str)
    assert got == brute(rows, ITEMS, 5)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.ranked_search(docs, items).count() == 0
    assert ranked_search.ranked_search(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_range_maxima():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 300)
    table = ranked_search.RangeMaxima(values, 300)
    a = rng.integers(0, 299, 500)
    b = a + 1 + (rng.random(500) * (300 - a - 1)).astype(int)
    assert all(values[p] == values[x:y].max() and x <= p < y for p, x, y in zip(table.place(a, b), a, b, strict=True))


def test_terms_are_maximal():
    flat, at = ranked_search.split_terms(pa.array(["A-b_c9É", None, "", " \t", "日本 x"]))
    assert flat.to_pylist() == ["a", "b", "c9É", "日本", "x"] and at.tolist() == [0, 3, 3, 3, 3, 5]
