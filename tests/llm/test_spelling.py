"""Spelling variants against counting and comparing all words; crowded lists, checksums, long words, chains of forms."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bazaarlens.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, list long, size int"


def cut(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            n[cut(i, "".join(c.lower() if c.isascii() else c for c in run))] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    forms, out = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = len(others)
    roots = {}
    for w in n:
        end = w
        while forms[end] is not None:
            end = forms[end]
        roots[w] = end
    return sorted((w, forms[w] or "", roots[w], n[w], out[w], n[forms[w]] if forms[w] else -1) for w in n)


def corpus(seed=6):
    rng = np.random.default_rng(seed)
    base = ["aaaaaaab", "Wonderful", "straßenbahn", "éclairées", "aaaaaaaa", "abcabcabc", "zwölftausend", "prefixed"]
    words = []
    for w in base:
        words += [w] * 60
        for _ in range(25):
            i, c = rng.integers(len(w)), rng.choice(list("abcéÀ"))
            v = [w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]][rng.integers(3)]
            words += [v] * int(rng.integers(1, 5))
    words += ["abcdefgh"] * 1200 + ["abcdefgx"] * 110 + ["abcdefyx"] * 10 + ["abcdezyx"] * 1 + ["q" * 300] * 4 + ["q" * 301] * 3 + ["short"] * 50 + ["don't"] * 9
    rng.shuffle(words)
    rows = [(int(i), " ".join(part)) for i, part in enumerate(np.array_split(np.array(words, dtype=object), 40))]
    return rows + [(None, "Wonderful wonderfull wonderfull"), (1, None), (2, ""), (3, "１２３ ×÷×÷×÷× ×÷×÷×÷×"), (3, "×÷×÷×÷×")]


@pytest.mark.parametrize("list_words", [2048, 5])
def test_against_all_pairs(spark, list_words, monkeypatch):
    monkeypatch.setattr(spelling, "LIST_WORDS", list_words)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in rows], SCHEMA).repartition(3)
    words = spelling.vocabulary(docs)
    found = spelling.near_words(words, 1000, list_words)
    want = brute(rows)
    assert {r.word: r.n_near for r in found.collect()} == {w: k for w, _, _, _, k, _ in want if k}
    got = spelling.spelling_variants(docs).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got) == want
    assert any(r.root != r.word and r.form != r.root for r in got)  # a chain of two steps


def test_empty_tables(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0


def test_checksums_of_joined_parts():
    words = [b"a", b"abc" * 21, b"x" * 64, b"y" * 65, b"z" * 500]
    prefixes = [b"0:", b"123456789:"]
    doc, word = np.repeat([0, 1], 5), np.tile(np.arange(5), 2)
    assert spelling._checksums(prefixes, words, doc, word).tolist() == [zlib.crc32(prefixes[d] + words[w]) for d, w in zip(doc, word, strict=True)]
