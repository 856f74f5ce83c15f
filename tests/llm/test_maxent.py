"""The language model against a plain reading of its definition."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import common
from bazaarlens.llm import maxent_lm as lm
from tests.llm.test_text_operators import SYLLABLES, docs, invented


def test_score_equals_its_definition(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [invented(rng, list(SYLLABLES)[i % 3], 40) for i in range(40)] + [None, "", "NEW words here", "the of " * 300] + ["one two three four five"] * 2
    monkeypatch.setattr(lm, "CHUNK", 1 << 11)  # many chunks
    got = {r.doc_id: r for r in lm.score_texts(docs(spark, texts), F.col("doc_id") % 5 != 0).collect()}
    tokens = [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]
    learned = [t for i, t in enumerate(tokens) if i % 5]
    words = sorted({w for t in tokens for w in t})
    bucket = dict(zip(words, lm.endings(pa.array(words)).tolist(), strict=True))
    pairs = np.zeros((lm.ENDINGS, lm.ENDINGS), np.int64)
    for t in learned:
        line = [lm.ENDINGS - 1, *[bucket[w] for w in t], lm.ENDINGS - 1]
        np.add.at(pairs, (line[:-1], line[1:]), 1)
    feature, cls = lm.groups_of(pairs)
    of = lambda w: int(feature[bucket[w]]) if w else lm.FEATURES - 1  # noqa: E731  None is the end token
    histories = np.zeros((lm.FEATURES, lm.CLASSES, lm.CLASSES), np.int64)
    count, after = Counter(), defaultdict(Counter)
    for t in learned:
        count.update([*t, None])
    common = lambda w: count[w] >= lm.COMMON
    for t in learned:
        line = [None, None, *t, None]
        for a, b, w in zip(line, line[1:], line[2:], strict=False):
            histories[of(b), cls[of(a)], cls[of(w)]] += 1
            if w is not None and common(b):
                after[b, int(cls[of(w)])][w if common(w) else ""] += 1
    chances = lm.history_table(lm.fit(histories, cls, spark), cls)
    weight = {w: float(lm.weight_of(lm.bias([n]))[0]) for w, n in count.items()}
    mass = np.ones(lm.CLASSES)
    for w, x in weight.items():
        mass[cls[of(w)]] += x
    change = {}
    for (b, c), seen in after.items():
        items = list(seen)
        n, own = np.array([seen[w] for w in items], float), np.array([w != "" for w in items])
        chance = np.array([weight[w] / mass[c] if w else 1.0 for w in items])
        value, z = lm.pair_weights(np.zeros(len(items), np.int64), n, chance, own)
        change[b, c] = dict(zip(items, (value - z[0]).tolist(), strict=True)), -z[0]
    for i, t in enumerate(tokens):
        line, total = [None, None, *t, None], 0.0
        for a, b, w in zip(line, line[1:], line[2:], strict=False):
            c = int(cls[of(w)])
            total += float(chances[of(b), cls[of(a)], c]) + math.log10(weight.get(w, 1.0) / mass[c])
            if w is not None and common(b) and (b, c) in change:
                known, other = change[b, c]
                total += known.get(w if common(w) else "", other) / math.log(10)
        assert got[i].score == pytest.approx(total, abs=3e-4 * (len(t) + 1)), i


def test_pair_weights_go_where_the_gradient_vanishes(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 300)
    rng = np.random.default_rng(2)
    history = np.sort(rng.integers(0, 30, 200))
    history = np.unique(history, return_inverse=True)[1]
    seen, chance, own = rng.integers(0, 6, 200).astype(float), rng.uniform(1e-4, 3e-2, 200), rng.random(200) < 0.8
    own &= seen > 0
    weight, z = lm.pair_weights(history, seen, chance, own)
    total = np.bincount(history, seen)
    p = chance * np.exp(weight - z[history])
    gradient = np.where(own, seen - lm.DISCOUNT - total[history] * p - lm.PRIOR * weight, 0)
    assert np.abs(gradient).max() < 1e-6
    # what has no weight keeps its chance, divided by the normaliser: all chances sum to one
    rest = 1 - np.bincount(history, np.where(own, chance, 0))
    np.testing.assert_allclose(np.bincount(history, np.where(own, p, 0)) + rest / np.exp(z), 1, rtol=1e-9)


def test_names_survive_their_planes():
    names = np.sort(np.random.default_rng(0).integers(0, 1 << 50, 1000).astype(np.uint64))
    assert (lm._unplanes(lm._planes(names)) == names).all() and not len(lm._unplanes(lm._planes(names[:0])))


def test_repeated_rows_are_rows(spark):
    got = lm.score_texts(docs(spark, ["a b a", "a b a", "c"], [1, 1, None]), F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 4), (1, 4)] and len({r.score for r in got}) == 2


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("nulls", [0, 5])
def test_words_of_a_slice(kind, lower, nulls):
    texts = [f"A{i} b  Ä{i}" + " Dd" * (i % 4) if i % 5 else "" for i in range(40)]
    texts[:nulls] = [None] * nulls
    whole = pa.array(texts, kind)
    for at, n in ((0, 40), (0, 9), (7, 20), (13, 27), (39, 1), (5, 0)):
        flat, bounds = common.split_words(whole.slice(at, n), lower)
        got = [flat[a:b].to_pylist() for a, b in zip(bounds, bounds[1:], strict=False)]
        low = lambda t: t.encode().lower().decode() if lower else t
        assert got == [low(t or "").split() for t in texts[at : at + n]]


def test_contract_of_a_task_with_more_text_than_a_piece(spark):
    """Counts and base scores of one partition whose texts come in several slices, some of them with upper case."""
    texts = [f"Common{i % 7} of THE {i % 50} " * (15_000 if i % 3 else 40) + f"once{i}" for i in range(60)] + [None, "", "never seen"]
    assert sum(len(t or "") for t in texts) > 2 * lm.STEP
    rows = docs(spark, texts).coalesce(1)
    got = {r.doc_id: r for r in lm.score_texts(rows, F.col("doc_id") % 7 != 2).collect()}
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    count = Counter(w for i, t in enumerate(tokens) if i % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    assert len(got) == len(texts)
    for i, t in enumerate(tokens):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(count[w] > 0 for w in t), n), i
        assert got[i].base_score == pytest.approx(math.fsum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel=1e-12), i
