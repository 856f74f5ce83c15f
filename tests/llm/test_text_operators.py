"""The text operators against brute force, on rows with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm import exact_dedup, language, line_dedup, maxent_lm, mixing, quality, substring_dedup, topk

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("sha", T.StringType())])


def docs(spark, texts, ids=None, langs=None, sources=None):
    rows = [(i, t, langs[k] if langs else None, sources[k] if sources else None, None, 7, "x") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def sample(seed=1, n=40, vocabulary=12):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["ä", "Ö!"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 90))) for _ in range(n)]
    passage = " ".join(f"p{i}" for i in range(33))
    texts[3] += " " + passage
    texts[9] = passage + "\n" + texts[9]
    texts[11] = texts[9]
    texts += ["", None, " \t\n", "a " * 70, "a " * 50, "x y " * 40, passage, texts[2], " ".join(f"z{i % 997}" for i in range(3000))]
    return texts


# exact dedup


@pytest.mark.parametrize("hot", [False, True])
def test_exact_dedup(spark, hot):
    texts = ["a", "b", "a", "", None, "a ", "A", "b", "long " * 5000, "long " * 5000] + ["hot"] * 40
    ids = [5, 6, 9, 1, 2, 3, 4, 6, 20, 21, *range(100, 140)]
    options = {"hot_share": 10_000, "hot_rows": 3, "salt_rows": 10} if hot else {}
    got = exact_dedup.exact_dedup(docs(spark, texts, ids).repartition(5), **options).collect()
    assert len(got) == len(texts)
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        groups.setdefault(t or "", []).append(i)
    assert Counter(r.doc_id for r in got) == Counter(ids)
    of = dict(zip(ids, texts, strict=True))
    for r in got:
        text = of[r.doc_id] or ""
        assert (r.keep_id, r.group_size) == (max(groups[text]), len(groups[text]))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_exact_dedup_of_repeated_and_null_ids(spark, hot):
    rows = [(None, "a"), (None, "a"), (None, "b"), (7, "c"), (7, "d"), (3, "d"), (9, "e")] + [(i, "hot") for i in range(100, 140)] + [(i, f"alone {i}") for i in range(100, 140)]
    options = {"hot_share": 10_000, "hot_rows": 3, "salt_rows": 10} if hot else {}
    got = exact_dedup.exact_dedup(docs(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5), **options).collect()
    sizes = Counter(hashlib.sha256(t.encode()).hexdigest() for _, t in rows)
    assert len(got) == len(rows) and all(r.group_size == sizes[r.text_sha256] for r in got)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(sizes))


# substring dedup


def brute_windows(texts, width):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            if key in seen:
                gone[p : p + width] = [True] * width
            seen.add(key)
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("width", "rounds"), [(20, 3), (20, 2), (5, 3), (3, 4)])
def test_substring_dedup(spark, monkeypatch, width, rounds):
    monkeypatch.setattr(substring_dedup, "STEP", 64)
    monkeypatch.setattr(substring_dedup, "text_bytes", lambda *a: 20 << 20)  # many chunks
    texts = sample()
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(docs(spark, texts), width, rounds).collect()}
    for i, (n, removed, kept) in enumerate(brute_windows(texts, width)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (n, removed, kept.decode()), i
    assert substring_dedup.drop_repeats(docs(spark, [])).count() == 0


def test_cores_agree_for_equal_windows():
    rng = np.random.default_rng(8)
    for _ in range(30):
        body = rng.integers(0, 4, 20).astype(np.uint64)
        keys = []
        for _ in range(4):
            a, b = rng.integers(0, 4, rng.integers(0, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 9)).astype(np.uint64)
            key, at = substring_dedup.anchors(np.concatenate([a, body, b]), np.array([len(a)]), 20, 3)
            keys.append((int(key[0]), int(at[0]) - len(a)))
        assert len(set(keys)) == 1


# line dedup


def brute_lines(texts, least):
    out, order = [], []
    runs = []
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        real = [(i, x) for i, x in enumerate(lines) if x.encode().split()]
        for a in range(len(real)):
            total = 0
            for b in range(a, len(real)):
                total += len(real[b][1].encode().split())
                if total >= least:
                    runs.append(((d, a), tuple(x for _, x in real[a : b + 1]), [i for i, _ in real[a : b + 1]]))
        order.append(lines)
    first = {}
    for place, run, _ in runs:
        first.setdefault(run, place)
    gone = {(place[0], i) for place, run, at in runs if first[run] != place for i in at}
    for d, lines in enumerate(order):
        out.append("\n".join(x for i, x in enumerate(lines) if (d, i) not in gone))
    return out


@pytest.mark.parametrize("least", [1, 4, 10])
def test_line_dedup(spark, least):
    rng = np.random.default_rng(4)
    pool = ["one", "two words", "three whole words", "", "  ", "ten words are in this line of text as said", "end."]
    texts = ["\n".join(rng.choice(pool, rng.integers(1, 9))) for _ in range(25)] + ["", None, "\n\n", "one\ntwo words\none\ntwo words\none\ntwo words", "\n".join(["same line"] * 300)]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs(spark, texts), least, counts=True).collect()}
    for i, want in enumerate(brute_lines(texts, least)):
        assert (got[i].text or "") == want, (i, texts[i])
    assert got[26].text is None
    repeated = line_dedup.drop_repeated_lines(docs(spark, [pool[5], pool[5]], [1, 1]), least).collect()
    assert [r.text for r in repeated] == [pool[5]] * 2
    assert line_dedup.drop_repeated_lines(docs(spark, [])).count() == 0


# language identification

SYLLABLES = {"en": ["the", "ing", "of", "ould", "th"], "de": ["der", "ung", "sch", "über", "ein"], "es": ["ción", "que", "los", "ado", "ñ"]}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


def test_language(spark):
    rng = np.random.default_rng(0)
    langs = [list(SYLLABLES)[i % 3] for i in range(90)]
    texts = [invented(rng, x, 30) for x in langs]
    field = language.train(docs(spark, texts, langs=langs))
    new = [invented(rng, x, 25) for x in SYLLABLES] + [None, "", "123 $$", invented(rng, "de", 60) + " " + invented(rng, "en", 20), invented(rng, "es", 20_000)]
    got = {r.doc_id: r for r in language.identify(docs(spark, new), field).collect()}
    assert [got[i].lang_pred for i in range(8)] == ["en", "de", "es", "und", "und", "und", "de", "es"]
    assert all(0 <= r.score <= 1 for r in got.values()) and 0.6 < got[6].score < 0.9
    kept = language.keep_identified(docs(spark, new), field)
    assert kept.columns == DOCS.names and {r.doc_id for r in kept.collect()} == {0, 1, 2, 6, 7}
    nothing = language.identify(docs(spark, ["the"]), language.train(docs(spark, ["x"]))).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)
    assert language.identify(docs(spark, []), field).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    field = language.Field(["a", "b", "c"])
    field.transition[...], field.initial[...] = rng.normal(size=(3, 3)), rng.normal(size=3)
    states, offsets = rng.normal(size=(9, 3)), np.array([0, 4, 4, 5, 9])
    p = field.marginals(states, offsets)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if a == b:
            continue
        want = np.zeros((b - a, 3))
        for path in np.ndindex(*[3] * (b - a)):
            score = field.initial[path[0]] + sum(states[a + t, s] for t, s in enumerate(path)) + sum(field.transition[x, y] for x, y in zip(path, path[1:], strict=False))
            for t, s in enumerate(path):
                want[t, s] += math.exp(score)
        np.testing.assert_allclose(p[a:b], want / want.sum(1, keepdims=True), rtol=1e-9)


# quality


def test_quality(spark):
    rng = np.random.default_rng(1)
    good = [invented(rng, "en", 40) for _ in range(60)]
    bad = [" ".join(w + "$$$" for w in invented(rng, "en", 40).split()) for _ in range(60)]
    texts, labels = good + bad, [1] * 60 + [0] * 60
    given = spark.createDataFrame([(i, q, None) for i, q in enumerate(labels) if i % 2] + [(3, None, 1)], "doc_id long, quality int, extra int")
    model = quality.train(docs(spark, texts), given)
    got = {r.doc_id: r for r in quality.score_quality(docs(spark, [*texts, None, "", "x " * 20_000]), model).collect()}
    assert np.mean([got[i].predicted == q for i, q in enumerate(labels)]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and got[120].score == got[121].score
    assert quality.score_quality(docs(spark, []), model).count() == 0
    assert quality.score_quality(docs(spark, ["a"]), quality.train(docs(spark, ["a"]), given.where("false"))).first().score == 0.5


# language model


def test_language_model(spark):
    rng = np.random.default_rng(6)
    texts = [invented(rng, list(SYLLABLES)[i % 3], 60) for i in range(60)] + [None, "", "NEW words HERE", "the " * 5000]
    rows = docs(spark, texts)
    held = F.col("doc_id") % 5 == 0
    got = {r.doc_id: r for r in maxent_lm.score_texts(rows, ~held).collect()}
    tokens = [[*[w.decode() for w in (t or "").encode().lower().split()], "\n"] for t in texts]
    counts = Counter(w for i, ws in enumerate(tokens) if i % 5 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in enumerate(tokens):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert got[i].score < 0
    unseen = [r for i, r in got.items() if i % 5 == 0 and i < 60]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert maxent_lm.score_texts(docs(spark, []), F.lit(True)).count() == 0
    none = maxent_lm.score_texts(docs(spark, ["a b"]), F.lit(False)).first()
    assert (none.n_known, none.train_tokens, none.base_score) == (0, 0, 0.0)


def test_history_distributions_sum_to_one():
    rng = np.random.default_rng(0)
    cls = rng.integers(0, maxent_lm.CLASSES, maxent_lm.FEATURES)
    table = maxent_lm.history_table(rng.normal(size=(maxent_lm.PARAMETERS, maxent_lm.CLASSES)), cls)
    np.testing.assert_allclose((10.0 ** table.astype(float)).sum(2), 1, rtol=1e-4)


# mixing


def test_mixing(spark):
    rng = np.random.default_rng(3)
    sources = ["big"] * 120 + ["mid"] * 30 + ["low"] * 20 + [None] * 4 + ["empty"]
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(1, 60, len(sources) - 1)] + [None]
    rows = docs(spark, texts, sources=sources)
    got = mixing.mixed(rows, target=0.9, repeats=3.0).collect()
    assert len(got) == len(texts) and all(r.copies >= 1 for r in got)
    size, spent, weight, epochs = Counter(), Counter(), {}, {}
    for r in got:
        size[r.source] += r.n_tokens
        spent[r.source] += r.n_tokens * r.copies
        weight[r.source], epochs[r.source] = r.weight, r.epochs
    assert sum(weight.values()) == pytest.approx(1) and max(epochs.values()) <= 3.0 + 1e-6
    live = {k: v for k, v in size.items() if v}
    w = np.array([weight[k] for k in live])
    share = np.array([live[k] for k in live]) / sum(live.values())
    # the weights are a power of the shares
    a = np.polyfit(np.log(share), np.log(w), 1)[0]
    np.testing.assert_allclose(w, share**a / (share**a).sum(), rtol=1e-6)
    entropy = -(w * np.log(w)).sum() / np.log(len(w))
    assert entropy >= 0.9 - 1e-6 or max(epochs.values()) > 3.0 - 1e-3
    for k, n in live.items():
        assert 0 <= epochs[k] * n - spent[k] < 60
    mixture = mixing.mix_documents(rows, target=0.9, repeats=3.0)
    assert mixture.columns == DOCS.names
    assert Counter(r.doc_id for r in mixture.collect()) == {r.doc_id: r.copies for r in got}
    again = mixing.mix_documents(rows.unionAll(rows), target=0.9, repeats=3.0)
    assert {r.doc_id for r in again.collect()} == set(range(len(texts)))
    assert mixing.mixed(docs(spark, [])).count() == 0 and mixing.mix_documents(docs(spark, [])).count() == 0


# top-k


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_topk(spark, scale, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(rng.normal(size=12) * scale * rng.choice([0.1, 1, 3])).tolist() for _ in range(300)]
    vectors[7], vectors[8] = vectors[6], vectors[6]
    vectors[20], vectors[21], vectors[22], vectors[23] = None, [1.0, None], [float("nan")] * 12, [float("inf")] * 12
    vectors[24] = [0.0] * 12
    schema = "vec_id long, embedding array<double>, label int, block int, norm string"
    rows = spark.createDataFrame([(i, v, 1, 0, "n") for i, v in enumerate(vectors)], schema)
    got = {}
    for r in topk.exact_topk(rows, F.col("vec_id") % 10 == 0, block=32).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    whole = {i: [math.floor(256 * x) for x in v] for i, v in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v)}
    assert set(got) == {i for i in whole if i % 10 == 0}
    for q in got:
        want = sorted(((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(c, -s) for s, c in want]
    few = spark.createDataFrame([(0, [1.0], 0, 0, ""), (1, [2.0], 0, 0, "")], schema)
    assert [tuple(r) for r in topk.exact_topk(few, F.col("vec_id") % 10 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.exact_topk(few.where("false"), F.lit(True)).count() == 0


def test_held_out_rule(spark):
    from bazaarlens.llm.common import training_rows

    got = spark.range(200).select(F.col("id"), training_rows(5, 0, "id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
