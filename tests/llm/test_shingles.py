"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from bazaarlens.llm import shingles, simhash
from tests.llm.test_pipeline import SCHEMA


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute_survivors(rows):
    """The indices of the rows that stay, where no two of a component have the same id and text."""
    sets, label = [brute_shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if label[i] != label[j] and common * 5 >= (len(sets[i]) + len(sets[j]) - common) * 4:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(i)
    return groups


def edited(rng, words, changes):
    words = list(words)
    for p in rng.choice(len(words), changes, replace=False).tolist():
        words[p] = f"new{rng.integers(1 << 30)}"
    return words


def family(rng):
    texts = []
    for k in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts += [" ".join(base), " ".join(edited(rng, base, 1 + k % 6)), " ".join(edited(rng, base, 4)).upper(), " ".join(base[: 120 + 8 * k])]
    # a group of copies of which many pairs are alike in less than 0.8
    base = [f"v{x}" for x in rng.integers(0, 5000, 150)]
    texts += [" ".join(edited(rng, base, int(rng.integers(1, 6)))) for _ in range(40)] + [" ".join(base)]
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join(chain[i : i + 200]) for i in range(0, 100, 15)]  # linked one by one only
    return [*texts, "a b", "A  b", "a b c", "", None, " \n", "a b c d e", "a b c d f", texts[0]]


@pytest.mark.parametrize(("nodes", "turns"), [(2048, 3), (4, 1)])
def test_stage_links_jaccard(spark, monkeypatch, nodes, turns):
    monkeypatch.setattr(simhash, "TURNS", turns)
    monkeypatch.setattr(simhash.similar_texts, "__defaults__", (simhash.WIDE, nodes, "text"))
    monkeypatch.setattr(simhash, "QUERIES", 8 * nodes)
    texts = family(np.random.default_rng(5))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    groups = brute_survivors(rows)
    assert sorted(r.doc_id for r in kept) == sorted(min(g) for g in groups.values())
    assert 12 < len(groups) < len(texts) - 36


def test_sketches_of_similar_sets_are_near():
    rng = np.random.default_rng(3)
    apart = []
    for n in (9, 90, 900):
        for _ in range(200):
            x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            a, b = x[:n], np.concatenate([x[: n - n // 9], x[n : n + n // 9]])
            apart.append((int.from_bytes(shingles.sketch(a)) ^ int.from_bytes(shingles.sketch(b))).bit_count())
    assert max(apart) <= shingles.APART and 97 < np.mean(apart) < 108


@pytest.mark.parametrize("n", [4, 30, 400])
def test_wide_radius_holds_similar_sets(n):
    rng = np.random.default_rng(n)
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64) ^ (rng.integers(0, 2, 2 * n).astype(np.uint64) << np.uint64(63))
        more = max(1, round(n / 9))  # sets of n and n with 8 parts of 9 in common, or of 4 and 5
        a, b = (x[:n], x[: n + 1]) if n == 4 else (x[:n], np.concatenate([x[: n - more], x[n : n + more]]))
        assert (shingles.fingerprint(a) ^ shingles.fingerprint(b)).bit_count() <= simhash.WIDE


def test_rows_of_one_id_are_documents(spark):
    """Distinct texts under a repeated or null id all stay; of linked rows the least id, then text hash."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (1, b), (1, a), (None, c), (None, d), (None, a), (7, b + " more"), (9, c), (9, None), (None, "x")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (1, b), (None, d), (9, c), (9, None), (None, "x")], key=str)


def test_nodes_of_a_bucket_come_in_several_batches():
    rows = [(1, 4), (1, 6), (2, 3), (2, 5), (2, 8), (2, 9), (3, 1), (4, 2), (4, 7)]
    want = [(1, 4, 40, 400, 6, 60, 600), (2, 3, 30, 300, 5, 50, 500), (2, 3, 30, 300, 8, 80, 800), (2, 3, 30, 300, 9, 90, 900), (4, 2, 20, 200, 7, 70, 700)]
    for size in range(1, 10):
        table = pa.table({"bucket": [r[0] for r in rows], "node": [r[1] for r in rows], "fp": [10 * r[1] for r in rows], "root": [100 * r[1] for r in rows]})
        got = pa.Table.from_batches(simhash._met(iter(table.to_batches(max_chunksize=size)))).to_pylist()
        assert [tuple(r.values()) for r in got] == want


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_have_the_sets_of_the_whole(kind):
    texts = [*family(np.random.default_rng(8)), "É é Ä " * 30]
    whole = shingles.shingle_sets(pa.array(texts, kind))
    assert [len(s) for s in whole] == [len(brute_shingles(t)) for t in texts]
    for at in (1, 7, 80):
        part = shingles.shingle_sets(pa.array(texts, kind).slice(at, 15))
        assert all(np.array_equal(a, b) for a, b in zip(part, whole[at : at + 15], strict=True)) and len(part) == len(texts[at : at + 15])


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_bands_meet(similarity):
    """Random sets at the limit share a band."""
    rng = np.random.default_rng(7)
    for n in (9, 90, 900):
        for _ in range(150):
            x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            common = round(2 * n * similarity / (1 + similarity))
            a, b = x[:n], np.concatenate([x[:common], x[n : 2 * n - common]])
            assert (shingles.bands(a) == shingles.bands(b)).any()
