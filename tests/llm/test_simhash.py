import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from bazaarlens.llm import simhash
from bazaarlens.llm.components import components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("key", T.IntegerType())])


def brute_fingerprint(text, words=4):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    size = min(words, len(found))
    h = [xxhash.xxh64_intdigest(b" ".join(found[i : i + size]), 42) for i in range(len(found) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_documents_with_odd_rows(spark):
    base = "one two three four five six seven eight nine ten " * 5
    texts = [base, base + " eleven", base.upper(), "", None, "  \t", "a", "a", "a b c", "Zu und ß", "x y z w v", base + " twelve thirteen", " ".join(f"w{i}" for i in range(30_000))]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, base, "x", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    want = brute_components([fps[i] for i in range(len(texts))], 4)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("nodes", "queries"), [(2048, 65536), (8, 65536), (8, 16)])
def test_links_equal_brute_force_with_large_shards(spark, monkeypatch, nodes, queries):
    monkeypatch.setattr(simhash, "QUERIES", queries)
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = set(centres.tolist())
    for c in centres[:4].tolist():
        for _ in range(40):
            x = c
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    dealt = simhash.shards(df, 4, nodes).repartition("shard").sortWithinPartitions("shard")
    got = {r.u: r.v for r in components(dealt.mapInArrow(simhash._probe(simhash._linked(4)), "u long, v long")).collect()}
    label = brute_components(values, 4)
    groups, want = {}, {}
    for v, at in zip(signed, label, strict=True):
        groups.setdefault(got.get(v, v), set()).add(v)
        want.setdefault(at, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_forest_search_equals_a_scan():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 14, 600).astype(np.uint64))
    shard = (np.arange(len(values)) % 3).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    values, shard = values[order], shard[order]
    forest = simhash.Forest(values, shard)
    q, n = forest.search(values, forest.roots[shard], 4)
    d = np.bitwise_count(values[:, None] ^ values[None, :])
    want = (d <= 4) & (shard[:, None] == shard[None, :])
    assert set(zip(q.tolist(), n.tolist(), strict=True)) == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(want))), strict=True))
