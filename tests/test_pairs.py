"""Pair sums by tiles, Kendall's tau by inversions, ordered first and last, and the kernel covariance."""

import numpy as np
import pandas as pd
import pytest

from bazaarlens.operators import describe, joins, panel_reg


@pytest.mark.parametrize(("blocks", "spans"), [(1, 1), (3, 4)])
def test_pair_sums(spark, blocks, spans, monkeypatch):
    monkeypatch.setattr(joins, "TILE_UNITS", 3)
    rng = np.random.default_rng(1)
    rows = [(f"m{i}", t, float(100 + rng.normal() * 3 + i)) for i in range(9) for t in range(30) if rng.random() < 0.7] + [("m0", 3, None), (None, 3, 1.0), ("m1", None, 1.0), ("m9", 2, 5.0), ("m2", 4, float("nan"))]
    got = joins.pair_sums(spark.createDataFrame(rows, "u string, t int, v double"), "v", "u", "t", blocks, spans).toPandas()
    wide = pd.DataFrame(rows, columns=["u", "t", "v"]).dropna().pivot_table(index="t", columns="u", values="v")
    want = {}
    for i, a in enumerate(wide.columns):
        for b in wide.columns[i + 1 :]:
            both = wide[[a, b]].dropna()
            if len(both):
                want[a, b] = (len(both), both[a].mean(), both[b].mean(), ((both[a] - both[a].mean()) ** 2).sum(), ((both[b] - both[b].mean()) ** 2).sum(), ((both[a] - both[a].mean()) * (both[b] - both[b].mean())).sum())
    found = {(r.left, r.right): tuple(r)[3:] for r in got.itertuples()}
    assert set(found) == set(want)
    for k, v in want.items():
        assert found[k] == pytest.approx(v, rel=1e-9, abs=1e-9)


def brute_tau(a, b):
    s = np.sign(a[:, None] - a[None, :]) * np.sign(b[:, None] - b[None, :])
    n0 = len(a) * (len(a) - 1) / 2
    ties = lambda x: sum(c * (c - 1) / 2 for c in np.unique(x, return_counts=True)[1])
    return s.sum() / 2 / np.sqrt((n0 - ties(a)) * (n0 - ties(b)))


@pytest.mark.parametrize("points", [5, 40, 4096])
def test_kendall(spark, points):
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.integers(0, 40, 300), rng.normal(size=100), np.full(80, 7)]).astype(float)
    b = np.concatenate([rng.integers(0, 15, 300) + a[:300] / 20, rng.normal(size=100), rng.integers(0, 4, 80)]).astype(float)
    b[50:150] = 3.0  # a value that is more than a range of points
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)] + [(None, 1.0), (1.0, None)], "a double, b double").repartition(4)
    assert describe.kendall(rows, "a", "b", points).first()[0] == pytest.approx(brute_tau(a, b), rel=1e-10)


def test_kendall_of_many_rows(spark):
    rows = spark.range(1_000_000).selectExpr("cast(id as double) AS a", "cast(id * 7919 % 1000003 as double) AS b")
    assert abs(describe.kendall(rows, "a", "b").first()[0]) < 0.05
    assert describe.kendall(rows.selectExpr("a", "-a AS b"), "a", "b").first()[0] == -1


def test_first_and_last_have_an_order(spark):
    rows = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 1.0), ("k", 3, 9.0), ("k", 0, None), ("j", 1, None)], "k string, t int, v double")
    got = {r.k: (r.v_first, r.v_last, r.v_mean) for r in describe.aggregate(rows, ["k"], {"v": ["first", "last", "mean"]}, ["t"]).collect()}
    assert got == {"k": (5.0, 9.0, 5.0), "j": (None, None, None)}
    with pytest.raises(ValueError, match="order"):
        describe.aggregate(rows, ["k"], {"v": "first"})


def test_kernel_covariance(spark):
    rng = np.random.default_rng(4)
    rows = [(f"e{i}", f"2001-{1 + t % 12:02d}-{1 + t // 12:02d}", float(rng.normal()), float(rng.normal() + np.sin(t))) for i in range(7) for t in range(60)]
    data = pd.DataFrame(rows, columns=["market", "date", "x", "y"])
    fit = panel_reg.pooled(panel_reg.prepare(spark.createDataFrame(data), "y", ["x"]), "y", ["x"], cov_type="kernel").first()
    data = data.sort_values("date")
    X = np.column_stack([np.ones(len(data)), data.x])
    inv = np.linalg.inv(X.T @ X)
    e = data.y.to_numpy() - X @ (inv @ X.T @ data.y.to_numpy())
    h = pd.DataFrame(X * e[:, None]).groupby(data.date.to_numpy()).sum().to_numpy()
    width = int(4 * (60 / 100) ** (2 / 9))
    s = h.T @ h + sum((1 - d / (width + 1)) * (h[d:].T @ h[:-d] + h[:-d].T @ h[d:]) for d in range(1, width + 1))
    want = np.sqrt(np.diag(inv @ s @ inv) * len(data) / (len(data) - 2))
    assert (fit.se["const"], fit.se["x"]) == pytest.approx(tuple(want), rel=1e-8)


def test_two_ways_against_dummies(spark):
    rng = np.random.default_rng(6)
    rows = [(f"e{i}", f"2001-01-{t + 1:02d}", float(i + t * t + rng.normal()), float(rng.normal())) for i in range(12) for t in range(20) if rng.random() < 0.5]
    panel = panel_reg.prepare(spark.createDataFrame(rows, "market string, date string, y double, x double"), "y", ["x"])
    got = panel_reg._demeaned(panel, ["y", "x"], True, True).toPandas()
    dummies = pd.get_dummies(got["entity"]).to_numpy(float), pd.get_dummies(got["time"].astype(str)).to_numpy(float)
    d = np.hstack(dummies)
    raw = panel.toPandas().merge(got, on=["entity", "time"], suffixes=("_raw", ""))
    d = np.hstack([pd.get_dummies(raw["entity"]).to_numpy(float), pd.get_dummies(raw["time"].astype(str)).to_numpy(float)])
    for c in ("y", "x"):
        want = raw[f"{c}_raw"] - d @ np.linalg.lstsq(d, raw[f"{c}_raw"].to_numpy(), rcond=None)[0]
        assert raw[c].to_numpy() == pytest.approx(want.to_numpy(), abs=1e-7)


@pytest.mark.parametrize("statistic", ["mean", "median", "std", "sum", "min", "max"])
def test_bootstrap_by_parts(spark, statistic):
    """Intervals of a known distribution, the same spread for one part and for many, and every replicate has n draws."""
    x = np.random.default_rng(7).normal(10, 2, 900)
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "key string, date int, v double")
    one = describe.bootstrap(rows, "v", statistic, 400, keys=["key"]).first()
    many = describe.bootstrap(rows, "v", statistic, 400, keys=["key"], part_rows=50).first()
    whole = describe.bootstrap(rows, "v", statistic, 400, part_rows=50).first()
    own = {"mean": x.mean(), "median": np.median(x), "std": x.std(ddof=1), "sum": x.sum(), "min": x.min(), "max": x.max()}[statistic]
    rng = np.random.default_rng(1)
    f = {"mean": np.mean, "median": np.median, "std": lambda a: a.std(ddof=1), "sum": np.sum, "min": np.min, "max": np.max}[statistic]
    want = np.std([f(rng.choice(x, len(x))) for _ in range(4000)])
    for r in (one, many, whole):
        assert r.statistic == pytest.approx(own) and r.lower <= own <= r.upper and r.se == pytest.approx(want, rel=0.35)


def test_parts_share_the_draws():
    parts = [describe.part_counts(1000, 7, p, 150, 50, [3, 4]) for p in range(7)]
    assert (sum(i for i, _ in parts) == 1000).all()
    assert all((parts[p][1] == sum(i for i, _ in parts[:p])).all() for p in range(1, 7))
    assert np.mean([i.mean() for i, _ in parts[:6]]) == pytest.approx(150, rel=0.1) and parts[6][0].mean() == pytest.approx(100, rel=0.1)
