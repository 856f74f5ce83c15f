"""Long series in ranges: equal results for one range and for many, nulls in keys and values, and averages of any length."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import clean, coint, features, ranges, threshold, unitroot

K, O = ["id"], ["t"]


@pytest.fixture(scope="module")
def data(spark):
    """Series of 150, 150 and 1 rows, one of them under a null key, with gaps."""
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("a", 150), (None, 150), ("c", 1)):
        walk = np.cumsum(rng.normal(size=n)) + 30
        for i in range(n):
            day = datetime.date(2001, 1, 1) + datetime.timedelta(days=i)
            rows.append((key, day, None if rng.random() < 0.2 else float(walk[i]), float(walk[i] + rng.normal()), float(abs(rng.normal())), float(1 + rng.random())))
    return spark.createDataFrame(rows, "id string, t date, v double, full double, conflict double, r double").repartition(5).cache()


def same(one, many):
    assert one.columns == many.columns
    kinds = dict(one.dtypes)
    flat = [c for c in one.columns if not kinds[c].startswith(("map", "array"))]
    order = sorted(flat)
    key = lambda r: str([r[c] for c in ("id", "t", "i", "lag") if c in flat])
    a, b = sorted(one.select(*order).collect(), key=key), sorted(many.select(*order).collect(), key=key)
    assert len(a) == len(b) and a
    for x, y in zip(a, b, strict=True):
        for c in order:
            if isinstance(x[c], float) and isinstance(y[c], float) and x[c] == x[c]:
                assert x[c] == pytest.approx(y[c], rel=1e-9, abs=1e-9), (c, x, y)
            else:
                assert str(x[c]) == str(y[c]), (c, x, y)


CASES = {
    "lags": lambda d, r: features.lags(d, ["v"], [1, 5, -2], K, O, rows=r),
    "rolling": lambda d, r: features.rolling(d, ["v"], [3, 7], K, O, ("mean", "std", "min", "max", "median"), rows=r),
    "differences": lambda d, r: features.differences(d, ["v"], K, O, [1, 2], 12, rows=r),
    "pct_changes": lambda d, r: features.pct_changes(d, ["v"], K, O, [1, 4], rows=r),
    "fill": lambda d, r: features.fill(d, "v", K, O, rows=r),
    "inferred_regimes": lambda d, r: features.inferred_regimes(d, "r", "full", K, O, "full", 1.2, rows=r),
    "steadiest_rate": lambda d, r: features.steadiest_rate(d, ["r", "full"], K, O, "full", rows=r),
    "momentum": lambda d, r: features.momentum(d, "v", K, O, "standard", 2, rows=r),
    "momentum_mean": lambda d, r: features.momentum(d, "full", K, O, "moving_average", 3, rows=r),
    "momentum_ewma": lambda d, r: features.momentum(d, "v", K, O, "exponential", alpha=0.3, rows=r),
    "decompose": lambda d, r: features.decompose(d.where("id is not null"), "full", K, O, 12, rows=r),
    "acf": lambda d, r: features.acf(d, "full", K, O, 9, rows=r),
    "qq": lambda d, r: features.qq(d.where("id is not null"), "full", K, O, rows=r),
    "interpolate": lambda d, r: clean.interpolate(d, "v", K, O, rows=r),
    "nearest": lambda d, r: clean.replace_outliers(d.where("id is not null"), "full", "nearest", "zscore", 1.0, K, O, rows=r),
    "conflict_outliers": lambda d, r: clean.conflict_outliers(d, "full", "conflict", 1.5, K, O, rows=r),
    "adf": lambda d, r: unitroot.adf(d, K, O, "full", "ct", rows=r),
    "phillips_perron": lambda d, r: unitroot.phillips_perron(d, K, O, "full", "ct", rows=r),
    "kpss": lambda d, r: unitroot.kpss(d, K, O, "full", "ct", rows=r),
    "zivot_andrews": lambda d, r: unitroot.zivot_andrews(d, K, O, "full", "ct", rows=r),
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("rows", [3, 1000])
def test_one_range_or_many(data, name, rows):
    same(CASES[name](data, None), CASES[name](data, rows))


PAIRS = {
    "engle_granger": lambda d, r: coint.engle_granger(d, K, O, rows=r),
    "error_correction": lambda d, r: coint.error_correction(d, K, O, rows=r).select("id", "n_obs", "r2", F.element_at("coef", "z").alias("z")),
    "gregory_hansen": lambda d, r: coint.gregory_hansen(d, "cshift", K, O, rows=r),
    "granger": lambda d, r: coint.granger(d, 2, K, O, rows=r),
    "tar": lambda d, r: threshold.fit(coint.residuals(d, K, r), "standard", K, O, block=r),
    "mtar": lambda d, r: threshold.fit(coint.residuals(d, K, r), "mtar", K, O, block=r),
}


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_pairs_in_ranges(data, name):
    pairs = data.where("id = 'a'").select("id", "t", F.col("full").alias("y"), (F.col("full") + F.col("conflict")).alias("x"))
    same(PAIRS[name](pairs, None), PAIRS[name](pairs, 7))


def test_whole_table_as_one_series(data):
    same(features.lags(data.where("id = 'a'"), ["v"], [2], K, O), features.lags(data.where("id = 'a'"), ["v"], [2], [], O, rows=20))


def test_a_long_halo_covers_several_blocks(data):
    same(features.lags(data, ["v"], [40], K, O), features.lags(data, ["v"], [40], K, O, rows=9))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id string, t date, v double")
    for rows in (None, 10):
        assert features.fill(empty, "v", K, O, rows=rows).count() == 0
        assert features.momentum(empty, "v", K, O, "exponential", rows=rows).count() == 0


@pytest.mark.parametrize("alpha", [0.001, 0.3, 0.9, 1.0])
def test_exponential_momentum_has_no_horizon(spark, alpha):
    """A jump at the start and nothing after it: the average shrinks by 1 - alpha a row, down to the least double."""
    n = 3000
    rows = spark.range(n).select(F.lit("k").alias("id"), F.col("id").alias("t"), F.when(F.col("id") > 0, 1e6).otherwise(0.0).alias("v"))
    got = [r.m for r in features.momentum(rows, "v", K, O, "exponential", alpha=alpha, name="m", rows=500).orderBy("t").collect()]
    want, s = [None, None], None
    for t in range(1, n - 1):
        x = 1e6 if t == 1 else 0.0
        s = x if s is None else s * (1 - alpha) + alpha * x
        want.append(s)
    assert got[:2] == [None, None]
    for a, b in zip(got[2:], want[2:], strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-300)


def test_running_and_known(data):
    out = ranges.running(data, {"s": F.col("v")}, K, O, 11)
    one = ranges.running(data, {"s": F.col("v")}, K, O)
    same(one, out)
    same(ranges.known(data, {"s": F.col("v")}, K, O, inclusive=False), ranges.known(data, {"s": F.col("v")}, K, O, 4, inclusive=False))


def brute_zivot_andrews(x, trend, lags):
    n, d = len(x), np.diff(x)
    best = np.inf
    a = int(np.floor(0.15 * n))
    for b in range(a, n - a):
        rows = np.arange(lags + 1, n)
        after = rows >= b
        cols = [np.ones(len(rows)), x[rows - 1], rows + 1.0, *[d[rows - 1 - k] for k in range(1, lags + 1)]]
        cols += [after.astype(float)] if trend in ("c", "ct") else []
        cols += [np.where(after, rows + 1.0 - b, 0)] if trend in ("t", "ct") else []
        m = np.column_stack(cols)
        y = d[rows - 1]
        if np.linalg.matrix_rank(m) < m.shape[1]:
            continue
        beta = np.linalg.lstsq(m, y, rcond=None)[0]
        e = y - m @ beta
        best = min(best, beta[1] / np.sqrt(np.linalg.inv(m.T @ m)[1, 1] * (e @ e) / (len(y) - m.shape[1])))
    return best


@pytest.mark.parametrize("trend", ["c", "t", "ct"])
@pytest.mark.parametrize("lags", [0, 2])
def test_zivot_andrews_against_dummies(data, trend, lags):
    x = np.array([r.full for r in data.where("id = 'a'").orderBy("t").collect()])
    got = unitroot.zivot_andrews(data.where("id = 'a'"), K, O, "full", trend, lags, rows=40).first()
    assert got.statistic == pytest.approx(brute_zivot_andrews(x, trend, lags), rel=1e-7)


def brute_gregory_hansen(y, x, model, lags):
    n = len(y)
    a = int(np.floor(0.15 * n))
    best = np.inf
    for b in range(a, n - a):
        du = (np.arange(n) >= b).astype(float)
        m = np.column_stack([np.ones(n), du, x, *([np.arange(n)] if model == "ct" else []), *([du * x] if model == "cshift" else [])])
        z = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
        d = np.diff(z)
        rows = np.arange(lags + 1, n)
        w = np.column_stack([z[rows - 1], *[d[rows - 1 - k] for k in range(1, lags + 1)]])
        t = d[rows - 1]
        beta = np.linalg.lstsq(w, t, rcond=None)[0]
        e = t - w @ beta
        best = min(best, beta[0] / np.sqrt(np.linalg.inv(w.T @ w)[0, 0] * (e @ e) / (len(t) - w.shape[1])))
    return best


@pytest.mark.parametrize("model", ["c", "ct", "cshift"])
@pytest.mark.parametrize("lags", [0, 1, 3])
def test_gregory_hansen_against_dummies(data, model, lags):
    rows = data.where("id = 'a'").select("id", "t", F.col("full").alias("y"), (F.col("full") * 0.5 + F.col("conflict")).alias("x"))
    found = rows.orderBy("t").collect()
    want = brute_gregory_hansen(np.array([r.y for r in found]), np.array([r.x for r in found]), model, lags)
    assert coint.gregory_hansen(rows, model, K, O, lags).first().statistic == pytest.approx(want, rel=1e-6)
