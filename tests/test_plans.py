"""Plans that spread what one task did: ranks, quantiles and pairs by ranges and blocks, draws from arrays."""

import numpy as np
import pandas as pd
import pytest

from bazaarlens.functions import draws
from bazaarlens.operators import clean, describe, joins, panel_reg, spatial_stats, unitroot


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=400), 1)
    return v, spark.createDataFrame([(i, None if i % 41 == 0 else float(x)) for i, x in enumerate(v)], "i long, v double").repartition(5)


def test_quantiles(numbers):
    v, rows = numbers
    known = [x for i, x in enumerate(v) if i % 41]
    levels = [0, 0.01, 0.25, 0.5, 0.9, 1]
    np.testing.assert_allclose(clean.quantiles(rows, "v", levels).first()[0], np.quantile(known, levels))
    assert clean.quantiles(rows.where("false"), "v", [0.5]).first()[0] == [None]
    assert clean.quantiles(rows.where("i = 3"), "v", [0.5]).first()[0] == [v[3]]


def test_average_ranks(numbers):
    v, rows = numbers
    got = {r.i: r.rank for r in describe.average_ranks(rows, "v", "rank").collect()}
    want = pd.Series([None if i % 41 == 0 else x for i, x in enumerate(v)], dtype=float).rank()
    assert all(got[i] is None if np.isnan(w) else got[i] == w for i, w in enumerate(want))


def test_pairs_by_blocks(spark):
    panel = spark.createDataFrame([(f"m{m}", f"2020-0{t + 1}-01", float(m * 10 + t)) for m in range(9) for t in range(3) if (m + t) % 4], "market string, date string, price double")
    plain = sorted(map(tuple, joins.market_pairs(panel, blocks=1).collect()))
    assert sorted(map(tuple, joins.market_pairs(panel).collect())) == plain and len(plain) > 50


def test_regimes_without_keys_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_BREAKS", 2)
    series = spark.createDataFrame([(i,) for i in range(9)], "date int")
    assert joins.regimes(series, spark.createDataFrame([(3,), (5,)], "break_date int")).count() == 11
    with pytest.raises(ValueError, match="break dates"):
        joins.regimes(series, spark.createDataFrame([(3,), (5,), (7,)], "break_date int"))


def test_draws_depend_on_seed_key_and_replicate_alone():
    reps = np.arange(50)
    a = draws.bits(1, 2, reps, 20)
    assert (draws.bits(1, 2, reps[10:20], 20) == a[10:20]).all() and len(np.unique(a)) == a.size
    assert (draws.bits(2, 2, reps, 20) != a).all() and (draws.bits(1, 3, reps, 20) != a).all()
    assert (np.sort(draws.permutations(1, -5, reps, 20), axis=1) == np.arange(20)).all()
    e = np.arange(1.0, 21.0)
    assert set(draws.errors("nonparametric", e, 0, 7, reps).ravel()) == set(e)
    assert (np.abs(draws.errors("wild", e, 0, 7, reps)) == e).all()
    normal = draws.errors("parametric", e, 0, 7, np.arange(4000))
    assert normal.std() == pytest.approx(e.std(), rel=0.02) and abs(normal.mean()) < 0.1
    with pytest.raises(ValueError, match="unknown"):
        draws.errors("other", e, 0, 7, reps)


def test_moran_permutations_are_centred(spark):
    rng = np.random.default_rng(1)
    n = 30
    data = spark.createDataFrame([(t, f"u{i:02}", float(x)) for t in range(2) for i, x in enumerate(rng.normal(size=n))], "t int, market string, v double")
    edges = spark.createDataFrame([(f"u{i:02}", f"u{(i + d) % n:02}", 0.5) for i in range(n) for d in (1, n - 1)], "src string, dst string, w double")
    got = spatial_stats.moran(edges, data, "v", by=["t"], permutations=400)
    again = {r.t: r for r in spatial_stats.moran(edges, data.repartition(7), "v", by=["t"], permutations=400).collect()}
    for r in got.collect():
        assert (again[r.t].p_sim, again[r.t].z_sim) == (r.p_sim, pytest.approx(r.z_sim))
        assert 1 / 401 <= r.p_sim <= 0.51 and abs(r.z_sim) < 6


def test_two_ways_that_do_not_settle_raise(spark):
    rows = [(e, t, float(e * t % 7)) for e in range(6) for t in range(6) if (e + 2 * t) % 3]
    panel = spark.createDataFrame(rows, "entity int, time int, y double")
    settled = panel_reg._demeaned(panel, ["y"], True, True).toPandas()
    assert settled.groupby("entity").y.mean().abs().max() < 1e-9 and settled.groupby("time").y.mean().abs().max() < 1e-9
    with pytest.raises(ArithmeticError, match="still there"):
        panel_reg._demeaned(panel, ["y"], True, True, most=1)


def test_phillips_perron_of_a_long_series(spark):
    """5,000 rows have a window of 32 lags by the rule; its long-run variance is that of numpy."""
    rng = np.random.default_rng(3)
    n = 5000
    v = np.cumsum(rng.normal(size=n))
    rows = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(v)], "market string, date int, price double")
    got = unitroot.phillips_perron(rows, ["market"], ["date"]).first()
    y, z = np.diff(v), v[:-1]
    x = np.column_stack([np.ones(n - 1), z])
    beta, *_ = np.linalg.lstsq(x, v[1:], rcond=None)
    e = v[1:] - x @ beta
    m = len(e)
    lags = int(np.ceil(12 * (m / 100) ** 0.25))
    assert lags > 30
    g0 = e @ e / m
    lrv = g0 + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / m for k in range(1, lags + 1))
    s2 = e @ e / (m - 2)
    se = np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])
    t = (beta[1] - 1) / se
    want = np.sqrt(g0 / lrv) * t - 0.5 * (lrv - g0) / np.sqrt(lrv) * m * se / np.sqrt(s2)
    assert got.statistic == pytest.approx(want, rel=1e-6) and len(y) == m
