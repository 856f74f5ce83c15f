"""Models against numpy least squares, dense linear algebra, enumeration and published values."""

import math

import numpy as np
import pandas as pd
import pytest

from bazaarlens.functions import dist
from bazaarlens.operators import clean, coint, describe, diagnostics, features, joins, ols, panel_reg, scenario, spatial_reg, spatial_stats, threshold, unitroot, weights


def ls(y, *xs):
    x = np.column_stack(xs)
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    s2 = e @ e / (len(y) - x.shape[1])
    return b, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2), e


@pytest.fixture(scope="module")
def series():
    """A random walk, a stationary series, one with a trend, and a short one."""
    rng = np.random.default_rng(42)
    e = rng.normal(size=100)
    ar = np.zeros(100)
    for t in range(1, 100):
        ar[t] = 0.5 * ar[t - 1] + rng.normal()
    return {"walk": 50 + np.cumsum(e), "ar": 10 + ar, "trend": 5 + 0.3 * np.arange(100) + rng.normal(size=100), "short": np.array([1.0, 2.0, 1.5])}


@pytest.fixture(scope="module")
def panel(spark, series):
    dates = pd.date_range("2015-01-01", periods=100, freq="MS").date
    rows = [(k, d, float(v)) for k, x in series.items() for d, v in zip(dates, x, strict=False)]
    return spark.createDataFrame(rows, "market string, date date, price double").repartition(3).cache()


@pytest.fixture(scope="module")
def pair(spark):
    """y = 2 + 1.5 x + e, with e slow above 0.5 and fast below."""
    rng = np.random.default_rng(42)
    out = {}
    for name in ("a|b", "c|d"):
        x = np.cumsum(rng.normal(size=120)) + 20
        e = np.zeros(120)
        for t in range(1, 120):
            e[t] = (0.7 if e[t - 1] > 0.5 else 0.3) * e[t - 1] + rng.normal()
        out[name] = (2 + 1.5 * x + e, x)
    dates = pd.date_range("2010-01-01", periods=120, freq="MS").date
    rows = [(k, d, float(a), float(b)) for k, (y, x) in out.items() for d, a, b in zip(dates, y, x, strict=True)]
    return spark.createDataFrame(rows, "pair_id string, ts date, y double, x double").repartition(3).cache(), out


K, O, PK, PO = ["market"], ["date"], ["pair_id"], ["ts"]


def adf_brute(x, lags_max, trend, autolag=True):
    d = np.diff(x)
    n = len(d)

    def fit(p, start):
        y = d[start:]
        cols = [x[start:-1], *[d[start - j : n - j] for j in range(1, p + 1)]]
        if trend in ("c", "ct"):
            cols.append(np.ones(n - start))
        if trend == "ct":
            cols.append(np.arange(start, n, dtype=float))
        b, se, e = ls(y, *cols)
        ssr = e @ e
        aic = len(y) * (math.log(2 * math.pi) + math.log(ssr / len(y)) + 1) + 2 * len(cols)
        return b[0] / se[0], aic

    p = min(range(lags_max + 1), key=lambda q: fit(q, lags_max)[1]) if autolag else lags_max
    return fit(p, p)[0], p


def test_distributions():
    assert dist.norm_ppf([0.975, 0.025, 1e-10]) == pytest.approx([1.959963985, -1.959963985, -6.361340902])
    assert dist.t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-8)
    # five per cent at the five per cent critical values, and both branches meet
    for (n, trend), rows in dist.CRITICAL.items():
        assert dist.mackinnon_p([rows[1][0]], trend, n)[0] == pytest.approx(0.05, abs=0.003)
    for (n, trend), (_, _, star, _, _) in dist.SURFACE.items():
        a, b = dist.mackinnon_p([star - 1e-9, star + 1e-9], trend, n)
        assert abs(a - b) < 0.012


def test_grouped_ols(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(5):
        a, b = rng.normal(1000, 5, 40), rng.normal(size=40)
        y = 3 + 2 * a - b + rng.normal(size=40)
        rows += [(g, float(p), float(q), float(r)) for p, q, r in zip(y, a, b, strict=True)]
        want[g] = ls(y, np.ones(40), a, b)
    rows += [(9, 1.0, 2.0, 3.0), (10, 1.0, 2.0, 4.0), (10, 2.0, 2.0, 4.0), (10, 3.0, 2.0, 4.0), (10, 4.0, 2.0, 4.0), (0, None, 1.0, 1.0), (0, 1.0, float("nan"), 1.0)]
    got = {r.g: r for r in ols.grouped_ols(spark.createDataFrame(rows, "g int, y double, a double, b double"), ["g"], "y", ["a", "b"]).collect()}
    for g, (b, se, e) in want.items():
        assert [got[g].coef[k] for k in ("const", "a", "b")] == pytest.approx(b, rel=1e-6)
        assert [got[g].se[k] for k in ("const", "a", "b")] == pytest.approx(se, rel=1e-5)
        assert got[g].ssr == pytest.approx(e @ e, rel=1e-5) and got[g].n_obs == 40
    assert got[9].status == "insufficient_data" and got[10].status == "singular"


@pytest.mark.parametrize("trend", ["n", "c", "ct"])
def test_adf(panel, series, trend):
    got = {r.market: r for r in unitroot.adf(panel, K, O, trend=trend, max_lags=4).collect()}
    for k in ("walk", "ar", "trend"):
        want, lags = adf_brute(series[k], 4, trend)
        assert got[k].statistic == pytest.approx(want, rel=1e-5) and got[k].n_lags == lags
    assert got["short"].status == "insufficient_data" and got["short"].statistic is None
    if trend == "c":
        assert got["ar"].is_stationary and not got["walk"].is_stationary
        assert got["walk"].crit["5%"] == pytest.approx(-2.89, abs=0.01)


def test_dfgls_and_zivot_andrews(panel, series):
    got = {r.market: r for r in unitroot.dfgls(panel, K, O).collect()}
    za = {r.market: r for r in unitroot.zivot_andrews(panel, K, O, lags=1).collect()}
    for k in ("walk", "ar"):
        x = series[k]
        n = len(x)
        a = 1 - 7 / n
        q, z = np.append(x[0], x[1:] - a * x[:-1]), np.append(1.0, np.full(n - 1, 1 - a))
        want, _ = adf_brute(x - (q @ z) / (z @ z), 4, "n")
        assert got[k].statistic == pytest.approx(want, rel=1e-5)
        d = np.diff(x)
        t = np.arange(2, n)
        stats = [(lambda b, se, _: b[0] / se[0])(*ls(d[1:], x[1:-1], np.ones(n - 2), t, d[:-1], (t >= i).astype(float))) for i in range(15, 85)]
        assert za[k].statistic == pytest.approx(min(stats), rel=1e-5)
        assert za[k].break_date == pd.date_range("2015-01-01", periods=n, freq="MS")[15 + int(np.argmin(stats))].date()
    assert za["short"].status == "insufficient_data"


def test_order_of_integration(panel):
    got = {r.market: r.order_of_integration for r in unitroot.order_of_integration(panel.where("market != 'short'"), K, O).collect()}
    assert got["ar"] == 0 and got["walk"] == 1


def test_engle_granger_and_gregory_hansen(pair):
    df, data = pair
    eg = {r.pair_id: r for r in coint.engle_granger(df).collect()}
    gh = {r.pair_id: r for r in coint.gregory_hansen(df, "cshift", max_lags=1).collect()}
    for k, (y, x) in data.items():
        one = np.ones(len(y))
        b, _, e = ls(y, one, x)
        assert (eg[k].const, eg[k].slope) == pytest.approx(tuple(b))
        assert eg[k].statistic == pytest.approx(adf_brute(e, 4, "n", False)[0], rel=1e-5) and eg[k].is_cointegrated
        stats = []
        for i in range(18, 102):
            du = (np.arange(120) >= i).astype(float)
            stats.append(adf_brute(ls(y, one, du, x, du * x)[2], 1, "n", False)[0])
        assert gh[k].statistic == pytest.approx(min(stats), rel=1e-5)
    short = df.where("ts < '2010-06-01'")
    assert {r.status for r in coint.engle_granger(short).collect()} == {"insufficient_data"}
    assert {r.status for r in coint.gregory_hansen(short).collect()} == {"insufficient_data"}


def test_johansen(pair):
    df, data = pair
    got = {r.pair_id: r for r in coint.johansen(df, k_ar_diff=2).collect()}
    for k, (y, x) in data.items():
        p = np.column_stack([y, x])
        d = np.diff(p, axis=0)
        z = np.hstack([np.ones((len(d) - 2, 1)), d[1:-1], d[:-2]])
        clear = lambda v: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]  # noqa: B023, E731
        r0, r1 = clear(d[2:]), clear(p[2:-1])
        n = len(r0)
        s00, s01, s11 = r0.T @ r0 / n, r0.T @ r1 / n, r1.T @ r1 / n
        eig = np.sort(np.linalg.eigvals(np.linalg.inv(s11) @ s01.T @ np.linalg.inv(s00) @ s01).real)[::-1]
        assert got[k].eigenvalues == pytest.approx(eig, rel=1e-6)
        assert got[k].trace[0] == pytest.approx(-n * np.log(1 - eig).sum(), rel=1e-6)
        assert got[k].is_cointegrated and got[k].beta[1] == pytest.approx(-1.5, abs=0.2)


def tar_brute(z, q, lags):
    d = np.diff(z)
    n = len(d)
    y = d[lags:]
    z1, qq = z[lags:-1], q[lags:]
    other = [np.ones(n - lags), *[d[lags - j : n - j] for j in range(1, lags + 1)]]
    best = (np.inf, None)
    m = len(y)
    order = np.sort(qq)
    for tau in np.unique(order[int(m * 0.15) : int(m * 0.85)]):
        up = qq >= tau
        e = ls(y, z1 * up, z1 * ~up, *other)[2]
        best = min(best, (e @ e, tau))
    return best


def test_threshold_search_and_fit(pair):
    df, data = pair
    z = coint.residuals(df)
    got = {r.pair_id: r for r in threshold.fit(z, max_lags=2).collect()}
    fixed = {r.pair_id: r for r in threshold.fit(z, "fixed", max_lags=2).collect()}
    for k, (y, x) in data.items():
        e = ls(y, np.ones(len(y)), x)[2]
        ssr, tau = tar_brute(e, e[:-1], 2)
        assert got[k].threshold == pytest.approx(tau, rel=1e-6) and got[k].ssr == pytest.approx(ssr, rel=1e-6)
        assert fixed[k].threshold == 0 and fixed[k].ssr >= got[k].ssr - 1e-9
        d = np.diff(e)
        up = e[2:-1] >= tau
        cols = [np.ones(len(d) - 2), e[2:-1] * up, e[2:-1] * ~up, d[1:-1], d[:-2]]
        b, se, _ = ls(d[2:], *cols)
        assert (got[k].rho_above, got[k].rho_below, got[k].se_above) == pytest.approx((b[1], b[2], se[1]), rel=1e-5)
        plain = ls(d[2:], cols[0], e[2:-1], *cols[3:])[2]
        assert got[k].f == pytest.approx((plain @ plain - ssr) / (ssr / (len(d) - 2 - 5)), rel=1e-4)
    assert {r.status for r in threshold.fit(coint.residuals(df.where("ts < '2010-06-01'"))).collect()} == {"insufficient_data"}


def test_tied_regime_values_use_what_is_strictly_below(spark):
    rng = np.random.default_rng(3)
    q = rng.integers(0, 8, 90).astype(float)
    z1, dz = rng.normal(size=90), rng.normal(size=90)
    rows = spark.createDataFrame([("p", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(dz, z1, q, strict=True))], "pair_id string, ts int, dz double, z1 double, q double")
    got = threshold.search(rows, PK, []).first()
    order = np.sort(q)
    best = min((float((lambda e: e @ e)(ls(dz, np.ones(90), z1 * (q >= t), z1 * (q < t))[2])), t) for t in np.unique(q) if 13 <= np.searchsorted(order, t) < 76)
    assert (got.ssr, got.threshold) == pytest.approx(best)


def test_bootstrap_is_repeatable_and_counts(pair):
    df, _ = pair
    z = coint.residuals(df).cache()
    fits = threshold.fit(z, max_lags=1).cache()
    a = {r.pair_id: r for r in threshold.bootstrap(z, fits, 60, max_lags=1).collect()}
    b = {r.pair_id: r for r in threshold.bootstrap(z.repartition(7), fits, 60, max_lags=1).collect()}
    for k in a:
        assert a[k].p_boot == b[k].p_boot and a[k].n_boot == 60 and 0 <= a[k].p_boot <= 1 and a[k].crit["90%"] <= a[k].crit["99%"]
    for kind in ("parametric", "wild"):
        assert threshold.bootstrap(z, fits, 10, max_lags=1, kind=kind).count() == 2
    s = threshold.sup_lm(z, 10, max_lags=1).first()
    assert s.sup_lm >= 0 and 0 <= s.p_boot <= 1


def test_tvecm_uses_one_threshold_for_both(pair):
    df, _ = pair
    rows = threshold.tvecm(df).collect()
    assert len(rows) == 4
    for k in ("a|b", "c|d"):
        both = [r for r in rows if r.pair_id == k]
        assert both[0].threshold == both[1].threshold and both[0].system_aic == pytest.approx(both[0].aic + both[1].aic)
        total = sum(r.ssr for r in both)
        other = threshold.tvecm(df, fixed_threshold=both[0].threshold + 0.8).where(f"pair_id = '{k}'").collect()
        assert total <= sum(r.ssr for r in other) + 1e-9
    assert {r.mode for r in threshold.compare(df, max_lags=1).where("is_best").collect()} <= {"standard", "fixed", "mtar", "tvecm"}


def test_ewma_and_pacf(spark, panel, series):
    got = [r.momentum for r in features.momentum(panel.where("market = 'ar'"), "price", K, O, "exponential").orderBy("date").collect()]
    d = pd.Series(series["ar"]).diff()
    want = d.shift(1).dropna().ewm(alpha=0.5, adjust=False).mean()
    assert got[2:] == pytest.approx(want.tolist()) and got[:2] == [None, None]
    p = {r.lag: r.pacf for r in features.pacf(features.acf(panel.where("market = 'ar'"), "price", K, O, 3), K).collect()}
    r = {r.lag: r.acf for r in features.acf(panel.where("market = 'ar'"), "price", K, O, 3).collect()}
    t = np.array([[1, r[1]], [r[1], 1]])
    assert p[1] == pytest.approx(r[1]) and p[2] == pytest.approx(np.linalg.solve(t, [r[1], r[2]])[1])


def test_lowess_follows_a_line(spark):
    noise = np.random.default_rng(0).normal(size=50) * 0.5
    rows = spark.createDataFrame([("m", i, float(3.0 + 2 * i + noise[i] + (50 if i == 20 else 0))) for i in range(50)], "market string, date int, price double")
    got = {r.date: r.trend for r in clean.lowess(rows).collect()}
    assert all(got[i] == pytest.approx(3 + 2 * i, abs=2.0) for i in range(50))
    flagged = [r.date for r in clean.trend_outliers(rows, threshold=20.0).where("is_outlier").collect()]
    assert 20 in flagged


def _lowess_by_rows(y, fraction=0.2, rounds=3):
    n = len(y)
    k = int(min(max(np.ceil(n * fraction), 2), n))
    r, fit = np.ones(n), np.zeros(n)
    for turn in range(rounds + 1):
        for i in range(n):
            a = max(0, min(i - (k - 1) // 2, n - k))
            x = np.arange(a, a + k) - i
            w = (1 - (np.abs(x) / max(np.abs(x).max(), 1)) ** 3) ** 3 * r[a : a + k]
            design = np.stack([np.ones(k), x], 1) * np.sqrt(w)[:, None]
            fit[i] = np.linalg.lstsq(design, y[a : a + k] * np.sqrt(w), rcond=None)[0][0]
        if turn < rounds:
            u = np.abs(y - fit)
            u = u / (6 * np.median(u))
            r = np.where(u < 1, (1 - u**2) ** 2, 0.0)
    return fit


def test_lowess_is_that_of_every_point_with_its_neighbours(spark):
    rng = np.random.default_rng(4)
    series = {m: rng.normal(size=n).cumsum() * 5 + 900 + (rng.random(n) < 0.1) * 80 for m, n in (("a", 301), ("b", 47), ("c", 10), ("d", 120))}
    data = spark.createDataFrame([(m, i, float(v)) for m, y in series.items() for i, v in enumerate(y)] + [("a", 999, None)], "market string, date int, price double")
    for rows in (None, 7):  # one range, ranges within a stretch of neighbours
        got = clean.lowess(data, rows=rows).toPandas()
        assert len(got) == sum(map(len, series.values()))
        for m, y in series.items():
            np.testing.assert_allclose(got[got.market == m].sort_values("date").trend.astype(float), _lowess_by_rows(y), rtol=0, atol=1e-7)


def test_lowess_of_short_and_level_series(spark):
    data = spark.createDataFrame([("one", 1, 5.0), ("two", 1, 1.0), ("two", 2, 3.0), *[("level", i, 4.0) for i in range(12)], ("none", 1, None)], "market string, date int, price double")
    got = {(r.market, r.date): r.trend for r in clean.lowess(data).collect()}
    assert got[("one", 1)] == pytest.approx(5.0) and all(got[("level", i)] == pytest.approx(4.0) for i in range(12))
    assert got[("two", 1)] == pytest.approx(1.0) and got[("two", 2)] == pytest.approx(3.0) and len(got) == 15
    assert clean.lowess(data.where("false")).count() == 0


def test_shapiro_wilk_published_value(spark):
    # the men's weights of Shapiro and Wilk (1965): W = .79
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    got = diagnostics.shapiro_wilk(spark.createDataFrame([(1, float(v)) for v in x], "k int, v double"), "v", ["k"]).first()
    assert got.w == pytest.approx(0.79, abs=0.01) and got.p == pytest.approx(0.0072, abs=0.003)


def test_panel_fits(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(8):
        for t in range(12):
            if rng.random() < 0.85:
                a, b = rng.normal(i), rng.normal()
                rows.append((f"e{i}", pd.Timestamp(2020, t + 1, 1).date(), float(3 * i + t + 2 * a - b + rng.normal()), float(a), float(b)))
    p = panel_reg.prepare(spark.createDataFrame(rows, "market string, date date, price double, a double, b double"), "price", ["a", "b"]).cache()
    frame = pd.DataFrame(rows, columns=["e", "t", "y", "a", "b"])
    de, dt = pd.get_dummies(frame.e).to_numpy(float), pd.get_dummies(frame.t).to_numpy(float)
    y, a, b = (frame[c].to_numpy() for c in "yab")
    one = ls(y, a, b, de)
    got = panel_reg.fixed(p, "price", ["a", "b"], cov_type="unadjusted").first()
    assert (got.coef["a"], got.coef["b"]) == pytest.approx(tuple(one[0][:2])) and got.se["a"] == pytest.approx(one[1][0], rel=1e-6)
    two = ls(y, a, b, de, dt[:, 1:])
    got = panel_reg.fixed(p, "price", ["a", "b"], True, True, "unadjusted").first()
    assert (got.coef["a"], got.coef["b"]) == pytest.approx(tuple(two[0][:2]), rel=1e-6) and got.se["b"] == pytest.approx(two[1][1], rel=1e-5)
    x = np.column_stack([np.ones(len(y)), a, b])
    beta, _, e = ls(y, *x.T)
    inv = np.linalg.inv(x.T @ x)
    meat = sum(np.outer(s, s) for s in [x[frame.e == k].T @ e[frame.e == k] for k in frame.e.unique()])
    got = panel_reg.pooled(p, "price", ["a", "b"], "clustered").first()
    n = len(y)
    assert got.se["a"] == pytest.approx(math.sqrt((inv @ meat @ inv)[1, 1] * n / (n - 3)), rel=1e-6)
    g = frame.groupby("e")
    t, means = g.size(), g[["y", "a", "b"]].mean()
    within = frame[["y", "a", "b"]] - g[["y", "a", "b"]].transform("mean")
    s_e = (lambda e: e @ e)(ls(*within.to_numpy().T)[2]) / (n - 8 - 2)
    s_u = max(0.0, (lambda e: e @ e)(ls(means.y.to_numpy(), np.ones(8), means.a, means.b)[2]) / 5 - s_e / (8 / (1 / t).sum()))
    th = (1 - np.sqrt(s_e / (s_e + t * s_u))).reindex(frame.e).to_numpy()
    q = frame[["y", "a", "b"]].to_numpy() - th[:, None] * g[["y", "a", "b"]].transform("mean").to_numpy()
    want = ls(q[:, 0], 1 - th, q[:, 1], q[:, 2])[0]
    got = panel_reg.random_effects(p, "price", ["a", "b"]).first()
    assert (got.coef["const"], got.coef["a"], got.coef["b"]) == pytest.approx(tuple(want), rel=1e-6)
    assert panel_reg.hausman(p, "price", ["a", "b"]).first().df == 2


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(7)
    n = 49
    xy = [(float(i % 7), float(i // 7)) for i in range(n)]
    points = spark.createDataFrame([(f"m{i:02d}", *p) for i, p in enumerate(xy)], "market string, x double, y double").cache()
    edges = weights.row_normalize(weights.knn(points, 4)).cache()
    w = np.zeros((n, n))
    for r in edges.collect():
        w[int(r.src[1:]), int(r.dst[1:])] = r.w
    a = rng.normal(size=n) * 2
    y = np.linalg.solve(np.eye(n) - 0.6 * w, 1 + 2 * a + rng.normal(size=n) * 0.5)
    data = spark.createDataFrame([(f"m{i:02d}", float(y[i]), float(a[i])) for i in range(n)], "market string, v double, a double").cache()
    return points, edges, w, y, a, data


def test_nearest_neighbours(spark, grid):
    points, *_ = grid
    xy = {r.market: (r.x, r.y) for r in points.collect()}
    for k in (1, 5, 60):
        got = {}
        for r in weights.nearest_pairs(points, k).collect():
            got.setdefault(r.src, []).append((r.d, r.dst))
        for m, p in xy.items():
            want = sorted((math.dist(p, q), o) for o, q in xy.items() if o != m)[:k]
            assert [d for _, d in sorted(got[m])] == [d for _, d in want]


def test_spatial_models(grid):
    _, edges, w, y, a, data = grid
    n = len(y)
    assert edges.groupBy("src").sum("w").agg({"sum(w)": "max"}).first()[0] == pytest.approx(1)
    x = np.column_stack([np.ones(n), a])

    def ll(r):
        e = (np.eye(n) - r * w) @ y
        e = e - x @ np.linalg.lstsq(x, e, rcond=None)[0]
        return np.linalg.slogdet(np.eye(n) - r * w)[1] - n / 2 * math.log(e @ e / n)

    rho = max(np.linspace(-0.9, 0.95, 1851), key=ll)
    ml = spatial_reg.lag_model(data, edges, "v", ["a"], method="ml").first()
    assert ml.spatial == pytest.approx(rho, abs=0.001)
    iv = spatial_reg.lag_model(data, edges, "v", ["a"]).first()
    h = np.column_stack([x, w @ a, w @ w @ a])
    z = np.column_stack([x, w @ y])
    zh = h @ np.linalg.lstsq(h, z, rcond=None)[0]
    want = np.linalg.lstsq(zh, y, rcond=None)[0]
    assert (iv.coef["const"], iv.coef["a"], iv.spatial) == pytest.approx(tuple(want), rel=1e-5)
    e = ls(y, *x.T)[2]
    s2 = e @ e / n
    t = np.trace(w.T @ w + w @ w)
    got = {r.test: r for r in spatial_reg.dependence(data, edges, "v", ["a"]).collect()}
    assert got["lm_error"].statistic == pytest.approx((e @ w @ e / s2) ** 2 / t)
    assert got["lm_lag"].p < 0.01 and got["lm_lag"].recommended in ("spatial_lag", "spatial_durbin")
    impact = spatial_reg.impacts(spatial_reg.lag_model(data, edges, "v", ["a"]), edges, data, ["a"]).first()
    s = np.linalg.inv(np.eye(n) - iv.spatial * w) * iv.coef["a"]
    assert impact.total == pytest.approx(s.sum() / n, rel=1e-6) and impact.direct == pytest.approx(np.trace(s) / n, rel=1e-6)
    assert abs(spatial_reg.error_model(data, edges, "v", ["a"]).first().spatial) < 1
    moran = spatial_stats.moran(edges, data, "v").first().moran
    scaled = spatial_stats.moran(edges, data.selectExpr("market", "3 * v - 7 as v"), "v").first().moran
    c = y - y.mean()
    assert moran == pytest.approx(n / w.sum() * (c @ w @ c) / (c @ c)) == pytest.approx(scaled)
    sims = spatial_stats.moran(edges, data, "v", permutations=99).first()
    assert sims.p_sim <= 0.05


def test_scenarios_and_joins(spark, grid):
    points, *_ = grid
    d = weights.band_pairs(points, 2.0)
    with pytest.raises(ValueError, match="scale"):
        scenario.reconnect(d, 0.2, "knn")
    near = joins.merge_conflict(points, spark.createDataFrame([(0.1, 0.1, 5.0)], "x double, y double, intensity double"), 1.0)
    got = {r.market: r.conflict_intensity for r in near.collect()}
    assert got["m00"] == 5.0 and got["m48"] == 0.0 and len(got) == 49


def test_bootstrap_statistic(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(50)], "market string, date int, price double")
    r = describe.bootstrap(rows, "price", "mean", 200, keys=["market"]).first()
    own = describe.bootstrap(rows, "price", lambda x: x.mean(), 50, keys=["market"]).first()
    assert r.lower < 24.5 < r.upper and r.statistic == own.statistic == 24.5


def test_phillips_perron_window_of_long_series(spark):
    """32 lags for 5,000 observations: no bound on the Bartlett window."""
    v = np.cumsum(np.random.default_rng(12).normal(size=5000))
    data = spark.range(5000).selectExpr("'a' AS market", "date_add(date'2000-01-01', cast(id AS int)) AS date", "cast(id AS int) AS i").join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, price double"), "i")
    got = unitroot.phillips_perron(data, ["market"], ["date"]).first()
    z, x = v[:-1], v[1:]
    X = np.column_stack([np.ones(len(z)), z])
    b = np.linalg.lstsq(X, x, rcond=None)[0]
    e = x - X @ b
    n, lags = len(e), int(np.ceil(12 * (4999 / 100) ** 0.25))
    s2 = e @ e / (n - 2)
    se = np.sqrt(s2 * np.linalg.inv(X.T @ X)[1, 1])
    g0 = e @ e / n
    lrv = g0 + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1)) / n
    want = np.sqrt(g0 / lrv) * (b[1] - 1) / se - 0.5 * (lrv - g0) / np.sqrt(lrv) * n * se / np.sqrt(s2)
    assert lags > 30 and got.n_lags == lags and np.isclose(got.statistic, want, rtol=1e-6)
