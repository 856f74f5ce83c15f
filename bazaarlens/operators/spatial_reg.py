"""Spatial dependence tests and spatial lag and error models (I19, J).

Everything that depends on the rows is a handful of sums over rows and edges; only those reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import dist
from bazaarlens.operators import logdet, spatial_stats, weights
from bazaarlens.operators.ols import CONST, grouped_ols
from bazaarlens.plans.lineage import saved


def ols(data: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares of a cross-section."""
    return grouped_ols(data, [], y, list(xs))


def _linear(coef: dict, xs: Sequence[str]):
    return reduce(lambda a, b: a + b, [F.col(x) * float(coef[x]) for x in xs], F.lit(float(coef.get(CONST, 0.0))))


def _lags(edges: DataFrame, data: DataFrame, columns: Sequence[str], key: str, prefix: str = "w_") -> DataFrame:
    """``data`` with the spatial lags of several columns, by one join; units without neighbours have lag 0."""
    other = data.select(F.col(key).alias("dst"), *[F.col(c).alias(f"_{c}") for c in columns])
    lag = edges.join(other, "dst").groupBy(F.col("src").alias(key)).agg(*[F.sum(F.col("w") * F.col(f"_{c}")).alias(f"{prefix}{c}") for c in columns])
    return data.join(lag, key, "left").na.fill(0.0, [f"{prefix}{c}" for c in columns])


def _sums(rows: DataFrame, terms: dict) -> dict:
    return rows.agg(*[F.sum(c).alias(n) for n, c in terms.items()]).first().asDict()


def dependence(data: DataFrame, edges: DataFrame, y: str, xs: Sequence[str], key: str = "market", alpha: float = 0.05) -> DataFrame:
    """(test, statistic, p, recommended): residual Moran, LM error and lag and their robust forms."""
    rows = saved(data.select(key, *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna())
    fit = ols(rows, y, xs).first()
    rows = rows.withColumn("_fit", _linear(fit["coef"], xs)).withColumn("_e", F.col(y) - F.col("_fit"))
    rows = saved(_lags(edges, rows, ["_e", y, "_fit"], key))
    n = fit["n_obs"]
    s = _sums(rows, {"ee": F.col("_e") ** 2, "ewe": F.col("_e") * F.col("w__e"), "ewy": F.col("_e") * F.col(f"w_{y}")})
    s0 = edges.agg(F.sum("w")).first()[0]
    # tr(W'W + W^2)
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v"))
    t = edges.agg(F.sum(F.col("w") ** 2)).first()[0] + (edges.join(back, ["src", "dst"]).agg(F.sum(F.col("w") * F.col("v"))).first()[0] or 0.0)
    sigma2 = s["ee"] / n
    # (WXb)' M (WXb): what regression on the regressors leaves of WXb
    j = grouped_ols(rows, [], "w__fit", list(xs)).first()["ssr"]
    nj = t + j / sigma2
    e, lag = s["ewe"] / sigma2, s["ewy"] / sigma2
    stats = {"lm_error": e**2 / t, "lm_lag": lag**2 / nj, "robust_lm_error": (e - t / nj * lag) ** 2 / (t * (1 - t / nj)), "robust_lm_lag": (lag - e) ** 2 / (nj - t)}
    p = {name: float(dist.chi2_sf(v, 1)) for name, v in stats.items()}
    sig = {name: v < alpha for name, v in p.items()}
    if sig["lm_error"] and sig["lm_lag"]:
        both = sig["robust_lm_error"], sig["robust_lm_lag"]
        choice = "spatial_durbin" if all(both) else "spatial_error" if both[0] or (not both[1] and p["lm_error"] < p["lm_lag"]) else "spatial_lag"
    else:
        choice = "spatial_error" if sig["lm_error"] else "spatial_lag" if sig["lm_lag"] else "ols"
    out = [("moran_residuals", n / s0 * s["ewe"] / s["ee"], None, choice)] + [(name, float(v), p[name], choice) for name, v in stats.items()]
    return data.sparkSession.createDataFrame(out, "test string, statistic double, p double, recommended string")


def _maximum(f, lo: float, hi: float) -> float:
    """Golden-section search from the best of a grid that is denser towards the ends."""
    lo, hi = lo + 1e-9 * (hi - lo), hi - 1e-9 * (hi - lo)
    grid = (lo + hi) / 2 + (hi - lo) / 2 * np.sin(np.linspace(-np.pi / 2, np.pi / 2, 401))
    i = int(np.argmax([f(x) for x in grid]))
    a, b = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if f(c) > f(d) else (c, b)
    return float((a + b) / 2)


def _likeliest(f, det, bounds: tuple[float, float]) -> float:
    """The rho of the largest f within the bounds and the interval of the weights.

    Moments are carried on while it is near their reach.
    """
    while True:
        lo, hi = max(det.lo, -det.reach, bounds[0]), min(det.hi, det.reach, bounds[1])
        rho = _maximum(f, lo, hi)
        if lo + 0.02 * (hi - lo) < rho < hi - 0.02 * (hi - lo) or not det.widen():
            return rho


MODEL = "model string, method string, spatial double, coef map<string,double>, se map<string,double>, z map<string,double>, p map<string,double>, sigma2 double, pseudo_r2 double, log_lik double, aic double, bic double, n_obs long, status string"


def _model(spark, name, method, rho, names, b, cov, sigma2, r2, ll, n):
    k = len(names)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.asarray(b) / se
    p = dist.norm_sf2(np.nan_to_num(z))
    named = lambda v: dict(zip(names, (float(x) for x in v), strict=True))
    aic, bic = (None, None) if ll is None else (-2 * ll + 2 * k, -2 * ll + k * math.log(n))
    return spark.createDataFrame([(name, method, float(rho), named(b), named(se), named(z), named(p), float(sigma2), r2, ll, aic, bic, int(n), "ok")], MODEL)


def _moments(rows: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Cross-products of columns (1 where named so), and the number of rows."""
    cols = [F.lit(1.0) if c == CONST else F.col(c) for c in columns]
    r = rows.agg(F.count("*").alias("n"), *[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]).first()
    m = np.zeros((len(cols), len(cols)))
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
    return m, r["n"]


def lag_model(data: DataFrame, edges: DataFrame, y: str, xs: Sequence[str], key: str = "market", method: str = "iv", durbin: bool = False, bounds: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """y = rho W y + X b + e (J2): ``iv`` by instruments WX and W^2 X, ``ml`` by the concentrated likelihood within ``bounds``, or ``ols``."""
    rows = data.select(key, *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna()
    rows = saved(_lags(edges, rows, [y, *xs], key))
    used = [*xs, *[f"w_{x}" for x in xs]] if durbin else list(xs)
    wy = f"w_{y}"
    rows = saved(_lags(edges, rows, [f"w_{x}" for x in xs], key))  # w_w_x: second lags
    names = [CONST, *used]
    spark, name = data.sparkSession, "spatial_durbin" if durbin else "spatial_lag"
    instruments = [*([] if durbin else [f"w_{x}" for x in xs]), *[f"w_w_{x}" for x in xs]]
    columns = [*names, wy, *instruments, y]
    m, n = _moments(rows, columns)
    at = {c: i for i, c in enumerate(columns)}
    ix = [at[c] for c in names]
    iz = [*ix, at[wy]]
    ih = [*ix, *[at[c] for c in instruments]]
    yy, sst = m[at[y], at[y]], m[at[y], at[y]] - m[at[CONST], at[y]] ** 2 / n
    if method in ("iv", "ols"):
        zz, zy = m[np.ix_(iz, iz)], m[iz, at[y]]
        if method == "iv":
            hh, hz = m[np.ix_(ih, ih)], m[np.ix_(ih, iz)]
            pz = hz.T @ np.linalg.pinv(hh)
            a, v = pz @ hz, pz @ m[ih, at[y]]
        else:
            a, v = zz, zy
        b = np.linalg.solve(a, v)
        ssr = yy - 2 * b @ zy + b @ zz @ b
        cov = np.linalg.inv(a) * ssr / n
        return _model(spark, name, method, b[-1], [*names, "rho"], b, cov, ssr / n, float(1 - ssr / sst), None, n)
    if method != "ml":
        raise ValueError(f"unknown method {method}")
    xx = m[np.ix_(ix, ix)]
    inv = np.linalg.inv(xx)
    b0, bl = inv @ m[ix, at[y]], inv @ m[ix, at[wy]]
    e00 = yy - b0 @ m[ix, at[y]]
    e0l = m[at[y], at[wy]] - b0 @ m[ix, at[wy]]
    ell = m[at[wy], at[wy]] - bl @ m[ix, at[wy]]
    det = logdet.determinant(edges, rows, key)
    ll = lambda r: det.log(r) - n / 2 * (math.log(2 * math.pi) + math.log(max((e00 - 2 * r * e0l + r * r * ell) / n, 1e-300)) + 1)
    rho = _likeliest(ll, det, bounds)
    b = b0 - rho * bl
    sigma2 = (e00 - 2 * rho * e0l + rho * rho * ell) / n
    h = min(1e-4, (min(det.hi, 1e6) - rho) / 4, (rho - max(det.lo, -1e6)) / 4)
    curve = -(ll(rho + h) - 2 * ll(rho) + ll(rho - h)) / h**2
    v_rho = 1 / curve if curve > 0 else float("nan")
    cov = np.zeros((len(names) + 1, len(names) + 1))
    cov[:-1, :-1] = inv * sigma2 + np.outer(bl, bl) * v_rho
    cov[-1, -1] = v_rho
    cov[:-1, -1] = cov[-1, :-1] = -bl * v_rho
    return _model(spark, name, "ml", rho, [*names, "rho"], [*b, rho], cov, sigma2, float(1 - n * sigma2 / sst), float(ll(rho)), n)


def error_model(data: DataFrame, edges: DataFrame, y: str, xs: Sequence[str], key: str = "market", method: str = "gm", bounds: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """y = X b + u, u = lambda W u + e (J3): ``gm`` by Kelejian and Prucha (1999), ``ml`` by the likelihood within ``bounds``, or ``ols``."""
    rows = saved(data.select(key, *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna())
    fit = ols(rows, y, xs).first()
    names, n, spark = [CONST, *xs], fit["n_obs"], data.sparkSession
    base = saved(_lags(edges, rows.withColumn("_one", F.lit(1.0)), [y, *xs, "_one"], key))
    columns = [CONST, *xs, y, "w__one", *[f"w_{x}" for x in xs], f"w_{y}"]
    m, _ = _moments(base, columns)
    k = len(names)
    sst = m[k, k] - m[0, k] ** 2 / n

    def filtered(lam: float) -> tuple[np.ndarray, np.ndarray, float]:
        """b, (X*'X*)^-1 and SSR after (I - lam W)."""
        t = np.hstack([np.eye(k + 1), -lam * np.eye(k + 1)])
        g = t @ m @ t.T
        inv = np.linalg.inv(g[:k, :k])
        b = inv @ g[:k, k]
        return b, inv, float(g[k, k] - b @ g[:k, k])

    ll = None
    if method == "ols":
        lam = 0.0
    elif method == "gm":
        e = rows.withColumn("_e", F.col(y) - _linear(fit["coef"], xs)).select(key, "_e")
        e = saved(_lags(edges, e, ["_e"], key))
        e = _lags(edges, e, ["w__e"], key)
        s = _sums(e, {"ee": F.col("_e") ** 2, "e1": F.col("_e") * F.col("w__e"), "11": F.col("w__e") ** 2, "e2": F.col("_e") * F.col("w_w__e"), "12": F.col("w__e") * F.col("w_w__e"), "22": F.col("w_w__e") ** 2})
        tr = edges.agg(F.sum(F.col("w") ** 2)).first()[0]
        g = np.array([[2 * s["e1"], -s["11"], n], [2 * s["12"], -s["22"], tr], [s["e2"] + s["11"], -s["12"], 0]]) / n
        target = np.array([s["ee"], s["11"], s["e1"]]) / n
        # the scale solves least squares at each lambda
        def miss(r: float) -> float:
            left = target - g[:, 0] * r - g[:, 1] * r * r
            s2 = max(float(left @ g[:, 2] / (g[:, 2] @ g[:, 2])), 0.0)
            return -float(((left - g[:, 2] * s2) ** 2).sum())

        lam = _maximum(miss, -0.9999, 0.9999)
    elif method == "ml":
        det = logdet.determinant(edges, rows, key)
        value = lambda r: det.log(r) - n / 2 * (math.log(2 * math.pi) + math.log(max(filtered(r)[2] / n, 1e-300)) + 1)
        lam = _likeliest(value, det, bounds)
        ll = float(value(lam))
    else:
        raise ValueError(f"unknown method {method}")
    b, inv, ssr = filtered(lam)
    raw = m[: k + 1, : k + 1]
    left = raw[k, k] - 2 * b @ raw[:k, k] + b @ raw[:k, :k] @ b
    return _model(spark, "spatial_error", method, lam, names, b, inv * ssr / n, ssr / n, float(1 - left / sst), ll, n)


def predict(model: DataFrame, data: DataFrame, xs: Sequence[str], edges: DataFrame | None = None, y: str | None = None, key: str = "market") -> DataFrame:
    """(key, predicted): X b, plus rho W y for a lag model (W X b where y isn't there)."""
    m = model.first()
    fitted = data.withColumn("_xb", _linear(m["coef"], xs))
    if m["model"] == "spatial_error" or edges is None:
        return fitted.select(key, F.col("_xb").alias("predicted"))
    lagged = _lags(edges, fitted, [y if y and y in data.columns else "_xb"], key)
    return lagged.select(key, (F.col("_xb") + float(m["spatial"]) * F.col(f"w_{y if y and y in data.columns else '_xb'}")).alias("predicted"))


def impacts(model: DataFrame, edges: DataFrame, units: DataFrame, xs: Sequence[str], key: str = "market") -> DataFrame:
    """(variable, direct, indirect, total) (J5): for a lag model by the trace of (I - rho W)^-1, W row-standardised.

    A Durbin model's lagged columns aren't part of it.  A rho outside the interval of the weights, as weak instruments may
    give, has no effects: they are null.
    """
    m = model.first()
    rho = m["spatial"] if m["model"] != "spatial_error" else 0.0
    schema = "variable string, direct double, indirect double, total double"
    share, total = 1.0, 1.0
    if rho:
        det = logdet.determinant(edges, units, key)
        if not max(det.lo, -1) < rho < min(det.hi, 1) or (abs(rho) > det.reach and not det.widen(rho)):
            return model.sparkSession.createDataFrame([(x, None, None, None) for x in xs], schema)
        share, total = det.trace(rho) / det.n, 1 / (1 - rho)
    rows = [(x, m["coef"][x] * share, m["coef"][x] * (total - share), m["coef"][x] * total) for x in xs]
    return model.sparkSession.createDataFrame([(a, float(b), float(c), float(d)) for a, b, c, d in rows], schema)


def estimate(data: DataFrame, edges: DataFrame, y: str, xs: Sequence[str], model: str | None = None, key: str = "market", method: str | None = None) -> DataFrame:
    """The named model, or the one that the dependence tests recommend."""
    chosen = model or dependence(data, edges, y, xs, key).first()["recommended"]
    if chosen == "spatial_error":
        return error_model(data, edges, y, xs, key, method or "gm")
    if chosen in ("spatial_lag", "spatial_durbin"):
        return lag_model(data, edges, y, xs, key, method or "iv", chosen == "spatial_durbin")
    return error_model(data, edges, y, xs, key, "ols").withColumn("model", F.lit("ols"))


def full_analysis(panel: DataFrame, points: DataFrame, y: str, xs: Sequence[str], kind: str = "knn", key: str = "market", ts: str = "date", reference: str | None = None, **options) -> dict[str, DataFrame]:
    """Weights, diagnostics, both models, and integration, dispersion and transmission as a dict of tables."""
    edges = saved(weights.create(points, kind, key, **options))
    cross = saved(panel.groupBy(key).agg(*[F.avg(c).alias(c) for c in (y, *xs)]))
    out = {"weights": edges, "diagnostics": dependence(cross, edges, y, xs, key), "lag": lag_model(cross, edges, y, xs, key), "error": error_model(cross, edges, y, xs, key), "integration": spatial_stats.integration(edges, panel, value=y, key=key, ts=ts), "dispersion": spatial_stats.price_dispersion(panel, y, ts=ts)}
    if reference is not None:
        out["transmission"] = spatial_stats.price_transmission(panel, reference, y, key=key, ts=ts)
    return out
