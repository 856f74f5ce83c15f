"""Log-determinants, traces and the spatial models built on them against dense matrices, up to strong dependence."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import logdet, spatial_reg

RHOS = (0.5, 0.9, 0.98, -0.7)


def ring(spark, n):
    """Two neighbours each, half the weight to each."""
    ids = spark.range(n).select(F.col("id").alias("src"))
    edges = ids.select("src", F.explode(F.array((F.col("src") + 1) % n, (F.col("src") + n - 1) % n)).alias("dst")).withColumn("w", F.lit(0.5))
    w = np.zeros((n, n))
    i = np.arange(n)
    w[i, (i + 1) % n] = w[i, (i - 1) % n] = 0.5
    return edges, ids.withColumnRenamed("src", "market"), w


def nearest(n, k=3, seed=5):
    """Each unit's k nearest of random points on a line: not symmetric."""
    x = np.random.default_rng(seed).random(n)
    d = np.abs(x[:, None] - x[None, :]) + np.eye(n) * 9
    w = np.zeros((n, n))
    for i in range(n):
        w[i, np.argsort(d[i])[:k]] = 1 / k
    return w


def table(spark, w):
    return spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in np.argwhere(w)], "src long, dst long, w double")


def dense(w, rho):
    m = np.eye(len(w)) - rho * w
    return np.linalg.slogdet(m)[1], np.trace(np.linalg.inv(m))


def test_exact(spark):
    edges, units, w = ring(spark, 400)
    det = logdet.determinant(edges, units)
    for rho in (*RHOS, 0.999):
        assert (det.log(rho), det.trace(rho)) == pytest.approx(dense(w, rho), rel=1e-9)
    assert det.hi == pytest.approx(1) and det.lo == pytest.approx(-1)
    other = nearest(60)
    det = logdet.determinant(table(spark, other), spark.range(61).select(F.col("id").alias("market")))
    for rho in RHOS:
        log, trace = dense(other, rho)
        assert (det.log(rho), det.trace(rho)) == pytest.approx((log, trace + 1), rel=1e-9)  # a unit without neighbours


def test_moments_of_even_weights(spark):
    edges, units, w = ring(spark, 400)
    det = logdet.determinant(edges, units, exact_units=0, numbers=400 * 320)
    assert det.even and det.reach == pytest.approx(0.9)
    for rho in (0.5, 0.9, -0.7):
        log, trace = dense(w, rho)
        assert det.log(rho) == pytest.approx(log, rel=0.03) and det.trace(rho) == pytest.approx(trace, rel=0.03)


def test_moments_of_uneven_weights(spark, monkeypatch):
    monkeypatch.setattr(logdet, "REACHES", (0.5,))
    w = nearest(300)
    det = logdet.determinant(table(spark, w), spark.range(300).select(F.col("id").alias("market")), exact_units=0, numbers=300 * 320)
    assert not det.even and not det.widen()
    for rho in (0.5, 0.2, -0.5):
        log, trace = dense(w, rho)
        assert det.log(rho) == pytest.approx(log, rel=0.05) and det.trace(rho) == pytest.approx(trace, rel=0.02)


@pytest.mark.parametrize("rho", [0.5, 0.9, 0.98])
def test_models_of_strong_dependence(spark, rho):
    n = 400
    edges, units, w = ring(spark, n)
    rng = np.random.default_rng(8)
    x = rng.normal(size=n)
    inv = np.linalg.inv(np.eye(n) - rho * w)
    y_lag, y_err = inv @ (1 + 2 * x + rng.normal(size=n)), 1 + 2 * x + inv @ rng.normal(size=n)
    data = spark.createDataFrame([(i, float(x[i]), float(y_lag[i]), float(y_err[i])) for i in range(n)], "market long, x double, yl double, ye double")
    m = np.column_stack([np.ones(n), x])

    def best(y, filtered):
        def value(r):
            a = np.eye(n) - r * w
            z = a @ m if filtered else m
            e = a @ y - z @ np.linalg.lstsq(z, a @ y, rcond=None)[0]
            return np.log(np.abs(1 - r * np.cos(2 * np.pi * np.arange(n) / n))).sum() - n / 2 * math.log(e @ e / n)

        grid = np.linspace(rho - 0.3, min(rho + 0.3, 0.9999), 61)
        for _ in range(5):
            i = int(np.argmax([value(r) for r in grid]))
            grid = np.linspace(grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)], 31)
        return grid[int(np.argmax([value(r) for r in grid]))]

    model = spatial_reg.lag_model(data, edges, "yl", ["x"], method="ml")
    got = model.first()
    assert got.spatial == pytest.approx(best(y_lag, False), rel=1e-3)
    impact = spatial_reg.impacts(model, edges, data, ["x"]).first()
    s = np.linalg.inv(np.eye(n) - got.spatial * w) * got.coef["x"]
    assert (impact.direct, impact.total) == pytest.approx((np.trace(s) / n, s.sum() / n), rel=1e-3)
    assert spatial_reg.error_model(data, edges, "ye", ["x"], method="ml").first().spatial == pytest.approx(best(y_err, True), rel=1e-3)
