"""Least squares for all groups at once: one aggregation of cross-products, then a small batch of solves."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import dist

CONST = "const"
FIT = "n_obs long, k int, coef map<string,double>, se map<string,double>, t map<string,double>, p map<string,double>, cov array<double>, ssr double, sst double, r2 double, adj_r2 double, aic double, bic double, log_lik double, sigma2 double, df long, status string"


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every given number is there and finite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != math.inf)
    return df.where(ok)


def gram(columns: Sequence[Column]) -> Column:
    """The upper triangle of the cross-products of some columns, row by row, as an array of sums."""
    return F.array(*[F.sum(a * b) for i, a in enumerate(columns) for b in columns[i:]])


def unpack(flat: np.ndarray, m: int) -> np.ndarray:
    """(rows, m, m) symmetric matrices from upper triangles."""
    out = np.zeros((len(flat), m, m))
    i, j = np.triu_indices(m)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def inverse(xx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of a stack of Gram matrices, scaled first; and which of them are regular."""
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", xx), 0))
    scale[scale == 0] = 1
    unit = xx / scale[:, :, None] / scale[:, None, :]
    good = np.isfinite(unit).all((1, 2))
    unit[~good] = np.eye(xx.shape[1])
    rank = np.linalg.svd(unit, compute_uv=False)
    good &= rank[:, -1] > 1e-13 * rank[:, 0]
    unit[~good] = np.eye(xx.shape[1])
    return np.linalg.inv(unit) / scale[:, :, None] / scale[:, None, :], good


def solved(g: np.ndarray, n: np.ndarray, names: list[str], const: bool) -> pd.DataFrame:
    """Fits from Gram matrices whose last row is y."""
    k = len(names)
    xx, xy, yy = g[:, :k, :k], g[:, :k, k], g[:, k, k]
    inv, good = inverse(xx.copy())
    good &= n > k
    b = np.einsum("nij,nj->ni", inv, xy)
    # one step of refinement, as cross-products lose digits
    b = b + np.einsum("nij,nj->ni", inv, xy - np.einsum("nij,nj->ni", xx, b))
    ssr = np.maximum(yy - 2 * np.einsum("ni,ni->n", b, xy) + np.einsum("ni,nij,nj->n", b, xx, b), 0)
    at = names.index(CONST) if const else -1
    sst = yy - xy[:, at] ** 2 / np.maximum(n, 1) if const else yy
    with np.errstate(divide="ignore", invalid="ignore"):
        df = n - k
        sigma2 = ssr / df
        cov = inv * sigma2[:, None, None]
        se = np.sqrt(np.einsum("nii->ni", cov))
        t = b / se
        p = dist.t_sf2(np.nan_to_num(t), np.maximum(df, 1)[:, None])
        ll = -n / 2 * (np.log(2 * np.pi) + np.log(ssr / n) + 1)
        r2 = 1 - ssr / sst
        adj = 1 - (1 - r2) * (n - (1 if const else 0)) / df
    number = lambda x: [float(v) if g and np.isfinite(v) else None for v, g in zip(x, good, strict=True)]
    maps = lambda m: [dict(zip(names, (float(v) if np.isfinite(v) else None for v in row), strict=True)) if g else None for row, g in zip(m, good, strict=True)]
    status = np.where(good, "ok", np.where(n > k, "singular", "insufficient_data"))
    return pd.DataFrame({
        "n_obs": n.astype(np.int64), "k": k, "coef": maps(b), "se": maps(se), "t": maps(t), "p": maps(p),
        "cov": [c.ravel().tolist() if g else None for c, g in zip(cov, good, strict=True)], "ssr": number(ssr), "sst": number(sst), "r2": number(r2), "adj_r2": number(adj),
        "aic": number(-2 * ll + 2 * k), "bic": number(-2 * ll + k * np.log(np.maximum(n, 1))), "log_lik": number(ll), "sigma2": number(sigma2), "df": (n - k).astype(np.int64), "status": status,
    })


def grouped_ols(df: DataFrame, keys: Sequence[str], y: str | Column, xs: dict[str, Column] | Sequence[str], const: bool = True) -> DataFrame:
    """One row of ``FIT`` per group: the regression of y on xs (and a constant) within each group.

    Rows that lack a number are left out.  A group that is too small or collinear has a status instead of numbers.
    """
    xs = xs if isinstance(xs, dict) else {x: F.col(x) for x in xs}
    names = [*([CONST] if const else []), *xs]
    columns = {f"x{i}": c.cast("double") for i, c in enumerate(xs.values())} | {"y": (F.col(y) if isinstance(y, str) else y).cast("double")}
    rows = complete(df.select(*keys, *[c.alias(n) for n, c in columns.items()]), list(columns))
    ones = [F.lit(1.0)] if const else []
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n_obs"), gram([*ones, *[F.col(n) for n in columns]]).alias("gram"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                g = unpack(np.array([np.array([np.nan if v is None else v for v in x], float) for x in frame["gram"]]), len(names) + 1)
                yield pd.concat([frame[list(keys)].reset_index(drop=True), solved(g, frame["n_obs"].to_numpy(float), names, const)], axis=1)

    return sums.mapInPandas(run, f"{head}, {FIT}" if keys else FIT)


def restriction_f(cov: Column, coef: Column, names: Sequence[str], a: str, b: str) -> Column:
    """F for equal coefficients a and b: (b_a - b_b)^2 / (V_aa + V_bb - 2 V_ab)."""
    k, i, j = len(names), list(names).index(a), list(names).index(b)
    at = lambda r, c: F.element_at(cov, r * k + c + 1)
    return F.pow(F.element_at(coef, a) - F.element_at(coef, b), 2) / (at(i, i) + at(j, j) - 2 * at(i, j))


def with_residuals(df: DataFrame, fits: DataFrame, keys: Sequence[str], y: str, xs: dict[str, Column] | Sequence[str], name: str = "residual") -> DataFrame:
    """``df`` with the residual of each row under its group's fit."""
    xs = xs if isinstance(xs, dict) else {x: F.col(x) for x in xs}
    found = fits.where("status = 'ok'").select(*keys, F.col("coef").alias("_coef"))
    fitted = F.coalesce(F.element_at("_coef", CONST), F.lit(0.0))
    joined = df.join(found, list(keys)) if keys else df.crossJoin(F.broadcast(found))  # without keys there is one fit
    for n, c in xs.items():
        fitted = fitted + c.cast("double") * F.element_at("_coef", n)
    return joined.withColumn(name, F.col(y).cast("double") - fitted).drop("_coef")
