"""Least squares in SQL, to hold the models against: sums of products, then a sweep for each regressor."""

from __future__ import annotations

from collections.abc import Sequence


def ols_sql(name: str, source: str, keys: Sequence[str], y: str, xs: Sequence[str], const: bool = True) -> str:
    """CTEs that end in ``name``: keys, n, ssr, df, b_<x>, v_<x>_<z> (of the covariance), se_<x>, and b_const.

    ``source`` has complete rows.  With a constant, sums are about the group's means.
    """
    columns = [*xs, y]
    m, k = len(columns), len(xs)
    head = "".join(f"{c}, " for c in keys)
    pair = (lambda a, b: f"covar_pop({a}, {b}) * count(*)") if const else (lambda a, b: f"sum({a} * {b})")
    cells = [f"{pair(columns[min(i, j)], columns[max(i, j)])} AS a{i}_{j}" for i in range(m) for j in range(m)]
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    means = "".join(f", avg({c}) AS m{i}" for i, c in enumerate(columns))
    out = [f"{name}_0 AS MATERIALIZED (SELECT {head}count(*) AS n, {', '.join(cells)}{means} FROM {source}{group})"]
    kept = ", ".join([*keys, "n", *[f"m{i}" for i in range(m)]])
    for p in range(k):
        swept = []
        for i in range(m):
            for j in range(m):
                cell = f"1 / a{p}_{p}" if i == j == p else f"a{p}_{j} / a{p}_{p}" if i == p else f"-a{i}_{p} / a{p}_{p}" if j == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p}"
                swept.append(f"{cell} AS a{i}_{j}")
        out.append(f"{name}_{p + 1} AS MATERIALIZED (SELECT {kept}, {', '.join(swept)} FROM {name}_{p})")
    df = k + (1 if const else 0)
    made = [f"a{k}_{k} AS ssr", f"n - {df} AS df", *[f"a{i}_{k} AS b_{x}" for i, x in enumerate(xs)]]
    made += [f"a{i}_{j} * a{k}_{k} / (n - {df}) AS v_{x}_{z}" for i, x in enumerate(xs) for j, z in enumerate(xs)]
    made += [f"sqrt(a{i}_{i} * a{k}_{k} / (n - {df})) AS se_{x}" for i, x in enumerate(xs)]
    if const:
        made.append(f"m{k} - ({' + '.join(f'a{i}_{k} * m{i}' for i in range(k))}) AS b_const")
    out.append(f"{name} AS MATERIALIZED (SELECT {head}n, {', '.join(made)} FROM {name}_{k})")
    return ", ".join(out)
