"""Panel regressions and their tests (L).  A panel has an entity and a time column; one row per estimate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import dist
from bazaarlens.operators import ranges
from bazaarlens.operators.joins import pair_sums
from bazaarlens.operators.ols import CONST, grouped_ols, with_residuals
from bazaarlens.plans.lineage import saved


#: Periods of one range of the kernel covariance.
PERIODS = 4096


def prepare(data: DataFrame, y: str, xs: Sequence[str], entity: str = "market", time: str = "date", drop_na: bool = True, standardize: bool = False) -> DataFrame:
    """(entity, time, y, xs): complete cases, z-scored by the sample deviation if asked (L1)."""
    rows = data.select(F.col(entity).alias("entity"), F.to_date(time).alias("time"), *[F.col(c).cast("double").alias(c) for c in (y, *xs)])
    rows = rows.dropna() if drop_na else rows
    if standardize:
        stats = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in (y, *xs) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
        rows = rows.crossJoin(F.broadcast(stats)).select("entity", "time", *[((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))).alias(c) for c in (y, *xs)])  # one row
    return rows


def _demeaned(panel: DataFrame, columns: Sequence[str], entity: bool, time: bool, tolerance: float = 1e-11, most: int = 200) -> DataFrame:
    """Columns less their entity means, their time means, or what both leave together."""
    if entity and time:
        return _two_ways(panel, columns, tolerance, most)
    for by in ["entity"] * entity + ["time"] * time:
        means = panel.groupBy(by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
        panel = ranges.matched(panel, means, [by]).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
    return panel


def _two_ways(panel: DataFrame, columns: Sequence[str], tolerance: float, most: int) -> DataFrame:
    """Columns less entity and time effects, by conjugate gradients on the graph of entities and periods.

    With entity effects swept out, the time effects solve D - N' E^-1 N (periods' and entities' numbers of rows on the
    diagonals, N rows of each entity and period).  The state is one row a period; a step sends a period's numbers to its
    entities and their means back.  A balanced panel needs one step, an unbalanced one some tens; an error is raised where
    ``most`` steps leave more than ``tolerance`` of what there was.
    """
    k = range(len(columns))
    graph = saved(panel.groupBy("entity", "time").agg(F.count("*").cast("double").alias("n")))
    within = saved(_demeaned(panel, columns, True, False))

    def product(state: DataFrame) -> DataFrame:
        sent = graph.join(state.select("time", *[f"p{i}" for i in k]), "time")
        mean = sent.groupBy("entity").agg(*[(F.sum(F.col("n") * F.col(f"p{i}")) / F.sum("n")).alias(f"m{i}") for i in k])
        return sent.join(mean, "entity").groupBy("time").agg(*[F.sum(F.col("n") * (F.col(f"p{i}") - F.col(f"m{i}"))).alias(f"q{i}") for i in k])

    sums = within.groupBy("time").agg(F.count("*").cast("double").alias("d"), *[F.sum(c).alias(f"r{i}") for i, c in enumerate(columns)])
    state = saved(sums.withColumns({f"b{i}": F.lit(0.0) for i in k} | {f"p{i}": F.col(f"r{i}") / F.col("d") for i in k}))
    size = lambda table: [v or 0.0 for v in table.agg(*[F.sum(F.col(f"r{i}") ** 2 / F.col("d")) for i in k]).first()]
    first = now = size(state)
    open_ = lambda z: any(z[i] > tolerance**2 * first[i] for i in k)
    steps = 0
    while open_(now):
        if steps == most:
            raise ArithmeticError(f"entity and time means are still there after {most} steps")
        both = saved(state.join(product(state), "time"))
        flat = [v or 0.0 for v in both.agg(*[F.sum(F.col(f"p{i}") * F.col(f"q{i}")) for i in k]).first()]
        alpha = [now[i] / flat[i] if flat[i] > 0 and now[i] > tolerance**2 * first[i] else 0.0 for i in k]
        moved = both.withColumns({f"b{i}": F.col(f"b{i}") + alpha[i] * F.col(f"p{i}") for i in k} | {f"r{i}": F.col(f"r{i}") - alpha[i] * F.col(f"q{i}") for i in k})
        then = size(moved)
        beta = [then[i] / now[i] if now[i] > 0 else 0.0 for i in k]
        state = moved.withColumns({f"p{i}": F.col(f"r{i}") / F.col("d") + beta[i] * F.col(f"p{i}") for i in k}).drop(*[f"q{i}" for i in k])
        now, steps = then, steps + 1
    effects_ = state.select("time", *[f"b{i}" for i in k])
    sent = graph.join(effects_, "time")
    mean = sent.groupBy("entity").agg(*[(F.sum(F.col("n") * F.col(f"b{i}")) / F.sum("n")).alias(f"m{i}") for i in k])
    out = within.join(effects_, "time").join(mean, "entity")
    return out.withColumns({c: F.col(c) - F.col(f"b{i}") + F.col(f"m{i}") for i, c in enumerate(columns)}).select(*panel.columns)


def counts(panel: DataFrame) -> tuple[int, int, int]:
    """Rows, entities, periods."""
    r = panel.agg(F.count("*"), F.count_distinct("entity"), F.count_distinct("time")).first()
    return r[0], r[1], r[2]


def _covariance(panel: DataFrame, fit_row, names: Sequence[str], columns, residual: str, kind: str, lost: int) -> np.ndarray:
    """Covariance of the coefficients: unadjusted, robust (White), clustered by entity, or kernel, from k x k sums.

    ``kernel`` is Driscoll and Kraay's: scores summed by period, and products of periods up to floor(4 (T / 100)^(2/9)) apart
    with Bartlett weights.
    """
    k = len(names)
    cov = np.array(fit_row["cov"], float).reshape(k, k)
    n, df = fit_row["n_obs"], fit_row["n_obs"] - k - lost
    bread = cov / fit_row["sigma2"]
    if kind == "unadjusted":
        return bread * fit_row["ssr"] / df
    score = [F.col(residual) * c for c in columns]
    if kind == "clustered":
        sums = panel.groupBy("entity").agg(*[F.sum(s).alias(f"_s{i}") for i, s in enumerate(score)])
        score = [F.col(f"_s{i}") for i in range(k)]
    elif kind == "kernel":
        by_time = saved(panel.groupBy("time").agg(*[F.sum(s).alias(f"_s{i}") for i, s in enumerate(score)]))
        width = int(4 * (by_time.count() / 100) ** (2 / 9))
        part = ranges.cut(by_time, [], ["time"], PERIODS, width)
        sums = part.own(part.data.withColumns({f"_l{i}_{j}": F.coalesce(F.lag(f"_s{i}", j).over(part.window()), F.lit(0.0)) for i in range(k) for j in range(1, width + 1)}))
        product = lambda i, j: reduce(lambda a, b: a + b, [(1 - d / (width + 1)) * (F.col(f"_s{i}") * F.col(f"_l{j}_{d}") + F.col(f"_l{i}_{d}") * F.col(f"_s{j}")) for d in range(1, width + 1)], F.col(f"_s{i}") * F.col(f"_s{j}"))
        meat = sums.agg(*[F.sum(product(i, j)).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    elif kind == "robust":
        sums = panel
    else:
        raise ValueError(f"unknown covariance {kind}")
    if kind != "kernel":
        meat = sums.agg(*[F.sum(score[i] * score[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = meat[f"m{i}_{j}"]
    return bread @ m @ bread * n / df


SCHEMA = "method string, cov_type string, coef map<string,double>, se map<string,double>, t map<string,double>, p map<string,double>, cov array<double>, ssr double, r2 double, n_obs long, n_entities long, n_periods long, df long, status string"


def _estimate(rows: DataFrame, y: str, xs: Sequence[str], method: str, cov_type: str, const: bool, lost: int, panel: DataFrame, const_name: str | None = None) -> DataFrame:
    spark = rows.sparkSession
    names = [*([CONST] if const else []), *xs]
    fits = grouped_ols(rows, [], y, {x: F.col(x) for x in xs} if const_name is None else {const_name: F.col(const_name)} | {x: F.col(x) for x in xs}, const=const)
    names = names if const_name is None else [const_name, *xs]
    r = fits.first()
    n, entities, periods = counts(panel)
    if r is None or r["status"] != "ok" or r["n_obs"] - len(names) - lost <= 0:
        status = "insufficient_data" if r is None or r["status"] == "ok" else r["status"]
        return spark.createDataFrame([(method, cov_type, None, None, None, None, None, None, None, n, entities, periods, None, status)], SCHEMA)
    fitted = reduce(lambda a, b: a + b, [F.col(x) * float(r["coef"][x]) for x in names if x != CONST], F.lit(float(r["coef"].get(CONST, 0.0))))
    with_e = rows.withColumn("_e", F.col(y) - fitted)
    columns = [F.lit(1.0) if x == CONST else F.col(x) for x in names]
    cov = _covariance(with_e, r, names, columns, "_e", cov_type, lost)
    b = np.array([r["coef"][x] for x in names])
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    df = r["n_obs"] - len(names) - lost
    with np.errstate(divide="ignore", invalid="ignore"):
        t = b / se
    p = dist.t_sf2(np.nan_to_num(t), df)
    named = lambda v: {("const" if x == const_name else x): float(q) for x, q in zip(names, v, strict=True)}
    row = (method, cov_type, named(b), named(se), named(t), named(p), cov.ravel().tolist(), r["ssr"], 1 - r["ssr"] / r["sst"] if r["sst"] else None, n, entities, periods, int(df), "ok")
    return spark.createDataFrame([row], SCHEMA)


def pooled(panel: DataFrame, y: str, xs: Sequence[str], cov_type: str = "robust") -> DataFrame:
    """Pooled least squares (L2)."""
    return _estimate(panel, y, xs, "pooled", cov_type, True, 0, panel)


def fixed(panel: DataFrame, y: str, xs: Sequence[str], entity_effects: bool = True, time_effects: bool = False, cov_type: str = "robust") -> DataFrame:
    """Within estimator, one or two ways (L3); effects cost degrees of freedom."""
    rows = saved(_demeaned(panel, [y, *xs], entity_effects, time_effects))
    _, n, t = counts(panel)
    lost = (n if entity_effects else 0) + (t if time_effects else 0) - (1 if entity_effects and time_effects else 0)
    return _estimate(rows, y, xs, "fixed", cov_type, False, lost, panel)


def random_effects(panel: DataFrame, y: str, xs: Sequence[str], cov_type: str = "robust") -> DataFrame:
    """GLS with entity effects (L4): quasi-demeaning by the Swamy-Arora (1972) variances."""
    n_rows, n, _ = counts(panel)
    within = grouped_ols(_demeaned(panel, [y, *xs], True, False), [], y, list(xs), const=False).first()
    means = panel.groupBy("entity").agg(F.count("*").alias("_t"), *[F.avg(c).alias(c) for c in (y, *xs)])
    between = grouped_ols(means, [], y, list(xs)).first()
    if within is None or between is None or within["status"] != "ok" or between["status"] != "ok":
        return _estimate(panel.where("false"), y, xs, "random", cov_type, True, 0, panel)
    s_e = within["ssr"] / (n_rows - n - len(xs))
    harmonic = n / means.agg(F.sum(1 / F.col("_t"))).first()[0]
    s_u = max(0.0, between["ssr"] / (n - len(xs) - 1) - s_e / harmonic)
    w = Window.partitionBy("entity")
    theta = 1 - F.sqrt(F.lit(s_e) / (F.lit(s_e) + F.count("*").over(w) * F.lit(s_u)))
    rows = panel.withColumn("_th", theta).withColumns({c: F.col(c) - F.col("_th") * F.avg(c).over(w) for c in (y, *xs)}).withColumn("_one", 1 - F.col("_th"))
    return _estimate(saved(rows), y, xs, "random", cov_type, False, 0, panel, "_one")


def between_effects(panel: DataFrame, y: str, xs: Sequence[str], cov_type: str = "robust") -> DataFrame:
    """Least squares on entity means."""
    return _estimate(panel.groupBy("entity").agg(*[F.avg(c).alias(c) for c in (y, *xs)]), y, xs, "between", cov_type, True, 0, panel)


def first_difference(panel: DataFrame, y: str, xs: Sequence[str], cov_type: str = "robust") -> DataFrame:
    """Least squares on changes, without a constant."""
    w = Window.partitionBy("entity").orderBy("time")
    rows = panel.select("entity", "time", *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in (y, *xs)]).dropna()
    return _estimate(rows, y, xs, "first_difference", cov_type, False, 0, panel)


def hausman(panel: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """(statistic, df, p, prefer): fixed against random effects, slopes only."""
    a, b = fixed(panel, y, xs, cov_type="unadjusted").first(), random_effects(panel, y, xs, "unadjusted").first()
    k = len(xs)
    if a["status"] != "ok" or b["status"] != "ok":
        return panel.sparkSession.createDataFrame([(None, k, None, None)], "statistic double, df int, p double, prefer string")
    d = np.array([a["coef"][x] - b["coef"][x] for x in xs])
    v = np.array(a["cov"]).reshape(k, k) - np.array(b["cov"]).reshape(k + 1, k + 1)[1:, 1:]
    s = float(d @ np.linalg.pinv(v) @ d)
    p = float(dist.chi2_sf(max(s, 0.0), k))
    return panel.sparkSession.createDataFrame([(s, k, p, "fixed" if p < 0.05 else "random")], "statistic double, df int, p double, prefer string")


def f_fixed_effects(panel: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """(f, df1, df2, p): pooled against entity effects."""
    a, b = pooled(panel, y, xs, "unadjusted"), fixed(panel, y, xs, cov_type="unadjusted")
    both = a.select(F.col("ssr").alias("s0")).crossJoin(b.select("ssr", "df", "n_entities"))  # a row each
    df1 = (F.col("n_entities") - 1).cast("int")
    out = both.withColumn("f", (F.col("s0") - F.col("ssr")) / df1 / (F.col("ssr") / F.col("df")))
    return out.select("f", df1.alias("df1"), F.col("df").cast("int").alias("df2"), dist.f_p("f", df1, "df").alias("p"))


def _pooled_residuals(panel: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    return with_residuals(panel, grouped_ols(panel, [], y, list(xs)), [], y, list(xs), "_e")


def breusch_pagan_lm(panel: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """(lm, p): random effects against none (Breusch and Pagan 1980), for unequal lengths as well."""
    sums = _pooled_residuals(panel, y, xs).groupBy("entity").agg(F.sum("_e").alias("s"), F.sum(F.pow("_e", F.lit(2))).alias("q"), F.count("*").cast("double").alias("t"))
    one = sums.agg(F.sum(F.pow("s", F.lit(2))).alias("ss"), F.sum("q").alias("q"), F.sum("t").alias("n"), F.sum(F.pow("t", F.lit(2))).alias("tt"))
    a = F.col("ss") / F.col("q") - 1
    out = one.select((F.col("n") ** 2 / (2 * (F.col("tt") - F.col("n"))) * a * a).alias("lm"))
    return out.select("lm", dist.chi2_p("lm", F.lit(1.0)).alias("p"))


def cross_section_dependence(panel: DataFrame, y: str, xs: Sequence[str], kind: str = "cd") -> DataFrame:
    """(statistic, p, n_pairs): Pesaran's CD or the Breusch-Pagan LM over residual correlations of entities."""
    sums = pair_sums(_pooled_residuals(panel, y, xs), "_e", "entity", "time")
    corr = F.col("s_lr") / F.sqrt(F.nullif(F.col("s_ll") * F.col("s_rr"), F.lit(0.0)))
    rho = sums.select(corr.alias("r"), F.col("n").cast("double").alias("t")).where("r is not null and t >= 3")
    if kind == "cd":
        out = rho.agg(F.sum(F.sqrt("t") * F.col("r")).alias("s"), F.count("*").alias("n_pairs")).withColumn("statistic", F.col("s") / F.sqrt("n_pairs"))
        return out.select("statistic", dist.normal_p("statistic").alias("p"), "n_pairs")
    if kind != "lm":
        raise ValueError(f"unknown statistic {kind}")
    out = rho.agg(F.sum(F.col("t") * F.pow("r", F.lit(2))).alias("statistic"), F.count("*").alias("n_pairs"))
    return out.select("statistic", dist.chi2_p("statistic", F.col("n_pairs").cast("double")).alias("p"), "n_pairs")


def effects(panel: DataFrame, estimate: DataFrame, y: str, xs: Sequence[str], by: str = "entity") -> DataFrame:
    """(entity or time, effect): means of y less means of x times the slopes."""
    slopes = estimate.select(*[F.element_at("coef", x).alias(f"_b_{x}") for x in xs])  # one row
    means = panel.groupBy(by).agg(*[F.avg(c).alias(c) for c in (y, *xs)]).crossJoin(F.broadcast(slopes))
    fitted = reduce(lambda a, b: a + b, [F.col(x) * F.col(f"_b_{x}") for x in xs])
    return means.select(by, (F.col(y) - fitted).alias("effect"))

