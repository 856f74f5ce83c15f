"""Weighted local lines from running sums of powers, for LOWESS.

A tricube weight is a polynomial of degree 9 in the distance to each side of a point, so that the sums behind a local line
are moments of the rows left and right of it.  A series is cut into stretches of as many rows as a neighbourhood has;
within a stretch moments about its middle are running sums, and a neighbourhood, which meets two stretches at most, is a
difference of such sums, moved to its own point.  No row is joined with its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Powers of the moments of weights, and of weights times values: 9 of the tricube, and 2 or 1 of the line.
POWERS, WITH_VALUE = 12, 11


def _moments(values: DataFrame, keys: list[str], rows: int | None) -> DataFrame:
    """(keys, _j, _s, _m): the running sums of powers up to and with row _j of its stretch _s.

    ``rows`` cuts a stretch into ranges of so many rows, each of which starts from the totals of those before it.
    """
    at = values.withColumn("_s", F.floor(F.col("_j") / F.col("_k")))
    at = at.withColumn("_p", F.lit(0) if rows is None else F.floor((F.col("_j") - F.col("_s") * F.col("_k")) / rows))
    u = (F.col("_j") - (F.col("_s") + 0.5) * F.col("_k")) / F.col("_k")
    terms = {f"_m{p}": F.col("_r") * F.pow(u, F.lit(p)) for p in range(POWERS)} | {f"_m{POWERS + p}": F.col("_r") * F.col("_y") * F.pow(u, F.lit(p)) for p in range(WITH_VALUE)}
    own = [*keys, "_s", "_p"]
    window = Window.partitionBy(*own).orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    termed = at.withColumns(terms)
    out = termed.withColumns({n: F.sum(n).over(window) for n in terms})
    if rows is not None:
        totals = termed.groupBy(*own).agg(*[F.sum(n).alias(n) for n in terms])
        earlier = Window.partitionBy(*keys, "_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        before = totals.select(*own, *[F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(f"{n}b") for n in terms])
        out = out.join(before, own).withColumns({n: F.col(n) + F.col(f"{n}b") for n in terms})
    return out.select(*keys, "_j", "_s", F.array(*terms).alias("_m"))


def _about(moments: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moments about points ``shift`` from the middle of a stretch."""
    powers = [np.ones_like(shift)]
    for _ in range(POWERS):
        powers.append(powers[-1] * -shift)
    moved = lambda m, top: np.stack([sum(comb(p, q) * powers[p - q] * m[:, q] for q in range(p + 1)) for p in range(top)], 1)
    return moved(moments[:, :POWERS], POWERS), moved(moments[:, POWERS:], WITH_VALUE)


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        i, k, a, n = (rows[c].to_numpy(dtype=float) for c in ("_j", "_k", "_a", "_n"))
        upto, before, last, first_all, own_all = (np.stack([np.zeros(POWERS + WITH_VALUE) if m is None else np.asarray(m, float) for m in rows[c]]) if len(rows) else np.zeros((0, POWERS + WITH_VALUE)) for c in ("_m", "_lo", "_hi", "_ta", "_ti"))
        end = a + k - 1
        far = np.maximum(np.maximum(i - a, end - i), 1.0)
        stretch = lambda x: np.floor(x / k)
        one_left, one_right = (stretch(a) == stretch(i))[:, None], (stretch(end) == stretch(i))[:, None]
        parts = [
            (-1, i, upto - np.where(one_left, before, 0.0)),
            (-1, a, np.where(one_left, 0.0, first_all - before)),
            (1, i, np.where(one_right, last, own_all) - upto),
            (1, end, np.where(one_right, 0.0, last)),
        ]
        w, y = np.zeros((3, len(rows))), np.zeros((2, len(rows)))
        wide = k / far
        for side, place, moments in parts:
            plain, valued = _about(moments, (i - (stretch(place) + 0.5) * k) / k)
            for power, factor in ((0, 1.0), (3, -3.0 * side), (6, 3.0), (9, -1.0 * side)):
                for t in range(3):
                    w[t] += factor * wide**power * plain[:, power + t]
                for t in range(2):
                    y[t] += factor * wide**power * valued[:, power + t]
        det = w[0] * w[2] - w[1] ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            fit = np.where(det > 1e-10 * w[0] ** 2, (w[2] * y[0] - w[1] * y[1]) / det, np.where(w[0] > 1e-10, y[0] / w[0], np.nan))
        yield rows.drop(columns=["_k", "_a", "_n", "_m", "_lo", "_hi", "_ta", "_ti"]).assign(_fit=pd.Series(fit, rows.index).astype(object).where(np.isfinite(fit), None).astype("Float64"))


def local_lines(values: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """(keys, _j, _fit): at each row the line through its neighbours, by tricube weights times ``_r``.

    ``values`` has the keys, ``_j`` (place in the series, from 0), ``_n`` (its length), ``_k`` (neighbours), ``_a`` (the first
    neighbour's place), ``_y`` and ``_r``.  Where the weights leave one place only the fit is a mean, and null where they leave
    none.
    """
    keys = list(keys)
    sums = _moments(values, keys, rows)
    whole = sums.groupBy(*keys, "_s").agg(F.max_by("_m", "_j").alias("_t"))
    named = lambda df, place, name: df.select(*keys, F.col("_j" if "_j" in df.columns else "_s").alias(place), F.col(df.columns[-1]).alias(name))
    points = values.select(*keys, "_j", "_k", "_a", "_n")
    points = points.withColumns({"_e": F.col("_a") + F.col("_k") - 1, "_sa": F.floor(F.col("_a") / F.col("_k")), "_si": F.floor(F.col("_j") / F.col("_k"))})
    # what comes before the first neighbour counts only in the same stretch
    points = points.withColumn("_l", F.when(F.col("_a") % F.col("_k") == 0, F.lit(-1)).otherwise(F.col("_a") - 1))
    found = points.join(sums.select(*keys, "_j", "_m"), [*keys, "_j"])
    found = found.join(named(sums, "_l", "_lo"), [*keys, "_l"], "left").join(named(sums, "_e", "_hi"), [*keys, "_e"])
    found = found.join(named(whole, "_sa", "_ta"), [*keys, "_sa"]).join(named(whole, "_si", "_ti"), [*keys, "_si"])
    found = found.select(*keys, "_j", "_k", "_a", "_n", "_m", "_lo", "_hi", "_ta", "_ti")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*keys, "_j").schema), "_fit double"])
    return found.mapInPandas(_lines, schema)
