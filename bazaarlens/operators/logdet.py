"""ln |I - rho W| and the trace of (I - rho W)^-1 for the likelihoods and impacts of spatial models.

Weights of up to EXACT_UNITS units are one bounded matrix, whose eigenvalues a task finds; both numbers are then exact for any
rho.  Larger weights stay an edge table, and random signs z give moments of W by joins: z' T_k(W) z in Chebyshev's polynomials
where W is similar to a symmetric matrix (with q = (1 - sqrt(1 - rho^2)) / rho,
ln(1 - rho x) = -ln(1 + q^2) - 2 sum q^k / k T_k(x)), and z' W^k z otherwise.  The number of terms follows from a bound of what
is left at the largest rho asked for; it grows as rho nears the edge, and the recursion goes on from where it stood.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.plans.lineage import saved

#: Units whose weights are one matrix in a task (32 MB of numbers).
EXACT_UNITS = 2048
#: Numbers that a step of the moments holds at least (units times signs), the least number of signs, and signs of one row.
NUMBERS, LEAST_SIGNS, ROW_SIGNS = 4_000_000, 64, 32
#: What the terms left out may come to, for each unit; and the shares of the interval of rho that are tried in turn.
TOLERANCE, REACHES = 1e-5, (0.9, 0.98, 0.995, 0.999, 0.9999)


class Exact:
    """From all eigenvalues; units without weights are zeros."""

    def __init__(self, values: np.ndarray, n: int):
        self.values, self.n = values, n
        real = values[np.abs(values.imag) < 1e-9].real
        self.lo = 1 / real.min() if len(real) and real.min() < -1e-12 else -1e6
        self.hi = 1 / real.max() if len(real) and real.max() > 1e-12 else 1e6
        self.reach = math.inf

    def log(self, rho: float) -> float:
        return float(np.log(np.maximum(np.abs(1 - rho * self.values), 1e-300)).sum())

    def trace(self, rho: float) -> float:
        return float((1 / (1 - rho * self.values)).real.sum()) + self.n - len(self.values)

    def widen(self, rho: float | None = None) -> bool:
        return False


class Moments:
    """From moments by random signs; good for |rho| up to ``reach``."""

    def __init__(self, edges: DataFrame, units: DataFrame, n: int, seed: int = 0, numbers: int = NUMBERS):
        self.n = n
        self.bound = edges.groupBy("src").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s")).first()[0] or 1.0
        self.lo, self.hi = -1 / self.bound, 1 / self.bound
        scaled = edges.select("src", "dst", (F.col("w") / self.bound).alias("w"))
        self.even, self.edges = self._even(scaled)
        # the first two are exact
        back = self.edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v"))
        one = self.edges.where("src = dst").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        two = self.edges.join(back, ["src", "dst"]).agg(F.coalesce(F.sum(F.col("w") * F.col("v")), F.lit(0.0))).first()[0]
        self.known = [float(n), one, 2 * two - n if self.even else two]
        self.signs = ROW_SIGNS * max(1, math.ceil(max(LEAST_SIGNS, numbers / n) / ROW_SIGNS))
        batches = self.signs // ROW_SIGNS
        sign = lambda p: F.when(F.xxhash64(F.lit(seed), F.lit(p), "batch", "id") % 2 == 0, 1.0).otherwise(-1.0)
        rows = units.select("id", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
        self.base = saved(rows.select("id", "batch", *[sign(p).alias(f"z{p}") for p in range(ROW_SIGNS)]))
        self.state = self.base.select("id", "batch", *[F.col(f"z{p}") for p in range(ROW_SIGNS)], *[F.lit(0.0).alias(f"b{p}") for p in range(ROW_SIGNS)])
        self.step, self.found = 0, [float(n)]
        self.reach = 0.0
        self.widen()

    @staticmethod
    def _even(edges: DataFrame) -> tuple[bool, DataFrame]:
        """Whether scales d make sqrt(d_i / d_j) w_ij symmetric, with none or with the numbers of neighbours; and those weights."""
        degree = edges.groupBy("src").agg(F.count("*").cast("double").alias("d"))
        both = edges.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst", "left").withColumn("e", F.coalesce("e", F.lit(1.0)))
        both = saved(both)
        for own, other in ((F.lit(1.0), F.lit(1.0)), (F.col("d"), F.col("e"))):
            even = both.select("src", "dst", (F.col("w") * F.sqrt(own / other)).alias("w"))
            turned = even.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v"))
            apart = even.join(turned, ["src", "dst"], "left").where(F.col("v").isNull() | (F.abs(F.col("w") - F.col("v")) > 1e-12))
            if apart.isEmpty():
                return True, saved(even)
        return False, edges

    def _terms(self, reach: float) -> int:
        q = (1 - math.sqrt(1 - reach * reach)) / reach if self.even else reach
        return math.ceil(math.log(TOLERANCE * (1 - q) / 2) / math.log(q))

    def _advance(self) -> None:
        """One more product with W, and the moments that it gives."""
        z, b = [f"z{p}" for p in range(ROW_SIGNS)], [f"b{p}" for p in range(ROW_SIGNS)]
        later = self.even and self.step > 0
        factor = "2 * w" if later else "w"
        # what neighbours send; and of a unit's own, less the numbers before, and the numbers now, which become those before
        sent = self.edges.join(self.state.withColumnRenamed("id", "dst"), "dst").selectExpr("src AS id", "batch", *[f"{factor} * {c} AS {c}" for c in z], *[f"0D AS {c}" for c in b])
        held = self.state.selectExpr("id", "batch", *[f"{f'-{o}' if later else '0D'} AS {c}" for c, o in zip(z, b, strict=True)], *[f"{o} AS {c}" for c, o in zip(b, z, strict=True)])
        names = [*z, *b]
        summed = sent.unionAll(held).groupBy("id", "batch").agg(dict.fromkeys(names, "sum"))
        self.state = saved(summed.selectExpr("id", "batch", *[f"`sum({c})` AS {c}" for c in names]))
        self.step += 1
        dot = lambda left, right: "sum(" + " + ".join(f"{x} * {y}" for x, y in zip(left, right, strict=True)) + ")"
        if self.even:
            # T_2k = 2 T_k^2 - 1 and T_2k-1 = 2 T_k T_k-1 - x
            odd, even = self.state.selectExpr(dot(b, z), dot(z, z)).first()
            m1 = self.found[1] if self.step > 1 else odd / self.signs
            self.found += [m1 if self.step == 1 else 2 * odd / self.signs - m1, 2 * even / self.signs - self.n]
        else:
            start = self.base.selectExpr("id", "batch", *[f"{c} AS u{c}" for c in z])
            self.found.append(self.state.join(start, ["id", "batch"]).selectExpr(dot(z, [f"u{c}" for c in z])).first()[0] / self.signs)

    def widen(self, rho: float | None = None) -> bool:
        """Goes on to the next reach, or to the first that holds ``rho``; False at the edge of the interval."""
        share = next((r for r in REACHES if r / self.bound > self.reach and (rho is None or r / self.bound >= abs(rho))), None)
        if share is None:
            return False
        while len(self.found) <= self._terms(share):
            self._advance()
        self.reach = share / self.bound
        return True

    def _series(self) -> np.ndarray:
        return np.array([*self.known, *self.found[3:]])

    def log(self, rho: float) -> float:
        r, m = rho * self.bound, self._series()
        k = np.arange(1, len(m))
        if not self.even:
            return float(-(r**k * m[1:] / k).sum())
        q = (1 - math.sqrt(1 - r * r)) / r if r else 0.0
        return float(-self.n * math.log1p(q * q) - 2 * (q**k * m[1:] / k).sum())

    def trace(self, rho: float) -> float:
        r, m = rho * self.bound, self._series()
        k = np.arange(1, len(m))
        if not self.even:
            return float(self.n + (r**k * m[1:]).sum())
        root = math.sqrt(1 - r * r)
        q = (1 - root) / r if r else 0.0
        return float((self.n + 2 * (q**k * m[1:]).sum()) / root)


def _eigenvalues(frame: pd.DataFrame) -> pd.DataFrame:
    ids, at = np.unique(np.concatenate([frame["src"].to_numpy(), frame["dst"].to_numpy()]), return_inverse=True)
    w = np.zeros((len(ids), len(ids)))
    np.add.at(w, (at[: len(frame)], at[len(frame) :]), frame["w"].to_numpy(float))
    values = np.linalg.eigvals(w)
    return pd.DataFrame({"re": values.real.astype(float), "im": values.imag.astype(float)})


def determinant(edges: DataFrame, units: DataFrame, key: str = "market", exact_units: int = EXACT_UNITS, numbers: int = NUMBERS) -> Exact | Moments:
    """``edges`` (src, dst, w); ``units`` has all units in ``key``, those without weights too.  Edges of other units don't count."""
    ids = saved(units.select(F.col(key).alias("id")).distinct())
    n = ids.count()
    inside = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    inside = saved(inside.groupBy("src", "dst").agg(F.sum("w").cast("double").alias("w")))
    if n <= exact_units:
        # at most exact_units^2 edges
        found = inside.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "w", F.lit(0).alias("one")).groupBy("one").applyInPandas(_eigenvalues, "re double, im double").collect()
        return Exact(np.array([complex(r[0], r[1]) for r in found]) if found else np.zeros(0, complex), n)
    return Moments(inside, ids, n, numbers=numbers)
