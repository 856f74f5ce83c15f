"""Long series in ranges: windows that don't need a whole series in one task.

A window partitioned by the series is one task a series, however long it is.  With ``rows`` given, an operator numbers the
rows of all series by one distributed sort (``numbered``), deals each series into blocks of that many rows, and works in two
ways that give what the whole window gives:

- lags, leads and bounded frames see the rows around their block as a halo, copies that go again (``cut``);
- running sums, last known values and exponential averages work within the blocks, and what the blocks before hand on is
  combined from one row a block (``running``, ``known``, ``smoothed``).

Without ``rows`` the same functions are plain windows over the series.  Null keys are a series of their own either way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.plans.lineage import saved

INDEX, LENGTH, BLOCK, OWN = "_place", "_length", "_block", "_own"


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; the right side's other columns are added."""
    if not on:
        return left.crossJoin(F.broadcast(right))  # without keys there is one series, and one row for it
    renamed = right.withColumnsRenamed({k: f"_on_{i}" for i, k in enumerate(on)})
    condition = F.lit(True)
    for i, k in enumerate(on):
        condition = condition & left[k].eqNullSafe(renamed[f"_on_{i}"])
    return left.join(renamed, condition, how).drop(*[f"_on_{i}" for i in range(len(on))])


def numbered(data: DataFrame, keys: Sequence[str], order: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """``data`` with ``_place``, the place of each row in its series from 0, ``_length``, the length of the series, and ``_first_c``.

    Ranges of (keys, order) are partitions of one sort; each counts its rows of every series, and the counts before it are
    where it starts.  A series is as many tasks as it fills ranges.
    """
    sort = [*keys, *order]
    placed = saved(data.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id()))
    ends = [F.min_by(c, F.struct(*order)).alias(f"_first_{c}") for c in first]
    sizes = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_c"), *ends)
    series = Window.partitionBy(*keys)  # a row for each range of a series
    before = F.sum("_c").over(series.orderBy("_part")) - F.col("_c")
    heads = {f"_first_{c}": F.first(f"_first_{c}").over(series.orderBy("_part")) for c in first}
    sizes = sizes.withColumns({"_before": before, LENGTH: F.sum("_c").over(series), **heads}).drop("_c")
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    out = matched(placed.withColumn("_at", place), sizes, [*keys, "_part"])
    return out.withColumn(INDEX, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


@dataclass
class Cut:
    """Rows to be windowed: by ``keys`` and ``order``; ``own`` takes the copies and marks away again."""

    data: DataFrame
    keys: list[str]
    order: list[str]
    ranged: bool

    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def index(self) -> Column:
        """The row's place in its series, from 0."""
        return F.col(INDEX) if self.ranged else F.row_number().over(self.window()) - 1

    def own(self, data: DataFrame, keep_index: bool = False) -> DataFrame:
        if not self.ranged:
            return data
        out = data.where(OWN).drop(BLOCK, OWN)
        return out if keep_index else out.drop(INDEX, LENGTH)


def cut(data: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None, before: int = 0, after: int = 0) -> Cut:
    """Blocks of ``rows`` rows of each series with ``before`` and ``after`` rows around them; whole series if ``rows`` is None.

    Data that is numbered already stays so.
    """
    if rows is None:
        return Cut(data, list(keys), list(order), False)
    if rows < 1 or before < 0 or after < 0:
        raise ValueError("a block has a row at least, and halos aren't negative")
    placed = data if INDEX in data.columns else numbered(data, keys, order)
    at = F.col(INDEX)
    # the blocks in whose halo or body a row is: those that begin up to ``after`` later or end up to ``before`` earlier
    low = F.greatest(F.floor((at - after) / rows), F.lit(0))
    high = F.floor((at + before) / rows)
    last = F.floor((F.col(LENGTH) - 1) / rows)
    blocks = F.explode(F.sequence(low, F.least(high, last))) if before or after else F.floor(at / rows)
    out = placed.withColumn(BLOCK, blocks).withColumn(OWN, F.col(BLOCK) == F.floor(at / rows))
    return Cut(out, [*keys, BLOCK], [INDEX], True)


def _carried(parts: Cut, keys: Sequence[str], local: dict[str, Column], ends: dict[str, Column], hand_on) -> DataFrame:
    """Local windows plus, for each column, ``_carry_c``: what ``hand_on(c)`` makes of the blocks' ``ends``."""
    table = parts.data.groupBy(*parts.keys).agg(*[e.alias(f"_end_{c}") for c, e in ends.items()])
    table = table.select(*parts.keys, *[hand_on(f"_end_{c}").alias(f"_carry_{c}") for c in ends])
    return matched(parts.data.withColumns(local), table, parts.keys)


def running(data: DataFrame, columns: dict[str, Column], keys: Sequence[str], order: Sequence[str], rows: int | None = None, inclusive: bool = True) -> DataFrame:
    """Sums of ``columns`` over a series' rows so far, with the row itself or without; null before the first number."""
    parts = cut(data, keys, order, rows)
    frame = parts.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = {c: F.sum(e).over(frame) for c, e in columns.items()}
    if rows is None:
        return data.withColumns(local)
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    out = _carried(parts, keys, local, {c: F.sum(e) for c, e in columns.items()}, lambda c: F.sum(c).over(earlier))
    both = lambda c: F.when(F.col(c).isNull(), F.col(f"_carry_{c}")).otherwise(F.col(c) + F.coalesce(F.col(f"_carry_{c}"), F.lit(0)))
    return parts.own(out.withColumns({c: both(c) for c in columns}).drop(*[f"_carry_{c}" for c in columns]), INDEX in data.columns)


def known(data: DataFrame, columns: dict[str, Column], keys: Sequence[str], order: Sequence[str], rows: int | None = None, following: bool = False, inclusive: bool = True) -> DataFrame:
    """The last value of each of ``columns`` that isn't null, up to the row; ``following``: the next one from the row on."""
    parts = cut(data, keys, order, rows)
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    sort = [F.desc(c) for c in parts.order] if following else parts.order
    window = Window.partitionBy(*parts.keys).orderBy(*sort).rowsBetween(*frame)
    local = {c: F.last(e, True).over(window) for c, e in columns.items()}
    if rows is None:
        return data.withColumns(local)
    pick = F.min_by if following else F.max_by
    earlier = Window.partitionBy(*keys).orderBy(F.desc(BLOCK) if following else F.col(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    ends = {c: pick(e, F.when(e.isNotNull(), F.col(INDEX))) for c, e in columns.items()}
    out = _carried(parts, keys, local, ends, lambda c: F.last(c, True).over(earlier))
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{c}")) for c in columns}).drop(*[f"_carry_{c}" for c in columns])
    return parts.own(out, INDEX in data.columns)


#: An average's weights within a block span no more than this factor, so that sums of scaled values keep their digits.
SPAN = 2.0**20
#: Rows of a block of an average at most.
SMOOTH_ROWS = 1 << 16


def smoothed(data: DataFrame, value: str, name: str, keys: Sequence[str], order: Sequence[str], alpha: float, rows: int | None = None) -> DataFrame:
    """``name``: the exponential average of the values so far, s = (1 - alpha) s + alpha x from s = the first value on.

    Null values have no row in it, and their rows have the average before them.  A step is an affine map of s, so a block's
    rows combine to one: within a block the average is a running sum of values scaled by powers of 1 - alpha, and a block
    begins from the averages that the blocks before it end with, each shrunk by the rows between; those that are shrunk
    below the least double are nothing.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is in (0, 1]")
    some = running(data, {"_rank": F.when(F.col(value).isNotNull(), 1)}, keys, order, rows)
    if alpha == 1:
        return known(some, {name: F.col(value)}, keys, order, rows).drop("_rank")
    keep = 1 - alpha
    length = max(1, min(int(math.log(SPAN) / -math.log(keep)), SMOOTH_ROWS))
    depth = math.ceil(1100 * math.log(2) / -math.log(keep) / length) + 1
    at = F.col("_rank") - 1
    # rows before the first value have no place in a block
    some = some.withColumns({"_cell": F.floor(at / length), "_in": (at % length).cast("double")})
    weight = F.when(at == 0, 1.0).otherwise(alpha)
    scaled = F.when(F.col(value).isNotNull(), weight * F.col(value) * F.pow(F.lit(keep), -F.col("_in")))
    cell = [*keys, "_cell"]
    so_far = F.sum(scaled).over(Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    local = so_far * F.pow(F.lit(keep), F.col("_in"))
    ends = some.where("_cell is not null").groupBy(*cell).agg((F.sum(scaled) * keep ** (length - 1)).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(-depth, -1)
    # the oldest first; a block that isn't the last is full
    carry = F.aggregate(F.collect_list("_end").over(earlier), F.lit(0.0), lambda s, x: s * keep**length + x)
    ends = ends.select(*cell, carry.alias("_carry"))
    out = matched(some.withColumn(name, local), ends, cell, "left")
    out = out.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_in") + 1))
    return out.drop("_rank", "_cell", "_in", "_carry")
