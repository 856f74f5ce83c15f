"""Filters, projections and labels (B)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators import ranges


def filter_commodity(data: DataFrame, commodity: str, column: str = "commodity", strict: bool = False) -> DataFrame:
    """Rows of one commodity (B1).  ``strict`` raises where there is none, at the price of a one-row action."""
    found = data.where(F.col(column) == commodity)
    if strict and found.limit(1).isEmpty():
        raise ValueError(f"no rows with {column} = {commodity}")
    return found


def filter_markets(data: DataFrame, markets: Sequence[str], column: str = "market") -> DataFrame:
    """Rows of the given markets (B2)."""
    return data.where(F.col(column).isin(list(markets)))


def missing_markets(data: DataFrame, markets: Sequence[str], column: str = "market") -> DataFrame:
    """The requested markets that the data doesn't have (B2)."""
    asked = data.sparkSession.createDataFrame([(m,) for m in dict.fromkeys(markets)], f"{column} string")
    return asked.join(data.select(column).distinct(), column, "left_anti")


def ensure_market(data: DataFrame, market: str = "market", fallbacks: Sequence[str] = ("admin1", "market_name")) -> DataFrame:
    """A market column, taken from the first fallback there is."""
    if market in data.columns:
        return data
    for name in fallbacks:
        if name in data.columns:
            return data.withColumn(market, F.col(name))
    raise ValueError(f"no column {market} nor any of {list(fallbacks)}")


def filter_period(data: DataFrame, start, end, ts: str = "date") -> DataFrame:
    """Rows from start to end, both included."""
    return data.where(F.col(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def complete_cases(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null among the columns."""
    return data.dropna(subset=list(columns))


def series_frame(data: DataFrame, value: str, name: str, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Keys and one value under a new name."""
    return data.select(*keys, F.col(value).alias(name))


def rate_adjusted(data: DataFrame, price: str = "price", rate: str = "exchange_rate") -> DataFrame:
    """``<price>_adjusted``: price / rate, null where the rate is zero."""
    return data.withColumn(f"{price}_adjusted", F.try_divide(price, rate))


def conflict_adjusted(data: DataFrame, price: str = "price", conflict: str = "conflict_intensity") -> DataFrame:
    """``<price>_conflict_adj``: price * (1 + conflict)."""
    return data.withColumn(f"{price}_conflict_adj", F.col(price) * (1 + F.col(conflict)))


def interactions(data: DataFrame, pairs: Sequence[tuple[str, str]], operations: Sequence[str] = ("mul",)) -> DataFrame:
    """``a_<op>_b`` for each pair and operation mul, div, add or sub; division by zero gives null."""
    made = {"mul": lambda a, b: a * b, "div": lambda a, b: a / F.nullif(b, F.lit(0)), "add": lambda a, b: a + b, "sub": lambda a, b: a - b}
    unknown = set(operations) - set(made)
    if unknown:
        raise ValueError(f"unknown operations {sorted(unknown)}")
    return data.withColumns({f"{a}_{op}_{b}": made[op](F.col(a), F.col(b)) for a, b in pairs for op in operations})


def time_features(data: DataFrame, date: str = "date") -> DataFrame:
    """year, month, day, day_of_week (Monday 0), quarter, and flags for starts and ends of month, quarter and year."""
    d = F.to_date(date)
    flag = lambda c: c.cast("int")
    return data.withColumns({
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "day_of_week": F.weekday(d), "quarter": F.quarter(d),
        "is_month_start": flag(d == F.trunc(d, "month")), "is_month_end": flag(d == F.last_day(d)),
        "is_quarter_start": flag(d == F.trunc(d, "quarter")), "is_quarter_end": flag(d == F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)),
        "is_year_start": flag(d == F.trunc(d, "year")), "is_year_end": flag(d == F.date_sub(F.add_months(F.trunc(d, "year"), 12), 1)),
    })


#: Categories that may become columns.
MOST_CATEGORIES = 1000


def one_hot(data: DataFrame, column: str, drop_first: bool = True, categories: Sequence[str] | None = None) -> DataFrame:
    """A 0/1 column per category in sorted order, the first left out; the source column goes.

    Without ``categories`` the distinct values are found by an action; more than MOST_CATEGORIES are an error.
    """
    if categories is None:
        categories = [r[0] for r in data.select(column).distinct().where(F.col(column).isNotNull()).orderBy(column).limit(MOST_CATEGORIES + 1).collect()]
        if len(categories) > MOST_CATEGORIES:
            raise ValueError(f"{column} has more than {MOST_CATEGORIES} categories; name those that are to be columns")
    used = list(categories)[1:] if drop_first else list(categories)
    return data.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in used}).drop(column)


def label_encode(data: DataFrame, column: str) -> DataFrame:
    """``<column>_code``: the place of the value in sorted order from 0, null as -1 (B12), by a table of categories that ranges number."""
    values = data.select(column).distinct().where(F.col(column).isNotNull())
    codes = ranges.numbered(values, [], [column]).select(column, F.col(ranges.INDEX).cast("int").alias(f"{column}_code"))
    return data.join(codes, column, "left").na.fill(-1, [f"{column}_code"])


def stars(p: Column) -> Column:
    """Significance stars."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def shape_label(skew: Column, kurt: Column) -> Column:
    """Words for a skewness and an excess kurtosis."""
    side = F.when(F.abs(skew) < 0.5, "approximately symmetric").when((skew >= 0.5) & (skew < 1), "moderately right-skewed").when(skew >= 1, "highly right-skewed").when((skew <= -0.5) & (skew > -1), "moderately left-skewed").otherwise("highly left-skewed")
    tail = F.when(F.abs(kurt) < 0.5, "normal tails").when((kurt >= 0.5) & (kurt < 1), "slightly heavy tails").when(kurt >= 1, "heavy tails").when((kurt <= -0.5) & (kurt > -1), "slightly light tails").otherwise("light tails")
    return F.concat_ws(", ", side, tail)
