"""Ranks and order statistics of groups from the counts of their distinct values.

Values are counted first, which Spark combines before its shuffle, so that many equal values cost one row. The distinct
values of a group are then cut into ranges of about equal numbers, each ordered in a task of its own; the counts of the
ranges below are added. Results are exact whatever the cuts are, as equal values share a range. Groups may have null
keys; null values are left out.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..sources.scratch import settle

#: Accuracy of the cuts between ranges; it decides how even the ranges are, not what comes out.
EVENNESS = 1000


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the keys are kept once."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row, as there is one group
    other = right.select(*[F.col(f"`{k}`").alias(f"__{k}") if k in keys else F.col(f"`{k}`") for k in right.columns])
    same = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys))
    return left.join(other, same, how).drop(*[f"__{k}" for k in keys])


def value_counts(df: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """(group, value, n): how often each value occurs."""
    return df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(F.count("*").alias("n"))


def in_ranges(counts: DataFrame, group: list[str], parts: int) -> DataFrame:
    """counts with `range`, `total` (rows of the group) and `below` (rows in lower ranges); written once where several ranges are cut."""
    if parts <= 1:
        total = F.sum("n").over(Window.partitionBy(*group))
        return counts.select("*", F.lit(0).alias("range"), total.alias("total"), F.lit(0).cast("long").alias("below"))
    counts = settle(counts, "value-counts")
    cuts = counts.groupBy(*group).agg(F.percentile_approx("value", [k / parts for k in range(1, parts)], EVENNESS).alias("cuts"))
    placed = join_same(counts, cuts, group).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    sizes = placed.groupBy(*group, "range").agg(F.sum("n").alias("own"))
    whole = Window.partitionBy(*group)
    before = F.sum("own").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*group, "range", F.sum("own").over(whole).alias("total"), F.coalesce(before, F.lit(0)).alias("below"))
    return join_same(placed, starts, [*group, "range"])


def _before(group: list[str]) -> Column:
    """Rows of the group with smaller values."""
    inside = Window.partitionBy(*group, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return F.col("below") + F.coalesce(F.sum("n").over(inside), F.lit(0))


def percentiles_of(counts: DataFrame, group: list[str], parts: int = 1) -> DataFrame:
    """(group, value, pct): 0 to 100 by average rank, for every distinct value."""
    ranked = in_ranges(counts, group, parts).withColumn("rank", _before(group) + 1)
    return ranked.select(*group, "value", ((F.col("rank") + (F.col("n") - 1) / 2) / F.col("total") * 100).alias("pct"))


def quantile_parts(counts: DataFrame, group: list[str], quantiles: list[float], parts: int = 1) -> DataFrame:
    """(group, q): for each quantile a struct (lo, hi, rem, den) of the two order statistics that it lies between.

    The quantile is lo + (hi - lo) * rem / den, interpolated linearly; only ranges that hold such an order statistic are
    ordered.
    """
    wanted = [Fraction(str(q)) for q in quantiles]
    spots = lambda n: [(C.whole_div((n - 1) * q.numerator, F.lit(q.denominator)), F.pmod((n - 1) * q.numerator, F.lit(q.denominator))) for q in wanted]
    placed = in_ranges(counts, group, parts)
    if parts > 1:
        edge = Window.partitionBy(*group, "range")
        last = F.col("below") + F.sum("n").over(edge)
        holds = [(at + i >= F.col("below")) & (at + i < last) for at, _ in spots(F.col("total")) for i in (0, 1)]
        placed = placed.withColumn("holds", reduce(lambda a, b: a | b, holds)).where("holds").drop("holds")
    placed = placed.withColumn("before", _before(group))
    at = lambda k: F.max(F.when((k >= F.col("before")) & (k < F.col("before") + F.col("n")), F.col("value")))
    found = []
    for (low, rem), q in zip(spots(F.col("total")), wanted):
        lo, hi = at(low), at(F.least(low + 1, F.col("total") - 1))
        found.append(F.struct(lo.alias("lo"), hi.alias("hi"), F.max(rem).alias("rem"), F.lit(q.denominator).alias("den")))
    return placed.groupBy(*group).agg(F.array(*found).alias("q"))


def quantiles(df: DataFrame, group: list[str], value: str, wanted: list[float], parts: int = 1) -> DataFrame:
    """(group, q): the exact quantiles of every group, interpolated linearly, as an array."""
    found = quantile_parts(value_counts(df, group, value), group, wanted, parts)
    return found.select(*group, F.transform("q", lambda p: p["lo"] + (p["hi"] - p["lo"]) * (p["rem"] / p["den"])).alias("q"))


#: Bits of an increasing id that hold the row inside its partition.
ROW_BITS = 33


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """df with every row's place in the order, from 1, without gaps and without a window over the whole table.

    The table is sorted by ranges and written once with each row's place in its partition; the sizes of the partitions
    before are added, one small row each. The order should tell all rows apart, else places of equal rows are arbitrary.
    """
    own = settle(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "sorted")
    part, row = F.shiftright("__id", ROW_BITS), F.col("__id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sizes = own.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    placed = own.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn(name, F.col("__start") + row + 1).drop("__id", "__part", "__start")
