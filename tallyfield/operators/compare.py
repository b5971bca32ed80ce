"""Comparison and distribution tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking
from .scoring import long_percentiles


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def box_table(df: DataFrame, ids: list[str], cohort: list[str], columns: list[str], parts: int = 1) -> DataFrame:
    """Per entity and column: the cohort's median, quartiles and whiskers, and whether the entity is outside them.

    Whiskers are the outermost values within 1.5 interquartile ranges of the box. Quartiles are exact, from counts of
    distinct values; parts above 1 finds them in so many ranges.
    """
    long = melt(df, [*ids, *cohort], columns).where("value is not null")
    group = [*cohort, "metric"]
    box = ranking.quantiles(long, group, "value", [0.25, 0.5, 0.75], parts)
    q1, q2, q3 = (F.get("q", F.lit(i)) for i in range(3))
    box = box.select(*group, q1.alias("p25"), q2.alias("median"), q3.alias("p75"), (q1 - 1.5 * (q3 - q1)).alias("lo"), (q3 + 1.5 * (q3 - q1)).alias("hi"))
    placed = ranking.join_same(long, box, group)
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    ends = placed.where(inside).groupBy(*group).agg(F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"))
    return placed.withColumn("outlier", ~inside).drop("lo", "hi").transform(lambda d: ranking.join_same(d, ends, group))


def radar_table(df: DataFrame, key: str, entity, cohort: list[str], columns: list[str], other=None) -> DataFrame:
    """(metric, value, reference): one entity against its cohort's mean or another entity."""
    long = melt(df, [key, *cohort], columns)
    one = long.where(F.col(key) == entity).select(*cohort, "metric", F.col("value"))
    if other is None:
        ref = long.join(one.select(*cohort).distinct(), cohort, "left_semi").groupBy(*cohort, "metric").agg(F.avg("value").alias("reference"))
        return one.join(ref, [*cohort, "metric"]).select("metric", "value", "reference")
    ref = long.where(F.col(key) == other).select("metric", F.col("value").alias("reference"))
    return one.join(ref, "metric").select("metric", "value", "reference")


def radar_tables(df: DataFrame, key: str, cohort: list[str], columns: list[str]) -> DataFrame:
    """Every entity's values beside the means of its cohort."""
    long = melt(df, [key, *cohort], columns)
    means = long.groupBy(*cohort, "metric").agg(F.avg("value").alias("reference"))
    return long.join(means, [*cohort, "metric"])


def radar_pairs(df: DataFrame, key: str, pairs: DataFrame, kept: list[str], columns: list[str]) -> DataFrame:
    """(kept, metric, value, reference): entities of pairs (one, other) beside each other; kept columns of pairs stay."""
    long = melt(df, [key], columns)
    one, other = (long.select(F.col(key).alias(n), "metric", F.col("value").alias(v)) for n, v in (("one", "value"), ("other", "reference")))
    return pairs.join(one, "one").join(other, ["other", "metric"]).select(*kept, "metric", "value", "reference")


def detail_table(df: DataFrame, key: str, cohort: list[str], columns: list[str], members: DataFrame | None = None, parts: int = 1) -> DataFrame:
    """Percentile of every entity and metric in its cohort and the cohort's mean percentile; not inverted.

    members restricts the cohort to given keys; metrics that are null for all are skipped; parts above 1 divides the
    ranking of a cohort.
    """
    own = df if members is None else df.join(members.select(key).distinct(), key, "left_semi")
    ranked = long_percentiles(own, [key], cohort, columns, parts)
    means = ranked.groupBy(*cohort, "metric").agg(F.avg("pct").alias("cohort_pct"), F.count("*").alias("cohort_n"))
    return ranked.join(means, [*cohort, "metric"])


def detail_against(ranked: DataFrame, key: str, pairs: DataFrame, least: int = 3) -> DataFrame:
    """(key, other, metric, pct, other_pct): the rows of detail_table of one entity beside those of another, aligned by metric.

    pairs holds (key, other). A metric that the first entity lacks is left out; one that only the other lacks has a
    null other_pct. Entities with fewer than `least` metrics have no table.
    """
    one = pairs.join(ranked.select(key, "metric", "pct"), key)
    enough = one.groupBy(key, "other").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    beside = ranked.select(F.col(key).alias("other"), "metric", F.col("pct").alias("other_pct"))
    return one.join(enough, [key, "other"], "left_semi").join(beside, ["other", "metric"], "left").select(key, "other", "metric", "pct", "other_pct")


def entity_card(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(source).alias(name) for name, source in columns.items() if source in df.columns])


def drop_repeats(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row by order for each key."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in df.columns if c not in keys and c not in order])).alias("r"))
    return first.select(*keys, *[F.col(f"r.{c}").alias(c) for c in df.columns if c not in keys])
