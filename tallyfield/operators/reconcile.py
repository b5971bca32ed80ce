"""Checks of one source against another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n): keys on both sides and on one only."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right only").when(F.col("r").isNull(), "left only").otherwise("both")
    return a.join(b, key, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def compare_totals(left: DataFrame, right: DataFrame, keys: list[str], ours: str, theirs: str) -> DataFrame:
    """Sums of both sides by key, their difference and its share of the right side."""
    a = left.groupBy(*keys).agg(F.sum(ours).alias("ours"))
    b = right.groupBy(*keys).agg(F.sum(theirs).alias("theirs"))
    return a.join(b, keys).withColumns({"diff": F.col("ours") - F.col("theirs"), "diff_pct": C.ratio((F.col("ours") - F.col("theirs")) * 100, F.col("theirs"))})


def worst(compared: DataFrame, n: int, *ties: str) -> DataFrame:
    return compared.orderBy(F.desc(F.abs("diff")), *ties).limit(n)


def within(compared: DataFrame, tolerance: float = 0.01) -> Column:
    return F.abs(F.col("diff")) < tolerance * F.abs(F.col("theirs"))


def metric_totals(left: DataFrame, right: DataFrame, pairs: dict[str, tuple[str, str]], tolerance: float = 0.01) -> DataFrame:
    """(metric, ours, theirs, relative, passes): grand totals of several metrics."""
    a = left.agg(*[F.sum(x).alias(m) for m, (x, _) in pairs.items()]).unpivot([], list(pairs), "metric", "ours")
    b = right.agg(*[F.sum(y).alias(m) for m, (_, y) in pairs.items()]).unpivot([], list(pairs), "metric", "theirs")
    relative = F.when(F.col("theirs") != 0, F.abs(F.col("ours") - F.col("theirs")) / F.abs(F.col("theirs")))
    return a.join(b, "metric").withColumn("relative", relative).withColumn("passes", F.coalesce(F.col("relative") < tolerance, F.col("ours") == F.col("theirs")))


def group_audit(events: DataFrame, key: str, group: str) -> DataFrame:
    """(key, groups, n_groups, events, unassigned, top_share) of entities seen in several groups."""
    by = events.groupBy(key, group).agg(F.count("*").alias("n"))
    out = by.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(F.col(group).cast("string"))), ", ").alias("groups"),
        F.count(group).alias("n_groups"),
        F.sum("n").alias("events"),
        F.coalesce(F.sum(F.when(F.col(group).isNull(), F.col("n"))), F.lit(0)).alias("unassigned"),
        (F.max("n") / F.sum("n")).alias("top_share"),
    )
    return out.where("n_groups > 1")


def group_sizes(audited: DataFrame) -> DataFrame:
    return audited.groupBy("n_groups").agg(F.count("*").alias("entities"))
