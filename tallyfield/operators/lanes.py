"""Value created by lane of the pitch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import pitch as P

EPS = 1e-9
OUTPUT = "obv_from_ext obv_from_int obv_from_ext_per90 obv_from_int_per90 lane_bias_index".split()


def lane_sums(width: float = P.WIDTH, value: str = "obv_total_net", y: Column | None = None) -> list[Column]:
    """Value from the outer and the inner lanes, null for who has no placed value."""
    y = F.col("y") if y is None else y
    group, here = P.lane_group(P.lane(y, width)), y.isNotNull() & F.col(value).isNotNull()
    part = lambda g: F.when(F.count_if(here) > 0, F.coalesce(F.sum(F.when(here & (group == g), F.col(value))), F.lit(0.0)))
    return [part("ext").alias("obv_from_ext"), part("int").alias("obv_from_int")]


def lane_index(outer: Column, inner: Column, passes: Column, least_passes: int) -> Column:
    """The inner minus the outer share of value; null below so many passes."""
    return F.when(passes >= least_passes, (inner - outer) / (F.abs(inner) + F.abs(outer) + EPS))


def lane_bias(events: DataFrame, minutes: DataFrame, width: float = P.WIDTH, least_passes: int = 50, value: str = "obv_total_net", y: Column | None = None) -> DataFrame:
    """(player_id, obv_from_ext, obv_from_int, per 90 of both, passes, lane_bias_index).

    The index is the inner minus the outer share of value; null below least_passes passes. y is where an event is
    across the pitch, if not a column of that name. One aggregation by player.
    """
    made = events.where("player_id is not null").groupBy("player_id").agg(*lane_sums(width, value, y), F.count_if(F.col("type") == "Pass").alias("passes"))
    out = made.where("obv_from_ext is not null").join(minutes.select("player_id", "total_minutes"), "player_id")
    inner, outer = F.col("obv_from_int"), F.col("obv_from_ext")
    return out.select(
        "player_id",
        "obv_from_ext",
        "obv_from_int",
        C.per90(outer, F.col("total_minutes")).alias("obv_from_ext_per90"),
        C.per90(inner, F.col("total_minutes")).alias("obv_from_int_per90"),
        "passes",
        lane_index(outer, inner, F.col("passes"), least_passes).alias("lane_bias_index"),
    )


def lane_profile(df: DataFrame, index: str = "lane_bias_index") -> DataFrame:
    """Side of influence and its strength, in the labels of the score tables."""
    b = F.col(index)
    side = F.when(b.isNull(), "Sin dato").when(b >= 0, "Interior").otherwise("Exterior")
    tag = F.when(b.isNull(), "Sin dato").when(F.abs(b) < 0.10, "Balanceado").when(F.abs(b) < 0.25, F.concat(F.lit("Tendencia "), side)).otherwise(F.concat(F.lit("Marcado "), side))
    return df.withColumns({"lane_influence_side": side, "lane_profile": tag})
