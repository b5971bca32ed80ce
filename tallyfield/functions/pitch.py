"""Expressions over pitch coordinates and match clocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH, WIDTH = 120.0, 80.0

#: Position names and their groups.
POSITION_GROUP = {
    "Goalkeeper": "Golero",
    "Center Back": "Zaguero",
    "Left Center Back": "Zaguero",
    "Right Center Back": "Zaguero",
    "Left Back": "Lateral",
    "Right Back": "Lateral",
    "Left Wing Back": "Lateral",
    "Right Wing Back": "Lateral",
    "Center Defensive Midfield": "Volante",
    "Left Defensive Midfield": "Volante",
    "Right Defensive Midfield": "Volante",
    "Left Center Midfield": "Interior/Mediapunta",
    "Right Center Midfield": "Interior/Mediapunta",
    "Center Midfield": "Interior/Mediapunta",
    "Center Attacking Midfield": "Interior/Mediapunta",
    "Left Attacking Midfield": "Interior/Mediapunta",
    "Right Attacking Midfield": "Interior/Mediapunta",
    "Left Wing": "Extremo",
    "Right Wing": "Extremo",
    "Left Midfield": "Extremo",
    "Right Midfield": "Extremo",
    "Center Forward": "Delantero",
    "Left Center Forward": "Delantero",
    "Right Center Forward": "Delantero",
    "Secondary Striker": "Delantero",
}


def position_group(position: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in POSITION_GROUP.items() for x in pair])[position]


def positions_of(group: str) -> list[str]:
    found = sorted(p for p, g in POSITION_GROUP.items() if g.lower() == group.strip().lower())
    if not found:
        raise ValueError(f"unknown position group {group!r}; one of {sorted(set(POSITION_GROUP.values()))}")
    return found


def third(x: Column, length: float | Column = LENGTH) -> Column:
    part = (length if isinstance(length, Column) else F.lit(length)) / 3
    return F.when(x < part, "defensive").when(x < part * 2, "middle").when(x.isNotNull(), "attacking")


def third_sql(x: str, length: float = LENGTH) -> str:
    """third as an SQL expression over a column's name."""
    part = float(length) / 3
    return f"CASE WHEN `{x}` < {part!r}D THEN 'defensive' WHEN `{x}` < {part * 2!r}D THEN 'middle' WHEN `{x}` IS NOT NULL THEN 'attacking' END"


def lane(y: Column, width: float = WIDTH) -> Column:
    """Lane 1 to 5; places outside the pitch count to the outer lanes."""
    return F.least(F.lit(5), F.floor(F.greatest(F.lit(0.0), F.least(y, F.lit(width))) / (width / 5)).cast("int") + 1)


def lane_group(lane_id: Column) -> Column:
    return F.when(lane_id.isin(1, 5), "ext").when(lane_id.isNotNull(), "int")


def in_box(x: Column, y: Column, length: float = LENGTH, width: float = WIDTH) -> Column:
    return (x >= length - 18) & y.between(width / 2 - 22, width / 2 + 22)


def into_final_third(kind: Column, name: str, end_x: Column, length: float = LENGTH) -> Column:
    return F.when((kind == name) & (end_x >= length * 2 / 3), 1.0).otherwise(0.0)


def mirrored(x: Column, y: Column, length: float = LENGTH, width: float = WIDTH) -> tuple[Column, Column]:
    return F.lit(length) - x, F.lit(width) - y


def clock_seconds(timestamp: Column, period: Column, minute: Column, second: Column) -> Column:
    """Seconds of an HH:MM:SS.fff text, or else of the period's clock."""
    parts = [F.regexp_extract(timestamp, r"^(\d+):(\d+):(\d+(?:\.\d+)?)$", i).try_cast("double") for i in (1, 2, 3)]
    parsed = reduce(lambda a, b: a * 60 + b, parts)
    return F.coalesce(parsed, (period - 1) * 3600.0 + minute * 60 + second)


def pitch_size(events: DataFrame, q: float = 0.995, exact: bool = True) -> DataFrame:
    """(length, width): one row with the size of the pitch that the coordinates suggest; 120 by 80 without any.

    The length is a high quantile of x between 100 and 120. The width is 80 or 100 where a high quantile of y is little
    above that, else the greatest y between 80 and 120.
    """
    pick = (lambda c: F.percentile(c, q)) if exact else (lambda c: F.percentile_approx(c, q, 100_000))
    ends = events.agg(pick(F.col("x")).alias("x"), pick(F.col("y")).alias("y"), F.max("y").alias("most"))
    within = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), c))
    width = F.when(F.col("y") <= 82, 80.0).when(F.col("y") <= 102, 100.0).otherwise(within(F.col("most"), 80.0, 120.0))
    return ends.select(F.coalesce(F.when(F.col("x").isNotNull(), within(F.col("x"), 100.0, 120.0)), F.lit(LENGTH)).alias("length"), F.coalesce(F.when(F.col("y").isNotNull(), width), F.lit(WIDTH)).alias("width"))


def dimensions(events: DataFrame, q: float = 0.995, exact: bool = True) -> DataFrame:
    """(length, width): one row, from a high quantile of the coordinates; approximate on request for very large input."""
    pick = (lambda c: F.percentile(c, q)) if exact else (lambda c: F.percentile_approx(c, q, 100_000))
    return events.agg(pick(F.col("x")).alias("length"), pick(F.col("y")).alias("width"))
