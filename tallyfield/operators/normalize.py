"""Raw event tables to typed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

#: Numeric columns that identify or place an event and are no metrics.
NOT_METRICS = frozenset("match_id index period minute second player_id possession idx event_id team_id possession_team_id id t x y z pass_end_x pass_end_y carry_end_x carry_end_y end_x end_y".split())
POINTS = {"location": ("x", "y"), "pass_end_location": ("pass_end_x", "pass_end_y"), "carry_end_location": ("carry_end_x", "carry_end_y")}
NAMED = ("team", "possession_team", "play_pattern", "position", "type")


def normalize_events(raw: DataFrame) -> DataFrame:
    """Coordinates, ids and names out of their cells; columns that are missing are skipped.

    A player id comes from player_id, or else from the player cell, whose text becomes player_name.
    """
    added = {}
    for source, names in POINTS.items():
        if source in raw.columns:
            column = F.col(source)
            xy = (F.get(column, F.lit(0)), F.get(column, F.lit(1))) if isinstance(raw.schema[source].dataType, T.ArrayType) else C.point(column)
            added |= dict(zip(names, xy))
    strings = {f.name for f in raw.schema if isinstance(f.dataType, T.StringType)}
    added |= {n: C.entity_name(F.col(n)) for n in NAMED if n in strings}
    if "player" in strings:
        added["player_name"] = C.entity_name(F.col("player"))
        ids = [C.safe_long(F.col(f"`{c}`")) for c in ("player_id", "playerId", "player.id") if c in raw.columns]
        added["player_id"] = F.coalesce(*ids, C.entity(F.col("player"))["id"])
    elif "player_id" in raw.columns:
        added["player_id"] = C.safe_long(F.col("player_id"))
    if "related_events" in strings:
        added["related_events"] = C.id_list(F.col("related_events"))
    return raw.withColumns(added)


def metric_columns(df: DataFrame) -> list[str]:
    """The numeric columns that are metrics, by the schema alone."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in NOT_METRICS]


def encode_flags(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns that hold only true and false become 0 and 1; one pass finds them unless they are given."""
    if columns is None:
        texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]
        found = df.agg(*[C.is_flag_column(F.col(c)).alias(c) for c in texts]).first() if texts else {}
        columns = [c for c in texts if found[c]]
    return df.withColumns({c: C.flag_value(F.col(c)) for c in columns})


def of_known_players(rows: DataFrame, players: DataFrame) -> DataFrame:
    """The rows of players that a line-up or a positioned event names; players without an id are none of them."""
    return rows.join(players.select("player_id").distinct(), "player_id", "left_semi")


def contract(df: DataFrame, ordered: list[str]) -> DataFrame:
    """The columns of an output contract that exist, in its order."""
    have = set(df.columns)
    return df.selectExpr(*[C.named(c) for c in ordered if c in have])


def player_dimension(lineup: DataFrame, events: DataFrame) -> DataFrame:
    """(player_id, positions, teams): distinct names, sorted and comma-joined, from line-ups and events."""
    rows = lineup.select("player_id", "position", "team").unionByName(events.where("position is not null").select("player_id", "position", "team")).where("player_id is not null")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return rows.groupBy("player_id").agg(joined("position").alias("all_positions"), joined("team").alias("teams"))
