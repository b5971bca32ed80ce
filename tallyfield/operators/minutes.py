"""Playing time from line-ups and substitutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C

LINEUP = "lineup array<struct<player: struct<id: bigint>, position: struct<name: string>>>"
END_CAP = 120


def lineup_from_tactics(events: DataFrame) -> DataFrame:
    """(match_id, player_id, position, team) of the line-up cells of Starting XI events."""
    own = events.where("type = 'Starting XI'").select("match_id", "team", F.explode(F.from_json(C.literal_json(F.col("tactics")), LINEUP)["lineup"]).alias("p"))
    return own.select("match_id", F.col("p.player.id").alias("player_id"), F.col("p.position.name").alias("position"), "team").where("player_id is not null")


def substitutions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(match_id, player_id, minute) going on and coming off."""
    own = events.where("type = 'Substitution'")
    on = own.select("match_id", C.entity_id(F.col("substitution_replacement")).alias("player_id"), "minute").where("player_id is not null")
    return on, own.select("match_id", "player_id", "minute").where("player_id is not null")


def match_end(events: DataFrame, cap: int = END_CAP) -> DataFrame:
    return events.groupBy("match_id").agg(F.least(F.lit(cap), F.greatest(F.lit(90), F.coalesce(F.max("minute"), F.lit(90)))).alias("end_minute"))


def appearances(events: DataFrame, lineup: DataFrame, on: DataFrame, off: DataFrame, cap: int = END_CAP) -> DataFrame:
    """(match_id, player_id, team, minutes, starter, position_match, season, seen_team, positions, teams): all that is known of who was in a match.

    A starter plays to the first substitution or the end; a substitute from coming on; who never came on has 0 minutes.
    The position is the line-up's, or else the most frequent in the player's events (first by name of equals); the team is
    that of the first event (seen_team, null without events), or the line-up's. positions and teams are those that the
    line-up and positioned events name, null for who is in neither. The season is the log's, null where it has none.

    All of an appearance comes together in one shuffle, and the end of a match is found among its appearances.
    """
    keys = ["match_id", "player_id"]
    nothing = {"seen": "struct<period int, idx bigint, team string>", "usual": "string", "minute": "long", "season": "string", "xi": "boolean", "xi_position": "string", "xi_team": "string", "on": "long", "off": "long"}
    whole = lambda df, **given: df.select(*keys, *[given[n].cast(t).alias(n) if n in given else F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
    known = F.col("player_id").isNotNull()
    season = F.col("season") if "season" in events.columns else F.lit(None)
    first = F.when(known, F.struct(F.col("period").cast("int").alias("period"), F.col("idx").cast("long").alias("idx"), "team"))
    rows = whole(events, seen=first, usual=F.col("position"), minute=F.col("minute"), season=season)
    rows = rows.unionByName(whole(lineup, xi=F.lit(True), xi_position=F.col("position"), xi_team=F.col("team")))
    rows = rows.unionByName(whole(on, on=F.col("minute"))).unionByName(whole(off, off=F.col("minute")))
    named = F.coalesce("xi", F.lit(False)) | F.col("usual").isNotNull()
    all_ = rows.groupBy(*keys).agg(
        F.min("seen")["team"].alias("seen_team"),
        F.mode("usual", True).alias("usual"),
        F.max("minute").alias("last"),
        F.min("season").alias("season"),
        F.coalesce(F.bool_or("xi"), F.lit(False)).alias("starter"),
        F.min("xi_position").alias("xi_position"),
        F.min("xi_team").alias("xi_team"),
        F.min("on").alias("on"),
        F.min("off").alias("off"),
        F.when(F.bool_or(named), F.collect_set(F.coalesce("xi_position", "usual"))).alias("positions"),
        F.when(F.bool_or(named), F.collect_set(F.when(F.col("xi"), F.col("xi_team")).when(F.col("usual").isNotNull(), F.col("seen.team")))).alias("teams"),
    )
    match = Window.partitionBy("match_id")
    all_ = all_.withColumns({"last": F.max("last").over(match), "season": F.min("season").over(match)}).where(known)
    end = F.least(F.lit(cap), F.greatest(F.lit(90), F.coalesce("last", F.lit(90))))
    played = F.when(F.col("starter"), F.coalesce("off", end)).when(F.col("on").isNotNull(), F.coalesce("off", end) - F.col("on")).otherwise(0)
    return all_.select(
        *keys,
        F.coalesce("seen_team", "xi_team").alias("team"),
        F.greatest(F.lit(0), played).cast("long").alias("minutes"),
        "starter",
        F.coalesce("xi_position", "usual").alias("position_match"),
        "season",
        "seen_team",
        "positions",
        "teams",
    )


def minutes_played(events: DataFrame, lineup: DataFrame, on: DataFrame, off: DataFrame, cap: int = END_CAP) -> DataFrame:
    """(match_id, player_id, team, minutes, starter, position_match) of appearances with minutes."""
    own = appearances(events, lineup, on, off, cap).where("minutes > 0")
    return own.select("match_id", "player_id", "team", "minutes", "starter", "position_match")


def minutes_summary(minutes: DataFrame) -> DataFrame:
    """One row per player with minutes: total, matches, starts, seasons, and the position with most minutes and its share.

    Takes one row for each match and player. Where the rows have positions and teams (see appearances), they are listed
    too, joined by commas, those of appearances without minutes included; players without any are left out then.
    """
    named = {"positions": "all_positions", "teams": "teams"} if {"positions", "teams"} <= set(minutes.columns) else {}
    some = F.col("minutes") > 0
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    by = minutes.groupBy("player_id", "position_match").agg(
        F.sum(F.when(some, F.col("minutes"))).alias("m"),
        F.count_if(some).alias("n"),
        F.sum(F.when(some, F.col("starter").cast("long"))).alias("starts"),
        F.collect_set(F.when(some, F.col("season"))).alias("seasons"),
        *[F.when(F.count(c) > 0, F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in named],
    )
    top = F.min(F.when(F.col("position_match").isNotNull() & (F.col("m") > 0), F.struct((-F.col("m")).alias("m"), "position_match")))
    joined = by.groupBy("player_id").agg(
        F.sum("m").alias("total_minutes"),
        F.sum("n").alias("matches_played"),
        F.coalesce(F.sum("starts"), F.lit(0)).alias("times_starter"),
        every("seasons").alias("seasons"),
        top.alias("top"),
        *[F.when(F.count(c) > 0, every(c)).alias(c) for c in named],
    )
    if named:
        joined = joined.where(F.col("positions").isNotNull())
    share = C.ratio(-F.col("top.m"), F.col("total_minutes"))
    lists = [F.array_join(c, ", ").alias(n) for c, n in named.items()]
    return joined.where("total_minutes > 0").select(
        "player_id", "total_minutes", "matches_played", "times_starter", "seasons", F.col("top.position_match").alias("primary_position"), (-F.col("top.m")).alias("minutes_primary_position"), share.alias("primary_position_share"), *lists
    )


def top_one(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
