"""Lost possessions: the last event of a team before the other has the ball."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C

#: Play patterns that are open play or restarts, and types that are no turnover.
OPEN_PLAY = ("Regular Play",)
RESTARTS = ("From Corner", "From Free Kick", "From Throw In", "From Goal Kick", "From Keeper", "From Kick Off", "Other")
NO_TURNOVER = ("Shot", "Foul Won", "Foul Committed", "Injury Stoppage", "Substitution")
WITH_OUTCOME = {"Pass": ("Pass", "pass_outcome"), "Dribble": ("Dribble", "dribble_outcome"), "Duel": ("Duel", "duel_outcome"), "Ball Receipt*": ("Ball Receipt", "ball_receipt_outcome")}


def how(columns: list[str]) -> Column:
    """Type and outcome of a lost ball, as far as the outcome columns exist."""
    t = F.col("type")
    out = F.when(t == "Carry", F.when(C.truthy(F.col("out")), "Carry: Out").otherwise("Carry") if "out" in columns else F.lit("Carry"))
    for name, (label, outcome) in WITH_OUTCOME.items():
        given = F.when(F.col(outcome) != "", F.concat(F.lit(f"{label}: "), F.col(outcome))) if outcome in columns else F.lit(None)
        out = out.when(t == name, F.coalesce(given, F.lit(label)))
    return out.otherwise(t)


def turnovers(events: DataFrame, open_play_only: bool = True, exclude_restarts: bool = True, exclude_types: tuple[str, ...] = NO_TURNOVER) -> DataFrame:
    """Events of a team in possession after which another team has it; a null next pattern is kept."""
    order = Window.partitionBy("match_id").orderBy("period", "idx")
    ahead = events.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("possession_team", "play_pattern", "idx", "team", "type")})
    lost = (F.col("team") == F.col("possession_team")) & (F.col("possession_team") != F.col("next_possession_team")) & F.col("player_id").isNotNull()
    if open_play_only:
        lost &= F.col("play_pattern").isin(*OPEN_PLAY)
    if exclude_restarts:
        lost &= ~F.coalesce(F.col("next_play_pattern").isin(*RESTARTS), F.lit(False))
    if exclude_types:
        lost &= ~F.coalesce(F.col("type").isin(*exclude_types), F.lit(False))
    return ahead.where(lost).withColumns({"turnover_team_lost": F.col("possession_team"), "turnover_team_won": F.col("next_possession_team"), "turnover_how": how(events.columns)})


def turnover_counts(lost: DataFrame, kinds: list[str]) -> DataFrame:
    """(player_id, total_turnovers, turnovers_<kind>...)."""
    by = [F.count_if(F.col("turnover_how") == k).alias(f"turnovers_{C.turnover_part(k)}") for k in kinds]
    return lost.groupBy("player_id").agg(F.count("*").alias("total_turnovers"), *by)
