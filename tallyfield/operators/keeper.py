"""Goalkeeper metrics from keeper events linked to the shots they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

BOX_LINE = 18.0
DEFENSIVE_THIRD = 40.0
LONG_BALL = 32.0
#: Outcomes of keeper events that count as errors, and post-shot xG columns in order of preference.
ERRORS = ("Touched Out", "Punched Out", "Incomplete", "No Catch", "Lost")
PSXG = ("shot_gk_shot_stopping_xg_suppression", "shot_shot_execution_xg", "shot_statsbomb_xg")


def psxg_column(columns: list[str]) -> str | None:
    return next((c for c in PSXG if c in columns), None)


def keepers(events: DataFrame, summary: DataFrame) -> DataFrame:
    """player_id of those who kept goal by main position, by a keeper event or by the position of an event."""
    acted = events.where(_acts()).select("player_id")
    return summary.where("primary_position = 'Goalkeeper'").select("player_id").union(acted).where("player_id is not null").distinct()


def _acts() -> Column:
    return F.coalesce((F.col("type") == "Goal Keeper") | F.contains("position", F.lit("Goalkeeper")), F.lit(False))


def shot_links(events: DataFrame, penalties: bool | None = False, psxg: str | None = None) -> DataFrame:
    """One row for each keeper event and related shot; penalties, all other shots, or (None) both.

    Joined on the event id, which no group shares, so neither side is skewed.
    """
    psxg = psxg or psxg_column(events.columns)
    kept = events.where("type = 'Goal Keeper' and player_id is not null").select("player_id", "x", "goalkeeper_outcome", F.explode("related_events").alias("shot_id"))
    value = F.coalesce(C.safe_double(F.col(psxg)), F.lit(0.0)) if psxg else F.lit(0.0)
    shots = events.where("type = 'Shot'")
    if penalties is not None:
        shots = shots.where(is_penalty() if penalties else ~is_penalty())
    return kept.join(shots.select(F.col("id").alias("shot_id"), "shot_outcome", "shot_type", value.alias("psxg")), "shot_id")


def is_penalty() -> Column:
    return F.coalesce(F.col("shot_type") == "Penalty", F.lit(False))


def faced(links: DataFrame, prevented_given: bool = False) -> DataFrame:
    """Shot stopping and penalties of each keeper, from links to all shots, in one aggregation.

    With prevented_given the post-shot column is goals prevented itself, else goals are taken off. A keeper without
    shots of a kind has no value in its columns.
    """
    penalty = is_penalty()
    n, n_pen = F.count_if(~penalty), F.count_if(penalty)
    goal, saved = F.coalesce(F.col("shot_outcome") == "Goal", F.lit(False)), F.coalesce(F.col("shot_outcome") == "Saved", F.lit(False))
    error = F.coalesce(F.col("goalkeeper_outcome").isin(*ERRORS), F.lit(False))
    play = lambda which: F.when(n > 0, F.count_if(~penalty & which))
    pen = lambda which: F.when(n_pen > 0, F.count_if(penalty & which))
    psxg = F.sum(F.when(~penalty, F.col("psxg")))
    return links.groupBy("player_id").agg(
        play(saved | goal).alias("gk_shots_on_target_against"),
        play(saved).alias("gk_saves"),
        C.ratio(F.count_if(~penalty & saved), F.count_if(~penalty & (saved | goal))).alias("gk_save_pct"),
        play(goal).alias("gk_goals_conceded_shots"),
        psxg.alias("gk_psxg_faced"),
        (psxg if prevented_given else psxg - F.count_if(~penalty & goal)).alias("gk_goals_prevented"),
        play(error).alias("gk_errors_leading_to_shot"),
        play(error & goal).alias("gk_errors_leading_to_goal"),
        play(F.coalesce((F.col("shot_type") == "Open Play") & (F.col("x") < BOX_LINE), F.lit(False))).alias("gk_shots_open_play_in_box_against"),
        F.when(n_pen > 0, n_pen).alias("gk_penalties_faced"),
        pen(saved).alias("gk_penalties_saved"),
        pen(goal).alias("gk_penalties_conceded"),
        C.ratio(F.count_if(penalty & saved), n_pen).alias("gk_penalty_save_pct"),
        F.sum(F.when(penalty, F.col("psxg"))).alias("gk_penalties_psxg"),
    )


def ball_sums() -> list[Column]:
    """Passing, play outside the box and claims, and whether a player acted as keeper."""
    passed = F.col("type") == "Pass"
    done = passed & F.col("pass_outcome").isNull()
    long_ = passed & F.coalesce(F.col("pass_length") > LONG_BALL, F.lit(False))
    pressed = passed & F.coalesce(F.col("x") < DEFENSIVE_THIRD, F.lit(False)) & C.truthy(F.col("under_pressure"))
    n = F.count_if(passed)
    return [
        F.bool_or(_acts()).alias("acted"),
        C.ratio(F.count_if(done), n).alias("gk_pass_completion_pct"),
        F.sum(F.when(passed, F.coalesce("obv_total_net", F.lit(0.0)))).alias("gk_pass_obv"),
        C.ratio(F.count_if(long_), n).alias("gk_long_ball_pct"),
        F.when(n > 0, F.count_if(pressed)).alias("gk_pressured_passes_def_third"),
        C.ratio(F.count_if(pressed & done), F.count_if(pressed)).alias("gk_pressured_passes_def_third_completion_pct"),
        F.count_if(F.col("x") > BOX_LINE).alias("gk_actions_outside_box"),
        F.avg("x").alias("gk_aggressive_distance_avg"),
        F.count_if(F.col("goalkeeper_outcome") == "Claim").alias("gk_claims"),
    ]


#: The columns of ball_sums that are output.
BALL = "gk_pass_completion_pct gk_pass_obv gk_long_ball_pct gk_pressured_passes_def_third gk_pressured_passes_def_third_completion_pct gk_actions_outside_box gk_aggressive_distance_avg gk_claims".split()


def on_the_ball(events: DataFrame) -> DataFrame:
    """ball_sums of every player, in one aggregation."""
    return events.where("player_id is not null").groupBy("player_id").agg(*ball_sums())


def own_goals(events: DataFrame, ids: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Own goals against the team that each player, or each of ids, first appears for in a match.

    seen gives (match_id, player_id, seen_team) where that is known already, so that the log is read for own goals only.
    """
    own = events.where("type = 'Own Goal Against'").groupBy("match_id", "team").agg(F.count("*").alias("n"))
    if seen is None:
        rows = events.where("player_id is not null")
        seen = rows.groupBy("match_id", "player_id").agg(F.min_by("team", F.struct("period", "idx")).alias("seen_team"))
    if ids is not None:
        seen = seen.join(ids, "player_id", "left_semi")
    met = seen.select("match_id", "player_id", F.col("seen_team").alias("team")).join(own, ["match_id", "team"])
    return met.groupBy("player_id").agg(F.sum("n").alias("gk_own_goals_against"))


#: The order of the output columns; totals with a rate per 90 minutes are marked by it.
OUTPUT = (
    "gk_save_pct gk_shots_on_target_against gk_saves gk_psxg_faced gk_goals_prevented gk_errors_leading_to_shot gk_errors_leading_to_goal "
    "gk_shots_on_target_against_per90 gk_saves_per90 gk_psxg_faced_per90 gk_goals_prevented_per90 gk_errors_leading_to_shot_per90 gk_errors_leading_to_goal_per90 "
    "gk_goals_conceded_shots gk_goals_conceded_total gk_own_goals_against gk_goals_conceded_per90 gk_own_goals_against_per90 gk_penalty_save_pct "
    "gk_penalties_faced gk_penalties_saved gk_penalties_conceded gk_penalties_psxg gk_penalties_faced_per90 gk_penalties_saved_per90 gk_penalties_conceded_per90 "
    "gk_shots_open_play_in_box_against gk_claims gk_shots_open_play_in_box_against_per90 gk_claims_per90 gk_pass_completion_pct gk_long_ball_pct "
    "gk_pressured_passes_def_third_completion_pct gk_pass_obv gk_pressured_passes_def_third gk_pass_obv_per90 gk_pressured_passes_def_third_per90 "
    "gk_actions_outside_box gk_actions_outside_box_per90 gk_aggressive_distance_avg"
).split()
RATED = {c: "gk_goals_conceded_total" if c == "gk_goals_conceded_per90" else c.removesuffix("_per90") for c in OUTPUT if c.endswith("_per90")}


def _rounded(df: DataFrame, name: str, places: int | None) -> Column:
    return C.round4(F.col(name), places).alias(name) if dict(df.dtypes)[name] == "double" else F.col(name)


def keeper_parts(events: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(player_id, what keepers faced, own goals): the parts that need other events than a player's own."""
    links = shot_links(events, penalties=None)
    return faced(links, psxg_column(events.columns) == PSXG[0]).join(own_goals(events, seen=seen), "player_id", "full")


def keeper_columns(df: DataFrame, places: int | None = 4) -> dict[str, Column]:
    """All keeper columns of OUTPUT over a table with their parts, primary_position, total_minutes and acted; null for others than keepers."""
    kept = (F.col("total_minutes") > 0) & (F.coalesce("acted", F.lit(False)) | F.coalesce(F.col("primary_position") == "Goalkeeper", F.lit(False)))
    whole = {c: F.coalesce(c, F.lit(0)) for c in ("gk_goals_conceded_shots", "gk_own_goals_against")}
    whole["gk_goals_conceded_total"] = whole["gk_goals_conceded_shots"]
    of = lambda c: whole.get(c, F.col(c))
    doubles = {n for n, t in df.dtypes if t == "double"} | set(RATED)
    value = lambda c: C.per90(of(RATED[c]), F.col("total_minutes")) if c in RATED else of(c)
    return {c: F.when(kept, C.round4(value(c), places) if c in doubles else value(c)) for c in OUTPUT}


def keeper_metrics(events: DataFrame, summary: DataFrame, places: int | None = 4) -> DataFrame:
    """All keeper metrics of those with minutes, in the order of OUTPUT, doubles to four places (None: as they are).

    Each part is one aggregation by player; who kept goal is told by the first of them and the main position.
    """
    mine = on_the_ball(events).join(summary.select("player_id", "primary_position", "total_minutes"), "player_id", "right")
    base = mine.where("total_minutes > 0 and (acted or primary_position = 'Goalkeeper')").join(keeper_parts(events), "player_id", "left")
    return base.select("player_id", *[v.alias(c) for c, v in keeper_columns(base, places).items()])
