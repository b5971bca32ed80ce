"""The player season table, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import pitch as P
from ..sources.scratch import settle
from . import keeper, lanes, metrics, minutes, normalize, turnovers, zones

#: The columns that come first.
BASE = "player_id player_name primary_position all_positions teams total_minutes minutes_primary_position primary_position_share matches_played times_starter".split()
#: Counts that are rated after the others.
COUNTED = ("total_shots", "total_touches", "touches_in_opp_box", "complete_passes")
RATIOS = "duel_win_pct tackle_success_pct ball_recovery_success_pct duel_success_rate aerial_duel_success_rate interception_success_rate pass_completion_rate".split()
COMPOSITES = "defensive_actions_lost_per90 clearances_total_per90 blocks_total_per90".split()
TOUCHES = "xg_per_shot shot_touch_pct touches_in_opp_box touches_in_opp_box_pct".split()


def player_season(events: DataFrame, lineup: DataFrame, on: DataFrame, off: DataFrame, break_down: dict[str, list[str]], turnover_kinds: list[str], value_metrics: tuple[str, ...] = metrics.SPLIT_METRICS, third_types: tuple[str, ...] = metrics.THIRD_TYPES, zone_types: tuple[str, ...] = zones.DEFENSIVE, least_passes: int = 50, size: tuple[float, float] | None = None, flags: list[str] | None = None, lost_duels: tuple[str, ...] = metrics.LOST_DUELS, places: int | None = 4) -> DataFrame:
    """One row per player with minutes: totals, breakdowns, rates per 90 minutes, turnovers, lanes, zones and keeping.

    Text columns of true and false count as 0 and 1 and are summed with the numeric metrics. break_down gives the values of
    each column to break down by, flags the columns of true and false, size the pitch; what is not given is found in one
    pass each. Lanes and zones are measured on the standard pitch. Zone and keeper values are rounded to places.

    Appearances, their summary and the totals are each written once, so that the log is read once for appearances, once for
    all of a player's own totals, and once for each part that needs other events (turnovers, zones, shots faced). What is
    left is a join of small tables by player, with all rates in one projection.
    """
    if size is None:
        size = tuple(P.pitch_size(events).first())
    length, width = size
    seen = settle(minutes.appearances(events, lineup, on, off), "appearances")
    summary = settle(minutes.minutes_summary(seen), "summary")

    coded = normalize.encode_flags(events, flags)
    numeric = normalize.metric_columns(coded)
    split = list(value_metrics)
    parts = metrics.breakdown_sums({c: v for c, v in break_down.items() if c not in metrics.COUNT_ONLY}, split)
    parts += metrics.breakdown_counts({c: v for c, v in break_down.items() if c in metrics.COUNT_ONLY})
    parts += metrics.thirds(split[:1], third_types, length) + metrics.open_play_crosses(split[:1], length)
    sums = metrics.totals(numeric) + metrics.final_third(length) + metrics.event_counts(coded.columns)
    rest = metrics.pass_completion() + metrics.outcome_rates(coded.columns) + metrics.shots_and_touches(length=length, width=width)
    mine = lanes.lane_sums() + keeper.ball_sums()
    table = settle(metrics.season_table(coded, sums + parts + rest + mine), "totals")

    lost = turnovers.turnover_counts(turnovers.turnovers(events), turnover_kinds)
    damage = zones.zone_damage(events, zones.zone_rectangles(events, types=zone_types), summary, places=places)
    met = summary.join(table, "player_id").join(lost, "player_id", "left").join(damage, "player_id", "left").join(keeper.keeper_parts(events, seen), "player_id", "left")

    losses, ratios = lost.columns[1:], metrics.ratio_columns(table.columns)
    apart = {"player_id", "acted", "obv_from_ext", "obv_from_int", *RATIOS, *TOUCHES, *COUNTED, *keeper.BALL, "total_passes", "incomplete_passes"}
    own = [c for c in (*table.columns, *losses, "foul_committed") if c not in apart]
    broken = [c for c in own if any(c.startswith((f"{m}_{d}_", f"{m}_third_")) for m in split for d in break_down) or c.startswith("n_events_")]
    plain = [c for c in own if c not in set(broken)]
    made = ratios | keeper.keeper_columns(met, places)
    made["lane_bias_index"] = lanes.lane_index(F.col("obv_from_ext"), F.col("obv_from_int"), F.col("total_passes"), least_passes)
    met = met.withColumns(made)
    # The rest is written as SQL: a projection of hundreds of columns, built call by call, would keep the driver busy.
    column = {c: C.named(c) for c in met.columns} | {c: f"coalesce({C.named(c)}, 0)" for c in losses}
    rates = {f"{c}_per90": f"CASE WHEN total_minutes > 0 THEN {column[c]} / total_minutes * 90 END" for c in (*plain, *broken, *COUNTED, "obv_from_ext", "obv_from_int")}
    column |= rates | metrics.composite_sql(rates, lost_duels)
    order = [*BASE, *plain, *RATIOS, *broken, *[f"{c}_per90" for c in (*plain, *broken)], *COMPOSITES, *TOUCHES, "total_passes", "incomplete_passes", *COUNTED, *[f"{c}_per90" for c in COUNTED], *lanes.OUTPUT, *zones.OUTPUT, *keeper.OUTPUT]
    return met.selectExpr(*[f"{column[c]} AS {C.named(c)}" for c in dict.fromkeys(order) if c in column])


def minutes_export(played: DataFrame, players: DataFrame) -> DataFrame:
    """Minutes by match beside the player's name and main position."""
    return played.join(players.select("player_id", *[c for c in ("player_name", "primary_position") if c in players.columns]), "player_id", "left")
