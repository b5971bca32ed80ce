"""Totals, breakdowns, rates and success ratios of players, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import pitch as P
from . import ranking

#: Columns and event types that the season table is broken down by.
BREAK_DOWN = ("type", "pass_height", "pass_type", "pass_switch", "duel_type", "shot_type", "play_pattern")
COUNT_ONLY = ("duel_outcome", "interception_outcome", "pass_outcome")
SPLIT_METRICS = ("obv_total_net", "shot_statsbomb_xg")
THIRD_TYPES = ("Carry", "Pass", "Ball Recovery", "Duel", "Interception", "Pressure", "Dispossessed")
NO_TOUCH = ("Starting XI", "Half Start", "Half End", "Substitution", "Player Off", "Player On", "Tactical Shift", "Injury Stoppage", "Bad Behaviour", "Referee Ball-Drop", "Shield", "Own Goal Against", "Own Goal For", "Error", "Offside")
#: Most values of a column that may become output columns.
MOST_VALUES = 500


def breakdown_values(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The values of each column, in one job; more than MOST_VALUES of one column are refused."""
    row = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns]).first()
    found = {c: row[c] for c in columns}
    for c, values in found.items():
        if len(values) > MOST_VALUES:
            raise ValueError(f"{c} has {len(values)} values; give the ones to break down by")
    return found


def totals(metrics: list[str]) -> list[Column]:
    """Sums that are null where all values are."""
    return [F.expr(f"sum({C.named(m)}) AS {C.named(m)}") for m in metrics]


# Hundreds of generated columns are written as SQL expressions: built call by call they would keep the driver busy for seconds.


def _sum_where(test: str, metric: str, name: str) -> Column:
    return F.expr(f"coalesce(sum(CASE WHEN {test} THEN {C.named(metric)} END), 0.0D) AS {C.named(name)}")


def _count_where(test: str, name: str) -> Column:
    return F.expr(f"count_if({test}) AS {C.named(name)}")


def breakdown_sums(values: dict[str, list[str]], metrics: list[str]) -> list[Column]:
    return [
        _sum_where(f"CAST({C.named(c)} AS STRING) = {C.text(v)}", m, f"{m}_{c}_{C.name_part(v)}")
        for c, own in values.items()
        for v in own
        for m in metrics
    ]


def breakdown_counts(values: dict[str, list[str]]) -> list[Column]:
    return [_count_where(f"CAST({C.named(c)} AS STRING) = {C.text(v)}", f"n_events_{c}_{C.name_part(v)}") for c, own in values.items() for v in own]


def thirds(metrics: list[str], types: tuple[str, ...] = THIRD_TYPES, length: float = P.LENGTH) -> list[Column]:
    """Sums and counts by third of the pitch and event type."""
    out = []
    for part in ("defensive", "middle", "attacking"):
        for t in types:
            here = f"{P.third_sql('x', length)} = '{part}' AND `type` = {C.text(t)}"
            out += [_sum_where(here, m, f"{m}_third_{part}_{C.name_part(t)}") for m in metrics]
            out.append(_count_where(here, f"n_events_third_{part}_{C.name_part(t)}"))
    return out


def open_play_crosses(metrics: list[str], length: float = P.LENGTH) -> list[Column]:
    here = (F.col("type") == "Pass") & C.truthy(F.col("pass_cross")) & (P.third(F.col("x"), length) == "attacking") & (F.col("play_pattern") == "Regular Play")
    name = "third_attacking_pass_cross_openplay"
    return [F.coalesce(F.sum(F.when(here, F.col(m))), F.lit(0.0)).alias(f"{m}_{name}") for m in metrics] + [F.count_if(here).alias(f"n_events_{name}")]


def season_table(events: DataFrame, aggregates: list[Column], key: str = "player_id") -> DataFrame:
    """All aggregates of a player in one shuffle."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)


def breakdown_statistics(df: DataFrame, columns: list[str], key: str = "player_id") -> DataFrame:
    """(column, value, events, players) of every breakdown."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(key, pairs.alias("b")).where("b.value is not null").groupBy("b.column", "b.value").agg(F.count("*").alias("events"), F.countDistinct(key).alias("players"))


def pass_completion(outcome: str = "pass_outcome") -> list[Column]:
    own = F.col("type") == "Pass"
    total, missed = F.count_if(own), F.count_if(own & F.col(outcome).isNotNull())
    return [total.alias("total_passes"), missed.alias("incomplete_passes"), (total - missed).alias("complete_passes"), C.ratio(total - missed, total).alias("pass_completion_rate")]


def success_rate(good: Column, bad: Column, name: str) -> Column:
    """Share of rows counted as good among those counted as good or bad."""
    won, lost = F.count_if(good), F.count_if(bad)
    return C.ratio(won, won + lost).alias(name)


def outcome_rates(columns: list[str], duel_won: str = "Won", duel_lost: str = "Lost In Play", caught_won: str = "Won", caught_lost: str = "Lost In Play") -> list[Column]:
    """Success of duels, tackles, aerial duels and interceptions by the outcomes of their events, as far as the columns exist.

    duel_success_rate and interception_success_rate take one outcome as won and one as lost, which the caller may name.
    tackle_success_pct takes all duels: won, success in play or success out against lost in play or lost out. Aerial
    duels are those whose type says so.
    """
    out = []
    if "duel_outcome" in columns:
        duel = F.col("duel_outcome")
        part = F.translate(F.lower(duel), " -", "__")
        won = F.contains(part, F.lit("won")) | F.contains(part, F.lit("success_in_play")) | F.contains(part, F.lit("success_out"))
        out += [success_rate(won, ~won & (F.contains(part, F.lit("lost_in_play")) | F.contains(part, F.lit("lost_out"))), "tackle_success_pct"), success_rate(duel == duel_won, duel == duel_lost, "duel_success_rate")]
        if "duel_type" in columns:
            high, good = F.contains(F.lower("duel_type"), F.lit("aerial")), F.contains(part, F.lit("won")) | F.contains(part, F.lit("success"))
            out.append(success_rate(high & good, high & ~good & F.contains(part, F.lit("lost")), "aerial_duel_success_rate"))
    if "interception_outcome" in columns:
        caught = F.col("interception_outcome")
        out.append(success_rate(caught == caught_won, caught == caught_lost, "interception_success_rate"))
    return out


def event_counts(columns: list[str]) -> list[Column]:
    """Counts of kinds of events that some sources carry as columns of their own; only those that this one lacks."""
    kind = F.col("type")
    each = {
        "pressure": (("type",), lambda: kind == "Pressure"),
        "duel_tackle": (("duel_type",), lambda: F.col("duel_type") == "Tackle"),
        "completed_passes_under_pressure": (("pass_outcome", "under_pressure"), lambda: (kind == "Pass") & F.col("pass_outcome").isNull() & C.truthy(F.col("under_pressure"))),
        "goals": (("shot_outcome",), lambda: (kind == "Shot") & (F.col("shot_outcome") == "Goal")),
    }
    return [F.count_if(which()).alias(name) for name, (needs, which) in each.items() if name not in columns and set(needs) <= set(columns)]


#: The columns that make up fouls, clearances and blocks.
FOULS = ("foul_committed_advantage", "foul_committed_penalty", "foul_committed_offensive")
CLEARANCES = ("clearance_aerial_won", "clearance_head", "clearance_left_foot", "clearance_right_foot", "clearance_other")
BLOCKS = ("block_deflection", "block_save_block")
#: The outcome whose duels count as lost defensive actions; more may be named.
LOST_DUELS = ("Lost In Play",)


def ratio_columns(columns: list[str]) -> dict[str, Column]:
    """Ratios and sums of totals: duel_win_pct, ball_recovery_success_pct and foul_committed, as far as their parts exist.

    Fouls are 0 without parts, and null parts count as zero; a ratio with a null part is null.
    """
    added = {}
    for name, good, bad in (("duel_win_pct", "duel_won", "duel_lost"), ("ball_recovery_success_pct", "ball_recovery_offensive", "ball_recovery_recovery_failure")):
        if good in columns and bad in columns:
            added[name] = C.ratio(F.col(good), F.col(good) + F.col(bad))
    fouls = [F.col(f"`{n}`") for n in FOULS if n in columns]
    return added | {"foul_committed": C.sum_or_zero(*fouls) if fouls else F.lit(0.0)}


def total_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(ratio_columns(df.columns))


def composite_sql(rates: dict[str, str], lost_duels: tuple[str, ...] = LOST_DUELS) -> dict[str, str]:
    """Rates made of rates, as SQL over theirs: lost duels and fouls, clearances, and blocks per 90 minutes, null parts as zero."""
    parts = {
        "defensive_actions_lost_per90": [*(f"n_events_duel_outcome_{C.name_part(v)}_per90" for v in lost_duels), "foul_committed_per90"],
        "clearances_total_per90": [f"{c}_per90" for c in CLEARANCES],
        "blocks_total_per90": [f"{c}_per90" for c in BLOCKS],
    }
    return {name: " + ".join(f"coalesce({rates[n]}, 0.0D)" for n in names if n in rates) for name, names in parts.items() if any(n in rates for n in names)}


def composites(df: DataFrame, lost_duels: tuple[str, ...] = LOST_DUELS) -> DataFrame:
    found = composite_sql({c: C.named(c) for c in df.columns}, lost_duels)
    return df.withColumns({name: F.expr(text) for name, text in found.items()})


def shots_and_touches(xg: str = "shot_statsbomb_xg", length: float = P.LENGTH, width: float = P.WIDTH) -> list[Column]:
    shot, touch = F.col("type") == "Shot", ~F.coalesce(F.col("type").isin(*NO_TOUCH), F.lit(False))
    shots, touches = F.count_if(shot), F.count_if(touch)
    box = F.count_if(touch & P.in_box(F.col("x"), F.col("y"), length, width))
    return [
        shots.alias("total_shots"),
        C.ratio(F.sum(F.when(shot, F.col(xg))), shots).alias("xg_per_shot"),
        touches.alias("total_touches"),
        C.ratio(shots, touches).alias("shot_touch_pct"),
        box.alias("touches_in_opp_box"),
        C.ratio(box, touches).alias("touches_in_opp_box_pct"),
    ]


def final_third(length: float = P.LENGTH) -> list[Column]:
    return [
        F.sum(P.into_final_third(F.col("type"), "Pass", F.col("pass_end_x"), length)).alias("pass_into_final_third"),
        F.sum(P.into_final_third(F.col("type"), "Carry", F.col("carry_end_x"), length)).alias("carry_into_final_third"),
    ]


def with_rates(totals_: DataFrame, minutes: DataFrame, metrics: list[str]) -> DataFrame:
    """Totals beside minutes, and every metric per 90 minutes."""
    joined = totals_.join(minutes, "player_id", "left")
    return joined.withColumns({f"{m}_per90": C.per90(F.col(f"`{m}`"), F.col("total_minutes")) for m in metrics})


def run_report(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n, mean, median, least, most) of a table's metrics."""
    long = df.unpivot([], metrics, "metric", "value")
    middle = ranking.quantiles(long, ["metric"], "value", [0.5]).select("metric", F.get("q", F.lit(0)).alias("median"))
    told = long.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return told.join(middle, "metric", "left").select("metric", "n", "mean", "median", "least", "most")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)
