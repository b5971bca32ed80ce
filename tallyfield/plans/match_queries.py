"""Queries of the match log and their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import pitch as P
from ..operators import keeper, lanes, metrics, minutes, normalize, ranking, scoring, season, specs, turnovers, zones
from ..sources import tables
from ..sources.scratch import scratch, settle
from .adapters import FLAGS, POSITIONS, lineups, match_sql, match_view

TYPES = ("Pass", "Carry", "Dribble", "Shot", "Pressure", "Ball Recovery", "Interception", "Clearance", "Block", "Foul Committed", "Duel", "Goal Keeper")
PATTERNS = ("Regular Play", "From Throw In", "From Corner")
SPLIT = ["obv_total_net", "shot_statsbomb_xg"]
DUEL_TYPES, SHOT_TYPES = ("Tackle", "Aerial Lost"), ("Penalty", "Open Play")
DUEL_OUTCOMES = ("Won", "Lost In Play", "Lost Out")
CAUGHT = ("Won", "Lost In Play", "Success Out")
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = match_sql(sql)
        return f

    return register


def rounded(df: DataFrame, places: int = 4, nudge: float | None = None) -> DataFrame:
    """Doubles to so many places; a nudge takes decimal ties, and minus zero, off the edge, so that the order of sums decides nothing."""
    shown = f"round({{0}}, {places})" if nudge is None else f"round({{0}} + {nudge!r}D, {places}) + 0.0D"
    return df.selectExpr(*[f"{(shown if t == 'double' else '{0}').format(C.named(c))} AS {C.named(c)}" for c, t in df.dtypes])


def _played(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = match_view(spark, sf_dir)
    return events, minutes.minutes_played(events, *lineups(events)).withColumn("season", F.lit("2024_2025"))


def _summary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events, played = _played(spark, sf_dir)
    return events, minutes.minutes_summary(played)


def _case(value: str, column: str, then: str) -> str:
    return f"CASE WHEN {column} = '{value}' THEN {then} END"


@query("SELECT player_id, round(sum(obv_total_net), 4) AS obv_total_net, round(sum(shot_statsbomb_xg), 4) AS shot_statsbomb_xg, " + ", ".join(f"round(coalesce(sum({_case(v, c, m)}), 0), 4) AS {m}_{c}_{C.name_part(v)}" for c, own in (("type", TYPES), ("play_pattern", PATTERNS)) for v in own for m in SPLIT) + " FROM ev GROUP BY player_id")
def breakdown_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"type": list(TYPES), "play_pattern": list(PATTERNS)}
    return rounded(metrics.season_table(match_view(spark, sf_dir), metrics.totals(SPLIT) + metrics.breakdown_sums(values, SPLIT)))


@query("SELECT player_id, " + ", ".join(f"count({_case(v, c, '1')}) AS n_events_{c}_{C.name_part(v)}" for c, own in (("duel_outcome", ("Lost In Play", "Lost Out", "Won")), ("pass_outcome", ("Incomplete",))) for v in own) + " FROM ev GROUP BY player_id")
def breakdown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = match_view(spark, sf_dir)
    return metrics.season_table(events, metrics.breakdown_counts(metrics.breakdown_values(events, ["duel_outcome", "pass_outcome"])))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS events, count(DISTINCT player_id) AS players FROM ev WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("type", "play_pattern", "duel_type", "shot_type")))
def breakdown_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.breakdown_statistics(match_view(spark, sf_dir), ["type", "play_pattern", "duel_type", "shot_type"])


THIRD = "CASE WHEN x < 40 THEN 'defensive' WHEN x < 80 THEN 'middle' ELSE 'attacking' END"


@query(f"SELECT player_id, " + ", ".join(f"round(coalesce(sum(CASE WHEN {THIRD} = '{p}' AND type = '{t}' THEN obv_total_net END), 0), 4) AS obv_total_net_third_{p}_{C.name_part(t)}, count(CASE WHEN {THIRD} = '{p}' AND type = '{t}' THEN 1 END) AS n_events_third_{p}_{C.name_part(t)}" for p in ("defensive", "middle", "attacking") for t in ("Carry", "Pass", "Duel", "Pressure")) + f", round(coalesce(sum(CASE WHEN {THIRD} = 'attacking' AND type = 'Pass' AND pass_cross AND play_pattern = 'Regular Play' THEN obv_total_net END), 0), 4) AS obv_total_net_third_attacking_pass_cross_openplay, count(CASE WHEN {THIRD} = 'attacking' AND type = 'Pass' AND pass_cross AND play_pattern = 'Regular Play' THEN 1 END) AS n_events_third_attacking_pass_cross_openplay FROM ev GROUP BY player_id")
def thirds_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = metrics.thirds(["obv_total_net"], ("Carry", "Pass", "Duel", "Pressure")) + metrics.open_play_crosses(["obv_total_net"])
    return rounded(metrics.season_table(match_view(spark, sf_dir), own))


def _rate(good: str, bad: str, places: int | None = 6) -> str:
    share = f"CASE WHEN count(CASE WHEN {good} OR {bad} THEN 1 END) > 0 THEN count(CASE WHEN {good} THEN 1 END) / count(CASE WHEN {good} OR {bad} THEN 1 END) END"
    return share if places is None else f"round({share}, {places})"


#: Share of events counted as good among those counted as good or bad.
RATES = {
    "pass_completion_rate": ("type = 'Pass' AND pass_outcome IS NULL", "type = 'Pass' AND pass_outcome IS NOT NULL"),
    "duel_success_rate": ("duel_outcome = 'Won'", "duel_outcome = 'Lost In Play'"),
    "tackle_success_pct": ("duel_outcome = 'Won'", "duel_outcome IN ('Lost In Play', 'Lost Out')"),
    "aerial_duel_success_rate": ("duel_type = 'Aerial Lost' AND duel_outcome = 'Won'", "duel_type = 'Aerial Lost' AND duel_outcome IN ('Lost In Play', 'Lost Out')"),
    "interception_success_rate": ("interception_outcome = 'Won'", "interception_outcome = 'Lost In Play'"),
}


@query("""SELECT player_id, count(CASE WHEN type = 'Pass' THEN 1 END) AS total_passes, count(pass_outcome) AS incomplete_passes,
  count(CASE WHEN type = 'Pass' THEN 1 END) - count(pass_outcome) AS complete_passes, """ + ", ".join(f"{_rate(*w)} AS {n}" for n, w in RATES.items()) + " FROM ev GROUP BY player_id")
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = match_view(spark, sf_dir)
    return rounded(metrics.season_table(events, metrics.pass_completion() + metrics.outcome_rates(events.columns)), 6)


@query("""SELECT player_id, count(shot_outcome) AS total_shots, round(sum(shot_statsbomb_xg) / count(shot_outcome), 6) AS xg_per_shot, count(*) AS total_touches, round(count(shot_outcome) / count(*), 6) AS shot_touch_pct,
  count(CASE WHEN x >= 102 AND y BETWEEN 18 AND 62 THEN 1 END) AS touches_in_opp_box, round(count(CASE WHEN x >= 102 AND y BETWEEN 18 AND 62 THEN 1 END) / count(*), 6) AS touches_in_opp_box_pct FROM ev GROUP BY player_id""")
def shots_and_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.season_table(match_view(spark, sf_dir), metrics.shots_and_touches()), 6)


@query("SELECT player_id, CAST(count(CASE WHEN type = 'Pass' AND end_x >= 80 THEN 1 END) AS DOUBLE) AS pass_into_final_third, CAST(count(CASE WHEN type = 'Carry' AND end_x >= 80 THEN 1 END) AS DOUBLE) AS carry_into_final_third FROM ev GROUP BY player_id")
def final_third(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.season_table(match_view(spark, sf_dir), metrics.final_third())


@query("SELECT round(quantile_cont(x, 0.995), 6) AS length, round(quantile_cont(y, 0.995), 6) AS width FROM ev")
def pitch_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.dimensions(match_view(spark, sf_dir)), 6)


@query("SELECT match_id, player_id, team, CAST(minutes AS BIGINT) AS minutes, starter, position_match FROM pmm")
def minutes_played(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _played(spark, sf_dir)[1].drop("season")


@query("SELECT player_id, total_minutes, matches_played, times_starter, '2024_2025' AS seasons, primary_position, total_minutes AS minutes_primary_position, CAST(1 AS DOUBLE) AS primary_position_share FROM pms")
def minutes_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)[1].withColumn("seasons", F.array_join("seasons", ","))


@query("SELECT t.player_id, total_minutes, round(obv / total_minutes * 90, 6) AS obv_total_net_per90, round(shots / total_minutes * 90, 6) AS shots_per90 FROM (SELECT player_id, sum(obv_total_net) AS obv, count(shot_outcome) AS shots FROM ev GROUP BY player_id) t LEFT JOIN pms ON t.player_id = pms.player_id")
def per90_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, summary = _summary(spark, sf_dir)
    own = metrics.season_table(events, [F.sum("obv_total_net").alias("obv_total_net"), F.count("shot_outcome").alias("shots")])
    rated = metrics.with_rates(own, summary.select("player_id", "total_minutes"), ["obv_total_net", "shots"])
    return rounded(rated.select("player_id", "total_minutes", "obv_total_net_per90", "shots_per90"), 6)


TURNOVER_SQL = """, led AS (
  SELECT *, lead(possession_team) OVER o AS np, lead(play_pattern) OVER o AS npp, lead(idx) OVER o AS next_idx, lead(team) OVER o AS next_team, lead(type) OVER o AS next_type FROM ev WINDOW o AS (PARTITION BY match_id ORDER BY period, idx)),
lost AS (
  SELECT *, CASE WHEN type = 'Pass' THEN CASE WHEN pass_outcome IS NULL THEN 'Pass' ELSE 'Pass: ' || pass_outcome END WHEN type = 'Duel' THEN 'Duel: ' || duel_outcome ELSE type END AS turnover_how
  FROM led WHERE team = possession_team AND possession_team <> np AND play_pattern = 'Regular Play' AND coalesce(npp NOT IN ('From Corner', 'From Throw In'), TRUE) AND type NOT IN ('Shot', 'Foul Committed') AND player_id IS NOT NULL)
"""


@query(TURNOVER_SQL + "SELECT match_id, period, idx, player_id, team, type, possession_team AS turnover_team_lost, np AS turnover_team_won, turnover_how, next_idx, next_team, next_type FROM lost")
def turnover_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnovers.turnovers(match_view(spark, sf_dir)).select("match_id", "period", "idx", "player_id", "team", "type", "turnover_team_lost", "turnover_team_won", "turnover_how", "next_idx", "next_team", "next_type")


KINDS = ["Pass", "Pass: Incomplete", "Carry", "Dribble", "Pressure", "Ball Recovery", "Interception", "Clearance", "Block", "Duel: Won", "Duel: Lost In Play", "Duel: Lost Out", "Goal Keeper"]


@query(TURNOVER_SQL + "SELECT player_id, count(*) AS total_turnovers, " + ", ".join(f"count({_case(k, 'turnover_how', '1')}) AS turnovers_{C.turnover_part(k)}" for k in KINDS) + " FROM lost GROUP BY player_id")
def turnover_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnovers.turnover_counts(turnovers.turnovers(match_view(spark, sf_dir)), KINDS)


LANE_SQL = """, made AS (
  SELECT player_id, sum(CASE WHEN l IN (1, 5) THEN o ELSE 0 END) AS e, sum(CASE WHEN l NOT IN (1, 5) THEN o ELSE 0 END) AS i
  FROM (SELECT player_id, obv_total_net AS o, least(5, CAST(floor(y / 16) AS INT) + 1) AS l FROM ev) GROUP BY player_id),
passed AS (SELECT player_id, count(*) AS passes FROM ev WHERE type = 'Pass' GROUP BY player_id),
lane AS (
  SELECT made.player_id, e, i, total_minutes, coalesce(passes, 0) AS passes, CASE WHEN passes >= 5 THEN (i - e) / (abs(i) + abs(e) + 1e-9) END AS b
  FROM made JOIN pms ON made.player_id = pms.player_id LEFT JOIN passed ON made.player_id = passed.player_id)
"""


@query(LANE_SQL + "SELECT player_id, round(e, 4) AS obv_from_ext, round(i, 4) AS obv_from_int, round(e / total_minutes * 90, 4) AS obv_from_ext_per90, round(i / total_minutes * 90, 4) AS obv_from_int_per90, passes, round(b, 4) AS lane_bias_index FROM lane")
def lane_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lanes.lane_bias(*_summary(spark, sf_dir), least_passes=5))


@query(LANE_SQL + "SELECT player_id, CASE WHEN b IS NULL THEN 'Sin dato' WHEN b >= 0 THEN 'Interior' ELSE 'Exterior' END AS lane_influence_side, CASE WHEN b IS NULL THEN 'Sin dato' WHEN abs(b) < 0.1 THEN 'Balanceado' WHEN abs(b) < 0.25 THEN 'Tendencia ' || CASE WHEN b >= 0 THEN 'Interior' ELSE 'Exterior' END ELSE 'Marcado ' || CASE WHEN b >= 0 THEN 'Interior' ELSE 'Exterior' END END AS lane_profile FROM lane")
def lane_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.lane_profile(lanes.lane_bias(*_summary(spark, sf_dir), least_passes=5)).select("player_id", "lane_influence_side", "lane_profile")


KEEPER_SQL = """, kept AS (SELECT player_id, x, goalkeeper_outcome AS g, unnest([CAST(idx - 1 AS VARCHAR), CAST(idx - 2 AS VARCHAR)]) AS shot_id FROM ev WHERE type = 'Goal Keeper'),
links AS (SELECT kept.player_id, kept.x, g, shot_id, s.shot_outcome AS so, s.shot_type AS st, coalesce(s.shot_statsbomb_xg, 0) AS psxg FROM kept JOIN ev s ON s.id = shot_id AND s.type = 'Shot')
"""


@query(KEEPER_SQL + "SELECT player_id, shot_id, x, g AS goalkeeper_outcome, so AS shot_outcome, st AS shot_type, psxg FROM links WHERE st <> 'Penalty'")
def keeper_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeper.shot_links(match_view(spark, sf_dir)).select("player_id", "shot_id", "x", "goalkeeper_outcome", "shot_outcome", "shot_type", "psxg")


@query(KEEPER_SQL + """, stop AS (
  SELECT player_id, count(CASE WHEN so IN ('Saved', 'Goal') THEN 1 END) AS sot, count(CASE WHEN so = 'Saved' THEN 1 END) AS sv, count(CASE WHEN so = 'Goal' THEN 1 END) AS gl, sum(psxg) AS px,
    count(CASE WHEN g = 'No Catch' THEN 1 END) AS er, count(CASE WHEN g = 'No Catch' AND so = 'Goal' THEN 1 END) AS eg, count(CASE WHEN x < 18 AND st = 'Open Play' THEN 1 END) AS bx FROM links WHERE st <> 'Penalty' GROUP BY player_id),
pen AS (SELECT player_id, count(*) AS pf, count(CASE WHEN so = 'Saved' THEN 1 END) AS ps, count(CASE WHEN so = 'Goal' THEN 1 END) AS pg FROM links WHERE st = 'Penalty' GROUP BY player_id),
foot AS (
  SELECT player_id, count(CASE WHEN type = 'Pass' THEN 1 END) AS n, count(CASE WHEN type = 'Pass' AND pass_outcome IS NULL THEN 1 END) AS ok, sum(CASE WHEN type = 'Pass' THEN obv_total_net END) AS po, count(CASE WHEN type = 'Pass' AND pass_length > 32 THEN 1 END) AS lg,
    count(CASE WHEN x > 18 THEN 1 END) AS ob, avg(x) AS ax, count(CASE WHEN goalkeeper_outcome = 'Claim' THEN 1 END) AS cl FROM ev WHERE position = 'Goalkeeper' GROUP BY player_id)
SELECT foot.player_id, round(sv / nullif(sot, 0), 4) AS gk_save_pct, sot AS gk_shots_on_target_against, round(px, 4) AS gk_psxg_faced, round(px - gl, 4) AS gk_goals_prevented, er AS gk_errors_leading_to_shot, eg AS gk_errors_leading_to_goal,
  round(sv / total_minutes * 90, 4) AS gk_saves_per90, coalesce(gl, 0) AS gk_goals_conceded_total, pf AS gk_penalties_faced, round(ps / pf, 4) AS gk_penalty_save_pct, bx AS gk_shots_open_play_in_box_against, cl AS gk_claims,
  round(CASE WHEN n > 0 THEN ok / n END, 4) AS gk_pass_completion_pct, round(CASE WHEN n > 0 THEN lg / n END, 4) AS gk_long_ball_pct, round(po, 4) AS gk_pass_obv, ob AS gk_actions_outside_box, round(ax, 4) AS gk_aggressive_distance_avg
FROM foot JOIN pms ON foot.player_id = pms.player_id LEFT JOIN stop ON foot.player_id = stop.player_id LEFT JOIN pen ON foot.player_id = pen.player_id""")
def keeper_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = keeper.keeper_metrics(*_summary(spark, sf_dir))
    return own.select("player_id", *"gk_save_pct gk_shots_on_target_against gk_psxg_faced gk_goals_prevented gk_errors_leading_to_shot gk_errors_leading_to_goal gk_saves_per90 gk_goals_conceded_total gk_penalties_faced gk_penalty_save_pct gk_shots_open_play_in_box_against gk_claims gk_pass_completion_pct gk_long_ball_pct gk_pass_obv gk_actions_outside_box gk_aggressive_distance_avg".split())


@query("SELECT k.player_id, CAST(count(*) AS BIGINT) AS gk_own_goals_against FROM (SELECT DISTINCT player_id, match_id, team FROM ev WHERE position = 'Goalkeeper') k JOIN ev o ON o.match_id = k.match_id AND o.team = k.team AND o.type = 'Duel' AND o.idx % 50 = 0 GROUP BY k.player_id")
def own_goal_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = match_view(spark, sf_dir)
    ids = events.where("position = 'Goalkeeper'").select("player_id").distinct()
    own = events.withColumn("type", F.when((F.col("type") == "Duel") & (F.col("idx") % 50 == 0), "Own Goal Against").otherwise(F.col("type")))
    return keeper.own_goals(own, ids)


ZONE_SQL = """, act AS (SELECT match_id, player_id, team, x, y FROM ev WHERE type IN ('Pressure', 'Ball Recovery', 'Duel', 'Clearance', 'Block', 'Interception')),
mom AS (SELECT match_id, player_id, min(team) AS team, count(*) AS n_actions, avg(x) AS mu_x, avg(y) AS mu_y, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS th FROM act GROUP BY match_id, player_id HAVING count(*) >= 5),
uv AS (SELECT m.match_id, m.player_id, (x - mu_x) * cos(th) + (y - mu_y) * sin(th) AS u, (y - mu_y) * cos(th) - (x - mu_x) * sin(th) AS v FROM act JOIN mom m ON act.match_id = m.match_id AND act.player_id = m.player_id),
rng AS (SELECT match_id, player_id, quantile_cont(u, 0.15) AS u_lo, quantile_cont(u, 0.85) AS u_hi, quantile_cont(v, 0.15) AS v_lo, quantile_cont(v, 0.85) AS v_hi FROM uv GROUP BY match_id, player_id),
zone AS (SELECT mom.*, u_lo, u_hi, v_lo, v_hi FROM mom JOIN rng ON mom.match_id = rng.match_id AND mom.player_id = rng.player_id)
"""


@query(ZONE_SQL + "SELECT match_id, player_id, team, n_actions, round(mu_x, 4) AS mu_x, round(mu_y, 4) AS mu_y, round(u_hi - u_lo, 4) AS u_width, round(v_hi - v_lo, 4) AS v_width, round(abs(cos(th)), 4) AS axis FROM zone")
def zone_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = zones.zone_rectangles(match_view(spark, sf_dir))
    shown = own.select("match_id", "player_id", "team", "n_actions", "mu_x", "mu_y", (F.col("u_hi") - F.col("u_lo")).alias("u_width"), (F.col("v_hi") - F.col("v_lo")).alias("v_width"), F.abs("cos").alias("axis"))
    return rounded(shown)


@query(ZONE_SQL + """, met AS (
  SELECT z.match_id, z.player_id, e.possession, e.t, e.type, obv_total_net AS o, shot_statsbomb_xg AS g,
    ((120 - e.x) - mu_x) * cos(th) + ((80 - e.y) - mu_y) * sin(th) BETWEEN u_lo - 1e-9 AND u_hi + 1e-9 AND ((80 - e.y) - mu_y) * cos(th) - ((120 - e.x) - mu_x) * sin(th) BETWEEN v_lo - 1e-9 AND v_hi + 1e-9 AS inside
  FROM zone z JOIN ev e ON e.match_id = z.match_id AND e.team <> z.team),
con AS (SELECT *, min(CASE WHEN inside THEN t END) OVER (PARTITION BY match_id, player_id, possession) AS t0 FROM met)
SELECT con.player_id, count(DISTINCT match_id) AS zone_matches, round(coalesce(sum(CASE WHEN inside THEN o END), 0), 4) AS obv_into_area, round(coalesce(sum(CASE WHEN t >= t0 THEN o END), 0), 4) AS obv_from_area,
  count(CASE WHEN t >= t0 AND type = 'Shot' THEN 1 END) AS shots_from_area, round(coalesce(sum(CASE WHEN t >= t0 AND type = 'Shot' THEN g END), 0), 4) AS xg_from_area FROM con JOIN pms ON con.player_id = pms.player_id GROUP BY con.player_id""")
def zone_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, summary = _summary(spark, sf_dir)
    own = zones.zone_damage(events, zones.zone_rectangles(events), summary)
    return rounded(own.select("player_id", "zone_matches", "obv_into_area", "obv_from_area", "shots_from_area", "xg_from_area"))


@query("SELECT idx, k2 AS x, y AS y, player_id AS parsed_id, 'U' || player_id AS parsed_name, CAST(idx - 1 AS VARCHAR) AS first_related FROM (SELECT *, CAST(round(x) AS DOUBLE) AS k2 FROM ev)")
def parsed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as text, as event files hold them, and what comes out of them again."""
    v = match_view(spark, sf_dir)
    raw = v.select(
        "idx",
        F.format_string("[%d.0, %d]", F.round("x").cast("long"), F.col("y").cast("long")).alias("location"),
        F.format_string("{'id': %d, 'name': 'U%d', 'label': None}", "player_id", "player_id").alias("player"),
        F.format_string("['%d', '%d']", F.col("idx") - 1, F.col("idx") - 2).alias("related_events"),
    )
    out = normalize.normalize_events(raw)
    return out.select("idx", "x", "y", F.col("player_id").alias("parsed_id"), F.col("player_name").alias("parsed_name"), F.get("related_events", F.lit(0)).alias("first_related"))


@query("SELECT player_id, sum(CASE WHEN under_pressure THEN 1.0 ELSE 0.0 END)::DOUBLE AS under_pressure, sum(CASE WHEN pass_cross THEN 1.0 ELSE 0.0 END)::DOUBLE AS pass_cross FROM ev GROUP BY player_id")
def boolean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = normalize.encode_flags(match_view(spark, sf_dir).select("player_id", "under_pressure", "pass_cross", "team"))
    return metrics.season_table(coded, metrics.totals(["under_pressure", "pass_cross"]))


@query("SELECT DISTINCT player_id, position AS all_positions, team AS teams FROM ev")
def player_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = match_view(spark, sf_dir)
    return normalize.player_dimension(lineups(events)[0], events)


@query("SELECT CASE WHEN position = 'Goalkeeper' THEN 'Golero' WHEN position = 'Center Back' THEN 'Zaguero' WHEN position = 'Left Back' THEN 'Lateral' WHEN position = 'Center Defensive Midfield' THEN 'Volante' WHEN position = 'Center Midfield' THEN 'Interior/Mediapunta' WHEN position = 'Left Wing' THEN 'Extremo' ELSE 'Delantero' END AS position_group, count(*) AS events, count(DISTINCT player_id) AS players FROM ev GROUP BY 1")
def position_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = match_view(spark, sf_dir).withColumn("position_group", P.position_group(F.col("position")))
    return own.groupBy("position_group").agg(F.count("*").alias("events"), F.countDistinct("player_id").alias("players"))


@query("SELECT 'obv_total_net' AS metric, count(obv_total_net) AS n, round(avg(obv_total_net), 6) AS mean, round(median(obv_total_net), 6) AS median, round(min(obv_total_net), 6) AS least, round(max(obv_total_net), 6) AS most FROM ev UNION ALL SELECT 'shot_statsbomb_xg', count(shot_statsbomb_xg), round(avg(shot_statsbomb_xg), 6), round(median(shot_statsbomb_xg), 6), round(min(shot_statsbomb_xg), 6), round(max(shot_statsbomb_xg), 6) FROM ev")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.run_report(match_view(spark, sf_dir), SPLIT), 6)


@query("SELECT type, count(*) AS n FROM ev GROUP BY type ORDER BY n DESC, type LIMIT 3")
def top_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_values(match_view(spark, sf_dir), "type", 3)


@query("SELECT idx, t AS clock, (period - 1) * 3600.0::DOUBLE + minute * 60 AS fallback FROM ev")
def clock_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = match_view(spark, sf_dir)
    text = F.format_string("%02d:%02d:%06.3f", F.floor(F.col("t") / 3600), F.floor(F.col("t") / 60) % 60, F.col("t") % 60)
    own = lambda stamp: P.clock_seconds(stamp, F.col("period"), F.col("minute"), F.lit(0))
    return v.select("idx", own(text).alias("clock"), own(F.lit(None).cast("string")).alias("fallback"))


SIZE_SQL = """, q AS (SELECT quantile_cont(x, 0.995) AS x, quantile_cont(y, 0.995) AS y, max(y) AS most FROM ev),
size AS (SELECT least(120, greatest(100, x)) AS length, CASE WHEN y <= 82 THEN 80.0::DOUBLE WHEN y <= 102 THEN 100.0::DOUBLE ELSE least(120, greatest(80, most)) END AS width FROM q)
"""


@query(SIZE_SQL + "SELECT round(length, 6) AS length, round(width, 6) AS width FROM size")
def pitch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.pitch_size(match_view(spark, sf_dir)), 6)


# The season table in SQL, from the same lists of columns as its definition in prose: totals, breakdowns, rates.


def _sum(test: str, metric: str) -> str:
    return f"coalesce(sum(CASE WHEN {test} THEN {metric} END), 0)"


def _n(test: str) -> str:
    return f"count(CASE WHEN {test} THEN 1 END)"


FLAG_SUM = "sum(CASE WHEN {0} THEN 1.0::DOUBLE WHEN NOT {0} THEN 0.0::DOUBLE END)"
TOTALS = {m: f"sum({m})" for m in ("obv_total_net", "shot_statsbomb_xg", "xa", "pass_length")} | {f: FLAG_SUM.format(f) for f in FLAGS}
TOTALS |= {f"{k.lower()}_into_final_third": f"sum(CASE WHEN type = '{k}' AND end_x >= length * 2 / 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for k in ("Pass", "Carry")}
TOTALS |= {"pressure": _n("type = 'Pressure'"), "duel_tackle": _n("duel_type = 'Tackle'"), "completed_passes_under_pressure": _n("type = 'Pass' AND pass_outcome IS NULL AND under_pressure"), "goals": _n("shot_outcome = 'Goal'")}
LOSSES = {"total_turnovers": "count(*)"} | {f"turnovers_{C.turnover_part(k)}": _n(f"turnover_how = '{k}'") for k in KINDS}
BROKEN = {f"{m}_{c}_{C.name_part(v)}": _sum(f"{c} = '{v}'", m) for c, own in (("type", TYPES), ("play_pattern", PATTERNS), ("duel_type", DUEL_TYPES), ("shot_type", SHOT_TYPES)) for v in own for m in SPLIT}
BROKEN |= {f"n_events_{c}_{C.name_part(v)}": _n(f"{c} = '{v}'") for c, own in (("duel_outcome", DUEL_OUTCOMES), ("interception_outcome", CAUGHT), ("pass_outcome", ("Incomplete",))) for v in own}
THIRD_OF = "CASE WHEN x < length / 3 THEN 'defensive' WHEN x < length * 2 / 3 THEN 'middle' ELSE 'attacking' END"
for part in ("defensive", "middle", "attacking"):
    for kind in metrics.THIRD_TYPES:
        at = f"{THIRD_OF} = '{part}' AND type = '{kind}'"
        BROKEN |= {f"obv_total_net_third_{part}_{C.name_part(kind)}": _sum(at, "obv_total_net"), f"n_events_third_{part}_{C.name_part(kind)}": _n(at)}
CROSS = f"{THIRD_OF} = 'attacking' AND type = 'Pass' AND pass_cross AND play_pattern = 'Regular Play'"
BROKEN |= {"obv_total_net_third_attacking_pass_cross_openplay": _sum(CROSS, "obv_total_net"), "n_events_third_attacking_pass_cross_openplay": _n(CROSS)}
BOX = "x >= length - 18 AND y BETWEEN width / 2 - 22 AND width / 2 + 22"
COUNTED = {"total_shots": _n("type = 'Shot'"), "total_touches": "count(*)", "touches_in_opp_box": _n(BOX), "complete_passes": _n("type = 'Pass' AND pass_outcome IS NULL")}
OTHER = {n: _rate(*w, places=None) for n, w in RATES.items()} | {
    "total_passes": _n("type = 'Pass'"),
    "incomplete_passes": "count(pass_outcome)",
    "xg_per_shot": "CASE WHEN count(shot_outcome) > 0 THEN sum(shot_statsbomb_xg) / count(shot_outcome) END",
    "shot_touch_pct": "count(shot_outcome) / count(*)",
    "touches_in_opp_box_pct": f"{_n(BOX)} / count(*)",
}
KEPT = {
    "gk_save_pct": "sv / nullif(sot, 0)", "gk_shots_on_target_against": "sot", "gk_saves": "sv", "gk_psxg_faced": "px", "gk_goals_prevented": "px - gl", "gk_errors_leading_to_shot": "er", "gk_errors_leading_to_goal": "eg",
    "gk_goals_conceded_shots": "coalesce(gl, 0)", "gk_goals_conceded_total": "coalesce(gl, 0)", "gk_own_goals_against": "CAST(0 AS BIGINT)", "gk_penalty_save_pct": "ps / pf", "gk_penalties_faced": "pf", "gk_penalties_saved": "ps", "gk_penalties_conceded": "pg", "gk_penalties_psxg": "pp",
    "gk_shots_open_play_in_box_against": "bx", "gk_claims": "cl", "gk_pass_completion_pct": "CASE WHEN n > 0 THEN ok / n END", "gk_long_ball_pct": "CASE WHEN n > 0 THEN lg / n END", "gk_pass_obv": "po", "gk_pressured_passes_def_third": "CASE WHEN n > 0 THEN pr END",
    "gk_pressured_passes_def_third_completion_pct": "CASE WHEN pr > 0 THEN pk / pr END", "gk_actions_outside_box": "ob", "gk_aggressive_distance_avg": "ax",
}
KEPT_WHOLE = {n for n, x in KEPT.items() if x in ("sot", "sv", "er", "eg", "pf", "ps", "pg", "bx", "cl", "ob") or "gl, 0" in x or "BIGINT" in x or x.endswith("THEN pr END")}
KEEPER_ALL = """, stop AS (
  SELECT player_id, count(CASE WHEN so IN ('Saved', 'Goal') THEN 1 END) AS sot, count(CASE WHEN so = 'Saved' THEN 1 END) AS sv, count(CASE WHEN so = 'Goal' THEN 1 END) AS gl, sum(psxg) AS px,
    count(CASE WHEN g = 'No Catch' THEN 1 END) AS er, count(CASE WHEN g = 'No Catch' AND so = 'Goal' THEN 1 END) AS eg, count(CASE WHEN x < 18 AND st = 'Open Play' THEN 1 END) AS bx FROM links WHERE st <> 'Penalty' GROUP BY player_id),
pen AS (SELECT player_id, count(*) AS pf, count(CASE WHEN so = 'Saved' THEN 1 END) AS ps, count(CASE WHEN so = 'Goal' THEN 1 END) AS pg, sum(psxg) AS pp FROM links WHERE st = 'Penalty' GROUP BY player_id),
foot AS (
  SELECT player_id, count(CASE WHEN type = 'Pass' THEN 1 END) AS n, count(CASE WHEN type = 'Pass' AND pass_outcome IS NULL THEN 1 END) AS ok, sum(CASE WHEN type = 'Pass' THEN obv_total_net END) AS po, count(CASE WHEN type = 'Pass' AND pass_length > 32 THEN 1 END) AS lg,
    count(CASE WHEN type = 'Pass' AND x < 40 AND under_pressure THEN 1 END) AS pr, count(CASE WHEN type = 'Pass' AND x < 40 AND under_pressure AND pass_outcome IS NULL THEN 1 END) AS pk,
    count(CASE WHEN x > 18 THEN 1 END) AS ob, avg(x) AS ax, count(CASE WHEN goalkeeper_outcome = 'Claim' THEN 1 END) AS cl FROM ev WHERE position = 'Goalkeeper' GROUP BY player_id),
kp AS (SELECT foot.player_id, """ + ", ".join(f"{e} AS {n}" for n, e in KEPT.items()) + """ FROM foot LEFT JOIN stop ON foot.player_id = stop.player_id LEFT JOIN pen ON foot.player_id = pen.player_id)
"""
DAMAGE_SQL = """, met AS (
  SELECT z.match_id, z.player_id, e.possession, e.t, e.type, obv_total_net AS o, shot_statsbomb_xg AS g,
    ((120 - e.x) - mu_x) * cos(th) + ((80 - e.y) - mu_y) * sin(th) BETWEEN u_lo - 1e-9 AND u_hi + 1e-9 AND ((80 - e.y) - mu_y) * cos(th) - ((120 - e.x) - mu_x) * sin(th) BETWEEN v_lo - 1e-9 AND v_hi + 1e-9 AS inside
  FROM zone z JOIN ev e ON e.match_id = z.match_id AND e.team <> z.team),
con AS (SELECT *, min(CASE WHEN inside THEN t END) OVER (PARTITION BY match_id, player_id, possession) AS t0 FROM met),
dmg AS (
  SELECT player_id, coalesce(sum(CASE WHEN inside THEN o END), 0) AS obv_into_area, coalesce(sum(CASE WHEN t >= t0 THEN o END), 0) AS obv_from_area,
    count(CASE WHEN t >= t0 AND type = 'Shot' THEN 1 END) AS shots_from_area, coalesce(sum(CASE WHEN t >= t0 AND type = 'Shot' THEN g END), 0) AS xg_from_area FROM con GROUP BY player_id)
"""
AREA = ("obv_into_area", "obv_from_area", "shots_from_area", "xg_from_area")
RATED = [*TOTALS, *LOSSES, "foul_committed", *BROKEN, *COUNTED]
SEASON_SQL = TURNOVER_SQL + LANE_SQL + ZONE_SQL + DAMAGE_SQL + KEEPER_SQL + KEEPER_ALL + SIZE_SQL + ", tn AS (SELECT player_id, " + ", ".join(f"{e} AS {n}" for n, e in LOSSES.items()) + " FROM lost GROUP BY player_id), tt AS (SELECT player_id, " + ", ".join(f"{e} AS {n}" for n, e in (TOTALS | BROKEN | COUNTED | OTHER).items()) + """ FROM ev, size GROUP BY player_id),
total AS (
  SELECT pms.player_id, primary_position, primary_position AS all_positions, 'T' || (pms.player_id % 2) AS teams, pms.total_minutes, pms.total_minutes AS minutes_primary_position, 1.0::DOUBLE AS primary_position_share, matches_played, times_starter,
    tt.* EXCLUDE (player_id), """ + ", ".join(f"coalesce(tn.{n}, 0) AS {n}" for n in LOSSES) + """,
    coalesce(foul_committed_advantage, 0) + coalesce(foul_committed_offensive, 0) AS foul_committed, CASE WHEN ball_recovery_offensive + ball_recovery_recovery_failure > 0 THEN ball_recovery_offensive / (ball_recovery_offensive + ball_recovery_recovery_failure) END AS ball_recovery_success_pct,
    e AS obv_from_ext, i AS obv_from_int, b AS lane_bias_index, """ + ", ".join(f"dmg.{c} AS {c}" for c in AREA) + ", " + ", ".join(f"kp.{c} AS {c}" for c in KEPT) + """
  FROM pms JOIN tt ON tt.player_id = pms.player_id LEFT JOIN tn ON tn.player_id = pms.player_id LEFT JOIN lane ON lane.player_id = pms.player_id LEFT JOIN dmg ON dmg.player_id = pms.player_id LEFT JOIN kp ON kp.player_id = pms.player_id),
rated AS (SELECT *, """ + ", ".join(f'"{c}" / total_minutes * 90 AS "{c}_per90"' for c in (*RATED, "obv_from_ext", "obv_from_int")) + ", " + ", ".join(f"{source} / total_minutes * 90 AS {name}" for name, source in ({f"{c}_per90": c for c in AREA} | keeper.RATED).items()) + """ FROM total),
season AS (
  SELECT *, coalesce(n_events_duel_outcome_lost_in_play_per90, 0) + coalesce(foul_committed_per90, 0) AS defensive_actions_lost_per90,
    coalesce(clearance_head_per90, 0) + coalesce(clearance_left_foot_per90, 0) AS clearances_total_per90, coalesce(block_deflection_per90, 0) AS blocks_total_per90 FROM rated)
"""
EXACT = ("player_id", "primary_position", "all_positions", "teams", "total_minutes", "minutes_primary_position", "matches_played", "times_starter")


def season_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.by_match(match_view(spark, sf_dir))
    values = {"type": list(TYPES), "play_pattern": list(PATTERNS), "duel_type": list(DUEL_TYPES), "shot_type": list(SHOT_TYPES), "duel_outcome": list(DUEL_OUTCOMES), "interception_outcome": list(CAUGHT), "pass_outcome": ["Incomplete"]}
    return season.player_season(events, *lineups(events), values, KINDS, least_passes=5, flags=FLAGS, places=None)


SEASON_COLUMNS = [*TOTALS, *LOSSES, "foul_committed", *BROKEN, *COUNTED, *OTHER, "ball_recovery_success_pct", "lane_bias_index", *AREA, *KEPT, "obv_from_ext", "obv_from_int"]
SEASON_COLUMNS += [f"{c}_per90" for c in (*RATED, "obv_from_ext", "obv_from_int", *AREA)] + [*keeper.RATED, "defensive_actions_lost_per90", "clearances_total_per90", "blocks_total_per90"]
#: Columns of whole numbers, which are compared as they are.
WHOLE_NUMBERS = {*[n for n, x in (TOTALS | BROKEN | COUNTED | OTHER).items() if x.startswith("count(") and not x.endswith("/ count(*)")], *LOSSES, "shots_from_area", *KEPT_WHOLE}
WHOLE = [*EXACT, *[c for c in SEASON_COLUMNS if c in WHOLE_NUMBERS]]


@query(SEASON_SQL + "SELECT " + ", ".join(WHOLE) + ", round(COLUMNS(* EXCLUDE (" + ", ".join(WHOLE) + ")) + 1e-9, 4) + 0 FROM season")
def player_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season table end to end, all of its columns."""
    return rounded(season_view(spark, sf_dir), nudge=1e-9)


# Position scoring through the season table.

LEAST = {"min_minutes": 200, "min_matches": 3}


def _scores_sql(least: dict[str, tuple[int, int]], used: dict[str, specs.Spec] = specs.SPECS, teams: str = "", mix: tuple[float, float] = (0.6, 0.4)) -> str:
    """Tables `flagged` (player_id, grp, category, s, flag) with scores in whole steps; written from the specifications' lists.

    Percentiles are whole numbers of 1e-9, weights and scores of 1e-6, so that sums and thresholds are exact.
    """
    rows, mixed = [], []
    for group, own in used.items():
        for category, listed in own.metrics.items():
            parts = [(f"{category}", listed)]
            if group == "Lateral" and category == "Defensivo":
                parts = [(f"_{n}", m) for n, (_, m) in specs.LATERAL_MIX.items()]
            rows += [(group, c, m, w, inv) for c, metrics_ in parts for m, w, inv in metrics_]
        mixed += [(group, c, w) for c, w in own.weights.items()]
    names = sorted({m for _, _, m, _, _ in rows} & set(SEASON_COLUMNS))
    group_of = " ".join(f"WHEN primary_position = '{p}' THEN '{g}'" for p, g in P.POSITION_GROUP.items())
    enough = " ".join(f"WHEN '{g}' THEN total_minutes >= {m} AND matches_played >= {n}" for g, (m, n) in least.items())
    values = ", ".join(f"('{g}', '{c}', '{m}', {round(w * 1e6)}::BIGINT, {str(inv).upper()})" for g, c, m, w, inv in rows)
    weights = ", ".join(f"('{g}', '{c}', {round(w * 1e6)}::BIGINT)" for g, c, w in mixed)
    return f""", pool AS (SELECT * FROM (SELECT *, CASE {group_of} END AS grp FROM season) WHERE CASE grp {enough} END {teams}),
spec(grp, category, metric, w, inv) AS (VALUES {values}), weight(grp, category, w) AS (VALUES {weights}),
long AS ({" UNION ALL ".join(f"SELECT player_id, grp, '{m}' AS metric, round(CAST({m} AS DOUBLE) + 1e-9, 6) AS v FROM pool WHERE {m} IS NOT NULL" for m in names)}),
pc AS (SELECT *, CAST(round((rank() OVER (PARTITION BY grp, metric ORDER BY v) + (count(*) OVER (PARTITION BY grp, metric, v) - 1) / 2) / count(*) OVER (PARTITION BY grp, metric) * 100 * 1e9) AS BIGINT) AS p FROM long),
cat AS (SELECT pc.player_id, pc.grp, category, (sum(CASE WHEN inv THEN 100000000000 - p ELSE p END * w) + 502 * sum(w)) // (1000 * sum(w)) AS s FROM pc JOIN spec ON spec.grp = pc.grp AND spec.metric = pc.metric GROUP BY 1, 2, 3),
mix AS (SELECT a.player_id, a.grp, 'Defensivo' AS category, (2 * (a.s * {round(mix[0] * 1e6)} + b.s * {round(mix[1] * 1e6)}) + 1000000) // 2000000 AS s FROM cat a JOIN cat b ON a.player_id = b.player_id AND a.category = '_exec' AND b.category = '_obv'),
cats AS (SELECT * FROM cat WHERE category NOT LIKE '\\_%' ESCAPE '\\' UNION ALL SELECT * FROM mix),
overall AS (SELECT player_id, cats.grp, 'Overall' AS category, (2 * sum(s * w) + sum(w)) // (2 * sum(w)) AS s FROM cats JOIN weight ON weight.grp = cats.grp AND weight.category = cats.category GROUP BY 1, 2),
every AS MATERIALIZED (SELECT * FROM cats UNION ALL SELECT * FROM overall),
sorted AS (SELECT grp, category, count(*) AS n, list_sort(list(s)) AS l FROM every GROUP BY 1, 2),
lim AS (SELECT grp, category, l[(n - 1) * 3 // 4 + 1] * (4 - (n - 1) * 3 % 4) + l[least(n, (n - 1) * 3 // 4 + 2)] * ((n - 1) * 3 % 4) AS four_quartiles FROM sorted),
flagged AS (
  SELECT player_id, every.grp, every.category, s, 4 * s >= four_quartiles AS flag
  FROM every JOIN lim ON lim.grp = every.grp AND lim.category = every.category)
"""


def season_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season table as scoring takes it, written once; values are rounded, so that equal ones tie whatever the order of their sums."""
    players = season_view(spark, sf_dir).withColumn("season", F.lit("2024_2025"))
    named = [*season.BASE, "season", "lane_bias_index", *[m for s in specs.SPECS.values() for m in s.all_metrics()], *[m for _, own in specs.LATERAL_MIX.values() for m, _, _ in own]]
    return settle(rounded(normalize.contract(players, list(dict.fromkeys(named))), 6, nudge=1e-9), "players")


LEAST_OF_ALL = {g: tuple(LEAST.values()) for g in specs.SPECS}
SCORED = "SELECT player_id, grp AS position_group, category, CAST(s AS DOUBLE) / 1e6 AS score, flag FROM flagged"


@query(SEASON_SQL + _scores_sql(LEAST_OF_ALL) + SCORED)
def position_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and flags of the players of all seven groups, a row for each category and the total."""
    scored = scoring.score_groups(season_players(spark, sf_dir), least=LEAST_OF_ALL)
    return scored.select("player_id", "position_group", "category", "score", "flag")


#: Weights and mixture that a user might choose, with the entry points' thresholds, for one team.
CHOSEN = {g: replace(own, weights={c: w for c, w in zip(own.weights, [0.4, 0.3, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05])}) for g, own in specs.SPECS.items()}
ENTRY_OF_ALL = {g: scoring.ENTRY.get(g, scoring.ENTRY_ELSE) for g in specs.SPECS}


@query(SEASON_SQL + _scores_sql(ENTRY_OF_ALL, CHOSEN, "AND teams = 'T1'", (0.5, 0.5)) + SCORED)
def chosen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the entry points' thresholds, among the players of one team, with changed weights and mixture."""
    scored = scoring.score_groups(season_players(spark, sf_dir), teams=["T1"], specs=CHOSEN, mix=(0.5, 0.5))
    return scored.select("player_id", "position_group", "category", "score", "flag")


_LABELS = ", ".join(f"('{g}', {i}, '{c}', '{label}')" for g, own in specs.SPECS.items() for i, (c, label) in enumerate(own.labels.items()))


@query(SEASON_SQL + _scores_sql(ENTRY_OF_ALL) + f""", label(grp, i, category, label) AS (VALUES {_LABELS}),
prof AS (SELECT f.player_id, f.grp, max(CASE WHEN f.category = 'Overall' THEN s END) AS s, string_agg(CASE WHEN flag THEN label END, ' | ' ORDER BY i) AS profile FROM flagged f LEFT JOIN label ON label.grp = f.grp AND label.category = f.category GROUP BY 1, 2)
SELECT player_id, grp AS position_group, CAST(s AS DOUBLE) / 1e6 AS total, coalesce(profile, 'Balanceado') AS profile, row_number() OVER (ORDER BY s DESC, player_id) AS position FROM prof""")
def league_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The league's players of all groups in the order of their totals, with profiles and places."""
    scored = scoring.score_groups(season_players(spark, sf_dir))
    own = scoring.group_profiles(scored.drop("season"))
    return ranking.positions(own, [F.desc_nulls_last("total"), "player_id"])


@query(""", xi AS (SELECT DISTINCT match_id, player_id, position, team FROM ev WHERE player_id % 3 <> 0),
sub AS (SELECT match_id, player_id, min(minute) AS minute FROM ev WHERE player_id % 3 = 0 GROUP BY 1, 2)
SELECT 'xi' AS kind, match_id, player_id, position, team, CAST(NULL AS INTEGER) AS minute FROM xi UNION ALL SELECT 'on', match_id, player_id, NULL, NULL, CAST(minute AS INTEGER) FROM sub UNION ALL SELECT 'off', match_id, player_id + 1, NULL, NULL, CAST(minute AS INTEGER) FROM sub""")
def parsed_lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-ups and substitutions as the cells of event files hold them, and what comes out of them again."""
    xi, on, _ = lineups(match_view(spark, sf_dir))
    cell = F.format_string("{'player': {'id': %d, 'name': None}, 'position': {'id': 1, 'name': '%s'}, 'jersey_number': 7}", "player_id", "position")
    tactics = F.concat(F.lit("{'formation': 442, 'lineup': ["), F.array_join(F.sort_array(F.collect_list(cell)), ", "), F.lit("]}"))
    starts = xi.groupBy("match_id", "team").agg(tactics.alias("tactics")).withColumn("type", F.lit("Starting XI"))
    changes = on.select("match_id", (F.col("player_id") + 1).alias("player_id"), "minute", F.lit("Substitution").alias("type"), F.format_string("{'id': %d, 'name': None}", "player_id").alias("substitution_replacement"))
    came, left = minutes.substitutions(changes)
    rows = minutes.lineup_from_tactics(starts).select(F.lit("xi").alias("kind"), "match_id", "player_id", "position", "team", F.lit(None).cast("int").alias("minute"))
    for kind, part in (("on", came), ("off", left)):
        rows = rows.unionByName(part.select(F.lit(kind).alias("kind"), "match_id", "player_id", F.lit(None).cast("string").alias("position"), F.lit(None).cast("string").alias("team"), "minute"))
    return rows


@query("SELECT match_id, pmm.player_id, CAST(minutes AS BIGINT) AS minutes, starter, position_match, primary_position FROM pmm JOIN pms ON pms.player_id = pmm.player_id")
def minutes_by_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    played = _played(spark, sf_dir)[1]
    out = season.minutes_export(played, minutes.minutes_summary(played))
    return out.select("match_id", "player_id", "minutes", "starter", "position_match", "primary_position")


@query(TURNOVER_SQL + ZONE_SQL + "SELECT l.player_id, total_turnovers, coalesce(zones, 0) AS zones FROM (SELECT player_id, count(*) AS total_turnovers FROM lost GROUP BY 1) l LEFT JOIN (SELECT player_id, count(*) AS zones FROM zone GROUP BY 1) z ON z.player_id = l.player_id")
def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnovers and zones from a log that is laid out by match: the matches are not shuffled again."""
    log = tables.by_match(match_view(spark, sf_dir))
    lost = turnovers.turnovers(log).groupBy("player_id").agg(F.count("*").alias("total_turnovers"))
    own = zones.zone_rectangles(log).groupBy("player_id").agg(F.count("*").alias("zones"))
    return lost.join(own, "player_id", "left").fillna(0, ["zones"])


# Files: the log as it is stored, and tables that are exported.

FILED = ("2023_2024", "2024_2025")
FILED_SCHEMA = "idx bigint, team string, type string, location string, player string"


@query("SELECT idx, CASE WHEN match_id >= 1000000000 THEN '2024_2025' ELSE '2023_2024' END AS season, 'Peñarol – ' || team AS team, type, round(x) AS x, y, player_id, 'Núñez, None ' || player_id AS player_name FROM ev")
def events_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as two seasons of CSV files in different encodings, named by season, read and normalised again."""
    v = match_view(spark, sf_dir)
    season_ = F.when(F.col("match_id") >= 1_000_000_000, FILED[1]).otherwise(FILED[0])
    dash = F.when(season_ == FILED[0], F.lit("\x96")).otherwise(F.lit("–"))  # where Windows-1252 has the dash that Latin-1 lacks
    raw = v.select(
        season_.alias("season"),
        "idx",
        F.concat(F.lit("Peñarol "), dash, F.lit(" "), "team").alias("team"),
        "type",
        F.format_string("[%d.0, %d]", F.round("x").cast("long"), F.col("y").cast("long")).alias("location"),
        F.format_string("{'id': %d, 'name': 'Núñez, None %d', 'label': None}", "player_id", "player_id").alias("player"),
    )
    raw = settle(raw, "raw-events")
    root = f"{scratch(spark)}/files-{uuid.uuid4().hex}"
    for name, code in zip(FILED, ("ISO-8859-1", "UTF-8")):
        raw.where(F.col("season") == name).drop("season").write.options(header=True, encoding=code, quote='"', escape='"').csv(f"{root}/events_{name}.csv")
    own = normalize.normalize_events(tables.read_events(spark, f"{root}/*.csv", schema=FILED_SCHEMA))
    return own.select("idx", "season", "team", "type", "x", "y", "player_id", "player_name")


@query("SELECT player_id, 'Peña ' || player_id AS player_name, CAST(total_minutes AS VARCHAR) AS total_minutes, primary_position FROM pms")
def exported_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes exported as CSV with a byte order mark, most minutes first, and read again; names that were spoilt come back repaired."""
    own = _summary(spark, sf_dir)[1]
    spoilt = F.decode(F.encode(F.format_string("Peña %d", "player_id"), "UTF-8"), "ISO-8859-1")
    path = f"{scratch(spark)}/export-{uuid.uuid4().hex}"
    tables.export_season(own.select("player_id", spoilt.alias("player_name"), "total_minutes", "primary_position"), path)
    return tables.read_scores(spark, path).withColumn("player_id", F.col("player_id").cast("long"))


@query("SELECT 'T' || (player_id % 2) AS team_name, CAST(player_id AS VARCHAR) AS player_name, total_minutes / 900.0::DOUBLE AS share, round(total_minutes / 900.0::DOUBLE * (matches_played / 10.0::DOUBLE), 6) AS used FROM pms")
def stored_cost_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of minutes and cost as stored, and their product."""
    share, cost = F.col("total_minutes") / 900.0, F.col("matches_played") / 10.0
    own = _summary(spark, sf_dir)[1].select(F.concat(F.lit("T"), F.col("player_id") % 2).alias("team_name"), F.col("player_id").cast("string").alias("player_name"), share.alias("minutes_played_percentage"), cost.alias("player_annual_cost_percentage"), (share * cost).alias("talent_cost_utilization_per_player"))
    path = f"{scratch(spark)}/cost-use-{uuid.uuid4().hex}"
    tables.write_csv(own, path)
    return tables.read_cost_use(spark, path).select("team_name", "player_name", F.col("minutes_played_percentage").alias("share"), F.round("talent_cost_utilization_per_player", 6).alias("used"))


# Views in which a player has several positions, post-shot values and own goals.

_PLACES = ", ".join(f"'{p}'" for p in POSITIONS)
_MOVED = f"[{_PLACES}][(player_id + match_id // 1000000000 + idx % 2) % 7 + 1]"
MOVED_SQL = f""", mv AS (SELECT * EXCLUDE (position), {_MOVED} AS position FROM ev),
often AS (SELECT match_id, player_id, position, row_number() OVER (PARTITION BY match_id, player_id ORDER BY count(*) DESC, position) AS n FROM mv GROUP BY 1, 2, 3),
first_ AS (SELECT match_id, player_id, min(position) AS least FROM mv GROUP BY 1, 2),
pos AS (SELECT pmm.match_id, pmm.player_id, minutes, CASE WHEN starter THEN least ELSE position END AS position_match FROM pmm JOIN often USING (match_id, player_id) JOIN first_ USING (match_id, player_id) WHERE n = 1),
by_pos AS (SELECT player_id, position_match, sum(minutes) AS m FROM pos GROUP BY 1, 2),
best AS (SELECT player_id, position_match, m, row_number() OVER (PARTITION BY player_id ORDER BY m DESC, position_match) AS n, sum(m) OVER (PARTITION BY player_id) AS total FROM by_pos),
named AS (SELECT player_id, string_agg(DISTINCT position, ', ' ORDER BY position) AS all_positions FROM mv GROUP BY 1)
"""


@query(MOVED_SQL + "SELECT best.player_id, position_match AS primary_position, CAST(m AS BIGINT) AS minutes_primary_position, round(m / total, 6) AS primary_position_share, all_positions FROM best JOIN named ON named.player_id = best.player_id WHERE n = 1")
def several_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main positions of players who change theirs between and within matches, with ties."""
    place = (F.col("player_id") + F.floor(F.col("match_id") / 1_000_000_000) + F.col("idx") % 2) % 7
    events = match_view(spark, sf_dir).withColumn("position", F.get(F.array(*map(F.lit, POSITIONS)), place.cast("int")))
    own = minutes.minutes_summary(minutes.appearances(events, *lineups(events)))
    return rounded(own.select("player_id", "primary_position", "minutes_primary_position", "primary_position_share", "all_positions"), 6)


@query(""", kept AS (SELECT player_id, unnest([CAST(idx - 1 AS VARCHAR), CAST(idx - 2 AS VARCHAR)]) AS shot_id FROM ev WHERE type = 'Goal Keeper'),
links AS (SELECT kept.player_id, s.shot_outcome AS so, coalesce(s.shot_statsbomb_xg * 1.25, 0) AS psxg FROM kept JOIN ev s ON s.id = shot_id AND s.type = 'Shot' AND s.shot_type <> 'Penalty')
SELECT player_id, round(sum(psxg) + 1e-9, 4) AS gk_psxg_faced, round(sum(psxg) - count(CASE WHEN so = 'Goal' THEN 1 END) + 1e-9, 4) AS gk_goals_prevented FROM links GROUP BY player_id""")
def post_shot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values faced by keepers where the log has a post-shot column beside the shot's own, which goes before it."""
    events = match_view(spark, sf_dir).withColumn("shot_shot_execution_xg", F.col("shot_statsbomb_xg") * 1.25)
    faced = keeper.faced(keeper.shot_links(events, penalties=None), keeper.psxg_column(events.columns) == keeper.PSXG[0])
    return rounded(faced.where("gk_psxg_faced is not null").select("player_id", "gk_psxg_faced", "gk_goals_prevented"), nudge=1e-9)


@query(LANE_SQL.replace("y / 16", "CASE WHEN period = 2 THEN 80 - y - 1e-6 ELSE y END / 16") + "SELECT player_id, round(e, 4) AS obv_from_ext, round(i, 4) AS obv_from_int, passes, round(b, 4) AS lane_bias_index FROM lane")
def turned_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes by a place that the caller works out: turned round in the second period."""
    y = F.when(F.col("period") == 2, 80 - F.col("y") - 1e-6).otherwise(F.col("y"))
    return rounded(lanes.lane_bias(*_summary(spark, sf_dir), least_passes=5, y=y).select("player_id", "obv_from_ext", "obv_from_int", "passes", "lane_bias_index"))


@query(""", led AS (SELECT *, lead(possession_team) OVER (PARTITION BY match_id ORDER BY period, idx) AS np FROM ev)
SELECT player_id, count(*) AS total_turnovers, count(CASE WHEN type = 'Shot' THEN 1 END) AS turnovers_shot, count(CASE WHEN type = 'Carry' THEN 1 END) AS turnovers_carry FROM led WHERE team = possession_team AND possession_team <> np GROUP BY player_id""")
def all_turnovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnovers with all switches off: any pattern, any restart, any type of event."""
    lost = turnovers.turnovers(match_view(spark, sf_dir), open_play_only=False, exclude_restarts=False, exclude_types=())
    return turnovers.turnover_counts(lost, ["Shot", "Carry"])


@query(SEASON_SQL.replace("SELECT *, coalesce(n_events_duel_outcome_lost_in_play_per90", "SELECT * EXCLUDE (goals_per90), round(round(goals_per90 + 1e-9, 6) + round(total_shots_per90 + 1e-9, 6), 6) AS goals_per90, coalesce(n_events_duel_outcome_lost_in_play_per90") + _scores_sql(ENTRY_OF_ALL) + """SELECT player_id, max(CASE WHEN category = 'Finalizacion' THEN CAST(s AS DOUBLE) / 1e6 END) AS finishing, max(CASE WHEN category = 'Overall' THEN CAST(s AS DOUBLE) / 1e6 END) AS total, bool_or(category = 'Overall' AND flag) AS flagged FROM flagged WHERE grp = 'Delantero' GROUP BY player_id""")
def mapped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forwards by their entry point, with a metric that the caller's mapping makes."""
    mapped = lambda d: d.withColumn("goals_per90", F.round(F.col("goals_per90") + F.col("total_shots_per90"), 6))
    scored = scoring.run_position(season_players(spark, sf_dir), "Delantero", derive=mapped)
    return scored.select("player_id", F.col("Score_Finalizacion").alias("finishing"), F.col("Score_Overall").alias("total"), F.col("flag_Score_Overall").alias("flagged"))
