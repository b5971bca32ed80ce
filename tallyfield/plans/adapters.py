"""Views of the given tables in the shapes that the operators take, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.scratch import settle

POSITIONS = ("Goalkeeper", "Center Back", "Left Back", "Center Defensive Midfield", "Center Midfield", "Left Wing", "Center Forward")
SEASON = "2024_2025"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of the match view that hold true and false as text.
FLAGS = "under_pressure pass_cross counterpress pass_switch pass_through_ball pass_shot_assist pass_goal_assist ball_recovery_offensive ball_recovery_recovery_failure foul_committed_advantage foul_committed_offensive clearance_head clearance_left_foot block_deflection".split()


def match_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a match log: 22 users meet in two teams for six days a match, half an hour is a possession.

    Matches are of bounded size: more users or days make more of them, not larger ones.
    """
    e = read(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.select("event_id", "user_id", "event_type", "value", day.alias("d"), k.alias("k"), F.second("ts").alias("s"), (F.hour("ts") * 60 + F.minute("ts")).alias("m"))
    w = F.col("d") % 6 * 1440 + F.col("m")
    i, u = F.col("event_id"), F.col("user_id")
    pick = lambda c, *values: F.get(F.array(*map(F.lit, values)), c.cast("int"))
    was = F.col("event_type")
    kind = F.when((u % 7 == 0) & (was == "signup"), "Goal Keeper").when(was == "view", "Pass").when(was == "click", F.when(i % 5 == 0, "Dribble").otherwise("Carry")).when(was == "purchase", "Shot")
    kind = kind.when(was == "signup", pick(i % 4, "Pressure", "Pressure", "Ball Recovery", "Interception")).when(was == "error", pick(i % 6, "Clearance", "Foul Committed", "Block", "Duel", "Duel", "Duel"))
    flag = lambda own, test: F.when(kind == own, test).cast("string")
    v = e.select(
        i.alias("idx"),
        i.cast("string").alias("id"),
        u.alias("player_id"),
        (F.floor(F.col("d") / 6) * 1_000_000_000 + F.floor(u / 22)).alias("match_id"),
        F.floor(w / 96).cast("int").alias("minute"),
        F.floor(w / 30).alias("possession"),
        (w * 60 + F.col("s")).cast("double").alias("t"),
        F.concat(F.lit("T"), u % 2).alias("team"),
        F.concat(F.lit("T"), F.floor(w / 30) % 2).alias("possession_team"),
        kind.alias("type"),
        F.when(F.col("k") < 70, "Regular Play").when(F.col("k") < 85, "From Throw In").otherwise("From Corner").alias("play_pattern"),
        (F.col("k") * F.lit(1.2)).alias("x"),
        (i * 37 % 80).cast("double").alias("y"),
        (i * 53 % 121).cast("double").alias("pass_end_x"),
        (i * 53 % 121).cast("double").alias("carry_end_x"),
        ((F.col("value") - 10) / 100).alias("obv_total_net"),
        F.when(kind == "Shot", F.col("value") / 500).alias("shot_statsbomb_xg"),
        F.when((kind == "Pass") & (i % 8 == 0), F.col("value") / 500).alias("xa"),
        F.when((kind == "Pass") & (i % 5 == 0), "Incomplete").alias("pass_outcome"),
        F.when(kind == "Duel", pick(i % 3, "Won", "Lost In Play", "Lost Out")).alias("duel_outcome"),
        F.when(kind == "Duel", pick(i % 2, "Tackle", "Aerial Lost")).alias("duel_type"),
        F.when(kind == "Interception", pick(i % 3, "Won", "Lost In Play", "Success Out")).alias("interception_outcome"),
        F.when(kind == "Shot", pick(i % 3, "Goal", "Saved", "Off T")).alias("shot_outcome"),
        F.when(kind == "Shot", F.when(i % 11 == 0, "Penalty").otherwise("Open Play")).alias("shot_type"),
        F.when(kind == "Goal Keeper", pick(i % 4, "Claim", "No Catch", None, None)).alias("goalkeeper_outcome"),
        F.when(kind == "Goal Keeper", F.array((i - 1).cast("string"), (i - 2).cast("string"))).alias("related_events"),
        F.when(i % 2 == 0, "true").otherwise("false").alias("under_pressure"),
        F.when(i % 4 == 0, "True").otherwise("False").alias("pass_cross"),
        F.when(i % 3 == 0, "true").otherwise("false").alias("counterpress"),
        flag("Pass", i % 7 == 0).alias("pass_switch"),
        flag("Pass", i % 9 == 0).alias("pass_through_ball"),
        flag("Pass", i % 8 == 0).alias("pass_shot_assist"),
        flag("Pass", i % 16 == 0).alias("pass_goal_assist"),
        flag("Ball Recovery", i % 8 == 2).alias("ball_recovery_offensive"),
        flag("Ball Recovery", i % 3 == 0).alias("ball_recovery_recovery_failure"),
        flag("Foul Committed", i % 4 == 1).alias("foul_committed_advantage"),
        flag("Foul Committed", i % 5 == 0).alias("foul_committed_offensive"),
        flag("Clearance", i % 4 == 0).alias("clearance_head"),
        flag("Clearance", i % 4 == 2).alias("clearance_left_foot"),
        flag("Block", i % 4 == 0).alias("block_deflection"),
        (i % 60).cast("double").alias("pass_length"),
        pick(u % 7, *POSITIONS).alias("position"),
        F.lit(SEASON).alias("season"),
    )
    return v.withColumn("period", F.when(F.col("minute") < 45, 1).otherwise(2))


def lineups(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line-up (two thirds of the players), coming on (the others) and coming off (every fifth), from one pass."""
    keys = ["match_id", "player_id"]
    seen = settle(events.groupBy(*keys).agg(F.min("position").alias("position"), F.min("team").alias("team"), F.min("minute").alias("first"), F.max("minute").alias("last")), "line-ups")
    on = seen.where("player_id % 3 = 0").select(*keys, F.col("first").alias("minute"))
    off = seen.where("player_id % 5 = 0").select(*keys, F.col("last").alias("minute"))
    return seen.where("player_id % 3 <> 0").select(*keys, "position", "team"), on, off


MATCH_SQL = """
e0 AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS d, hour(ts) * 60 + minute(ts) AS m, second(ts) AS s FROM events),
e1 AS (
  SELECT *, (d % 6) * 1440 + m AS w, CASE WHEN user_id % 7 = 0 AND event_type = 'signup' THEN 'Goal Keeper' WHEN event_type = 'view' THEN 'Pass'
    WHEN event_type = 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'Dribble' ELSE 'Carry' END WHEN event_type = 'purchase' THEN 'Shot'
    WHEN event_type = 'signup' THEN CASE event_id % 4 WHEN 2 THEN 'Ball Recovery' WHEN 3 THEN 'Interception' ELSE 'Pressure' END
    WHEN event_type = 'error' THEN CASE event_id % 6 WHEN 0 THEN 'Clearance' WHEN 1 THEN 'Foul Committed' WHEN 2 THEN 'Block' ELSE 'Duel' END END AS type FROM e0),
ev AS (
  SELECT event_id AS idx, CAST(event_id AS VARCHAR) AS id, user_id AS player_id, (d // 6) * 1000000000 + user_id // 22 AS match_id, w // 96 AS minute, w // 30 AS possession, w * 60 + s AS t,
    'T' || (user_id % 2) AS team, 'T' || ((w // 30) % 2) AS possession_team, type,
    CASE WHEN k < 70 THEN 'Regular Play' WHEN k < 85 THEN 'From Throw In' ELSE 'From Corner' END AS play_pattern,
    k * CAST(1.2 AS DOUBLE) AS x, CAST(event_id * 37 % 80 AS DOUBLE) AS y, CAST(event_id * 53 % 121 AS DOUBLE) AS end_x,
    (value - 10) / 100 AS obv_total_net, CASE WHEN type = 'Shot' THEN value / 500 END AS shot_statsbomb_xg,
    CASE WHEN type = 'Pass' AND event_id % 8 = 0 THEN value / 500 END AS xa, CASE WHEN type = 'Pass' AND event_id % 5 = 0 THEN 'Incomplete' END AS pass_outcome,
    CASE WHEN type = 'Duel' THEN CASE event_id % 3 WHEN 0 THEN 'Won' WHEN 1 THEN 'Lost In Play' ELSE 'Lost Out' END END AS duel_outcome,
    CASE WHEN type = 'Duel' THEN CASE event_id % 2 WHEN 0 THEN 'Tackle' ELSE 'Aerial Lost' END END AS duel_type,
    CASE WHEN type = 'Interception' THEN CASE event_id % 3 WHEN 0 THEN 'Won' WHEN 1 THEN 'Lost In Play' ELSE 'Success Out' END END AS interception_outcome,
    CASE WHEN type = 'Shot' THEN CASE event_id % 3 WHEN 0 THEN 'Goal' WHEN 1 THEN 'Saved' ELSE 'Off T' END END AS shot_outcome,
    CASE WHEN type = 'Shot' THEN CASE WHEN event_id % 11 = 0 THEN 'Penalty' ELSE 'Open Play' END END AS shot_type,
    CASE WHEN type = 'Goal Keeper' THEN CASE event_id % 4 WHEN 0 THEN 'Claim' WHEN 1 THEN 'No Catch' END END AS goalkeeper_outcome,
    event_id % 2 = 0 AS under_pressure, event_id % 4 = 0 AS pass_cross, event_id % 3 = 0 AS counterpress,
    CASE WHEN type = 'Pass' THEN event_id % 7 = 0 END AS pass_switch, CASE WHEN type = 'Pass' THEN event_id % 9 = 0 END AS pass_through_ball,
    CASE WHEN type = 'Pass' THEN event_id % 8 = 0 END AS pass_shot_assist, CASE WHEN type = 'Pass' THEN event_id % 16 = 0 END AS pass_goal_assist,
    CASE WHEN type = 'Ball Recovery' THEN event_id % 8 = 2 END AS ball_recovery_offensive, CASE WHEN type = 'Ball Recovery' THEN event_id % 3 = 0 END AS ball_recovery_recovery_failure,
    CASE WHEN type = 'Foul Committed' THEN event_id % 4 = 1 END AS foul_committed_advantage, CASE WHEN type = 'Foul Committed' THEN event_id % 5 = 0 END AS foul_committed_offensive,
    CASE WHEN type = 'Clearance' THEN event_id % 4 = 0 END AS clearance_head, CASE WHEN type = 'Clearance' THEN event_id % 4 = 2 END AS clearance_left_foot,
    CASE WHEN type = 'Block' THEN event_id % 4 = 0 END AS block_deflection, CAST(event_id % 60 AS DOUBLE) AS pass_length,
    CASE user_id % 7 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'Center Back' WHEN 2 THEN 'Left Back' WHEN 3 THEN 'Center Defensive Midfield' WHEN 4 THEN 'Center Midfield' WHEN 5 THEN 'Left Wing' ELSE 'Center Forward' END AS position,
    CASE WHEN w // 96 < 45 THEN 1 ELSE 2 END AS period FROM e1),
mp AS (
  SELECT match_id, player_id, min(team) AS team, min(position) AS position_match, player_id % 3 <> 0 AS starter, min(minute) AS first_minute, max(minute) AS last_minute FROM ev GROUP BY match_id, player_id),
ends AS (SELECT match_id, least(120, greatest(90, max(minute))) AS end_minute FROM ev GROUP BY match_id),
played AS (
  SELECT mp.match_id, player_id, team, starter, position_match,
    CASE WHEN starter THEN CASE WHEN player_id % 5 = 0 THEN last_minute ELSE end_minute END ELSE greatest(0, (CASE WHEN player_id % 5 = 0 THEN last_minute ELSE end_minute END) - first_minute) END AS minutes
  FROM mp JOIN ends USING (match_id)),
pmm AS (SELECT * FROM played WHERE minutes > 0),
pms AS (
  SELECT player_id, CAST(sum(minutes) AS BIGINT) AS total_minutes, count(DISTINCT match_id) AS matches_played, CAST(sum(CASE WHEN starter THEN 1 ELSE 0 END) AS BIGINT) AS times_starter, min(position_match) AS primary_position FROM pmm GROUP BY player_id)
"""


def match_sql(body: str) -> str:
    return f"WITH {MATCH_SQL.strip()} {body}"


def supplier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, region, sales...) of every supplier: the metrics that scores are made of; equal suppliers tie whatever the order of rows."""
    items = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("items"),
        C.exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        C.exact_sum(F.col("l_quantity")).alias("quantity"),
        C.exact_mean(F.col("l_discount")).alias("discount"),
        (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("returned"),
        (F.count_if(F.col("l_linestatus") == "O") / F.count("*")).alias("open_share"),
    )
    suppliers = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.join(items, F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.col("s_suppkey").alias("entity"), F.col("n_regionkey").alias("region"), F.col("s_acctbal").alias("balance"), "items", "revenue", "quantity", "discount", "returned", "open_share"
    )


FACTS_SQL = """
li AS (
  SELECT l_suppkey, count(*) AS items, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) AS quantity, avg(l_discount) AS discount,
    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*) AS returned, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) / count(*) AS open_share FROM lineitem GROUP BY l_suppkey),
facts AS (
  SELECT s_suppkey AS entity, n_regionkey AS region, s_acctbal AS balance, items, revenue, quantity, discount, returned, open_share
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN li ON s_suppkey = l_suppkey)
"""


def facts_sql(body: str) -> str:
    return f"WITH {FACTS_SQL.strip()} {body}"
