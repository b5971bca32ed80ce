"""Hand-computed cases of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import columns as C
from tallyfield.functions import pitch as P
from tallyfield.operators import compare, keeper, lanes, market, metrics, minutes, normalize, reconcile, scoring, turnovers, zones
from tallyfield.operators.specs import SPECS, parse, spec
from tallyfield.sources import tables

EVENT = "match_id long, player_id long, idx long, period int, minute int, possession long, t double, team string, possession_team string, type string, play_pattern string, x double, y double, obv_total_net double, shot_statsbomb_xg double, position string"


def event(spark, rows):
    names = [c.split()[0] for c in EVENT.split(", ")]
    base = dict.fromkeys(names) | {"match_id": 1, "period": 1, "minute": 0, "possession": 1, "t": 0.0}
    return spark.createDataFrame([tuple((base | {"idx": i} | r)[n] for n in names) for i, r in enumerate(rows)], EVENT)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


def test_cells(spark):
    assert one(spark, "{'id': 7, 'name': 'Ana', 'x': None, 'y': True}", C.entity_name) == "Ana"
    assert one(spark, '{"id": 7, "label": "L"}', C.entity_name) == "L"
    assert one(spark, "Plain None", C.entity_name) == "Plain None"
    assert one(spark, "{'id': 7}", C.entity_id) == 7 and one(spark, "12.0", C.entity_id) == 12 and one(spark, "x", C.entity_id) is None
    assert one(spark, "[61.0, 40.1]", lambda c: F.struct(*C.point(c)))[0:2] == (61.0, 40.1)
    assert one(spark, "[61.0]", lambda c: C.point(c)[0]) is None and one(spark, "nope", lambda c: C.point(c)[1]) is None
    assert one(spark, "['a', 'b']", C.id_list) == ["a", "b"]
    assert [one(spark, v, C.safe_double) for v in ("1.5", "x", "NaN", None)] == [1.5, None, None, None]
    assert [one(spark, v, C.truthy) for v in ("True", " 1.0", "0", None)] == [True, True, False, False]
    assert [one(spark, v, C.flag_value) for v in ("TRUE", "false", "", None)] == [1.0, 0.0, None, None]
    assert C.name_part("Ball Receipt-In") == "ball_receipt_in" and C.turnover_part("Pass: Out") == "pass_out"
    assert one(spark, "a/events_2025_2026.csv", C.season_of) == "2025_2026"


def test_mojibake(spark):
    good = ["José Núñez", "Âge", "Ã", "plain", "日本 Ã", "naïve Â "]
    spoilt = ["Müller", "Núñez Ã", "çà"]
    for text in spoilt:
        assert one(spark, text.encode().decode("latin-1"), C.repair_mojibake) == text
    for text in good:
        want = text
        if any(s in text for s in "ÃÂ") and all(ord(c) < 256 for c in text):
            try:
                want = text.encode("latin-1").decode()
            except UnicodeDecodeError:
                want = text
        assert one(spark, text, C.repair_mojibake) == want
    assert one(spark, None, C.repair_mojibake) is None


def test_rounding_and_rates(spark):
    row = spark.range(1).select(C.round4(F.lit(0.12345)).alias("a"), C.per90(F.lit(2.0), F.lit(0)).alias("b"), C.per90(F.lit(2.0), F.lit(45)).alias("c"), C.ratio(F.lit(1), F.lit(0)).alias("d"), C.weighted_mean([(F.lit(None).cast("double"), 3), (F.lit(4.0), 1)]).alias("e"), C.sum_or_zero(F.lit(None).cast("double"), F.lit(2.0)).alias("f")).first()
    assert row.b is None and row.c == 4.0 and row.d is None and row.e == 4.0 and row.f == 2.0


def test_pitch(spark):
    rows = spark.createDataFrame([(0.0, -5.0), (39.9, 15.9), (40.0, 16.0), (80.0, 79.9), (102.0, 90.0)], "x double, y double")
    got = rows.select(P.third(F.col("x")).alias("t"), P.lane(F.col("y")).alias("l"), P.lane_group(P.lane(F.col("y"))).alias("g"), P.in_box(F.col("x"), F.lit(62.0)).alias("b")).collect()
    assert [r.t for r in got] == ["defensive", "defensive", "middle", "attacking", "attacking"]
    assert [r.l for r in got] == [1, 1, 2, 5, 5] and got[2].g == "int" and [r.b for r in got] == [False] * 4 + [True]
    assert P.positions_of("volante") == ["Center Defensive Midfield", "Left Defensive Midfield", "Right Defensive Midfield"]
    with pytest.raises(ValueError):
        P.positions_of("none")
    assert one(spark, "00:12:30.125", lambda c: P.clock_seconds(c, F.lit(1), F.lit(0), F.lit(0))) == 750.125
    assert one(spark, None, lambda c: P.clock_seconds(c, F.lit(2), F.lit(3), F.lit(4))) == 3784.0


def test_minutes(spark):
    ev = event(spark, [{"player_id": p, "minute": m, "team": "A", "position": "Left Wing"} for p in (1, 2, 3, 4, 5) for m in (10,)] + [{"player_id": 9, "minute": 130, "team": "B"}])
    xi = spark.createDataFrame([(1, 1, "Goalkeeper", "A"), (1, 2, "Left Back", "A")], "match_id long, player_id long, position string, team string")
    on = spark.createDataFrame([(1, 3, 60), (1, 4, 50), (1, 4, 55)], "match_id long, player_id long, minute int")
    off = spark.createDataFrame([(1, 2, 70), (1, 4, 80)], "match_id long, player_id long, minute int")
    got = {r.player_id: r for r in minutes.minutes_played(ev, xi, on, off).collect()}
    assert {p: r.minutes for p, r in got.items()} == {1: 120, 2: 70, 3: 60, 4: 30}
    assert got[1].starter and not got[3].starter and got[1].position_match == "Goalkeeper" and got[3].position_match == "Left Wing"
    played = spark.createDataFrame([(1, 1, "s", 40, True, "B"), (1, 2, "s", 40, False, "A"), (1, 3, "s2", 20, True, None)], "player_id long, match_id long, season string, minutes long, starter boolean, position_match string")
    (row,) = minutes.minutes_summary(played).collect()
    assert (row.total_minutes, row.matches_played, row.times_starter, row.seasons, row.primary_position, row.minutes_primary_position, row.primary_position_share) == (100, 3, 2, ["s", "s2"], "A", 40, 0.4)


def test_lineup_cells(spark):
    tactics = "{'formation': 442, 'lineup': [{'player': {'id': 5, 'name': 'X'}, 'position': {'id': 1, 'name': 'Goalkeeper'}, 'n': None}]}"
    ev = spark.createDataFrame([(1, 10, 8, "A", "Starting XI", tactics, None), (1, 60, 5, "A", "Substitution", None, "{'id': 11, 'name': 'Y'}")], "match_id long, minute int, player_id long, team string, type string, tactics string, substitution_replacement string")
    assert [tuple(r) for r in minutes.lineup_from_tactics(ev).collect()] == [(1, 5, "Goalkeeper", "A")]
    on, off = minutes.substitutions(ev)
    assert [tuple(r) for r in on.collect()] == [(1, 11, 60)] and [tuple(r) for r in off.collect()] == [(1, 5, 60)]


def test_turnovers(spark):
    base = {"player_id": 1, "team": "A", "possession_team": "A", "play_pattern": "Regular Play"}
    other = {"player_id": 2, "team": "B", "possession_team": "B"}
    ev = event(spark, [
        base | {"type": "Pass"}, other | {"type": "Pass", "play_pattern": None},  # lost; a null next pattern is kept
        base | {"type": "Carry"}, other | {"type": "Pass", "play_pattern": "From Throw In"},  # a restart follows
        base | {"type": "Shot"}, other | {"type": "Pass", "play_pattern": "Regular Play"},  # no turnover type; then B loses
        base | {"type": "Duel"},  # last event of the match
    ])
    got = turnovers.turnovers(ev.withColumn("pass_outcome", F.lit("Out")))
    assert sorted((r.idx, r.turnover_how) for r in got.collect()) == [(0, "Pass: Out"), (5, "Pass: Out")]
    (counts,) = turnovers.turnover_counts(got.where("idx = 0"), ["Pass: Out", "Carry"]).collect()
    assert tuple(counts) == (1, 1, 1, 0)


def test_breakdowns(spark):
    ev = event(spark, [{"player_id": 1, "type": "Pass", "obv_total_net": None}, {"player_id": 1, "type": "Ball Receipt*", "obv_total_net": None}, {"player_id": 2, "type": "Pass", "obv_total_net": 2.0}, {"player_id": None, "type": "Pass", "obv_total_net": 5.0}])
    values = metrics.breakdown_values(ev, ["type"])
    assert values == {"type": ["Ball Receipt*", "Pass"]}
    got = {r.player_id: r.asDict() for r in metrics.season_table(ev, metrics.totals(["obv_total_net"]) + metrics.breakdown_sums(values, ["obv_total_net"]) + metrics.breakdown_counts(values)).collect()}
    assert got[1] == {"player_id": 1, "obv_total_net": None, "obv_total_net_type_ball_receipt*": 0.0, "obv_total_net_type_pass": 0.0, "n_events_type_ball_receipt*": 1, "n_events_type_pass": 1}
    assert got[2]["obv_total_net_type_pass"] == got[2]["obv_total_net"] == 2.0
    with pytest.raises(ValueError):
        metrics.breakdown_values(spark.range(501).withColumn("type", F.col("id").cast("string")), ["type"])


def test_zone_is_the_same_turned_round(spark):
    places = [(10, 20), (20, 30), (30, 25), (25, 40), (40, 45), (15, 22)]
    own = [{"player_id": 1, "team": "A", "type": "Pressure", "x": float(x), "y": float(y)} for x, y in places]
    assert zones.zone_rectangles(event(spark, own[:4])).count() == 0
    (z,) = zones.zone_rectangles(event(spark, own)).collect()
    (r,) = zones.zone_rectangles(event(spark, [e | {"x": 120 - e["x"], "y": 80 - e["y"]} for e in own])).collect()
    assert z.n_actions == 6 and math.isclose(z.u_hi - z.u_lo, r.u_hi - r.u_lo) and math.isclose(abs(z.cos), abs(r.cos))


def test_zone_damage_counts_from_first_contact(spark):
    own = [{"player_id": 1, "team": "A", "type": "Duel", "x": float(x), "y": float(y), "possession": 0} for x, y in [(10, 10), (30, 30), (10, 30), (30, 10), (20, 20)]]
    rival = lambda t, x, y, o, p, **k: {"player_id": 2, "team": "B", "type": "Pass", "t": t, "x": 120.0 - x, "y": 80.0 - y, "obv_total_net": o, "possession": p} | k
    ev = event(spark, own + [rival(1.0, 90, 70, 1.0, 5), rival(2.0, 20, 20, 2.0, 5), rival(3.0, 90, 70, 4.0, 5, type="Shot", shot_statsbomb_xg=0.3), rival(4.0, 20, 20, 8.0, 5), rival(5.0, 90, 70, 16.0, 6)])
    minutes_ = spark.createDataFrame([(1, 45)], "player_id long, total_minutes long")
    (d,) = zones.zone_damage(ev, zones.zone_rectangles(ev), minutes_).collect()
    assert (d.obv_into_area, d.obv_from_area, d.shots_from_area, d.xg_from_area, d.obv_into_area_per90) == (10.0, 14.0, 1, 0.3, 20.0)


def test_keeper_links(spark):
    ev = spark.createDataFrame([
        ("k1", 1, "Goal Keeper", 5.0, "No Catch", ["s1", "s2", "zz"], None, None, None), ("k2", 1, "Goal Keeper", 25.0, None, ["p1"], None, None, None), ("k3", 1, "Goal Keeper", 5.0, None, None, None, None, None),
        ("s1", 2, "Shot", 110.0, None, None, "Goal", "Open Play", "0.5"), ("s2", 2, "Shot", 110.0, None, None, "Saved", None, "bad"), ("p1", 2, "Shot", 108.0, None, None, "Goal", "Penalty", "0.8"),
    ], "id string, player_id long, type string, x double, goalkeeper_outcome string, related_events array<string>, shot_outcome string, shot_type string, shot_statsbomb_xg string")
    (s,) = keeper.faced(keeper.shot_links(ev)).collect()
    assert (s.gk_shots_on_target_against, s.gk_saves, s.gk_save_pct, s.gk_psxg_faced, s.gk_goals_prevented, s.gk_errors_leading_to_shot, s.gk_errors_leading_to_goal, s.gk_shots_open_play_in_box_against) == (2, 1, 0.5, 0.5, -0.5, 2, 1, 1)
    (p,) = keeper.faced(keeper.shot_links(ev, penalties=None)).collect()
    assert all(getattr(s, c) == getattr(p, c) for c in keeper.OUTPUT if c in s.asDict() and "penalt" not in c) and s.gk_penalties_faced is None
    assert (p.gk_penalties_faced, p.gk_penalties_conceded, p.gk_penalty_save_pct, p.gk_penalties_psxg) == (1, 1, 0.0, 0.8)
    assert keeper.psxg_column(["shot_statsbomb_xg", "shot_shot_execution_xg"]) == "shot_shot_execution_xg"


def test_percentiles_and_flags(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 2.0), ("d", 1, None), ("e", 2, 9.0)], "e string, g int, m double")
    got = {r.e: r.p for r in df.select("e", scoring.percentile_rank(F.col("m"), ["g"]).alias("p")).collect()}
    assert got == {"a": pytest.approx(100 / 3), "b": pytest.approx(250 / 3), "c": pytest.approx(250 / 3), "d": None, "e": 100.0}
    s = spec("g", One=(0.7, "first", "m 1\nabsent 3"), Two=(0.3, "second", "-m 1"))
    rows = {r.e: r for r in scoring.score(df, ["e"], ["g"], s).collect()}
    assert "d" not in rows and rows["a"].Score_One == pytest.approx(100 / 3) and rows["a"].Score_Two == pytest.approx(200 / 3)
    assert rows["a"].profile == "second" and rows["b"].profile == "first" and rows["e"].profile == "first | second"
    with pytest.raises(ValueError):
        scoring.what_if(df, {"m": 1.0})
    assert scoring.weights_accepted({"a": 0.5, "b": 0.49}) and not scoring.weights_accepted({"a": 0.5})


def test_specs():
    assert parse(" a .5\n-b_per90 .25 ") == [("a", 0.5, False), ("b_per90", 0.25, True)]
    assert len(SPECS) == 7
    for s in SPECS.values():
        assert sum(s.weights.values()) == pytest.approx(1) and set(s.labels) == set(s.weights)
        for name, own in s.metrics.items():
            assert sum(w for _, w, _ in own) == pytest.approx(0.6 if name == "ImpactoOfensivo" else 1), name


def test_positions_score(spark):
    names = SPECS["Lateral"].all_metrics()
    extra = ["obv_total_net_type_duel_per90", "obv_total_net_type_interception_per90"]
    rows = [(i, "s", "Left Back", 900, 10, "T", *[float((i * (k + 3)) % 7) for k in range(len(names) + 2)]) for i in range(12)] + [(99, "s", "Left Back", 10, 1, "T", *[1.0] * (len(names) + 2))]
    schema = "player_id long, season string, primary_position string, total_minutes long, matches_played long, teams string, " + ", ".join(f"{n} double" for n in names + extra)
    df = spark.createDataFrame(rows, schema)
    got = scoring.score_position(df, "Lateral").collect()
    assert len(got) == 12 and {"Score_Defensivo", "flag_Score_Defensivo", "profile"} <= set(got[0].asDict())
    assert all(r.Score_Overall == pytest.approx(0.3 * r.Score_Profundidad + 0.3 * r.Score_Calidad + 0.2 * r.Score_Presion + 0.2 * r.Score_Defensivo) for r in got)
    assert sum(r.flag_Score_Overall for r in got) >= 3
    turned = scoring.score_position(df.withColumnRenamed("xa_per90", "assists"), "Lateral", derive=lambda d: d.withColumn("xa_per90", F.col("assists"))).collect()
    assert [(r.player_id, r.Score_Profundidad) for r in turned] == [(r.player_id, r.Score_Profundidad) for r in got]
    lanes_ = lanes.lane_profile(spark.createDataFrame([(1, 0.05), (2, -0.2), (3, 0.3), (4, None)], "player_id long, lane_bias_index double")).orderBy("player_id").collect()
    assert [r.lane_profile for r in lanes_] == ["Balanceado", "Tendencia Exterior", "Marcado Interior", "Sin dato"]


def test_market(spark):
    df = spark.createDataFrame([("a", 50.0, 0.1), ("b", 60.0, 0.2), ("c", 70.0, 0.3), ("d", 70.0, None)], "e string, s double, c double")
    curve = market.market_curve(df, "s", "c", [])
    (m,) = curve.collect()
    assert m.n == 3 and m.slope == pytest.approx(0.01) and m.intercept == pytest.approx(-0.4) and m.sigma == pytest.approx(0, abs=1e-9)
    prices = {r.e: r for r in market.fair_prices(df, curve, "s", "c", []).collect()}
    assert prices["d"].fair == pytest.approx(0.3) and prices["d"].verdict is None and prices["a"].verdict == "good deal"
    ladder = market.price_ladder(curve, 0.0, 0.8, 0.4).orderBy("rung").collect()
    assert [(round(r.score_from), round(r.score_to)) for r in ladder] == [(40, 80), (80, 100)]
    blend = {r.k: r.score_final for r in market.season_blend(spark.createDataFrame([(1, 10.0), (2, 5.0)], "k int, s double"), spark.createDataFrame([(1, 20.0), (3, 7.0)], "k int, s double"), ["k"], "s").collect()}
    assert blend == {1: pytest.approx(18.0), 2: 5.0, 3: 7.0}


def test_compare_and_reconcile(spark):
    df = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "e int, g string, m double")
    box = {r.e: r for r in compare.box_table(df, ["e"], ["g"], ["m"]).collect()}
    assert box[4].outlier and not box[0].outlier and (box[0].median, box[0].whisker_low, box[0].whisker_high) == (3.0, 1.0, 4.0)
    assert [tuple(r) for r in compare.radar_table(df, "e", 0, ["g"], ["m"]).collect()] == [("m", 1.0, 22.0)]
    assert [tuple(r) for r in compare.radar_table(df, "e", 0, ["g"], ["m"], other=1).collect()] == [("m", 1.0, 2.0)]
    a, b = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, v double"), spark.createDataFrame([(2, 4.0), (3, 1.0)], "k int, v double")
    assert {r.side: r.n for r in reconcile.coverage(a, b, "k").collect()} == {"left only": 1, "both": 1, "right only": 1}
    (r,) = reconcile.compare_totals(a, b, ["k"], "v", "v").collect()
    assert (r.diff, r.diff_pct) == (1.0, 25.0)
    audit = reconcile.group_audit(spark.createDataFrame([(1, "x"), (1, "y"), (1, None), (2, "x")], "e int, g string"), "e", "g").collect()
    assert [tuple(x)[:5] for x in audit] == [(1, "x, y", 2, 3, 1)]
    assert normalize.contract(df, ["m", "zz", "e"]).columns == ["m", "e"]


def test_season_tables(spark, tmp_path):
    root = f"{tmp_path}/scores"
    df = spark.createDataFrame([(1, "2023_2024"), (2, "2024_2025")], "player_id int, season string")
    tables.write_season(df, root)
    tables.write_season(df.where("player_id = 2").withColumn("player_id", F.lit(5)), root)
    assert [r.season for r in tables.seasons(spark.read.parquet(root)).collect()] == ["2024_2025", "2023_2024"]
    assert [r.player_id for r in tables.read_season(spark, root, "2024_2025").collect()] == [5] and spark.read.parquet(root).count() == 2
    with open(f"{tmp_path}/events_2021_2022.csv", "w", encoding="utf-8-sig") as f:
        f.write('id,player\n1,"{\'id\': 3, \'name\': \'NÃºÃ±ez\'}"\n')
    ev = tables.read_events(spark, f"{tmp_path}/events_2021_2022.csv").collect()
    assert ev[0].season == "2021_2022" and ev[0].id == "1"
    assert tables.read_scores(spark, f"{tmp_path}/events_2021_2022.csv").first().player == "{'id': 3, 'name': 'Núñez'}"
    tables.write_csv(df, f"{tmp_path}/out", [F.desc("player_id")])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2
