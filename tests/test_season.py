"""Season metrics against values worked out by hand from their definitions."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import columns as C
from tallyfield.functions import pitch as P
from tallyfield.operators import compare, metrics, normalize, ranking, scoring, season
from tallyfield.operators.specs import SPECS, spec
from tallyfield.sources import tables

EVENT = "match_id long, player_id long, idx long, period int, minute int, possession long, t double, team string, possession_team string, type string, play_pattern string, x double, y double, pass_end_x double, carry_end_x double, obv_total_net double, shot_statsbomb_xg double, position string, season string, id string, related_events array<string>, goalkeeper_outcome string, shot_outcome string, shot_type string, pass_outcome string, pass_length double, pass_cross string, under_pressure string, duel_type string, duel_outcome string, interception_outcome string, ball_recovery_offensive string, ball_recovery_recovery_failure string, foul_committed_advantage string, foul_committed_offensive string, clearance_head string, clearance_other string, block_deflection string, duel_won double, duel_lost double"
NAMES = [c.split()[0] for c in EVENT.split(", ")]


def events(spark, rows):
    base = dict.fromkeys(NAMES) | {"match_id": 1, "period": 1, "minute": 0, "possession": 1, "t": 0.0, "team": "A", "possession_team": "A", "play_pattern": "Regular Play", "position": "Center Back", "season": "s", "x": 60.0, "y": 40.0}
    return spark.createDataFrame([tuple((base | {"idx": i, "id": f"e{i}"} | r)[n] for n in NAMES) for i, r in enumerate(rows)], EVENT)


def duel(outcome, kind="Tackle", player=1):
    return {"player_id": player, "type": "Duel", "duel_type": kind, "duel_outcome": outcome}


def test_season_metrics(spark):
    rows = [
        # Duels: 3 won in some way, 4 lost in some way; Won 1, Lost In Play 3; aerial 1 of 2.
        duel("Won"), duel("Success In Play"), duel("Success Out"), duel("Lost In Play"), duel("Lost In Play"), duel("Lost Out"), duel("Lost In Play", "Aerial Lost"), duel("Success"), duel(None), duel("Won", "Aerial Lost", 2),
        {"player_id": 1, "type": "Interception", "interception_outcome": "Won"}, {"player_id": 1, "type": "Interception", "interception_outcome": "Lost In Play"}, {"player_id": 1, "type": "Interception", "interception_outcome": "Lost Out"}, {"player_id": 1, "type": "Interception", "interception_outcome": "Success Out"},
        # Recoveries: 1 offensive, 2 failures, 1 neither.
        *({"player_id": 1, "type": "Ball Recovery", "ball_recovery_offensive": o, "ball_recovery_recovery_failure": f} for o, f in (("true", "false"), ("false", "true"), ("False", "TRUE"), ("false", None))),
        # Fouls: 2 with advantage, 1 offensive; fouls won do not count.
        *({"player_id": 1, "type": "Foul Committed", "foul_committed_advantage": a, "foul_committed_offensive": o} for a, o in (("true", None), ("true", "true"), ("false", "false"))), {"player_id": 1, "type": "Foul Won"},
        # Clearances: 2 by head, 1 other, 1 of no kind; blocks: 1 deflection of 2.
        *({"player_id": 1, "type": "Clearance", "clearance_head": h, "clearance_other": o} for h, o in (("true", "false"), ("true", "false"), ("false", "true"), ("false", "false"))),
        {"player_id": 1, "type": "Block", "block_deflection": "true"}, {"player_id": 1, "type": "Block", "block_deflection": "false"},
        # Passes: 3, one out; 1 complete under pressure; one ends in the final third.
        {"player_id": 1, "type": "Pass", "pass_end_x": 81.0, "under_pressure": "true", "pass_cross": "false", "obv_total_net": 0.5}, {"player_id": 1, "type": "Pass", "pass_end_x": 10.0, "pass_outcome": "Out", "under_pressure": "true", "obv_total_net": -0.25}, {"player_id": 1, "type": "Pass", "under_pressure": "false"},
        {"player_id": 1, "type": "Shot", "shot_outcome": "Goal", "shot_statsbomb_xg": 0.4, "x": 110.0}, {"player_id": 1, "type": "Shot", "shot_outcome": "Saved", "shot_statsbomb_xg": 0.2, "x": 90.0}, {"player_id": 1, "type": "Pressure", "x": 100.0, "duel_won": 3.0, "duel_lost": 1.0},
        # No line-up and no position: not a known player. Of B, only to end the match at 90.
        {"player_id": 3, "type": "Pass", "position": None}, {"player_id": 2, "type": "Pass", "minute": 90, "team": "B", "possession_team": "B"},
    ]
    xi = spark.createDataFrame([(1, 1, "Center Back", "A"), (1, 2, "Left Back", "B")], "match_id long, player_id long, position string, team string")
    none = spark.createDataFrame([], "match_id long, player_id long, minute int")
    off = spark.createDataFrame([(1, 1, 45)], "match_id long, player_id long, minute int")
    values = {"type": ["Pass", "Shot"], "duel_outcome": ["Won", "Lost In Play", "Lost Out"]}
    table = season.player_season(events(spark, rows), xi, none, off, values, ["Pass: Out"])
    assert table.columns[:9] == ["player_id", "primary_position", "all_positions", "teams", "total_minutes", "minutes_primary_position", "primary_position_share", "matches_played", "times_starter"]
    got = {r.player_id: r.asDict() for r in table.collect()}
    # The pitch is as long as nearly all places: some 108, so that its box begins at 90 and a bit.
    assert set(got) == {1, 2} and got[1]["total_minutes"] == 45 and got[2]["total_minutes"] == 90
    want = {
        "tackle_success_pct": 3 / 7, "duel_success_rate": 1 / 4, "aerial_duel_success_rate": 0.0, "interception_success_rate": 1 / 2, "ball_recovery_success_pct": 1 / 3, "duel_win_pct": 3 / 4,
        "foul_committed": 3.0, "foul_committed_per90": 6.0, "defensive_actions_lost_per90": 3 * 2 + 3 * 2, "clearances_total_per90": (2 + 1) * 2, "blocks_total_per90": 2.0,
        "pass_completion_rate": 2 / 3, "total_passes": 3, "incomplete_passes": 1, "complete_passes_per90": 4.0, "completed_passes_under_pressure": 1, "pass_into_final_third_per90": 2.0, "under_pressure": 2.0,
        "xg_per_shot": 0.3, "goals_per90": 2.0, "pressure_per90": 2.0, "touches_in_opp_box": 2, "total_touches": 33, "shot_touch_pct": 2 / 33, "obv_total_net": 0.25, "obv_total_net_type_pass": 0.25, "obv_total_net_type_pass_per90": 0.5, "n_events_duel_outcome_lost_in_play": 3,
        "ball_recovery_offensive_per90": 2.0, "n_events_third_attacking_pressure_per90": 2.0, "duel_tackle": 8,
    }
    for name, value in want.items():
        assert got[1][name] == pytest.approx(value), name
    assert got[2]["tackle_success_pct"] == 1.0 and got[2]["aerial_duel_success_rate"] == 1.0 and got[2]["interception_success_rate"] is None and got[2]["foul_committed"] == 0.0
    # All null: a null total, but breakdowns of zero.
    assert got[2]["obv_total_net"] is None and got[2]["obv_total_net_type_pass"] == 0.0
    two = metrics.composites(spark.createDataFrame([(1.0, 2.0, 4.0)], "n_events_duel_outcome_lost_in_play_per90 double, n_events_duel_outcome_lost_out_per90 double, foul_committed_per90 double"), ("Lost In Play", "Lost Out"))
    assert two.first().defensive_actions_lost_per90 == 7.0 and "blocks_total_per90" not in two.columns


def test_every_metric_of_the_specifications_is_made_or_named():
    from tallyfield.plans.match_queries import SEASON_COLUMNS

    absent = {m for s in SPECS.values() for m in s.all_metrics()} - set(SEASON_COLUMNS)
    # The match view has no free kicks; a log with that play pattern gives these two by its breakdown.
    assert absent == {f"{m}_play_pattern_from_free_kick_per90" for m in ("obv_total_net", "shot_statsbomb_xg")}


def test_pitch_size(spark):
    size = lambda *xy: tuple(P.pitch_size(spark.createDataFrame(xy, "x double, y double")).first())
    assert size((130.0, 81.0)) == (120.0, 80.0) and size((90.0, 99.0)) == (100.0, 100.0) and size((110.0, 105.0)) == (110.0, 105.0) and size((110.0, 500.0)) == (110.0, 120.0)
    assert size((None, None)) == (120.0, 80.0)


def test_derived_metrics_and_entry_points(spark):
    df = spark.createDataFrame([(1, "Center Midfield", 90, 10.0, "3", 0.6, 3.0)], "player_id long, primary_position string, total_minutes long, complete_passes double, tackles_per90 string, shot_statsbomb_xg_per90 double, total_shots_per90 double")
    assert scoring.derived_metrics(df, "Interior/Mediapunta").first().complete_passes_per90 == 10.0
    assert scoring.derived_metrics(df, "Volante").first().duel_tackle_per90 == 3.0
    assert scoring.derived_metrics(df, "Delantero").first().xg_per_shot == pytest.approx(0.2) and scoring.derived_metrics(df, "Golero").columns == df.columns
    kept = scoring.derived_metrics(df.withColumn("xg_per_shot", F.lit(9.0)), "Extremo").first()
    assert kept.xg_per_shot == 9.0
    rows = [(i, "s", p, m, n, "T", float(i)) for i, (p, m, n) in enumerate([("Center Back", 599, 9), ("Center Back", 600, 5), ("Left Wing", 450, 3), ("Left Wing", 449, 3), ("Left Wing", 900, 2)])]
    players = spark.createDataFrame(rows, "player_id long, season string, primary_position string, total_minutes long, matches_played long, teams string, counterpress_per90 double")
    assert [r.player_id for r in scoring.run_position(players, "Zaguero").collect()] == [1]
    wing = scoring.run_position(players, "Extremo").collect()
    assert [(r.player_id, r.lane_profile) for r in wing] == [(2, "Sin dato")] and scoring.run_position(players, "Extremo", min_matches=1).count() == 2


def test_detail_against(spark):
    df = spark.createDataFrame([(1, "g", 1.0, 5.0, 2.0), (2, "g", 3.0, None, 1.0), (3, "g", 2.0, None, None)], "e long, g string, a double, b double, c double")
    ranked = compare.detail_table(df, "e", ["g"], ["a", "b", "c"])
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "e long, other long")
    got = {(r.e, r.metric): (r.pct, r.other_pct) for r in compare.detail_against(ranked, "e", pairs).collect()}
    assert got == {(1, "a"): (pytest.approx(100 / 3), 100.0), (1, "b"): (100.0, None), (1, "c"): (100.0, 50.0)}


def test_cells_of_players_and_teams(spark):
    raw = spark.createDataFrame([("7", None, "{'team_name': 'Reds'}"), (None, "{'id': 8, 'name': 'Z'}", "Blues")], "`player.id` string, player string, team string")
    got = normalize.normalize_events(raw).select("player_id", "player_name", "team").collect()
    assert [tuple(r) for r in got] == [(7, None, "Reds"), (8, "Z", "Blues")]


def test_encodings_and_byte_order_mark(spark, tmp_path):
    for name, code in (("a", "utf-8"), ("b", "cp1252"), ("c", "utf-8-sig")):
        (tmp_path / f"{name}.csv").write_bytes("team_name,player_name\nPeñarol,José – “x”\n".encode(code))
        (row,) = tables.read_scores(spark, f"{tmp_path}/{name}.csv").collect()
        assert tuple(row) == ("Peñarol", "José – “x”"), name
    assert [tables.is_utf8(spark, f"{tmp_path}/{n}.csv") for n in "abc"] == [True, False, True]
    players = spark.createDataFrame([(1, 10, "é"), (2, 30, "b"), (3, 30, "c")], "player_id long, total_minutes long, player_name string")
    tables.export_season(players.coalesce(1), f"{tmp_path}/out")
    parts = [p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert all(p.startswith(b"\xef\xbb\xbfplayer_id,") for p in parts)
    assert [line.split(",")[0] for p in parts for line in p.decode("utf-8-sig").splitlines()[1:]] == ["2", "3", "1"]
    (tmp_path / "use.csv").write_text("team_name,player_name,minutes_played_percentage,player_annual_cost_percentage,talent_cost_utilization_per_player\nA,B,0.5,0.2,0.1\n")
    assert math.isclose(tables.read_cost_use(spark, f"{tmp_path}/use.csv").first().talent_cost_utilization_per_player, 0.1)


def test_divided_ranking_equals_the_plain_one(spark):
    rows = [(i, "g" if i % 3 else "h", float((i * 7919) % 101), None if i % 5 == 0 else float(i % 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "e long, g string, a double, b double")
    plain, divided = (sorted(map(tuple, scoring.long_percentiles(df, ["e"], ["g"], ["a", "b"], parts=p).select("e", "g", "metric", "value", F.round("pct", 9)).collect())) for p in (1, 7))
    assert plain == divided and len(plain) == 720


def test_mixed_encodings_in_one_folder(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    for name, code in (("a_2023_2024", "utf-8"), ("b_2024_2025", "cp1252"), ("c_2025_2026", "utf-8-sig")):
        (folder / f"{name}.csv").write_bytes(f"team_name,señal\nPeñarol,José – “{name[0]}”\n".encode(code))
    names = sorted(tuple(r) for r in tables.read_scores(spark, str(folder)).select("team_name", "señal").collect())
    assert names == [("Peñarol", f"José – “{n}”") for n in "abc"]
    assert [[f.rsplit("/", 1)[1][0] for f in files] for files in tables.by_encoding(spark, str(folder))] == [["a", "c"], ["b"]]
    read = tables.read_events(spark, str(folder), schema="team_name string, note string")
    assert sorted((r.season, r.team_name) for r in read.collect()) == [(s, "Peñarol") for s in ("2023_2024", "2024_2025", "2025_2026")]
    assert read.columns == ["team_name", "note", "season"]
    assert {r.team_name for r in tables.read_scores(spark, f"{folder}/b_2024_2025.csv", encoding="ISO-8859-1").collect()} == {"Peñarol"}


def test_literals_keep_their_strings(spark):
    cells = {
        "{'id': 7, 'name': 'a: None, b'}": {"id": 7, "name": "a: None, b"},
        "{'name': \"O'Neil, True \", 'label': None}": {"name": "O'Neil, True ", "label": None},
        r"{'name': 'it\'s, None ]', 'type': 'x'}": {"name": "it's, None ]", "type": "x"},
        '{"name": "say \\"True\\"", "id": 3}': {"name": 'say "True"', "id": 3},
        "{'a': [True, False,None], 'name': 'N'}": {"name": "N"},
        "{'name': '" + "x: None, " * 5000 + "', 'id': 1}": {"name": "x: None, " * 5000, "id": 1},
    }
    df = spark.createDataFrame([(c,) for c in cells], "v string").select("v", C.entity(F.col("v")).alias("e")).collect()
    for row in df:
        for key, value in cells[row.v].items():
            assert row.e[key] == value, row.v[:60]
    one = spark.createDataFrame([("[True, None,False , 'None']",), (None,), ("",), ("'open",)], "v string").select(C.literal_json(F.col("v")).alias("j")).collect()
    assert [r.j for r in one] == ["[true, null,false , 'None']", None, "", "'open"]


def test_stored_seasons_read_no_data(spark, tmp_path):
    root = f"{tmp_path}/t"
    tables.write_season(spark.createDataFrame([(1, "2023_2024"), (2, "2025_2026"), (3, "a b/ñ"), (4, None)], "i long, season string"), root)
    listed = tables.stored_seasons(spark, root)
    assert [r.season for r in listed.collect()] == ["a b/ñ", "2025_2026", "2023_2024"]
    assert "FileScan" not in listed._jdf.queryExecution().executedPlan().toString()


def test_exact_quantiles(spark):
    rows = [("g" if i % 3 else None, float((i * 7919) % 23)) for i in range(200)] + [("h", 1.0), ("g", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    want = {r.g: r.q for r in df.where("value is not null").groupBy("g").agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    for parts in (1, 5, 40):
        got = {r.g: r.q for r in ranking.quantiles(df, ["g"], "value", [0.1, 0.5, 0.75], parts).collect()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    plan = ranking.quantiles(df, ["g"], "value", [0.5], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    assert ranking.quantiles(df.where("g = 'none'"), ["g"], "value", [0.5], 5).count() == 0


def test_positions_without_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit("x").alias("position_")).repartition(7)
    got = ranking.positions(rows, [F.desc("k")]).select("position", "k").collect()
    want = sorted((r.k for r in rows.collect()), reverse=True)
    assert sorted(tuple(r) for r in got) == [(i + 1, k) for i, k in enumerate(want)]


def test_equal_scores_are_equal_bits_and_equally_flagged(spark):
    # 7/11 and 3/11 + 4/11 of a hundred, as means of different metrics: equal as numbers, not as sums of floats.
    own = spec("g", A=(0.7, "A", "a 0.1\nb 0.2\nc 0.7"), B=(0.3, "B", "c 1.0"))
    rows = [(i, "s", float(i % 11), float((i * 3) % 11), float((i * 5) % 11)) for i in range(220)]
    df = spark.createDataFrame(rows, "e long, g string, a double, b double, c double")
    seen = []
    for parts, slices in ((1, 1), (1, 4), (1, 16), (6, 5)):
        spark.conf.set("spark.sql.shuffle.partitions", str(slices))
        scored = scoring.score(df.repartition(slices), ["e"], ["g"], own, parts=parts).collect()
        seen.append(sorted((r.e, r.Score_A, r.Score_B, r.Score_Overall, r.flag_Score_A, r.flag_Score_B, r.flag_Score_Overall, r.profile) for r in scored))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(s == seen[0] for s in seen)
    for column, flag in ((1, 4), (2, 5), (3, 6)):
        assert len({(r[column], r[flag]) for r in seen[0]}) == len({r[column] for r in seen[0]})
    a = {r[0]: r[1] for r in seen[0]}
    assert a[0] == a[11] and len(set(a.values())) <= 11


def test_all_groups_in_one_plan(spark):
    named = list(dict.fromkeys(m for s in SPECS.values() for m in s.all_metrics()))[:60]
    places = [P.positions_of(g)[0] for g in SPECS]
    rows = [(i, "s" if i % 2 else "t", places[i % 7], 500 + i, 4 + i % 3, f"T{i % 3}, U") + tuple(None if (i * j) % 13 == 0 else float((i * (j + 3)) % 17) for j in range(len(named))) for i in range(1, 150)]
    players = spark.createDataFrame(rows, "player_id long, season string, primary_position string, total_minutes long, matches_played long, teams string, " + ", ".join(f"`{m}` double" for m in named))
    for given in ({}, {"teams": ["T1, U"], "mix": (0.5, 0.5)}):
        together = {(r.player_id, r.season, r.category): (r.score, r.flag) for r in scoring.score_groups(players, **given).collect()}
        apart = {}
        for group, own in SPECS.items():
            for r in scoring.run_position(players, group, **given).collect():
                for c in (*own.weights, "Overall"):
                    if r[f"Score_{c}"] is not None:
                        apart[r.player_id, r.season, c] = (r[f"Score_{c}"], r[f"flag_Score_{c}"])
        assert together == apart and together
    profiles = {(r.player_id, r.season): (r.total, r.profile) for r in scoring.group_profiles(scoring.score_groups(players)).collect()}
    alone = {(r.player_id, r.season): (r.Score_Overall, r.profile) for g in SPECS for r in scoring.run_position(players, g).collect()}
    assert profiles == alone


def test_season_reads_the_log_few_times(spark):
    from tallyfield.plans.match_queries import season_view

    plan = season_view(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("FileScan") <= 12 and len(re.findall(r"\bExchange\b", plan)) <= 15


def test_a_log_laid_out_by_match_is_not_shuffled_by_match(spark):
    from tallyfield.operators import turnovers, zones
    from tallyfield.plans.adapters import match_view

    plain = match_view(spark, "/root/testdata/sf0.001")
    log = tables.by_match(plain, 4)
    assert sorted(map(str, log.collect())) == sorted(map(str, plain.select(*log.columns).collect()))
    exchanges = lambda df: len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))
    assert exchanges(turnovers.turnovers(log)) == 0 < exchanges(turnovers.turnovers(plain))
    assert exchanges(zones.zone_rectangles(log)) == 0 < exchanges(zones.zone_rectangles(plain))
