"""Scoring specifications of the position groups, as data.

A metric is a line `name weight`; a leading - marks lower as better.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Spec:
    """Categories with their weights and metrics (name, weight, inverted), and the label of each category's flag."""

    group: str
    weights: dict[str, float]
    metrics: dict[str, list[tuple[str, float, bool]]]
    labels: dict[str, str] = field(default_factory=dict)

    def all_metrics(self) -> list[str]:
        return list(dict.fromkeys(m for own in self.metrics.values() for m, _, _ in own))

    def table(self, spark: SparkSession) -> DataFrame:
        """(grp, category, metric, weight, inverted, category_weight): a row for each metric."""
        rows = [(self.group, c, m, w, inv, self.weights[c]) for c, own in self.metrics.items() for m, w, inv in own]
        return spark.createDataFrame(rows, "grp string, category string, metric string, weight double, inverted boolean, category_weight double")


def parse(text: str) -> list[tuple[str, float, bool]]:
    pairs = [line.split() for line in text.strip().splitlines()]
    return [(name.lstrip("-"), float(weight), name.startswith("-")) for name, weight in pairs]


def spec(group: str, **categories: tuple[float, str, str]) -> Spec:
    """categories: weight, label, metrics."""
    return Spec(group, {c: w for c, (w, _, _) in categories.items()}, {c: parse(m) for c, (_, _, m) in categories.items()}, {c: label for c, (_, label, _) in categories.items()})


#: The groups' categories, weights, labels and metrics.
DEF_EXEC = """
    duel_success_rate 0.25
    tackle_success_pct 0.25
    ball_recovery_success_pct 0.15
    interception_success_rate 0.1
    clearances_total_per90 0.1
    blocks_total_per90 0.05
    -defensive_actions_lost_per90 0.1
"""
DEF_OBV = """
    obv_total_net_type_duel_per90 0.2
    obv_total_net_duel_type_tackle_per90 0.25
    obv_total_net_type_interception_per90 0.2
    obv_total_net_type_ball_recovery_per90 0.2
    obv_total_net_type_clearance_per90 0.15
"""
SPECS = {
    s.group: s
    for s in (
        spec(
            "Golero",
            Effectiveness=(
                0.5,
                "Atajador",
                """
                gk_goals_prevented_per90 0.5
                gk_save_pct 0.25
                -gk_errors_leading_to_shot_per90 0.1
                -gk_errors_leading_to_goal_per90 0.15
                """,
            ),
            Area_Domination=(
                0.2,
                "Dominante",
                """
                gk_claims_per90 0.5
                -gk_shots_open_play_in_box_against_per90 0.5
                """,
            ),
            Foot_Play=(
                0.15,
                "Juego de Pies",
                """
                gk_pass_obv_per90 0.4
                gk_long_ball_pct 0.2
                gk_pressured_passes_def_third_per90 0.2
                gk_pressured_passes_def_third_completion_pct 0.2
                """,
            ),
            Outside_Box=(
                0.15,
                "Libero",
                """
                gk_actions_outside_box_per90 0.5
                gk_aggressive_distance_avg 0.5
                """,
            ),
        ),
        spec(
            "Zaguero",
            AccionDefensiva=(0.25, "Acción Def", DEF_EXEC),
            ControlDefensivo=(
                0.45,
                "Control Def",
                """
                pressure_per90 0.15
                counterpress_per90 0.15
                -obv_into_area_per90 0.25
                -obv_from_area_per90 0.25
                -shots_from_area_per90 0.1
                -xg_from_area_per90 0.1
                """,
            ),
            Progresion=(
                0.2,
                "Progresión",
                """
                pass_completion_rate 0.15
                pass_into_final_third_per90 0.2
                pass_switch_per90 0.2
                carry_into_final_third_per90 0.1
                pass_through_ball_per90 0.15
                obv_total_net_type_pass_per90 0.2
                """,
            ),
            ImpactoOfensivo=(
                0.1,
                "Ofensivo",
                """
                shot_statsbomb_xg_play_pattern_regular_play_per90 0.15
                shot_statsbomb_xg_play_pattern_from_corner_per90 0.075
                shot_statsbomb_xg_play_pattern_from_free_kick_per90 0.075
                obv_total_net_play_pattern_regular_play_per90 0.15
                obv_total_net_play_pattern_from_free_kick_per90 0.075
                obv_total_net_play_pattern_from_corner_per90 0.075
                """,
            ),
        ),
        spec(
            "Lateral",
            Profundidad=(
                0.3,
                "Profundos",
                """
                pass_into_final_third_per90 0.15
                carry_into_final_third_per90 0.25
                n_events_third_attacking_pass_per90 0.2
                n_events_third_attacking_pass_cross_openplay_per90 0.2
                xa_per90 0.2
                """,
            ),
            Calidad=(
                0.3,
                "Técnicos",
                """
                obv_total_net_type_pass_per90 0.45
                obv_total_net_type_dribble_per90 0.25
                obv_total_net_type_carry_per90 0.2
                -total_turnovers_per90 0.1
                """,
            ),
            Presion=(
                0.2,
                "Presionantes",
                """
                pressure_per90 0.35
                n_events_third_attacking_pressure_per90 0.35
                ball_recovery_offensive_per90 0.15
                counterpress_per90 0.15
                """,
            ),
            Defensivo=(0.2, "Protectores", DEF_EXEC),
        ),
        spec(
            "Volante",
            Posesion=(
                0.25,
                "Posesión",
                """
                complete_passes_per90 0.2
                completed_passes_under_pressure_per90 0.3
                -total_turnovers_per90 0.2
                obv_total_net_type_pass_per90 0.3
                """,
            ),
            Progresion=(
                0.3,
                "Progresión",
                """
                pass_into_final_third_per90 0.2
                carry_into_final_third_per90 0.2
                obv_total_net_type_carry_per90 0.2
                pass_switch_per90 0.2
                pass_through_ball_per90 0.2
                """,
            ),
            Territoriales=(
                0.25,
                "Territoriales",
                """
                n_events_third_defensive_pressure_per90 0.12
                n_events_third_middle_pressure_per90 0.18
                counterpress_per90 0.05
                n_events_third_defensive_ball_recovery_per90 0.15
                n_events_third_middle_ball_recovery_per90 0.2
                obv_total_net_type_interception_per90 0.15
                obv_total_net_type_ball_recovery_per90 0.15
                """,
            ),
            Contencion=(
                0.2,
                "Contención",
                """
                duel_tackle_per90 0.22
                obv_total_net_duel_type_tackle_per90 0.23
                interception_success_rate 0.17
                obv_total_net_type_interception_per90 0.23
                n_events_third_defensive_interception_per90 0.15
                """,
            ),
        ),
        spec(
            "Interior/Mediapunta",
            BoxToBox=(
                0.25,
                "Box to Box",
                """
                n_events_third_defensive_ball_recovery_per90 0.11
                n_events_third_attacking_ball_recovery_per90 0.11
                n_events_third_middle_ball_recovery_per90 0.14
                n_events_third_defensive_duel_per90 0.08
                n_events_third_attacking_duel_per90 0.08
                n_events_third_middle_duel_per90 0.14
                carry_into_final_third_per90 0.1
                touches_in_opp_box_per90 0.1
                shot_touch_pct 0.05
                total_touches_per90 0.09
                """,
            ),
            Desequilibrio=(
                0.3,
                "Desequilibrantes",
                """
                obv_total_net_type_dribble_per90 0.3
                obv_total_net_type_carry_per90 0.25
                carry_into_final_third_per90 0.15
                pass_into_final_third_per90 0.1
                obv_total_net_type_shot_per90 0.1
                shot_statsbomb_xg_per90 0.1
                """,
            ),
            Organizacion=(
                0.25,
                "Organizadores",
                """
                obv_total_net_type_pass_per90 0.3
                complete_passes_per90 0.2
                pass_shot_assist_per90 0.12
                obv_total_net_third_attacking_pass_per90 0.13
                obv_total_net_play_pattern_regular_play_per90 0.1
                -total_turnovers_per90 0.15
                """,
            ),
            ContencionPresion=(
                0.2,
                "Contención/Presión",
                """
                n_events_third_middle_pressure_per90 0.18
                n_events_third_attacking_pressure_per90 0.12
                counterpress_per90 0.1
                n_events_third_middle_ball_recovery_per90 0.12
                n_events_third_attacking_ball_recovery_per90 0.13
                obv_total_net_duel_type_tackle_per90 0.1
                duel_tackle_per90 0.1
                obv_total_net_type_interception_per90 0.08
                obv_total_net_third_middle_interception_per90 0.07
                """,
            ),
        ),
        spec(
            "Extremo",
            CompromisoDef=(
                0.2,
                "Compromiso Def",
                """
                n_events_third_attacking_pressure_per90 0.2
                counterpress_per90 0.2
                n_events_third_attacking_ball_recovery_per90 0.15
                obv_total_net_type_ball_recovery_per90 0.2
                obv_total_net_type_interception_per90 0.1
                pressure_per90 0.15
                """,
            ),
            Desequilibrio=(
                0.35,
                "Desequilibrio",
                """
                obv_total_net_type_dribble_per90 0.18
                obv_total_net_type_carry_per90 0.18
                carry_into_final_third_per90 0.1
                pass_into_final_third_per90 0.08
                pass_shot_assist_per90 0.15
                pass_goal_assist_per90 0.05
                xa_per90 0.12
                obv_total_net_type_pass_per90 0.14
                """,
            ),
            Finalizacion=(
                0.3,
                "Finalización",
                """
                shot_statsbomb_xg_per90 0.35
                obv_total_net_type_shot_per90 0.25
                xg_per_shot 0.2
                touches_in_opp_box_per90 0.2
                """,
            ),
            ZonaInfluencia=(
                0.15,
                "Zona Influencia",
                """
                obv_from_ext_per90 0.35
                obv_from_int_per90 0.35
                obv_total_net_type_pass_per90 0.3
                """,
            ),
        ),
        spec(
            "Delantero",
            Finalizacion=(
                0.4,
                "Killer",
                """
                xg_per_shot 0.2
                shot_statsbomb_xg_per90 0.18
                obv_total_net_type_shot_per90 0.15
                goals_per90 0.05
                touches_in_opp_box_per90 0.15
                touches_in_opp_box_pct 0.1
                obv_total_net_play_pattern_regular_play_per90 0.1
                total_shots_per90 0.04
                shot_touch_pct 0.03
                """,
            ),
            Presionante=(
                0.1,
                "Presionante",
                """
                pressure_per90 0.3
                n_events_third_attacking_pressure_per90 0.2
                counterpress_per90 0.15
                ball_recovery_offensive_per90 0.15
                n_events_third_attacking_ball_recovery_per90 0.1
                obv_total_net_type_interception_per90 0.05
                obv_total_net_type_ball_recovery_per90 0.05
                """,
            ),
            Conector=(
                0.25,
                "Falso 9",
                """
                complete_passes_per90 0.25
                pass_completion_rate 0.15
                pass_into_final_third_per90 0.15
                obv_total_net_type_pass_per90 0.25
                pass_shot_assist_per90 0.15
                -total_turnovers_per90 0.05
                """,
            ),
            Disruptivo=(
                0.25,
                "Disruptivo",
                """
                obv_total_net_type_dribble_per90 0.4
                obv_total_net_type_carry_per90 0.35
                carry_into_final_third_per90 0.15
                pass_into_final_third_per90 0.1
                """,
            ),
        ),
    )
}
#: The fullback's defensive category is a fixed mix of two scores.
LATERAL_MIX = {"exec": (0.6, parse(DEF_EXEC)), "obv": (0.4, parse(DEF_OBV))}
