"""Percentile scores inside peer groups: metrics, categories, totals, flags and profiles.

Metrics are unpivoted first, so that one window partitioned by cohort and metric ranks all of them, and a cohort is
never gathered in one task for all metrics at once. The specification is joined as a small table; score_groups ranks the
groups of all specifications in one plan.

Percentiles enter a score as whole numbers of 10^-9, weights as whole numbers of 10^-6, and scores lie on a grid of 10^-6,
so that sums are exact: the order of rows and partitions decides nothing, equal players have equal scores, and flags
compare them with the exact quantile.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import pitch as P
from ..sources.scratch import settle
from . import ranking
from .specs import LATERAL_MIX, SPECS, Spec

BALANCED, NO_PROFILE = "Balanceado", "Sin perfil"
QUANTILE = 0.75


def percentile_rank(value: Column, cohort: list[str]) -> Column:
    """0 to 100 among the values that are not null, ties averaged; null stays null."""
    present = value.isNotNull()
    by = Window.partitionBy(*cohort, present)
    ordered = by.orderBy(value)
    # Ties are the peers in the same ordering, so that all three windows share one shuffle and one sort.
    ties = F.count("*").over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(present, (F.rank().over(ordered) + (ties - 1) / 2) / F.count(value).over(by) * 100)


def spread_percentiles(long: DataFrame, group: list[str], parts: int) -> DataFrame:
    """long with pct, as percentile_rank gives it, for cohorts too large for one task: distinct values are ranked in ranges.

    The ranks meet the rows by value; they are one row for each value, so that Spark may send them out where they are
    small and split a frequent value where they are not.
    """
    long = settle(long, "values")
    ranks = ranking.percentiles_of(ranking.value_counts(long, group), group, parts)
    return ranking.join_same(long, ranks, [*group, "value"])


def long_percentiles(df: DataFrame, keys: list[str], cohort: list[str], metrics: list[str], parts: int = 1) -> DataFrame:
    """(keys, cohort, metric, value, pct), without null values; parts above 1 divides the ranking of each cohort and metric."""
    ids = list(dict.fromkeys([*keys, *cohort]))
    typed = df.select(*ids, *[C.safe_double(F.col(f"`{m}`")).alias(m) for m in metrics])
    return with_percentiles(typed.unpivot(ids, metrics, "metric", "value").where("value is not null"), [*cohort, "metric"], parts)


def with_percentiles(long: DataFrame, group: list[str], parts: int = 1) -> DataFrame:
    """Rows of (group, value) with pct, their percentile in the group."""
    if parts > 1:
        return spread_percentiles(long, group, parts)
    return long.withColumn("pct", percentile_rank(F.col("value"), group))


def eligible(df: DataFrame, min_minutes: int = 450, min_matches: int = 5, teams: list[str] | None = None, any_team: bool = False) -> DataFrame:
    """Players with enough minutes and matches; teams match the joined team text, or any of its parts."""
    out = df.where((F.col("total_minutes") >= min_minutes) & (F.col("matches_played") >= min_matches))
    if teams:
        listed = F.array(*map(F.lit, teams))
        out = out.where(F.arrays_overlap(F.split("teams", ", "), listed) if any_team else F.col("teams").isin(teams))
    return out


#: Percentiles enter sums in whole numbers of so many a point.
FINE = 1_000_000_000


def _points(pct: Column, inverted: Column) -> Column:
    """A percentile, turned round where lower is better, in whole numbers."""
    whole = F.round(pct * FINE).cast("long")
    return F.when(inverted, 100 * FINE - whole).otherwise(whole)


def _score_of(points: Column, weight: Column) -> Column:
    """Steps of the mean of weighted points: rounded, where what lies within 2 points of a half counts as the half."""
    unit = FINE // C.STEPS
    return F.when(weight > 0, C.whole_div(points + (unit // 2 + 2) * weight, F.greatest(F.lit(1), unit * weight)))


def category_scores(ranked: DataFrame, keys: list[str], cohort: list[str], spec: Spec) -> DataFrame:
    """Weighted means of the percentiles by category, wide; weights of missing metrics are renormalised."""
    ids = list(dict.fromkeys([*keys, *cohort]))
    table = spec.table(ranked.sparkSession).select("category", "metric", F.round(F.col("weight") * C.WEIGHT_STEPS).cast("long").alias("weight"), "inverted")
    own = ranked.join(F.broadcast(table), "metric").withColumn("points", _points(F.col("pct"), F.col("inverted")))  # a row for each metric of one spec is sent
    part = lambda c, v: F.sum(F.when(F.col("category") == c, v))
    one = lambda c: C.from_steps(_score_of(part(c, F.col("points") * F.col("weight")), part(c, F.col("weight"))))
    return own.groupBy(*ids).agg(*[one(c).alias(f"Score_{c}") for c in spec.weights])


def total_score(spec: Spec) -> Column:
    return C.weighted_mean([(F.col(f"Score_{c}"), w) for c, w in spec.weights.items()])


def with_flags(long: DataFrame, group: list[str], q: float = QUANTILE, parts: int = 1) -> DataFrame:
    """Rows of (group, score) with flag: the score reaches the group's exact quantile (linear), compared in whole steps; scores are written once, as they meet their thresholds."""
    placed = settle(long.withColumn("__steps", C.steps(F.col("score"))), "scores")
    limits = ranking.quantile_parts(ranking.value_counts(placed, group, "__steps"), group, [q], parts).select(*group, F.get("q", F.lit(0)).alias("__q"))
    lo, hi, rem, den = (F.col(f"__q.{n}") for n in ("lo", "hi", "rem", "den"))
    reached = F.col("__steps") * den >= lo * (den - rem) + hi * rem
    return ranking.join_same(placed, limits, group, "left").withColumn("flag", F.coalesce(reached, F.lit(False))).drop("__steps", "__q")


def flags(df: DataFrame, cohort: list[str], names: list[str], q: float = QUANTILE, parts: int = 1) -> DataFrame:
    """flag_<name>: the score on the grid reaches the cohort's exact quantile (linear); thresholds are one small row per cohort."""
    df = settle(df, "scores") if parts > 1 else df
    long = df.select(*cohort, *names).unpivot(cohort, names, "__name", "score").withColumn("steps", C.steps(F.col("score")))
    group = [*cohort, "__name"]
    found = ranking.quantile_parts(ranking.value_counts(long, group, "steps"), group, [q], parts)
    wide = found.groupBy(*cohort).agg(*[F.max(F.when(F.col("__name") == n, F.get("q", F.lit(0)))).alias(f"__q_{n}") for n in names])
    joined = ranking.join_same(df, wide, cohort, "left")

    def reached(name: str) -> Column:
        lo, hi, rem, den = (F.col(f"__q_{name}.{p}") for p in ("lo", "hi", "rem", "den"))
        return F.coalesce(C.steps(F.col(name)) * den >= lo * (den - rem) + hi * rem, F.lit(False))

    return joined.withColumns({f"flag_{n}": reached(n) for n in names}).drop(*[f"__q_{n}" for n in names])


def profile(labels: dict[str, str]) -> Column:
    """Labels of the raised flags; Balanceado for none, Sin perfil without labels."""
    if not labels:
        return F.lit(NO_PROFILE)
    text = F.concat_ws(" | ", *[F.when(F.col(f"flag_Score_{c}"), F.lit(label)) for c, label in labels.items()])
    return F.when(text == "", BALANCED).otherwise(text)


def score(df: DataFrame, keys: list[str], cohort: list[str], spec: Spec, q: float = QUANTILE, parts: int = 1) -> DataFrame:
    """Category scores, total, flags and profile of every entity with a metric of the spec; absent metrics are skipped.

    parts above 1 divides ranks and thresholds of a cohort among so many tasks.
    """
    metrics = [m for m in spec.all_metrics() if m in df.columns]
    if not metrics:
        raise ValueError(f"none of the metrics of {spec.group} is there")
    cats = category_scores(long_percentiles(df, keys, cohort, metrics, parts), keys, cohort, spec)
    out = cats.withColumn("Score_Overall", total_score(spec))
    out = flags(out, cohort, ["Score_Overall", *[f"Score_{c}" for c in spec.weights]], q, parts)
    return out.withColumn("profile", profile(spec.labels))


#: Columns that stand in for a metric of a group where it is absent, in order of preference.
STAND_INS = {
    "Volante": {
        "complete_passes_per90": ("passes_completed_per90", "completed_passes"),
        "completed_passes_under_pressure_per90": ("passes_under_pressure_completed_per90",),
        "duel_tackle_per90": ("tackles_per90",),
    }
}


def _derived(have: set[str], group: str) -> dict[str, Column]:
    added = {}
    for name, others in STAND_INS.get(group, {}).items():
        source = next((c for c in others if c in have), None)
        if name not in have and source:
            added[name] = C.safe_double(F.col(source))
    minutes = next((c for c in ("minutes", "total_minutes") if c in have), None)
    if group == "Interior/Mediapunta" and "complete_passes_per90" not in have and "complete_passes" in have and minutes:
        added["complete_passes_per90"] = C.per90(C.safe_double(F.col("complete_passes")), C.safe_double(F.col(minutes)))
    if group in ("Delantero", "Extremo") and "xg_per_shot" not in have and {"shot_statsbomb_xg_per90", "total_shots_per90"} <= have:
        added["xg_per_shot"] = C.ratio(C.safe_double(F.col("shot_statsbomb_xg_per90")), C.safe_double(F.col("total_shots_per90")))
    return added


def derived_metrics(players: DataFrame, group: str) -> DataFrame:
    """Metrics of a group that other columns give, where they are absent: stand-ins, passes per 90 minutes, xG per shot."""
    return players.withColumns(_derived(set(players.columns), group))


def _derived_by_group(players: DataFrame, groups: list[str], of: Column) -> DataFrame:
    """The derived metrics of all groups at once, each in the rows of its own group."""
    found: dict[str, Column] = {}
    for group in groups:
        for name, value in _derived(set(players.columns), group).items():
            found[name] = F.when(of == group, value) if name not in found else found[name].when(of == group, value)
    return players.withColumns(found)


#: Least minutes and matches of a group's own entry point, and of the others.
ENTRY = {"Zaguero": (600, 5)}
ENTRY_ELSE = (450, 3)


def run_position(players: DataFrame, group: str, **given) -> DataFrame:
    """score_position with the thresholds of the group's entry point, unless others are given."""
    least = dict(zip(("min_minutes", "min_matches"), ENTRY.get(group, ENTRY_ELSE)))
    return score_position(players, group, **(least | given))


def score_position(players: DataFrame, group: str, cohort: list[str] | None = None, min_minutes: int = 450, min_matches: int = 5, teams: list[str] | None = None, q: float = QUANTILE, derive: Callable[[DataFrame], DataFrame] | None = None, spec: Spec | None = None, mix: tuple[float, float] | None = None, parts: int = 1) -> DataFrame:
    """Score the players of a position group; fullbacks get the mixed defensive category, wingers a lane profile.

    The group's derived metrics are added where they are absent; derive may add or map more columns before that, and
    spec replaces the group's specification. mix gives the fullback's weights of execution and value; parts above 1
    divides the ranking of a cohort.
    """
    spec = spec or SPECS[group]
    players = derived_metrics(players.transform(derive) if derive else players, group)
    own = eligible(players.where(F.col("primary_position").isin(P.positions_of(group))), min_minutes, min_matches, teams)
    cohort = cohort or ["season"]
    keys = ["player_id"]
    if group != "Lateral":
        out = score(own, keys, cohort, spec, q, parts)
    else:
        out = _lateral(own, keys, cohort, spec, q, mix, parts)
    if group == "Extremo":
        out = lane_columns(out, own if "lane_bias_index" in own.columns else own.withColumn("lane_bias_index", F.lit(None).cast("double")), keys)
    return out.orderBy(F.desc_nulls_last("Score_Overall"), *keys)


#: The name of the total among the categories of score_groups.
OVERALL = "Overall"


def _dimension(spark: SparkSession, used: dict[str, Spec]) -> DataFrame:
    """(position_group, metric, uses): the categories that a metric counts in, with weight and direction; one row each."""
    rows = []
    for group, own in used.items():
        listed = dict(own.metrics)
        if group == "Lateral":
            listed.pop("Defensivo", None)
            listed |= {f"_{n}": m for n, (_, m) in LATERAL_MIX.items()}
        for metric in dict.fromkeys(m for each in listed.values() for m, _, _ in each):
            uses = [(c, C.weight_steps(w), inv) for c, each in listed.items() for m, w, inv in each if m == metric]
            rows.append((group, metric, uses))
    return spark.createDataFrame(rows, "position_group string, metric string, uses array<struct<category: string, weight: bigint, inverted: boolean>>")


def score_groups(players: DataFrame, groups: list[str] | None = None, cohort: list[str] | None = None, least: dict[str, tuple[int, int]] | None = None, teams: list[str] | None = None, q: float = QUANTILE, specs: dict[str, Spec] | None = None, mix: tuple[float, float] | None = None, parts: int = 1) -> DataFrame:
    """(player_id, cohort, position_group, category, score, flag): the scores of all groups in one plan, long.

    Every player is ranked among those of the same group and cohort, as score_position does it for one group: all metrics
    of all groups in one shuffle, with the specifications as one small dimension of group and metric. A row for each
    category that has a score, and one for the total. least gives the minutes and matches of each group, or else those
    of its entry point; specs replaces specifications.
    """
    used = {g: (specs or {}).get(g, SPECS[g]) for g in groups or SPECS}
    cohort = cohort or ["season"]
    spark, ids = players.sparkSession, list(dict.fromkeys(["player_id", *cohort, "position_group"]))
    of = P.position_group(F.col("primary_position"))
    own = _derived_by_group(players.withColumn("position_group", of), list(used), F.col("position_group"))
    bounds = [(g, *(least or {}).get(g, ENTRY.get(g, ENTRY_ELSE))) for g in used]
    enough = reduce(lambda a, b: a | b, ((F.col("position_group") == g) & (F.col("total_minutes") >= minutes) & (F.col("matches_played") >= matches) for g, minutes, matches in bounds))
    own = eligible(own.where(enough), 0, 0, teams)
    dimension = _dimension(spark, used)
    named = dict.fromkeys(m for s in (*used.values(), Spec("", {}, {n: m for n, (_, m) in LATERAL_MIX.items()})) for m in s.all_metrics())
    metrics = [m for m in named if m in own.columns]
    typed = own.select(*ids, *[C.safe_double(F.col(f"`{m}`")).alias(m) for m in metrics])
    long = typed.unpivot(ids, metrics, "metric", "value").where("value is not null").join(F.broadcast(dimension), ["position_group", "metric"])  # as many rows as the specifications have metrics
    ranked = with_percentiles(long, [*cohort, "position_group", "metric"], parts)
    uses = ranked.select(*ids, "pct", F.explode("uses").alias("use"))
    weighted = uses.select(*ids, F.col("use.category").alias("category"), F.col("use.weight").alias("weight"), _points(F.col("pct"), F.col("use.inverted")).alias("points"))
    cats = weighted.groupBy(*ids, "category").agg(C.from_steps(_score_of(F.sum(F.col("points") * F.col("weight")), F.sum("weight"))).alias("score"))
    by_player = cats.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("category", "score"))).alias("found"))

    def listed(group: str, spec: Spec) -> Column:
        of_category = {c: F.col("found")[c] for c in spec.weights}
        if group == "Lateral":
            weights = mix or tuple(w for w, _ in LATERAL_MIX.values())
            of_category["Defensivo"] = composed(*[(F.col("found")[f"_{n}"], w) for n, w in zip(LATERAL_MIX, weights)])
        of_category[OVERALL] = C.weighted_mean([(of_category[c], w) for c, w in spec.weights.items()])
        return F.array(*[F.struct(F.lit(c).alias("category"), s.alias("score")) for c, s in of_category.items()])

    every = None
    for group, spec in used.items():
        here = F.col("position_group") == group
        every = F.when(here, listed(group, spec)) if every is None else every.when(here, listed(group, spec))
    rows = by_player.select(*ids, F.explode(every).alias("e")).select(*ids, "e.*").where("score is not null")
    return with_flags(rows, [*cohort, "position_group", "category"], q, parts)


def group_profiles(scored: DataFrame, specs: dict[str, Spec] | None = None) -> DataFrame:
    """(player_id, ..., position_group, total, profile): the total and the labels of the raised flags, from score_groups."""
    ids = [c for c in scored.columns if c not in ("category", "score", "flag")]
    category = F.col("category")
    raised = lambda c: F.bool_or((category == c) & F.col("flag"))
    used = {g: (specs or {}).get(g, s) for g, s in SPECS.items()}
    names = list(dict.fromkeys(c for s in used.values() for c in s.labels))
    wide = scored.groupBy(*ids).agg(F.max(F.when(category == OVERALL, F.col("score"))).alias("total"), *[raised(c).alias(f"flag_Score_{c}") for c in names])
    text = None
    for group, spec in used.items():
        here = F.col("position_group") == group
        text = F.when(here, profile(spec.labels)) if text is None else text.when(here, profile(spec.labels))
    return wide.select(*ids, "total", text.alias("profile"))


def lane_columns(scored: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    from .lanes import lane_profile

    return scored.join(lane_profile(players.select(*keys, "lane_bias_index")), keys, "left")


def _lateral(own: DataFrame, keys: list[str], cohort: list[str], spec: Spec, q: float, mix_weights: tuple[float, float] | None = None, parts: int = 1) -> DataFrame:
    mixed = Spec(spec.group, {f"_{n}": w for n, (w, _) in LATERAL_MIX.items()}, {f"_{n}": m for n, (_, m) in LATERAL_MIX.items()})
    metrics = [m for m in dict.fromkeys([*spec.all_metrics(), *mixed.all_metrics()]) if m in own.columns]
    ranked = long_percentiles(own, keys, cohort, metrics, parts)
    ids = list(dict.fromkeys([*keys, *cohort]))
    cats = category_scores(ranked, keys, cohort, spec).drop("Score_Defensivo")
    halves = category_scores(ranked, keys, cohort, mixed)
    weights = mix_weights or tuple(w for w, _ in LATERAL_MIX.values())
    mix = composed(*[(F.col(f"Score__{n}"), w) for n, w in zip(LATERAL_MIX, weights)])
    out = ranking.join_same(cats, halves.select(*ids, mix.alias("Score_Defensivo")), ids, "left").withColumn("Score_Overall", total_score(spec))
    out = flags(out, cohort, ["Score_Overall", *[f"Score_{c}" for c in spec.weights]], q, parts)
    return out.withColumn("profile", profile(spec.labels))


def composed(*parts: tuple[Column, float]) -> Column:
    """A plain weighted sum of scores: null if any part is."""
    return C.weighted_sum(list(parts))


def what_if(df: DataFrame, weights: dict[str, float], name: str = "Score_Ajustado") -> DataFrame:
    """Another total by at least two weights, taken to sum 1; null if any category is."""
    used = {c: w for c, w in weights.items() if c in df.columns}
    if len(used) < 2 or sum(used.values()) <= 0:
        raise ValueError("at least two categories with weights are needed")
    present = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in used))
    return df.withColumn(name, F.when(present, C.weighted_mean([(F.col(c), w) for c, w in used.items()])))


def weights_accepted(weights: dict[str, float], slack: float = 0.02) -> bool:
    return abs(sum(weights.values()) - 1) <= slack


def top_n(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), *ties).limit(n)


def top_n_per(df: DataFrame, cohort: list[str], column: str, n: int, *ties: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*cohort).orderBy(F.desc_nulls_last(column), *ties))
    return df.withColumn("position", rank).where(F.col("position") <= n)
