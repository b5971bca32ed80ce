"""Price curve of cost on score, fair prices, price ladders and cost utilisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def _beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a table of one row, which is broadcast."""
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one.withColumn("__one", F.lit(1))), "__one").drop("__one")


def market_curve(df: DataFrame, score: str, cost: str, by: list[str]) -> DataFrame:
    """(by, n, intercept, slope, sigma): least squares in each group; sigma has ddof 1 and is 0 for one row."""
    own = df.where(F.col(score).isNotNull() & F.col(cost).isNotNull())
    fit = own.groupBy(*by).agg(F.count("*").alias("n"), F.regr_intercept(cost, score).alias("intercept"), F.regr_slope(cost, score).alias("slope"), F.avg(cost).alias("mean_cost"))
    # Without spread in the scores the curve is flat at the mean.
    fit = fit.withColumns({"intercept": F.coalesce("intercept", "mean_cost"), "slope": F.coalesce("slope", F.lit(0.0))}).drop("mean_cost")
    rest = own.join(fit, by) if by else _beside(own, fit)
    spread = rest.groupBy(*by).agg(F.coalesce(F.stddev_samp(F.col(cost) - (F.col("intercept") + F.col("slope") * F.col(score))), F.lit(0.0)).alias("sigma"))
    return fit.join(spread, by) if by else _beside(fit, spread)


def fair_prices(df: DataFrame, curve: DataFrame, score: str, cost: str, by: list[str], slack: float = 1e-9) -> DataFrame:
    """Fitted value, residual, one-sigma band, negotiation range (floored at 0) and verdict of every entity.

    A cost within slack of the fair price is no overpayment, so that rounding decides nothing.
    """
    out = df.join(curve, by) if by else _beside(df, curve)
    fair, sigma = F.col("intercept") + F.col("slope") * F.col(score), F.col("sigma")
    floor = lambda c: F.greatest(F.lit(0.0), c)
    return out.withColumns({
        "fair": floor(fair),
        "residual": F.col(cost) - fair,
        "band_low": fair - sigma,
        "band_high": fair + sigma,
        "offer_low": floor(fair - 0.5 * sigma),
        "offer_high": floor(fair + 0.5 * sigma),
        "offer_most": floor(fair + sigma),
        "verdict": F.when(F.col(cost) > floor(fair) + slack, "overpaid").when(F.col(cost).isNotNull() & fair.isNotNull(), "good deal"),
    })


def price_ladder(curve: DataFrame, start: float, end: float, step: float, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """(cost_from, cost_to, score_from, score_to) of every bucket of cost: the scores that the curve asks for."""
    count = max(0, round((end - start) / step))
    rungs = curve.where("slope <> 0").withColumn("rung", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count else curve.withColumn("rung", F.lit(0)).where("false")
    a, b = F.lit(start) + F.col("rung") * step, F.lit(start) + (F.col("rung") + 1) * step
    need = lambda c: F.least(F.lit(high), F.greatest(F.lit(low), (c - F.col("intercept")) / F.col("slope")))
    return rungs.withColumns({"cost_from": a, "cost_to": b, "score_from": F.least(need(a), need(b)), "score_to": F.greatest(need(a), need(b))})


def ladder_rung(df: DataFrame, cost: str, start: float, step: float) -> DataFrame:
    """The bucket of each entity's cost, by arithmetic in place of a range join."""
    return df.withColumn("rung", F.floor((F.col(cost) - start) / step).cast("int"))


def season_blend(old: DataFrame, new: DataFrame, keys: list[str], score: str, weight_old: float = 0.2) -> DataFrame:
    """Weighted mean of two seasons' scores, or the one there is."""
    a, b = old.select(*keys, F.col(score).alias("score_old")), new.select(*keys, F.col(score).alias("score_new"))
    return a.join(b, keys, "full").withColumn("score_final", C.weighted_mean([(F.col("score_old"), weight_old), (F.col("score_new"), 1 - weight_old)]))


def utilisation(df: DataFrame, minutes_share: str, cost_share: str) -> DataFrame:
    return df.withColumn("utilisation", F.col(minutes_share) * F.col(cost_share))


def utilisation_rollup(df: DataFrame, team: str) -> DataFrame:
    """(team, utilisation, scaled): sums by team, scaled between the least and the most, and a row with their average.

    The teams are reduced to one row of bounds, which is joined back.
    """
    teams = df.groupBy(F.col(team).alias("team")).agg(F.sum("utilisation").alias("utilisation"))
    both = teams.unionByName(teams.agg(F.lit("promedio liga").alias("team"), F.avg("utilisation").alias("utilisation")))
    bounds = teams.agg(F.min("utilisation").alias("lo"), F.max("utilisation").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("utilisation") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return _beside(both, bounds).select("team", "utilisation", scaled.alias("scaled"))
