"""Influence zones of defenders, and what opponents make of them.

A zone is a rectangle along the principal axes of a player's defensive actions in a match, kept as a centre, an angle
and two ranges, so that containment is two dot products. Opponents' possessions meet the zones of their match in one
join; the rest are sums. A scale widens or narrows the ranges about their middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import pitch as P

#: Event types that count as defensive actions.
DEFENSIVE = ("Pressure", "Ball Recovery", "Duel", "Clearance", "Block", "Interception", "Foul Won", "Shield", "50/50", "Dispossessed", "Dribbled Past")


def zone_rectangles(events: DataFrame, q: float = 0.15, scale: float = 1.0, least: int = 5, types: tuple[str, ...] = DEFENSIVE) -> DataFrame:
    """(match_id, player_id, team, n_actions, mu_x, mu_y, cos, sin, u_lo, u_hi, v_lo, v_hi) of players with enough actions.

    One aggregation: the places of a player's actions in one match are few and stay beside their moments, so that turning
    them and their quantiles (linear) need neither a second pass nor a join.
    """
    own = events.where(F.col("type").isin(*types) & F.col("player_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    moments = own.groupBy("match_id", "player_id").agg(
        F.count("*").alias("n_actions"),
        F.min("team").alias("team"),
        F.avg("x").alias("mu_x"),
        F.avg("y").alias("mu_y"),
        F.var_samp("x").alias("xx"),
        F.var_samp("y").alias("yy"),
        F.covar_samp("x", "y").alias("xy"),
        F.collect_list(F.struct("x", "y")).alias("places"),
    )
    angle = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    axes = moments.where(F.col("n_actions") >= least).withColumns({"cos": F.cos(angle), "sin": F.sin(angle)})
    dx, dy = lambda p: p["x"] - F.col("mu_x"), lambda p: p["y"] - F.col("mu_y")
    turned = axes.select(
        *("match_id", "player_id", "team", "n_actions", "mu_x", "mu_y", "cos", "sin"),
        F.array_sort(F.transform("places", lambda p: dx(p) * F.col("cos") + dy(p) * F.col("sin"))).alias("u"),
        F.array_sort(F.transform("places", lambda p: dy(p) * F.col("cos") - dx(p) * F.col("sin"))).alias("v"),
    )

    def quantile(a: str, share: float) -> Column:
        at = (F.size(a) - 1) * F.lit(share)
        low, high = F.get(a, F.floor(at).cast("int")), F.get(a, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    ends = {a: (quantile(a, q), quantile(a, 1 - q)) for a in "uv"}
    bounds = {f"{a}_{n}": (lo + hi) / 2 + side * (hi - lo) / 2 * scale for a, (lo, hi) in ends.items() for n, side in (("lo", -1), ("hi", 1))}
    return turned.withColumns(bounds).drop("u", "v")


#: The output columns of zone_damage.
OUTPUT = [f"{c}{s}" for s in ("", "_per90") for c in ("obv_into_area", "obv_from_area", "shots_from_area", "xg_from_area")]


def zone_damage(events: DataFrame, zones: DataFrame, minutes: DataFrame, length: float = P.LENGTH, width: float = P.WIDTH, eps: float = 1e-9, value: str = "obv_total_net", xg: str = "shot_statsbomb_xg", places: int | None = 4) -> DataFrame:
    """Per player: opponents' value inside the zone, and their value, shots and xG from the first contact with it on.

    Opponents' places are turned to the defender's side of the pitch. The border belongs to the zone, eps wide, so that
    rounding decides nothing there. Within a possession all that happens at or after
    the first event in the zone counts. A possession's events are gathered once, as an array; zones meet possessions of
    their match, so that contact and sums are found within a row and only sums by player are shuffled afterwards.
    """
    rx, ry = P.mirrored(F.col("x"), F.col("y"), length, width)
    one = F.struct(F.col("t"), rx.alias("x"), ry.alias("y"), F.coalesce(value, F.lit(0.0)).alias("value"), F.coalesce((F.col("type") == "Shot").cast("int"), F.lit(0)).alias("shot"), F.coalesce(xg, F.lit(0.0)).alias("xg"))
    balls = events.where("x is not null and y is not null and team is not null").groupBy("match_id", F.col("team").alias("rival"), "possession").agg(F.collect_list(one).alias("e"))
    met = zones.join(balls, "match_id").where(F.col("rival") != F.col("team"))

    def inside(e):
        dx, dy = e["x"] - F.col("mu_x"), e["y"] - F.col("mu_y")
        u, v = dx * F.col("cos") + dy * F.col("sin"), dy * F.col("cos") - dx * F.col("sin")
        return u.between(F.col("u_lo") - eps, F.col("u_hi") + eps) & v.between(F.col("v_lo") - eps, F.col("v_hi") + eps)

    def total(of, cell) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda sum_, e: sum_ + cell(e))

    met = met.select("match_id", "player_id", "e", F.filter("e", inside).alias("hit"))
    met = met.withColumn("t0", F.array_min(F.transform("hit", lambda e: e["t"])))
    met = met.withColumn("later", F.filter("e", lambda e: e["t"] >= F.col("t0")))
    met = met.select(
        "match_id",
        "player_id",
        total("hit", lambda e: e["value"]).alias("obv_into_area"),
        total("later", lambda e: e["value"]).alias("obv_from_area"),
        total("later", lambda e: e["shot"].cast("double")).cast("long").alias("shots_from_area"),
        total("later", lambda e: F.when(e["shot"] == 1, e["xg"]).otherwise(0.0)).alias("xg_from_area"),
    )
    sums = ("obv_into_area", "obv_from_area", "shots_from_area", "xg_from_area")
    by_match = met.groupBy("match_id", "player_id").agg(*[F.sum(c).alias(c) for c in sums])
    out = by_match.groupBy("player_id").agg(F.count("*").alias("zone_matches"), *[F.sum(c).alias(c) for c in sums])
    out = out.join(minutes.select("player_id", "total_minutes"), "player_id")
    rated = {f"{c}_per90": C.round4(C.per90(F.col(c), F.col("total_minutes")), places) for c in sums}
    return out.withColumns(rated).drop("total_minutes")
