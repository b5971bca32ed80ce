"""Queries of keyed facts (suppliers, customers, orders) and of texts, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import compare, market, ranking, reconcile, scoring
from ..operators.specs import LATERAL_MIX, spec
from ..sources import tables
from ..sources.scratch import scratch
from .adapters import facts_sql, read, supplier_facts
from .match_queries import rounded

QUERIES, SQL = {}, {}


def query(sql: str | None = None, facts: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = facts_sql(sql) if facts else sql
        return f

    return register


#: Suppliers are scored in their region: what they sell, how it is priced, and how well it lasts.
SUPPLY = spec(
    "suppliers",
    Volume=(0.5, "Volume", "revenue .6\nquantity .3\nitems .1"),
    Price=(0.2, "Price", "-discount .7\nbalance .3"),
    Quality=(0.3, "Quality", "-returned .6\nopen_share .4"),
)
METRICS = ["revenue", "quantity", "items", "discount", "balance", "returned", "open_share"]

RANK_SQL = (
    ", lg AS ("
    + " UNION ALL ".join(f"SELECT entity, region, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM facts" for m in METRICS)
    + """),
pr AS (
  SELECT *, (rank() OVER (PARTITION BY region, metric ORDER BY value) + (count(*) OVER (PARTITION BY region, metric, value) - 1) / 2.0) / count(*) OVER (PARTITION BY region, metric) * 100 AS pct FROM lg WHERE value IS NOT NULL)
"""
)
def _mean_sql(pairs: dict[str, float]) -> str:
    """Steps of the mean of scores that are whole steps, halves up."""
    top, low = " + ".join(f"{c} * {round(w * 1e6)}" for c, w in pairs.items()), round(sum(pairs.values()) * 1e6)
    return f"(2 * ({top}) + {low}) // {2 * low}"


def _category_sql(pairs: dict[str, float]) -> str:
    """Steps of the mean of percentiles in whole numbers of 1e-9."""
    top, low = " + ".join(f"{c} * {round(w * 1e6)}" for c, w in pairs.items()), round(sum(pairs.values()) * 1e6)
    return f"({top} + {502 * low}) // {1000 * low}"


def _limits_sql(scores: list[str]) -> str:
    """Four times the upper quartile (linear) of each score, as lim_<score>; of n sorted values it lies at (n - 1) * 3 / 4."""
    at, rest = "(count(*) - 1) * 3 // 4", "(count(*) - 1) * 3 % 4"
    one = "(list_sort(list({0})))[{1} + 1] * (4 - {2}) + (list_sort(list({0})))[least(count(*), {1} + 2)] * ({2}) AS lim_{0}"
    return ", ".join(one.format(s, at, rest) for s in scores)


def _reached_sql(score: str) -> str:
    return f"4 * {score} >= lim_{score}"


#: Whole numbers as the scores have them: percentiles of 1e-9, weights and scores of 1e-6.
SCORE_SQL = (
    RANK_SQL
    + ", w AS (SELECT entity, region, metric, CAST(round(pct * 1e9) AS HUGEINT) AS p FROM pr), p AS (SELECT entity, region, "
    + ", ".join(f"max(CASE WHEN metric = '{m}' THEN {'100000000000 - p' if m in ('discount', 'returned') else 'p'} END) AS {m}" for m in METRICS)
    + f""" FROM w GROUP BY entity, region),
c AS (SELECT entity, region, {_category_sql({"revenue": 0.6, "quantity": 0.3, "items": 0.1})} AS vol, {_category_sql({"discount": 0.7, "balance": 0.3})} AS pri, {_category_sql({"returned": 0.6, "open_share": 0.4})} AS qua FROM p),
t AS (SELECT *, {_mean_sql({"vol": 0.5, "pri": 0.2, "qua": 0.3})} AS tot FROM c),
q AS (SELECT region, {_limits_sql(["vol", "pri", "qua", "tot"])} FROM t GROUP BY region),
f AS (SELECT t.*, {_reached_sql("vol")} AS fv, {_reached_sql("pri")} AS fp, {_reached_sql("qua")} AS fq, {_reached_sql("tot")} AS ft FROM t JOIN q USING (region)),
s AS (SELECT *, coalesce(nullif(concat_ws(' | ', CASE WHEN fv THEN 'Volume' END, CASE WHEN fp THEN 'Price' END, CASE WHEN fq THEN 'Quality' END), ''), 'Balanceado') AS profile FROM f)
"""
)


def _points_sql(steps: str) -> str:
    return f"CAST({steps} AS DOUBLE) / 1e6"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(supplier_facts(spark, sf_dir), ["entity"], ["region"], SUPPLY)


@query(SCORE_SQL + f"SELECT region, CAST(position AS INTEGER) AS position, entity, total, profile FROM (SELECT region, entity, {_points_sql('tot')} AS total, profile, row_number() OVER (PARTITION BY region ORDER BY tot DESC, entity) AS position FROM s) WHERE position <= 10")
def percentile_score_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scores(spark, sf_dir).withColumn("total", F.col("Score_Overall"))
    return scoring.top_n_per(own, ["region"], "total", 10, "entity").select("region", "position", "entity", "total", "profile")


@query(SCORE_SQL + f'SELECT entity, region, {_points_sql("vol")} AS "Score_Volume", {_points_sql("pri")} AS "Score_Price", {_points_sql("qua")} AS "Score_Quality", {_points_sql("tot")} AS "Score_Overall", profile FROM s')
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("entity", "region", "Score_Volume", "Score_Price", "Score_Quality", "Score_Overall", "profile")


@query(RANK_SQL + "SELECT entity, region, metric, round(pct, 6) AS pct FROM pr")
def percentile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scoring.long_percentiles(supplier_facts(spark, sf_dir), ["entity"], ["region"], METRICS)
    return rounded(own.select("entity", "region", "metric", "pct"), 6)


@query(SCORE_SQL + f'SELECT entity, {_points_sql(_mean_sql({"vol": 0.5, "qua": 1.5}))} AS "Score_Ajustado" FROM s')
def what_if_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scoring.what_if(_scores(spark, sf_dir), {"Score_Volume": 0.5, "Score_Quality": 1.5})
    return own.select("entity", "Score_Ajustado")


@query(SCORE_SQL + f'SELECT entity, {_points_sql(_mean_sql({"vol": 0.6, "pri": 0.4}))} AS composed FROM s')
def composed_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scores(spark, sf_dir)
    parts = [(F.col(c), LATERAL_MIX[n][0]) for c, n in (("Score_Volume", "exec"), ("Score_Price", "obv"))]
    return own.select("entity", scoring.composed(*parts).alias("composed"))


@query(SCORE_SQL + "SELECT region, count(*) AS entities, CAST(sum(CASE WHEN ft THEN 1 ELSE 0 END) AS BIGINT) AS flagged, CAST(sum(CASE WHEN fv THEN 1 ELSE 0 END) AS BIGINT) AS flagged_volume FROM s GROUP BY region")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scores(spark, sf_dir)
    return own.groupBy("region").agg(F.count("*").alias("entities"), F.count_if("flag_Score_Overall").alias("flagged"), F.count_if("flag_Score_Volume").alias("flagged_volume"))


#: All orders are one cohort, which is ranked in ranges of values.
ORDER_PARTS = 8
ORDERED = spec("orders", Value=(0.6, "Value", "price .7\n-discount .3"), Size=(0.4, "Size", "quantity .5\nitems .5"))
ORDER_METRICS = ("price", "discount", "quantity", "items")
ORDER_SQL = (
    "WITH o AS (SELECT l_orderkey AS entity, sum(l_extendedprice) AS price, avg(l_discount) AS discount, sum(l_quantity) AS quantity, count(*) AS items FROM lineitem GROUP BY 1), lg AS ("
    + " UNION ALL ".join(f"SELECT entity, '{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS value FROM o" for m in ORDER_METRICS)
    + "), w AS (SELECT *, CAST(round((rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0) / count(*) OVER (PARTITION BY metric) * 100 * 1e9) AS HUGEINT) AS p FROM lg), p AS (SELECT entity, "
    + ", ".join(f"max(CASE WHEN metric = '{m}' THEN {'100000000000 - p' if m == 'discount' else 'p'} END) AS {m}" for m in ORDER_METRICS)
    + f""" FROM w GROUP BY entity),
c AS (SELECT entity, {_category_sql({"price": 0.7, "discount": 0.3})} AS val, {_category_sql({"quantity": 0.5, "items": 0.5})} AS siz FROM p),
t AS (SELECT *, {_mean_sql({"val": 0.6, "siz": 0.4})} AS tot FROM c),
q AS (SELECT {_limits_sql(["val", "siz", "tot"])} FROM t)
"""
)


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, price, discount, quantity, items) of every order; rounded, so that equal values tie whatever the order of their sums."""
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("entity"))
    own = own.agg(F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.sum("l_quantity").alias("quantity"), F.count("*").alias("items"))
    return own.select("entity", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ORDER_METRICS])


@query(ORDER_SQL + f"""SELECT entity, {_points_sql("val")} AS "Score_Value", {_points_sql("siz")} AS "Score_Size", {_points_sql("tot")} AS "Score_Overall", coalesce(nullif(concat_ws(' | ', CASE WHEN {_reached_sql("val")} THEN 'Value' END, CASE WHEN {_reached_sql("siz")} THEN 'Size' END), ''), 'Balanceado') AS profile,
  {_reached_sql("tot")} AS flagged, row_number() OVER (ORDER BY tot DESC, entity) AS position FROM t, q""", facts=False)
def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, flags, profile and place of every order in one cohort of all of them: no task ranks it alone."""
    own = scoring.score(order_facts(spark, sf_dir), ["entity"], [], ORDERED, parts=ORDER_PARTS)
    own = own.select("entity", "Score_Value", "Score_Size", "Score_Overall", "profile", F.col("flag_Score_Overall").alias("flagged"))
    return ranking.positions(own, [F.desc("Score_Overall"), "entity"])


@query(ORDER_SQL + """, bx AS (SELECT metric, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM lg WHERE metric IN ('price', 'items') GROUP BY metric),
pl AS (SELECT lg.metric, a, b, c, value, value BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) AS inside FROM lg JOIN bx ON lg.metric = bx.metric)
SELECT metric, round(b + 1e-9, 3) + 0 AS median, round(a + 1e-9, 3) + 0 AS p25, round(c + 1e-9, 3) + 0 AS p75, count(*) FILTER (NOT inside) AS outliers, round(min(value) FILTER (inside) + 1e-9, 3) + 0 AS whisker_low, round(max(value) FILTER (inside) + 1e-9, 3) + 0 AS whisker_high FROM pl GROUP BY metric, a, b, c""", facts=False)
def order_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles, whiskers and outliers of all orders as one cohort, from counted ranges."""
    own = compare.box_table(order_facts(spark, sf_dir), ["entity"], [], ["price", "items"], parts=ORDER_PARTS)
    return rounded(own.groupBy("metric", "median", "p25", "p75", "whisker_low", "whisker_high").agg(F.count_if("outlier").alias("outliers")), 3, nudge=1e-9)


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(year(o_orderdate) + 1 AS VARCHAR) AS season, row_number() OVER (ORDER BY year(o_orderdate) DESC) AS place, count(*) AS orders FROM orders GROUP BY year(o_orderdate)", facts=False)
def stored_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored by season; the seasons come from the names of partitions, newest first, and each is read alone."""
    year = F.year("o_orderdate")
    root = f"{scratch(spark)}/seasons-{uuid.uuid4().hex}"
    tables.write_season(read(spark, sf_dir, "orders").select("o_orderkey", F.concat(year, F.lit("_"), year + 1).alias("season")), root)
    newest = tables.stored_seasons(spark, root)
    counts = spark.read.parquet(root).groupBy("season").agg(F.count("*").alias("orders"))
    place = F.row_number().over(Window.orderBy(F.desc("season")))  # a row for each season
    return newest.withColumn("place", place).join(counts, "season").select("season", "place", "orders")


@query(RANK_SQL + ", far AS (SELECT region, min(entity) AS one, max(entity) AS other FROM facts GROUP BY region) SELECT far.region, one, other, a.metric, round(a.value, 3) AS value, round(b.value, 3) AS reference FROM far JOIN lg a ON a.entity = one JOIN lg b ON b.entity = other AND b.metric = a.metric WHERE a.metric IN ('revenue', 'discount', 'balance')")
def radar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supplier of every region beside the last one, by metric."""
    own = supplier_facts(spark, sf_dir)
    pairs = own.groupBy("region").agg(F.min("entity").alias("one"), F.max("entity").alias("other"))
    return rounded(compare.radar_pairs(own, "entity", pairs, ["region", "one", "other"], BOX), 3)


BOX = ["revenue", "discount", "balance"]


@query(RANK_SQL + """, bx AS (SELECT region, metric, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM lg WHERE metric IN ('revenue', 'discount', 'balance') GROUP BY region, metric),
pl AS (SELECT lg.*, a, b, c, value BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) AS inside FROM lg JOIN bx ON lg.region = bx.region AND lg.metric = bx.metric),
wk AS (SELECT region, metric, min(value) AS lo, max(value) AS hi FROM pl WHERE inside GROUP BY region, metric)
SELECT entity, pl.region, pl.metric, round(value + 1e-9, 3) + 0 AS value, round(b + 1e-9, 3) + 0 AS median, round(a + 1e-9, 3) + 0 AS p25, round(c + 1e-9, 3) + 0 AS p75, NOT inside AS outlier, round(lo + 1e-9, 3) + 0 AS whisker_low, round(hi + 1e-9, 3) + 0 AS whisker_high FROM pl JOIN wk ON pl.region = wk.region AND pl.metric = wk.metric""")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = compare.box_table(supplier_facts(spark, sf_dir), ["entity"], ["region"], BOX)
    return rounded(own.select("entity", "region", "metric", "value", "median", "p25", "p75", "outlier", "whisker_low", "whisker_high"), 3, nudge=1e-9)


@query(RANK_SQL + "SELECT entity, region, metric, round(value, 3) AS value, round(avg(value) OVER (PARTITION BY region, metric), 3) AS reference FROM lg WHERE metric IN ('revenue', 'discount', 'balance')")
def radar_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.radar_tables(supplier_facts(spark, sf_dir), "entity", ["region"], BOX).select("entity", "region", "metric", "value", "reference"), 3)


@query(", big AS (SELECT * FROM facts WHERE balance > 0)" + RANK_SQL.replace("FROM facts", "FROM big") + "SELECT entity, region, metric, round(pct, 6) AS pct, round(avg(pct) OVER (PARTITION BY region, metric), 6) AS cohort_pct, count(*) OVER (PARTITION BY region, metric) AS cohort_n FROM pr")
def detail_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = supplier_facts(spark, sf_dir)
    out = compare.detail_table(own, "entity", ["region"], METRICS, members=own.where("balance > 0"))
    return rounded(out.select("entity", "region", "metric", "pct", "cohort_pct", "cohort_n"), 6)


@query("SELECT entity, region, 'revenue' AS metric, round(revenue, 2) AS value FROM facts UNION ALL SELECT entity, region, 'balance', round(balance, 2) FROM facts")
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.melt(supplier_facts(spark, sf_dir), ["entity", "region"], ["revenue", "balance"]), 2)


CURVE_SQL = """, pt AS (SELECT entity, region, balance / 10000 AS cost, revenue / 10000000 AS score FROM facts),
fit AS (SELECT region, count(*) AS n, CASE WHEN count(DISTINCT score) > 1 THEN regr_intercept(cost, score) ELSE avg(cost) END AS intercept, CASE WHEN count(DISTINCT score) > 1 THEN regr_slope(cost, score) ELSE 0 END AS slope FROM pt GROUP BY region),
sg AS (SELECT pt.region, coalesce(stddev_samp(cost - (intercept + slope * score)), 0) AS sigma FROM pt JOIN fit ON pt.region = fit.region GROUP BY pt.region),
curve AS (SELECT fit.*, sigma FROM fit JOIN sg ON fit.region = sg.region)
"""


def _priced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = supplier_facts(spark, sf_dir).select("entity", "region", (F.col("balance") / 10000).alias("cost"), (F.col("revenue") / 10000000).alias("score"))
    return own, market.market_curve(own, "score", "cost", ["region"])


@query(CURVE_SQL + "SELECT region, n, round(intercept, 6) AS intercept, round(slope, 6) AS slope, round(sigma, 6) AS sigma FROM curve")
def market_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_priced(spark, sf_dir)[1], 6)


@query(CURVE_SQL + """SELECT entity, round(greatest(0, intercept + slope * score), 5) AS fair, round(cost - (intercept + slope * score), 5) + 0 AS residual, round(greatest(0, intercept + slope * score - 0.5 * sigma), 5) AS offer_low, round(greatest(0, intercept + slope * score + 0.5 * sigma), 5) AS offer_high,
  round(greatest(0, intercept + slope * score + sigma), 5) AS offer_most, CASE WHEN cost > greatest(0, intercept + slope * score) + 1e-9 THEN 'overpaid' ELSE 'good deal' END AS verdict FROM pt JOIN curve ON pt.region = curve.region""")
def fair_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = market.fair_prices(*_priced(spark, sf_dir), "score", "cost", ["region"])
    return rounded(own.select("entity", "fair", "residual", "offer_low", "offer_high", "offer_most", "verdict"), 5)


@query(CURVE_SQL + """, rg AS (SELECT region, CAST(i AS INTEGER) AS rung, 0.0 + i * 0.2 AS a, 0.0 + (i + 1) * 0.2 AS b, intercept, slope FROM curve, range(5) r(i) WHERE slope <> 0),
nd AS (SELECT region, rung, a, b, least(100, greatest(0, (a - intercept) / slope)) AS x, least(100, greatest(0, (b - intercept) / slope)) AS y FROM rg)
SELECT region, rung, round(CAST(a AS DOUBLE), 4) AS cost_from, round(CAST(b AS DOUBLE), 4) AS cost_to, round(least(x, y), 4) AS score_from, round(greatest(x, y), 4) AS score_to FROM nd""")
def price_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = market.price_ladder(_priced(spark, sf_dir)[1], 0.0, 1.0, 0.2)
    return rounded(own.select("region", "rung", "cost_from", "cost_to", "score_from", "score_to"))


BLEND_SQL = """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders WHERE year(o_orderdate) IN (1997, 1998) GROUP BY 1, 2),
a AS (SELECT * FROM y WHERE y = 1997), b AS (SELECT * FROM y WHERE y = 1998)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, round(a.s, 2) AS score_old, round(b.s, 2) AS score_new, round(CASE WHEN a.s IS NULL THEN b.s WHEN b.s IS NULL THEN a.s ELSE a.s * 0.2 + b.s * 0.8 END, 2) AS score_final FROM a FULL JOIN b ON a.o_custkey = b.o_custkey"""


@query(BLEND_SQL, facts=False)
def season_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders")
    year = lambda y: own.where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return rounded(market.season_blend(year(1997), year(1998), ["o_custkey"], "s"), 2)


@query("""WITH li AS (SELECT l_suppkey, sum(l_quantity) / 1000 AS a, avg(l_discount) AS b FROM lineitem GROUP BY l_suppkey),
tm AS (SELECT n_name AS team, sum(a * b) AS u FROM li JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name),
al AS (SELECT team, u FROM tm UNION ALL SELECT 'promedio liga', avg(u) FROM tm), bd AS (SELECT min(u) AS lo, max(u) AS hi FROM tm)
SELECT team, round(u, 4) AS utilisation, round(CASE WHEN hi > lo THEN (u - lo) / (hi - lo) ELSE 0 END, 4) AS scaled FROM al, bd""", facts=False)
def utilisation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.sum("l_quantity") / 1000).alias("a"), F.avg("l_discount").alias("b"))
    own = li.join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rounded(market.utilisation_rollup(market.utilisation(own, "a", "b"), "n_name"))


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT CASE WHEN a.k IS NULL THEN 'right only' WHEN b.k IS NULL THEN 'left only' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""", facts=False)
def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    right = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return reconcile.coverage(left, right, "k")


@query("""WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY 1)
SELECT a.k AS k, round(a.s, 2) AS ours, round(b.s, 2) AS theirs, round(a.s - b.s, 2) AS diff, round((a.s - b.s) * 100 / b.s, 4) AS diff_pct FROM a JOIN b ON a.k = b.k ORDER BY abs(a.s - b.s) DESC, a.k LIMIT 20""", facts=False)
def totals_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice")
    right = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    own = reconcile.worst(reconcile.compare_totals(left, right, ["k"], "l_extendedprice", "o_totalprice"), 20, "k")
    return own.select("k", *[F.round(c, 2).alias(c) for c in ("ours", "theirs", "diff")], F.round("diff_pct", 4).alias("diff_pct"))


@query("""WITH a AS (SELECT sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem), b AS (SELECT sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem WHERE l_tax > 0)
SELECT 'quantity' AS metric, round(a.q, 1) AS ours, round(b.q, 1) AS theirs, round(abs(a.q - b.q) / abs(b.q), 6) AS relative, abs(a.q - b.q) / abs(b.q) < 0.01 AS passes FROM a, b
UNION ALL SELECT 'price', round(a.p, 1), round(b.p, 1), round(abs(a.p - b.p) / abs(b.p), 6), abs(a.p - b.p) / abs(b.p) < 0.01 FROM a, b""", facts=False)
def metric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    own = reconcile.metric_totals(li, li.where("l_tax > 0"), {"quantity": ("l_quantity", "l_quantity"), "price": ("l_extendedprice", "l_extendedprice")})
    return own.select("metric", F.round("ours", 1).alias("ours"), F.round("theirs", 1).alias("theirs"), F.round("relative", 6).alias("relative"), "passes")


@query("""WITH b AS (SELECT l_suppkey, l_returnflag AS g, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, string_agg(g, ', ' ORDER BY g) AS groups, count(g) AS n_groups, CAST(sum(n) AS BIGINT) AS events, CAST(sum(CASE WHEN g IS NULL THEN n ELSE 0 END) AS BIGINT) AS unassigned, round(max(n) / sum(n), 6) AS top_share FROM b GROUP BY l_suppkey HAVING count(g) > 1""", facts=False)
def multi_group_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reconcile.group_audit(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag"), 6)


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey", facts=False)
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return compare.drop_repeats(own, ["o_custkey"], ["o_orderkey"])


@query("""SELECT l_linestatus, l_returnflag, count(TRY_CAST(v AS DOUBLE)) AS numbers, round(sum(TRY_CAST(v AS DOUBLE)), 1) AS total FROM
(SELECT l_linestatus, l_returnflag, CASE WHEN l_linenumber % 3 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS v FROM lineitem) GROUP BY 1, 2""", facts=False)
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string"))
    own = read(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", C.safe_double(v).alias("v"))
    return own.groupBy("l_linestatus", "l_returnflag").agg(F.count("v").alias("numbers"), F.round(F.sum("v"), 1).alias("total"))


@query("SELECT c_custkey, trim(c_name) || '||' || trim(c_mktsegment) AS key FROM customer", facts=False)
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", C.entity_key(F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[^\x{00}-\x{FF}]') THEN length(text) ELSE strlen(text) END AS n_spoilt, length(text) AS n, md5(text) AS repaired FROM documents", facts=False)
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts spoilt as if UTF-8 had been read as Latin-1, which gives a character for every byte, and what repair makes of them."""
    own = read(spark, sf_dir, "documents").select("doc_id", "text")
    spoilt = F.when(~F.col("text").rlike(r"[^\x{0}-\x{FF}]"), F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    fixed = C.repair_mojibake(F.col("spoilt"))
    length = lambda c: F.char_length(c).cast("long")
    return own.select("doc_id", spoilt.alias("spoilt")).select("doc_id", length(F.col("spoilt")).alias("n_spoilt"), length(fixed).alias("n"), F.md5(fixed.cast("binary")).alias("repaired"))


@query(RANK_SQL + """, pairs AS (SELECT entity, min(entity) OVER (PARTITION BY region) AS other FROM facts), many AS (SELECT entity FROM pr GROUP BY entity HAVING count(*) >= 3)
SELECT a.entity, pairs.other, a.metric, round(a.pct, 6) AS pct, round(b.pct, 6) AS other_pct FROM pr a JOIN pairs ON pairs.entity = a.entity JOIN many ON many.entity = a.entity LEFT JOIN pr b ON b.entity = pairs.other AND b.metric = a.metric""")
def detail_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's percentiles beside those of the first supplier of its region, aligned by metric."""
    own = supplier_facts(spark, sf_dir)
    ranked = compare.detail_table(own, "entity", ["region"], METRICS)
    first = own.groupBy("region").agg(F.min("entity").alias("other"))
    return rounded(compare.detail_against(ranked, "entity", own.join(first, "region").select("entity", "other")), 6)


@query(CURVE_SQL + "SELECT entity, CAST(floor((cost + 0.1) / 0.2) AS INTEGER) AS rung FROM pt")
def ladder_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket of cost that each supplier falls in."""
    return market.ladder_rung(_priced(spark, sf_dir)[0], "cost", -0.1, 0.2).select("entity", "rung")


@query(SCORE_SQL + f"SELECT s.entity AS name, s.region AS team, facts.items AS matches, {_points_sql('tot')} AS score, profile FROM s JOIN facts ON facts.entity = s.entity")
def entity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a card of each supplier shows."""
    own = _scores(spark, sf_dir).join(supplier_facts(spark, sf_dir).select("entity", "items"), "entity")
    return compare.entity_card(own, {"name": "entity", "team": "region", "minutes": "absent", "matches": "items", "score": "Score_Overall", "profile": "profile"})
