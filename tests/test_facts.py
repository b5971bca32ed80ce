"""Facts whose doubles add up to other last places in other orders of rows: equal suppliers tie in every query."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import columns as C
from tallyfield.plans.adapters import supplier_facts
from tallyfield.plans.catalog import ORACLE_SQL, QUERIES

from .test_catalog import cell

#: Discounts of the same mean and prices of the same sum, in orders that give unequal sums of doubles.
DEALT = [[0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [0.2, 0.3, 0.1], [0.2], [0.05, 0.35], [0.1, 0.2, 0.3, 0.2, 0.2, 0.1, 0.3]]


@pytest.fixture(scope="module")
def facts_dir(spark, tmp_path_factory):
    """Suppliers of two regions: those of the one are equal but for the order of their lines, those of the other have as much discount, on average, over other numbers of lines."""
    root = str(tmp_path_factory.mktemp("facts"))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    write([(0, "A", 0), (1, "B", 1)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    write([(i, i % 2, 10.0 if i % 2 else 10.0 + i) for i in range(12)], "s_suppkey long, s_nationkey int, s_acctbal double", "supplier")
    lines = []
    for i in range(12):
        discounts = DEALT[i // 4] if i % 2 else DEALT[i // 2]
        lines += [(i, 3.0, 1000.0 * d if i % 2 else 100.1 + i, d, "R", "O") for d in discounts]
    write(lines, "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string", "lineitem")
    return root


def sql_on_decimals(name, root):
    """The query's SQL as it is, over the same tables with decimals in place of doubles, so that its sums have no order."""
    con = duckdb.connect()
    for t in ("nation", "supplier", "lineitem"):
        exact = " REPLACE (l_quantity::DECIMAL(12, 2) AS l_quantity, l_extendedprice::DECIMAL(12, 2) AS l_extendedprice, l_discount::DECIMAL(6, 4) AS l_discount)" if t == "lineitem" else ""
        con.execute(f"CREATE VIEW {t} AS SELECT *{exact} FROM '{root}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name])
    return [d[0] for d in want.description], sorted(tuple(cell(v) for v in r) for r in want.fetchall())


@pytest.mark.parametrize("name", ["composed_category", "detail_compare", "detail_pairs", "entity_cards", "flag_counts", "score_table", "percentile_ranks"])
def test_equal_suppliers_tie(spark, facts_dir, name):
    names, want = sql_on_decimals(name, facts_dir)
    assert sorted(tuple(cell(v) for v in r) for r in QUERIES[name](spark, facts_dir).select(*names).collect()) == want


def test_facts_in_any_order(spark, facts_dir, tmp_path):
    """Facts are the same doubles for lines dealt out anew."""
    told = [sorted(tuple(r) for r in supplier_facts(spark, facts_dir).collect())]
    for k in range(3):
        root = f"{tmp_path}/{k}"
        for t in ("nation", "supplier", "lineitem"):
            spark.read.parquet(f"{facts_dir}/{t}.parquet").repartition(1 + 2 * k).orderBy(F.rand(k)).write.parquet(f"{root}/{t}.parquet")
        told.append(sorted(tuple(r) for r in supplier_facts(spark, root).collect()))
    assert all(t == told[0] for t in told)


def test_exact_sums(spark):
    dice = random.Random(7)
    values = [(g, v) for g in range(3) for v in [dice.uniform(-1, 1) * 10 ** dice.randint(-3, 8) for _ in range(200)]]
    seen = set()
    for k in range(4):
        dice.shuffle(values)
        rows = spark.createDataFrame(values, "g int, v double").repartition(1 + k).groupBy("g").agg(C.exact_sum(F.col("v")), C.exact_mean(F.col("v"))).collect()
        seen.add(tuple(sorted(tuple(r) for r in rows)))
    assert len(seen) == 1
    odd = [("nulls", None), ("some", None), ("some", 2.5), ("huge", 1e300), ("huge", 1.0), ("tiny", 1e-30), ("tiny", 3e-30), ("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("less", -0.25), ("less", -1.5), ("many", 999999999.5), ("many", 999999999.5)]
    got = {r.g: (r.s, r.m, r.one) for r in spark.createDataFrame(odd, "g string, v double").groupBy("g").agg(C.exact_sum(F.col("v")).alias("s"), C.exact_mean(F.col("v")).alias("m"), F.sum("v").alias("one")).collect()}
    assert got.pop("nulls") == (None, None, None)
    s, m, _ = got.pop("nan")
    assert s != s and m != m
    assert {g: v[:2] for g, v in got.items()} == {"some": (2.5, 2.5), "huge": (1e300, 5e299), "tiny": (4e-30, 2e-30), "inf": (float("inf"), float("inf")), "less": (-1.75, -0.875), "many": (1999999999.0, 999999999.5)}
