"""Reading and writing of event logs, season tables and scores."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .scratch import scratch

SCORES = "player_id bigint, player_name string, team_name string, matches double, minutes double, primary_position string, primary_position_share double"
COST_USE = "team_name string, player_name string, minutes_played_percentage double, player_annual_cost_percentage double, talent_cost_utilization_per_player double"


def by_encoding(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The text files under a path that are valid UTF-8, and the others, from one pass that tells each by its own lines.

    Files without lines are in neither list. Their names come to the driver, which lists the files anyway.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    told = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid")).collect()
    found = sorted((unquote(r["file"]), r["valid"]) for r in told)
    return [f for f, valid in found if valid], [f for f, valid in found if not valid]


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether all lines of the text files are valid UTF-8."""
    return not by_encoding(spark, path)[1]


#: What Windows-1252 has in the place of the control characters of Latin-1.
WINDOWS = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


#: The column that carries a row's file until its season is told.
FILE = "__file"


def _file() -> Column:
    return F.col("_metadata.file_path").alias(FILE)


def _csv(spark: SparkSession, path: str, schema: str | None, encoding: str | None, **options) -> DataFrame:
    """CSV files with FILE, in the encoding given, or each in its own: UTF-8 if it is valid in it, or else Windows-1252."""

    def read(code: str, files: str | list[str]) -> DataFrame:
        reader = spark.read.options(header=True, encoding=code, **options)
        df = (reader.schema(schema) if schema else reader).csv(files)
        return df.select("*", _file())

    if encoding:
        return read(encoding, path)
    valid, other = by_encoding(spark, path)
    if not other:
        return read("UTF-8", path)
    turn = lambda c: F.translate(c, "".join(WINDOWS), "".join(WINDOWS.values()))
    old = read("ISO-8859-1", other)
    fixed = old.select(*[(turn(F.col(f"`{c}`")) if t == "string" else F.col(f"`{c}`")).alias(c.translate(str.maketrans(WINDOWS))) for c, t in old.dtypes])
    return read("UTF-8", valid).unionByName(fixed, allowMissingColumns=True) if valid else fixed


def read_events(spark: SparkSession, path: str, season: str | None = None, schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """Event CSV or Parquet with its season: the one given, or the one in the file's name or its folder's. Without an encoding each file tells its own."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        df = _csv(spark, path, schema, encoding, quote='"', escape='"', multiLine=True)
    else:
        df = spark.read.parquet(path).select("*", _file())
    name, folder = F.element_at(F.split(FILE, "/"), -1), F.try_element_at(F.split(FILE, "/"), F.lit(-2))
    told = F.coalesce(F.nullif(C.season_of(name), F.lit("")), C.season_of(folder))
    return df.withColumn("season", F.lit(season) if season else told).drop(FILE)


def seasons(df: DataFrame) -> DataFrame:
    """The seasons of a table, newest first."""
    return df.select("season").where("season <> ''").distinct().orderBy(F.desc("season"))


def stored_seasons(spark: SparkSession, root: str) -> DataFrame:
    """The seasons that write_season has stored under root, newest first, from the names of its partitions (escaped by the writer, and again as addresses): no data is read."""
    found = {unquote(unquote(m[1])) for m in (re.search(r"/season=([^/]*)/", f) for f in spark.read.parquet(root).inputFiles()) if m}
    own = sorted(found - {"", "__HIVE_DEFAULT_PARTITION__"}, reverse=True)
    return spark.createDataFrame([(s,) for s in own], "season string")


def read_season(spark: SparkSession, root: str, season: str) -> DataFrame:
    """One season of a table that write_season wrote; other seasons' files are not read."""
    return spark.read.parquet(root).where(F.col("season") == season)


def write_season(df: DataFrame, root: str) -> None:
    """Parquet by season; writing a season again replaces it alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(root)


def by_match(events: DataFrame, buckets: int | None = None, keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """The log written once in buckets of matches, one file each, as a table that knows it.

    What is done by match, or by match and more, needs no shuffle of this table: windows over a match, appearances,
    zones, and joins of two such tables. There are as many buckets as the session has shuffle partitions, unless told;
    take more for larger logs, so that each fits a task.
    """
    spark = events.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"log_{uuid.uuid4().hex}"
    writer = events.repartition(buckets, *keys).write.option("path", f"{scratch(spark)}/{name}")
    writer.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    return spark.table(name)


def read_scores(spark: SparkSession, path: str, schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """Score CSV with repaired names; without a schema all columns are text, without an encoding each file tells its own."""
    df = _csv(spark, path, schema, encoding).drop(FILE)
    texts = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: C.repair_mojibake(F.col(f"`{c}`")) for c in texts})


def read_cost_use(spark: SparkSession, path: str) -> DataFrame:
    """Shares of minutes and cost of each player, and their product."""
    return read_scores(spark, path, COST_USE)


def export_season(players: DataFrame, path: str) -> None:
    """The season table as CSV with a byte order mark, most minutes first."""
    write_csv(players, path, [F.desc("total_minutes"), "player_id"], mark=True)


def write_csv(df: DataFrame, path: str, order: list | None = None, mark: bool = False) -> None:
    """CSV parts under path, globally sorted where an order is given; each part begins with a byte order mark on request."""
    df = df.orderBy(*order) if order else df
    df = df.toDF(f"\ufeff{df.columns[0]}", *df.columns[1:]) if mark else df
    df.write.mode("overwrite").option("header", True).csv(path)
