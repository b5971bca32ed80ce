"""Documents to packed sequences: language filter, near-duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; run()
writes each result as Parquet to the shared folder and reads it back as the next stage's docs. Stages use the columns of
documents and drop others, whatever their names; texts are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import decontaminate, language, packing, pii, simhash
from tallyfield.llm.common import settle, table

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _row() -> Column:
    """Key of a row: its id and a hash of its text, as ids may be null or shared by different texts. Null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_row().alias("doc_id"), "text")


def _without(docs: DataFrame, bad: DataFrame, few: bool) -> DataFrame:
    """The rows whose key is not in `bad` (column gone).

    The keys are written first, so that Spark knows their size. Where they are `few` beside the documents it may send
    them to the texts if they are small; otherwise texts and keys meet in one shuffle at any size.
    """
    keys = settle(bad.select("gone").distinct(), "gone-keys")
    met = keys if few else keys.hint("merge")
    return docs.withColumn("row_key", _row()).join(met, F.col("row_key") == F.col("gone"), "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, for which no language can be told, go.

    Each row is judged by its own text, so null ids, repeated ids and repeated rows all stay or go by themselves.
    """
    model = language.fit(docs.where(~language.is_held_out(F.col("doc_id"))))
    return language.with_known_language(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component one row stays: the least by doc_id (null last), then by a hash of the text, then by the other columns.

    Rows of different components stay even if their ids are equal or null. Null and wordless texts form one component.
    """
    found = settle(simhash.near_duplicates(_keyed(docs)).select(F.col("doc_id").alias("key"), F.col("component_id").alias("least")), "components")
    # component_id is the least key of its component, so all rows with another key go; of equal keys one row stays.
    times = found.where("key = least").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("gone"))
    repeated = settle(times, "repeated-keys")
    single = _without(docs.select(*COLUMNS), found.where("key <> least").select(F.col("key").alias("gone")).unionByName(repeated), few=False)
    many = docs.select(*COLUMNS, _row().alias("row_key")).join(repeated, F.col("row_key") == F.col("gone"))
    one = many.groupBy("row_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return single.unionByName(one)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each row by its own text; null texts hold none and stay."""
    found = decontaminate.contamination(_keyed(docs), table(spark, sf_dir, "benchmark"))
    return _without(docs.select(*COLUMNS), found.where("contaminated").select(F.col("doc_id").alias("gone")), few=True)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows, and null stays null. Every row stays."""
    clean = pii.redacted(docs.select(*COLUMNS), pii.train(docs))
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences; rows with null or equal ids are documents of their own, a null text is its end alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language id", identify_language),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express the language model, the fingerprints or the random field.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
