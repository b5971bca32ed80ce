"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of WINDOW consecutive words (the whole item if it is shorter). A document that contains
a window contains all of the window's shingles, so joining the rarest shingle alone loses nothing: for containment the
necessary prefix of the shingles in order of rarity is one. Rarity is counted over all documents. The shingle's place
in the window gives the only possible start of the window, which must lie within the document (positional and length
bounds); then the words are compared.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

WINDOW = 10
#: Words in the shingles that the join uses; a shorter window is one shingle.
SHINGLE = 3
#: Largest estimated size of the windows that are sent to every executor; beyond it both sides are shuffled, but first
#: positions are kept by their keys alone, as long as the keys stay below this size.
BROADCAST_BYTES = 32 << 20
KEY_BYTES = 16

#: Fixed value: what stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text after lower-casing A to Z and no other letter; none for null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    # Only the first and the last part can be empty. Splitting takes a third of the time of extracting matches.
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), "")


def _shingle(of: str, at: str, size: int) -> Column:
    """Hash of the words at, at + 1, ... of an array column."""
    return F.xxhash64(*[F.get(F.col(of), F.col(at) + j) for j in range(size)])


def windows(items: DataFrame, id_col: str, text_col: str, width: int = WINDOW) -> DataFrame:
    """(item, win, size): the distinct windows of every item; items without words have none."""
    split = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), words(F.col(f"`{text_col}`").cast("string")).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1))))
    return split.select("item", "w", starts.alias("i")).select("item", F.slice("w", F.col("i"), width).alias("win")).distinct().withColumn("size", F.size("win"))


def _document_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("h"), words(text).alias("w"))


def _grams(split: DataFrame, sizes: list[int], first: int = 0) -> DataFrame:
    """One row per position from `first` and shingle size, with the shingle's hash as key; `w` stays beside it."""
    placed = split.where(F.size("w") > first).select("doc", "h", "w", F.explode(F.sequence(F.lit(first), F.size("w") - 1)).alias("i"))
    keys = [F.when(F.col("i") < 0, WHOLE).otherwise(_shingle("w", "i", k)) for k in sizes]
    if len(keys) == 1:
        return placed.select("*", keys[0].alias("key"))
    return placed.select("*", F.explode(F.array_distinct(F.array(*keys))).alias("key"))


#: Key of the row that stands for a whole document, at position -1; its window is empty.
WHOLE = 0


def _occurrences(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, width: int, broadcast_bytes: int) -> DataFrame:
    """(doc, h, start, size, item, n): occurrences of windows, and for every document row one of size 0.

    h is a hash of the document's text and n its number of words, in rows of size 0.
    """
    wins = settle(windows(items, item_col, item_text_col, width), "windows")
    found = wins.agg(F.collect_set(F.least("size", F.lit(SHINGLE))).alias("sizes"), F.sum(F.octet_length(F.concat_ws(" ", "win")) + 24 * F.col("size") + 64).alias("bytes")).first()
    sizes, small = sorted(found["sizes"]), (found["bytes"] or 0) <= broadcast_bytes
    split = _document_words(docs, id_col, text_col)
    rows = split.select("doc", "h", F.lit(-1).alias("start"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("item"), F.size("w").alias("n"))
    if not sizes:
        return rows

    def of_keys(grams: DataFrame, keys: DataFrame) -> DataFrame:
        """The rows with one of the keys, which are sent out while they are small."""
        keys = settle(keys.select("key").distinct(), "keys")
        return grams.join(F.broadcast(keys) if keys.count() * KEY_BYTES <= broadcast_bytes else keys, "key", "left_semi")

    in_window = wins.select("item", "win", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("size") - SHINGLE))).alias("offset"))
    key = F.coalesce(*[F.when(F.least("size", F.lit(SHINGLE)) == k, _shingle("win", "offset", k)) for k in sizes])
    shingles = settle(in_window.select("*", key.alias("key")), "shingles")
    seen = of_keys(_grams(split, sizes).select("key"), shingles).groupBy("key").agg(F.count("*").alias("n"))
    rarity = settle(seen, "rarity")
    # The least (count, offset) of each window; a window with a shingle that never occurs cannot occur.
    ranked = shingles.join(rarity, "key", "left").groupBy("item", "win", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "key")).alias("first"))
    prefix = settle(ranked.where("first.n > 0").select("item", "win", "size", "first.key", "first.offset"), "prefix")

    start = F.col("i") - F.col("offset")
    bounds = (start >= 0) & (start + F.col("size") <= F.size("w"))
    same = F.slice("w", start + 1, F.col("size")) == F.col("win")
    if small:
        # The row at -1 carries the count of words, so that texts are split no third time.
        whole = prefix.sparkSession.range(1).select(F.lit(None).cast("string").alias("item"), F.array().cast("array<string>").alias("win"), F.lit(0).alias("size"), F.lit(WHOLE).cast("long").alias("key"), F.lit(0).alias("offset"))
        hit = _grams(split, sizes, -1).join(F.broadcast(prefix.unionByName(whole)), "key")
        hit = hit.where(F.when(F.col("size") == 0, F.col("i") < 0).otherwise(bounds & same))
        return hit.select("doc", "h", start.alias("start"), "size", "item", F.size("w").alias("n"))
    places = of_keys(_grams(split, sizes).select("doc", "h", "i", "key", F.size("w").alias("n")), prefix).join(prefix, "key").where((start >= 0) & (start + F.col("size") <= F.col("n")))
    again = split.select(F.col("doc").alias("doc_"), F.col("h").alias("h_"), "w").dropDuplicates(["doc_", "h_"])
    hit = places.join(again, F.col("doc").eqNullSafe(F.col("doc_")) & F.col("h").eqNullSafe(F.col("h_"))).where(same)
    return rows.unionByName(hit.select("doc", "h", start.alias("start"), "size", "item", "n"))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc, h, start, size, item): every occurrence of an item's window in a document; h is a hash of its text."""
    found = _occurrences(docs, items, id_col, text_col, item_col, item_text_col, width, broadcast_bytes)
    return found.where("size > 0").select("doc", "h", "start", "size", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For every document: n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of a window, n_items the items with an occurring window. A null or
    wordless text has no words and no hits. Repeated rows give repeated equal rows, and null ids are kept. An item with
    a null id hits words but counts as no item. Texts are compared whole however long. Items
    without words, or an empty table of items, match nothing. Other columns are ignored.
    """
    found = _occurrences(docs, items, id_col, text_col, item_col, item_text_col, width, broadcast_bytes)
    before = Window.partitionBy("doc", "h").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    covered = found.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))))
    by_doc = covered.groupBy("doc", "h").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"), F.max("n").alias("n"), F.count_if(F.col("size") == 0).cast("int").alias("times"))
    each = by_doc.select("*", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return each.select(
        F.col("doc").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, list_slice(w, i + 1, i + 10) AS g FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)),
pos AS (
  SELECT doc_id, w, i, s FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM dw) CROSS JOIN (SELECT DISTINCT len(g) AS s FROM win) WHERE i + s <= len(w)),
hit AS (
  SELECT DISTINCT doc_id, i, s, item FROM (SELECT doc_id, i, s, list_slice(w, i + 1, i + s) AS g FROM pos) JOIN win USING (g)),
cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover ON dw.doc_id = cover.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
