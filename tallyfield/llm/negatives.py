"""Hard negatives of anchors by slots: exact top rows in overlapping windows of integer inner products.

An anchor's positives, best first, have falling upper limits, which cut the scores into disjoint slots: slot j holds
what lies above the next limit and not above its own. Every block of rows keeps the best few of each slot (a combiner),
a window function reduces the blocks, and merges from the last slot upwards answer all windows: as slots are disjoint
and ordered, the best of a suffix are the first of slot j followed by those of the suffix behind it.

The anchors are a stated share of the rows and are compared with all rows, in blocks: rows are dealt evenly to cells of
bounded size and each cell meets all anchors. Nothing grows in one task but the anchors, which are held in narrow
integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only, settle, ship

#: Rows of a cell at most, and cells at least (for the sake of parallel work on small tables).
CELL_ROWS, CELLS = 131_072, 32
#: Anchors and rows that are multiplied at once.
ANCHORS, ROWS = 256, 8192
#: Positives of an anchor and negatives of each of them.
POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score in hundredths of the positive's.
LEAST, MOST = 50, 95
#: Values of components and scores are held within this.
WIDEST = 2**62


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, q): the rows that take part, with integer components; `row` tells repeated ids apart."""
    named = only(embeddings, id_col, vector_col, label_col).toDF("vec_id", "v", "label")
    named = named.withColumn("v", F.col("v").cast("array<double>"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.least(F.greatest(x, F.lit(-float(WIDEST))), F.lit(float(WIDEST)))
    whole = F.transform("v", lambda x: F.floor(held(x * scale)).cast("long"))
    taken = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(sound)
    return taken.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).alias("label"), whole.alias("q"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The lists as rows of a matrix; a shorter one ends in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy().astype(np.int64)
    if len(sizes) and (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    at = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - at] = values
    return out


def _dim(*tables: pa.Table) -> int:
    return max((int(np.diff(t["q"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables), default=0)


def _bound(a: np.ndarray, b: np.ndarray) -> int:
    """No inner product of the rows is larger in size."""
    top = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    return top(a) * top(b) * max(1, a.shape[1])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers, held within WIDEST: by floating point while all sums are exact there."""
    bound = _bound(a, b)
    if bound < 2**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < WIDEST:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -WIDEST, WIDEST).astype(np.int64)


def leading(group: np.ndarray, score: np.ndarray, place: np.ndarray, k: int, groups: int, bound: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, score, place) of the first k of every group by falling score, then by place.

    Where the three fit in one 64-bit integer that is sorted, else they are sorted one after another.
    """
    low, mid = places.bit_length(), (2 * bound).bit_length()
    if groups.bit_length() + mid + low <= 62:
        code = np.sort((group << (mid + low)) | ((bound - score) << low) | place)
        group, score, place = code >> (mid + low), bound - ((code >> low) & ((1 << mid) - 1)), code & ((1 << low) - 1)
    else:
        order = np.lexsort((place, -score, group))
        group, score, place = group[order], score[order], place[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    keep = rank < k
    return group[keep], score[keep], place[keep]


def _found(choose, anchors: pa.Table, rows: pa.Table, k: int, slots: int) -> tuple[np.ndarray, ...]:
    """(anchor position, slot, score, row position) of the best k of every anchor and slot in a cell; rows come by vec_id.

    choose(scores, anchor positions, row positions) gives the pairs that count (two index arrays) and their slots.
    """
    dim = _dim(anchors, rows)
    a, b = _matrix(anchors["q"], dim), _matrix(rows["q"], dim)
    bound, out = min(WIDEST, _bound(a, b)), [(np.zeros(0, np.int64),) * 4]
    for i in range(0, len(a), ANCHORS):
        near = slice(i, min(i + ANCHORS, len(a)))
        kept = [(np.zeros(0, np.int64),) * 3]
        for j in range(0, len(b), ROWS):
            far = slice(j, min(j + ROWS, len(b)))
            s = products(a[near], b[far])
            x, y, slot = choose(s, near, far)
            kept.append(leading(x * slots + slot, s[x, y], y + j, k, ANCHORS * slots, bound, len(b)))
        group, score, place = leading(*map(np.concatenate, zip(*kept)), k, ANCHORS * slots, bound, len(b))
        out.append((group // slots + i, group % slots, score, place))
    return tuple(map(np.concatenate, zip(*out)))


def _positives_of(k: int):
    def each(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        own, named = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()

        def choose(s, near, far):
            x, y = np.nonzero((named[near, None] == labels[None, far]) & (own[near, None] != ids[None, far]))
            return x, y, np.zeros(len(x), np.int64)

        x, _, score, place = _found(choose, anchors, rows, k, 1)
        return pa.table({"row": anchors["row"].to_numpy()[x], "score": score, "vec_id": ids[place]})

    return each


def _negatives_of(k: int, count: int):
    def each(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        ids, labels, named = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), anchors["label"].to_numpy()
        low, high = (_matrix(anchors[c], count) for c in ("low", "high"))
        held = np.diff(anchors["low"].combine_chunks().offsets.to_numpy())
        absent = np.arange(count)[None, :] >= held[:, None]
        low[absent], high[absent] = WIDEST + 1, -WIDEST - 1  # a slot that is not there takes nothing

        def choose(s, near, far):
            x, y = np.nonzero((named[near, None] != labels[None, far]) & (s <= high[near, :1]))
            score = s[x, y]
            slot = (score[:, None] <= high[near][x]).sum(1) - 1
            good = score >= low[near][x, slot]
            return x[good], y[good], slot[good]

        x, slot, score, place = _found(choose, anchors, rows, k, count)
        return pa.table({"row": anchors["row"].to_numpy()[x], "slot": slot.astype(np.int32), "score": score, "vec_id": ids[place]})

    return each


def _against(anchors: DataFrame, rows: DataFrame, cells: int, kernel, schema: str) -> DataFrame:
    """kernel over every cell of the rows and all anchors."""
    sent = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    dealt = rows.select("vec_id", "label", "q", F.pmod("row", F.lit(cells)).cast("int").alias("cell"))
    return sent.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInArrow(kernel, schema)


def _in_slot(j: int):
    return lambda e: e["slot"] == j


def hard_negatives(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, cell_rows: int = CELL_ROWS, cells: int = CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of every anchor.

    Anchors are rows whose id is divisible by `every`. Rows with a null id, label or vector, or with a null or non-finite
    component, take no part. Higher scores come first, ties by smaller id. Repeated rows each count by themselves, as
    anchors and as negatives; a row with the anchor's id is none of its positives. Of vectors of unequal length the
    shorter counts as ending in zeros; an empty one scores 0. Scores are exact and held within 2^62, as components are. An
    empty table, an anchor without positives and a positive without negatives give no rows. `label` replaces the label
    of a row by an expression over vec_id and label. Other columns are ignored.
    """
    ship(embeddings.sparkSession)
    table = settle(whole_vectors(embeddings, id_col, vector_col, label_col, label), "vectors")
    seen = table.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("q", F.abs))).alias("top")).first()
    narrow = "array<smallint>" if (seen["top"] or 0) < 2**15 else "array<bigint>"
    rows = table.withColumn("q", F.col("q").cast(narrow))
    count = max(cells, -(-seen["n"] // cell_rows))
    anchors = rows.where(F.col("vec_id") % every == 0)

    best = _against(anchors, rows, count, _positives_of(positives), "row long, score long, vec_id long")
    order = [F.desc("score"), F.asc("vec_id")]
    first = best.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("n") <= positives)
    listed = first.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "score", F.col("vec_id").alias("id")))).alias("positives"))
    # Limits of score s: s * LEAST / 100 rounded up and s * MOST / 100 rounded down; hundreds and the rest apart, so that nothing overflows.
    low = F.expr(f"transform(positives, p -> ((p.score - pmod(p.score, 100L)) div 100L) * {LEAST}L + (pmod(p.score, 100L) * {LEAST}L + 99L) div 100L)")
    high = F.expr(f"transform(positives, p -> ((p.score - pmod(p.score, 100L)) div 100L) * {MOST}L + (pmod(p.score, 100L) * {MOST}L) div 100L)")
    limited = settle(anchors.join(listed, "row").select("row", F.col("vec_id").alias("anchor_id"), "label", "q", "positives", low.alias("low"), high.alias("high")), "limits")

    sent = limited.select("row", "label", "q", "low", "high")
    hits = _against(sent, rows, count, _negatives_of(negatives, positives), "row long, slot int, score long, vec_id long")
    in_slot = Window.partitionBy("row", "slot").orderBy(*order)
    top = hits.withColumn("n", F.row_number().over(in_slot)).where(F.col("n") <= negatives)
    item = F.struct("slot", "n", "score", F.col("vec_id").alias("id"))
    by_anchor = top.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("all"))
    met = by_anchor.join(limited.select("row", "anchor_id", "positives", "low"), "row")
    # Suffix merges from the last slot upwards; suffixes[j] answers the window of positive j.
    nothing = F.array().cast("array<struct<slot:int,n:int,score:bigint,id:bigint>>")
    suffixes, behind = [], nothing
    for j in reversed(range(positives)):
        behind = F.slice(F.concat(F.filter("all", _in_slot(j)), behind), 1, negatives)
        suffixes.insert(0, behind)
    each = met.select("anchor_id", "positives", "low", F.array(*suffixes).alias("suffixes"))
    each = each.select("anchor_id", F.posexplode("positives").alias("j", "positive"), "low", "suffixes")
    good = F.filter(F.get("suffixes", F.col("j")), lambda e: e["score"] >= F.get("low", F.col("j")))
    out = each.select("anchor_id", "positive", F.posexplode(good).alias("at", "negative"))
    return out.select("anchor_id", F.col("positive.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("negative.id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score"))


def shifted_label(id_col: str = "vec_id", label_col: str = "label", every: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one where the id is divisible by `every`."""
    return F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
