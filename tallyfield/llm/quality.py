"""Quality scores by Bradley-Terry ranking: weights of features learnt from preference pairs, cut at a quantile.

A labelled good document is preferred to a labelled bad one. The chance that a beats b is the logistic function of the
difference of their scores, and a score is linear in the features of a text, so the weights minimise logistic loss on
differences of features. The learnt scores of labelled documents, weighted to the shares that the labels have over the
whole table, are cut at the quantile of the bad share; that cut becomes the score THRESHOLD.

All labelled documents are learnt from. Their features are dealt to cells of about CELL rows by hash, and every row meets
opponents of its cell. Means, spreads, gradients and curves are sums over cells that Spark adds up, one job for each Newton
step; only these sums, a square of the number of features, reach the driver. The quantile is found by counts in bins.

Features are computed from the whole text alone: what kinds of characters follow each other, and how much of the words,
word pairs, word triples and lines repeats. Scoring needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, id_bucket, only, settle, ship

#: Opponents that each document of the more frequent label meets; those of the other meet as many or more.
OPPONENTS = 8
#: Labelled rows of a cell, about; a label with fewer than MEET rows a cell sends each row to several cells.
CELL, MEET = 4096, 8 * OPPONENTS
#: Cells sent to Python at once, 6 MB each.
CELLS_AT_ONCE = 4
#: Bins of one counting of scores.
BINS = 1024
#: The score that a document at the quantile gets; from it on a document is taken for good.
THRESHOLD = 0.7
#: A hair above its logit, so that a document on the cut itself is taken.
LOGIT = float(np.log(THRESHOLD / (1 - THRESHOLD))) + 1e-12
PENALTY, STEPS = 1.0, 60
FARTHEST = 4.0
#: No feature of any text is larger.
LARGEST = 4.0
#: Remainder of the id that is held out, and the divisor.
HELD_OUT, FOLDS = 2, 4

#: Kinds of bytes, each by the ASCII characters that it holds; the rest of ASCII and the bytes beyond it are two more.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?", "|", "#", "&", "*", "$%", "'\"()-", "<>{}[]/\\=_+~^`@")
KIND_OF = np.full(256, len(KINDS) + 1, np.int64)
KIND_OF[:128] = len(KINDS)
for _i, _letters in enumerate(KINDS):
    KIND_OF[list(_letters.encode())] = _i
N_KINDS = len(KINDS) + 2
EXTRA = 12
N_FEATURES = N_KINDS * N_KINDS + N_KINDS + EXTRA


def _repeats(codes: np.ndarray) -> tuple[float, float]:
    """Share of different codes, and of the most frequent one."""
    if not len(codes):
        return 1.0, 0.0
    counts = np.unique(codes, return_counts=True)[1]
    return len(counts) / len(codes), counts.max() / len(codes)


def features(text: bytes) -> np.ndarray:
    """The features of a text in UTF-8; those of an empty one are of no repeats and no characters."""
    out = np.zeros(N_FEATURES)
    kinds = KIND_OF[np.frombuffer(text, np.uint8)]
    n, square = len(kinds), N_KINDS * N_KINDS
    out[square : square + N_KINDS] = np.bincount(kinds, minlength=N_KINDS) / max(1, n)
    if n > 1:
        out[:square] = np.sqrt(np.bincount(kinds[:-1] * N_KINDS + kinds[1:], minlength=square) / (n - 1))
    words = text.split()
    w = len(words)
    codes = np.fromiter(map(hash, words), np.int64, w)
    with np.errstate(over="ignore"):
        pairs = codes[:-1] * 1_000_003 + codes[1:]
        triples = pairs[:-1] * 1_000_003 + codes[2:]
    lines = np.fromiter(map(hash, text.split(b"\n")), np.int64)
    (d1, t1), (d2, t2), (d3, t3), (dl, tl) = map(_repeats, (codes, pairs, triples, lines))
    upper = sum(map(bytes.isupper, words)) / max(1, w)
    size = np.log1p(w)
    out[square + N_KINDS :] = (t1, t2, t3, tl if len(lines) > 1 else 0.0, d2, d3, dl, d1 * size / 10, upper, min(30.0, n / max(1, w)) / 10, size / 10, float(w == 0))
    return out


def scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Features in spreads from the mean, at most FARTHEST, so that no single one of an odd text outweighs all others."""
    return np.clip((x - mean) / spread, -FARTHEST, FARTHEST)


@dataclass(frozen=True)
class Ranker:
    """score = logistic(weights . scaled features - cut + logit(THRESHOLD))."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return scaled(x, self.mean, self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cut + LOGIT
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _opponents(good: int, bad: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of winners and losers of all pairs: opponents are spread over the bad rows and wrap around, so that every one of either side is met."""
    many = max(good, bad)
    first = np.arange(many * OPPONENTS)
    return first % many % good, (first + first // many * 7919) % bad


def _square(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = x * np.sqrt(weight)[:, None]
    return x.T @ x


def _slopes(good: np.ndarray, bad: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss over the pairs of scaled rows, without the penalty, its gradient and its curve.

    The square of a difference is the two squares less the products across, so the squares are taken once a row.
    """
    winners, losers = _opponents(len(good), len(bad))
    ahead = np.clip((good @ beta)[winners] - (bad @ beta)[losers], -60, 60)
    p = 1 / (1 + np.exp(-ahead))
    gradient = np.bincount(losers, 1 - p, len(bad)) @ bad - np.bincount(winners, 1 - p, len(good)) @ good
    weight = p * (1 - p)
    # In each round every row of the longer side is met once; its opponents and weights are put in its order.
    many, few, i, j = (good, bad, winners, losers) if len(good) >= len(bad) else (bad, good, losers, winners)
    met = np.zeros_like(many)
    for a, b, w in zip(*(v.reshape(OPPONENTS, -1) for v in (i, j, weight)), strict=True):
        order = np.argsort(a)
        met += w[order, None] * few[b[order]]
    across = many.T @ met
    curve = _square(good, np.bincount(winners, weight, len(good))) + _square(bad, np.bincount(losers, weight, len(bad)))
    return float(np.log1p(np.exp(-ahead)).sum()), gradient, curve - across - across.T


def _newton(slopes: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The weights of least penalised loss, from loss, gradient and curve at any weights; a step that raises the loss is halved."""
    beta, step, least = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.inf
    for _ in range(STEPS):
        near = beta - step
        loss, gradient, curve = slopes(near)
        loss += PENALTY / 2 * near @ near
        if loss > least * (1 + 1e-9):
            step = step / 2
            continue
        beta, least = near, loss
        step = np.linalg.solve(curve + PENALTY * np.eye(N_FEATURES), gradient + PENALTY * beta)
        if np.abs(step).max() < 1e-6:
            return beta - step
    raise RuntimeError(f"weights did not settle in {STEPS} steps")


def _nothing() -> Ranker:
    return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)


def learn(good: np.ndarray, bad: np.ndarray, bad_share: float) -> Ranker:
    """The model of one cell in memory, as `fit` has it of all cells; without pairs every score is THRESHOLD."""
    every = np.vstack([good, bad])
    if not len(good) or not len(bad):
        return _nothing()
    mean, spread = every.mean(0), every.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    x, y = scaled(good, mean, spread), scaled(bad, mean, spread)
    model = Ranker(mean, spread, _newton(lambda beta: _slopes(x, y, beta)), 0.0)
    raw = np.r_[model.raw(good), model.raw(bad)]
    weight = np.r_[np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))]
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order])
    at = min(int(np.searchsorted(below, bad_share - 1e-9)), len(raw) - 1)
    # Halfway from the last document below the quantile to the next one.
    cut = (raw[order[at]] + raw[order[min(at + 1, len(raw) - 1)]]) / 2
    return Ranker(mean, spread, model.weights, float(cut))


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(x, pa.binary())], ["id", "h", "x"])


def _cells(rows: DataFrame, count: dict[int, int]) -> DataFrame:
    """(own_good, own_bad, good, bad): features by cell, those of rows whose first cell it is before those of copies.

    A label of at most MEET rows is in every cell; a more frequent one has MEET rows or more a cell on average, so that a
    cell without it is not to be expected (e^-64); `_moments` raises an error if there is one.
    """
    n = math.ceil(sum(count.values()) / CELL)
    times = {q: min(n, math.ceil(MEET * n / c)) for q, c in count.items()}
    mix = F.xxhash64("id", "h")
    turns = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == 1, times[1] - 1).otherwise(times[0] - 1)))
    dealt = rows.select("quality", "h", "x", mix.alias("mix"), turns.alias("turn")).withColumn("cell", F.pmod(F.pmod("mix", F.lit(n)) + F.col("turn"), F.lit(n)))

    def pack(cell: pa.Table) -> pa.Table:
        cell = cell.append_column("copy", pa.array(cell["turn"].to_numpy() > 0)).sort_by([("copy", "ascending"), ("mix", "ascending"), ("h", "ascending")])
        good, copy = cell["quality"].to_numpy() == 1, cell["copy"].to_numpy()
        blobs = [b"".join(cell["x"].filter(pa.array(side)).to_pylist()) for side in (good, ~good)]
        own = [int((side & ~copy).sum()) for side in (good, ~good)]
        return pa.table({"own_good": own[:1], "own_bad": own[1:], "good": blobs[:1], "bad": blobs[1:]})

    packed = dealt.repartition(n, "cell").groupBy("cell").applyInArrow(pack, "own_good long, own_bad long, good binary, bad binary")
    return settle(packed, "quality-cells", compression="zstd")


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Good and bad rows of each cell, and how many of either are its own."""
    for batch in batches:
        for cell in batch.to_pylist():
            good, bad = (np.frombuffer(cell[c], np.float32).reshape(-1, N_FEATURES).astype(np.float64) for c in ("good", "bad"))
            yield good, bad, cell["own_good"], cell["own_bad"]


def _total(cells: DataFrame, work: Callable[..., np.ndarray], size: int, bound: float) -> np.ndarray:
    """Sum over cells of the `size` numbers that work gives for each, their sum at most `bound`.

    Added as whole numbers of one unit, so that the order of adding changes nothing.
    """
    unit = 2.0 ** (61 - math.ceil(math.log2(bound)))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for cell in _sides(batches):
            total += np.rint(work(*cell) * unit).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    with batches_of(cells.sparkSession, CELLS_AT_ONCE):
        rows = cells.mapInArrow(added, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[rows["i"].to_numpy()] = rows["v"].to_numpy() / unit
    return out


def _moments(cells: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of all rows, each counted in its own cell."""

    def sums(good, bad, own_good, own_bad):
        alone = own_good + own_bad if not len(good) or not len(bad) else 0
        return np.r_[alone, good[:own_good].sum(0) + bad[:own_bad].sum(0)]

    alone, *total = _total(cells, sums, 1 + N_FEATURES, LARGEST * n)
    if alone:
        raise RuntimeError(f"{alone:.0f} labelled documents meet no opponent")
    mean = np.array(total) / n

    def squares(good, bad, own_good, own_bad):
        return ((good[:own_good] - mean) ** 2).sum(0) + ((bad[:own_bad] - mean) ** 2).sum(0)

    spread = np.sqrt(_total(cells, squares, N_FEATURES, LARGEST**2 * n) / n)
    return mean, np.where(spread > 1e-9, spread, 1.0)


def _weights(cells: DataFrame, mean: np.ndarray, spread: np.ndarray, rows: int) -> np.ndarray:
    upper = np.triu(np.ones((N_FEATURES, N_FEATURES), bool))

    def slopes(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def work(good, bad, *_):
            loss, gradient, curve = _slopes(scaled(good, mean, spread), scaled(bad, mean, spread), beta)
            return np.r_[loss, gradient, curve[np.triu(np.ones(curve.shape, bool))]]

        # A pair adds 61 at most to the loss, twice FARTHEST to a slope and FARTHEST squared to a curve.
        loss, *found = _total(cells, work, 1 + N_FEATURES + int(upper.sum()), 64.0 * OPPONENTS * rows)
        curve = np.zeros((N_FEATURES, N_FEATURES))
        curve[upper] = found[N_FEATURES:]
        return loss, np.array(found[:N_FEATURES]), curve + np.triu(curve, 1).T

    return _newton(slopes)


def _cut(raw: DataFrame, weight: tuple[float, float], bad_share: float) -> float:
    """Halfway from the last of the scores below the quantile to the next one, by counts in ever finer bins around it."""
    lo, hi = raw.agg(F.min("raw"), F.max("raw")).first()
    below, after = 0.0, hi
    while True:
        bin_of = F.least(F.floor((F.col("raw") - lo) / ((hi - lo) or 1.0) * BINS), F.lit(BINS - 1))
        within = raw.where(F.col("raw").between(lo, hi)).groupBy(bin_of.alias("bin"))
        bins = within.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("bin").collect()
        for at, found in enumerate(bins):
            mass = weight[1] * found.good + weight[0] * found.bad
            if below + mass >= bad_share - 1e-9 or at == len(bins) - 1:
                break
            below += mass
        lo, hi = found.lo, found.hi
        if at < len(bins) - 1:
            after = bins[at + 1].lo
        if lo == hi:
            break
    # Equal scores lie side by side, the bad ones last: the next one is equal unless the very last of them reaches the quantile.
    last = weight[0] if found.bad else weight[1]
    return (lo + (lo if below + mass - last >= bad_share - 1e-9 else after)) / 2


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def is_held_out(doc_id: Column) -> Column:
    """Whether the fold of an id is held out; a null id is not."""
    return F.coalesce(id_bucket(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int | None = None) -> Ranker:
    """Learn from all labelled documents outside the held-out fold; for trials, from at most `sample` labels of each class.

    Rows with a null id or a label other than 0 and 1 are left out; a document with two labels counts under both, one that
    is repeated with the same text and label counts once. Texts are read once and stay where they are; rows of features,
    about 0.2 kB each when compressed, are shuffled to the labels and into cells.
    """
    spark = docs.sparkSession
    ship(spark)
    given = only(labels, id_col, label_col).toDF("id", "quality").where("id is not null and quality in (0, 1)").where(~is_held_out(F.col("id"))).withColumn("quality", F.col("quality").cast("int"))
    counts = {r["quality"]: r["n"] for r in given.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return _nothing()
    if sample is not None:
        order = [F.xxhash64("id"), F.col("id")]
        given = given.where("quality = 1").orderBy(*order).limit(sample).unionByName(given.where("quality = 0").orderBy(*order).limit(sample))
    texts = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), _text(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("h"))
    texts = texts.where("id is not null").where(~is_held_out(F.col("id")))
    kinds = dict(texts.dtypes)
    # Labels grow with the documents, so they are not broadcast.
    met = texts.mapInArrow(_blobs, f"id {kinds['id']}, h long, x binary").join(given.distinct().hint("merge"), "id")
    rows = settle(met.dropDuplicates(["id", "h", "quality"]), "quality-features", compression="zstd")
    found = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return _nothing()
    n = sum(found.values())
    cells = _cells(rows, found)
    mean, spread = _moments(cells, n)
    # With their copies the rows of all cells are at most these.
    model = Ranker(mean, spread, _weights(cells, mean, spread, n + 2 * MEET * math.ceil(n / CELL)), 0.0)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for good, bad, own_good, own_bad in _sides(batches):
            # Summed row by row, as in predictions, so that equal texts lie on the same side of the cut.
            raw = np.array([float(model.raw(row)) for row in np.vstack([good[:own_good], bad[:own_bad]])])
            yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(np.arange(len(raw)) < own_good)], ["raw", "good"])

    with batches_of(spark, CELLS_AT_ONCE):
        raw = settle(cells.mapInArrow(ranked, "raw double, good boolean"), "quality-scores", compression="zstd")
    bad_share = counts[0] / sum(counts.values())
    return Ranker(mean, spread, model.weights, _cut(raw, (bad_share / found[0], (1 - bad_share) / found[1]), bad_share))


def predict(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: its chance to be preferred, and 1 from THRESHOLD on.

    Texts are taken whole; a null text counts as empty, and both get the score of an empty text. Repeated rows give
    repeated equal rows, null ids are kept and are not held out, an empty table gives no rows. If there was nothing to
    learn from, every score is THRESHOLD. Other columns are ignored.
    """
    ship(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            # Rounded as for learning, so that a text that was learnt from gets the score that the cut was made from.
            x = np.array([features(t.as_py()).astype(np.float32) for t in texts], np.float64).reshape(-1, N_FEATURES)
            # Summed row by row, so that equal texts get equal scores in batches of any size.
            score = np.array([float(model.score(row)) for row in x])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), is_held_out(F.col(f"`{id_col}`")).alias("held_out"), _text(f"`{text_col}`").alias("text"))
    out = given.mapInArrow(scored, f"doc_id {id_type}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).withColumnRenamed("doc_id", id_col)
