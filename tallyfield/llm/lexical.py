"""Ranked lexical search: exact inner products of sparse vectors through ball trees.

A document is a sparse vector over the terms of the items (a term that no item has cannot add to a score), an item one
of counts, and a score their inner product with integer weights. Documents are put into trees where they lie, without
a shuffle: a task sorts them by zone (the group of related items whose terms they mostly hold) and makes a tree of every
TREE_DOCS of them. A node of a tree has a centroid and, for each zone of terms, the radius around it. The product of an
item with any document of the node is at most that with the centroid plus, summed over the zones, the item's length
times the radius, both of that zone. Bounds are taken a little larger than they were calculated, so that rounding never
loses a document.

A tree is searched best first: nodes in the order of their bounds, until none can reach the best few found so far; leaves
are scored in integers. While trees are made, the most promising leaf of each gives every item some scores; the k-th
best of those over all trees is a sure lower bound that the search of all trees starts with.

Items are taken in blocks of bounded size, as their terms are sent to the tasks; each block is searched for in all
documents.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, settle, ship

#: Results of an item.
TOP = 10
#: Items of a block, and bytes of their texts, about.
BLOCK_ITEMS, BLOCK_BYTES = 256, 256_000
#: Zones of terms; documents and entries of a tree at most; documents of a leaf.
ZONES, TREE_DOCS, TREE_ENTRIES, LEAF = 8, 4096, 1_000_000, 32
#: Cells of the dense tables of a tree's terms and some items.
DENSE = 4_000_000
#: Trees that go to a task's Python side at once.
TREES_AT_ONCE = 4
#: Relative and absolute allowance for rounding in bounds, and for squares of lengths in radii.
SLACK, SLACK_AT_LEAST, SLACK_SQUARE = 1e-9, 1.0, 1e-10

#: What separates terms becomes a blank, A-Z lower case; bytes beyond ASCII are parts of terms.
TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(128)) + bytes(range(128, 256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


@dataclass(frozen=True)
class Block:
    """Items of a block: the position of every term, and term counts of every item; zone of every term."""

    ids: list
    vocabulary: dict[bytes, int]
    counts: list[dict[int, int]]
    zone: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[bytes]) -> "Block":
        vocabulary: dict[bytes, int] = {}
        counts = [{vocabulary.setdefault(t, len(vocabulary)): n for t, n in Counter(terms(x)).items()} for x in texts]
        return Block(ids, vocabulary, counts, _zones(counts, len(vocabulary)))


def _zones(counts: list[dict[int, int]], size: int) -> np.ndarray:
    """A zone for every term: items that share a fifth of their terms with an earlier leader join it, and a term goes where most of its items are."""
    leaders, votes = [], np.zeros((ZONES, size), np.int32)
    for own in counts:
        shared = [len(own.keys() & leader) for leader in leaders]
        best = max(range(len(leaders)), key=shared.__getitem__, default=-1)
        if best < 0 or (shared[best] * 5 < len(own) and len(leaders) < ZONES):
            best = len(leaders)
            leaders.append(set())
        leaders[best] |= own.keys()
        votes[best, list(own)] += 1
    return votes.argmax(0).astype(np.int64)


@dataclass(frozen=True)
class Weights:
    """What scores need of all documents: weight of each term, N and L."""

    term: np.ndarray
    docs: int
    length: int

    def values(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 25 + (75 * n * self.docs) // max(1, self.length)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weights(df: np.ndarray, docs: int, length: int) -> Weights:
    return Weights(np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64), docs, length)


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of the runs of values between pointers; all runs hold something."""
    return np.add.reduceat(values, ptr[:-1], axis=0) if len(ptr) > 1 else values[:0]


def _pick(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers of the chosen rows, and the places of their entries."""
    size = np.diff(ptr)[rows]
    new = np.r_[0, np.cumsum(size)]
    return new, np.arange(new[-1]) + np.repeat(ptr[:-1][rows] - new[:-1], size)


@dataclass
class Tree:
    """Documents in the order of the leaves (ptr, cols, x) over local terms, and nodes in preorder (lo, hi, left, right; -1: leaf)."""

    terms: np.ndarray
    ids: list
    ptr: np.ndarray
    cols: np.ndarray
    x: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    c_ptr: np.ndarray
    c_cols: np.ndarray
    c: np.ndarray
    radius: np.ndarray  # nodes x zones


def grow(ids: list, ptr: np.ndarray, cols: np.ndarray, x: np.ndarray, weight: np.ndarray, zone: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over documents, none of them empty; distances are between vectors of values times term weights."""
    own, cols = np.unique(cols, return_inverse=True)
    scale, zones = weight[own].astype(np.float64), zone[own]
    y = x * scale[cols]
    order = np.arange(len(ids))
    rows = np.repeat(order, np.diff(ptr))
    norms = np.bincount(rows * ZONES + zones[cols], weights=y * y, minlength=len(ids) * ZONES).reshape(-1, ZONES)
    nodes, centroids, radii = [], [], []
    stack = [(0, len(ids), -1, 0)]
    while stack:
        lo, hi, parent, side = stack.pop()
        here = order[lo:hi]
        at = len(nodes)
        nodes.append([lo, hi, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = at
        p, e = _pick(ptr, here)
        k, v = cols[e], y[e]
        center = (np.bincount(k, weights=v, minlength=len(own)) / (hi - lo)).astype(np.float32)
        centroids.append(np.flatnonzero(center))
        c = center.astype(np.float64)
        square = np.bincount(zones, weights=c * c, minlength=ZONES)
        local = np.repeat(np.arange(hi - lo), np.diff(p))
        dot = np.bincount(local * ZONES + zones[k], weights=v * c[k], minlength=(hi - lo) * ZONES).reshape(-1, ZONES)
        far = norms[here] - 2 * dot + square
        far = np.maximum(far, 0) + SLACK_SQUARE * (norms[here] + square)
        radii.append(np.sqrt(far.max(0)))
        centroids[-1] = (centroids[-1], center[centroids[-1]])
        if hi - lo <= leaf:
            continue
        # Two documents far from each other, and every document to the nearer one, in halves.
        ends, pole = [], int(far.sum(1).argmax())
        for _ in range(2):
            line = np.zeros(len(own))
            line[k[p[pole] : p[pole + 1]]] = v[p[pole] : p[pole + 1]]
            near = _sums(v * line[k], p)
            ends.append(near)
            pole = int((norms[here].sum(1) - 2 * near).argmax())
        order[lo:hi] = here[np.argsort(ends[1] - ends[0], kind="stable")]
        half = (lo + hi) // 2
        stack += [(half, hi, at, 1), (lo, half, at, 0)]
    new, e = _pick(ptr, order)
    lo, hi, left, right = (np.array(v, np.int64) for v in zip(*nodes))
    c_ptr = np.r_[0, np.cumsum([len(a) for a, _ in centroids])]
    return Tree(own, [ids[i] for i in order], new, cols[e], x[e], lo, hi, left, right, c_ptr, np.concatenate([a for a, _ in centroids]), np.concatenate([b for _, b in centroids]), np.array(radii))


class Search:
    """Some items of a block against one tree: bounds of all nodes at once, scores of leaves when they are met."""

    def __init__(self, tree: Tree, counts: list[dict[int, int]], weight: np.ndarray, zone: np.ndarray):
        self.tree = tree
        place = {t: i for i, t in enumerate(tree.terms.tolist())}
        q = np.zeros((len(tree.terms), len(counts)), np.int64)
        for j, own in enumerate(counts):
            for t, n in own.items():
                if t in place:
                    q[place[t], j] = n
        zones = zone[tree.terms]
        self.q = q * weight[tree.terms][:, None]
        f = q.astype(np.float64)
        length = np.sqrt(np.array([(f[zones == z] ** 2).sum(0) for z in range(ZONES)]))
        near = np.array([tree.c[a:b].astype(np.float64) @ f[tree.c_cols[a:b]] for a, b in zip(tree.c_ptr[:-1], tree.c_ptr[1:])])
        self.bound = (near + tree.radius @ length) * (1 + SLACK) + SLACK_AT_LEAST
        self.scored: dict[int, np.ndarray] = {}

    def leaf(self, node: int) -> np.ndarray:
        """Exact scores of the leaf's documents for all items."""
        if node not in self.scored:
            t = self.tree
            a, b = t.lo[node], t.hi[node]
            p = t.ptr[a : b + 1]
            e = slice(p[0], p[-1])
            self.scored[node] = _sums(t.x[e, None] * self.q[t.cols[e]], p - p[0])
        return self.scored[node]

    def _merge(self, found: list, node: int, j: int, k: int) -> list:
        a = self.tree.lo[node]
        new = [(-int(s), self.tree.ids[a + i] is None, self.tree.ids[a + i]) for i, s in enumerate(self.leaf(node)[:, j].tolist()) if s > 0]
        return heapq.nsmallest(k, found + new, key=_order)

    def promising(self, j: int, k: int) -> list:
        """The best of the leaf that the bounds lead to."""
        node = 0
        while self.tree.left[node] >= 0:
            node = max(self.tree.left[node], self.tree.right[node], key=lambda n: self.bound[n, j])
        return self._merge([], node, j, k)

    def best(self, j: int, k: int, least: int) -> tuple[list, int]:
        """The best k documents with scores of at least `least`, and how many leaves were scored; ties by id, null last."""
        found, leaves = [], 0
        heap = [(-self.bound[0, j], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            if self.tree.left[node] < 0:
                leaves += 1
                found = [x for x in self._merge(found, node, j, k) if -x[0] >= least]
                if len(found) == k:
                    least = max(least, -found[-1][0])
                continue
            for child in (self.tree.left[node], self.tree.right[node]):
                if self.bound[child, j] >= least:
                    heapq.heappush(heap, (-min(-bound, self.bound[child, j]), child))
        return found, leaves


def _order(entry: tuple) -> tuple:
    score, null, doc = entry
    return score, null, 0 if null else doc


def _searches(tree: Tree, block: Block, weight: np.ndarray) -> Iterator[tuple[int, Search]]:
    """Searches for slices of the items, so that their dense tables stay bounded; with the first item's position."""
    step = max(1, DENSE // max(1, len(tree.terms)))
    for i in range(0, len(block.counts), step):
        yield i, Search(tree, block.counts[i : i + step], weight, block.zone)


COUNTED = "doc_id {id}, n long, zone int, cols array<int>, tf array<int>"
TREE = "zone int, terms array<int>, ids array<{id}>, ptr array<int>, cols array<int>, x array<int>, lo array<int>, hi array<int>, lft array<int>, rgt array<int>, c_ptr array<int>, c_cols array<int>, c array<float>, radius array<double>, seeds array<struct<item: int, score: long>>"
PARTS = ("terms", "ptr", "cols", "x", "lo", "hi", "lft", "rgt", "c_ptr", "c_cols")


def _counter(block: Block):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.vocabulary
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = terms(text.as_py())
                own = sorted((known[t], n) for t, n in Counter(found).items() if t in known)
                cols = [c for c, _ in own]
                zone = int(np.bincount(block.zone[cols], minlength=ZONES).argmax()) if own else None
                rows.append((len(found), zone, cols, [n for _, n in own]))
            n, zone, cols, tf = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(zone, pa.int32()), pa.array(cols, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))],
                ["doc_id", "n", "zone", "cols", "tf"],
            )

    return count


def _entries(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy().astype(np.int64)


def _grower(block: Block, given: Weights, k: int, id_type: pa.DataType, tree_docs: int, leaf: int):
    def tree_of(zone: int, parts: list[tuple]) -> pa.RecordBatch:
        ids = [i for part in parts for i in part[0]]
        sizes, cols, x = (np.concatenate([part[i] for part in parts]) for i in (1, 2, 3))
        tree = grow(ids, np.r_[0, np.cumsum(sizes)], cols, x, given.term, block.zone, leaf)
        seeds = [{"item": i + j, "score": -s} for i, search in _searches(tree, block, given.term) for j in range(len(search.bound[0])) for s, _, _ in search.promising(j, k)]
        lists = [tree.terms, tree.ptr, tree.cols, tree.x, tree.lo, tree.hi, tree.left, tree.right, tree.c_ptr, tree.c_cols]
        arrays = {n: pa.array([v.astype(np.int32)], pa.list_(pa.int32())) for n, v in zip(PARTS, lists)}
        arrays |= {"zone": pa.array([zone], pa.int32()), "ids": pa.array([tree.ids], pa.list_(id_type)), "c": pa.array([tree.c], pa.list_(pa.float32())), "radius": pa.array([tree.radius.ravel()], pa.list_(pa.float64()))}
        arrays["seeds"] = pa.array([seeds], pa.list_(pa.struct([("item", pa.int32()), ("score", pa.int64())])))
        names = "zone terms ids ptr cols x lo hi lft rgt c_ptr c_cols c radius seeds".split()
        return pa.RecordBatch.from_arrays([arrays[n] for n in names], names)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            zones = batch.column("zone").to_numpy(zero_copy_only=False)
            sizes, cols = _entries(batch.column("cols"))
            tf = _entries(batch.column("tf"))[1]
            x = given.values(tf, np.repeat(batch.column("n").to_numpy(), sizes))
            ids, ptr = batch.column("doc_id").to_pylist(), np.r_[0, np.cumsum(sizes)]
            for zone in np.unique(zones).tolist():
                rows = np.flatnonzero(zones == zone)
                # As many rows at once as a tree may still take.
                while len(rows):
                    size = held.setdefault(zone, np.zeros(2, np.int64))
                    total = np.cumsum(sizes[rows]) + size[1]
                    fit = max(int(size[0] == 0), min(tree_docs - size[0], int(np.searchsorted(total, TREE_ENTRIES, "right"))))
                    now, rows = rows[:fit], rows[fit:]
                    if fit:
                        p, e = _pick(ptr, now)
                        waiting.setdefault(zone, []).append(([ids[i] for i in now], np.diff(p), cols[e], x[e]))
                        size += (fit, p[-1])
                    if len(rows):
                        yield tree_of(zone, waiting.pop(zone))
                        del held[zone]
        for zone, parts in sorted(waiting.items()):
            yield tree_of(zone, parts)

    return trees


def _read(batch: pa.RecordBatch, i: int) -> Tree:
    get = lambda name: batch.column(name)[i].values
    terms_, ptr, cols, x, lo, hi, left, right, c_ptr, c_cols = (get(n).to_numpy().astype(np.int64) for n in PARTS)
    return Tree(terms_, get("ids").to_pylist(), ptr, cols, x, lo, hi, left, right, c_ptr, c_cols, get("c").to_numpy(), get("radius").to_numpy().reshape(-1, ZONES))


def _searcher(block: Block, given: Weights, least: list[int], k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                tree = _read(batch, r)
                for i, s in _searches(tree, block, given.term):
                    for j in range(s.bound.shape[1]):
                        found, _ = s.best(j, k, least[i + j])
                        rows += [(i + j, doc, -score) for score, _, doc in found]
            item, doc, score = zip(*rows) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, batch.column("ids").type.value_type), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return search


def _block_results(docs: DataFrame, block: Block, k: int, tree_docs: int, leaf: int) -> DataFrame:
    """(item, doc_id, score, rank) for the items of a block."""
    id_name = dict(docs.dtypes)["doc_id"]
    counted = settle(docs.mapInArrow(_counter(block), COUNTED.format(id=id_name)), "term-counts")
    totals = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
    df = np.zeros(len(block.vocabulary), np.int64)
    for row in counted.select(F.explode("cols").alias("col")).groupBy("col").agg(F.count("*").alias("df")).collect():  # no more rows than the block has terms
        df[row["col"]] = row["df"]
    given = weights(df, totals["docs"], totals["length"] or 0)
    trees = settle(counted.where("size(cols) > 0").mapInArrow(_grower(block, given, k, _arrow_type(id_name), tree_docs, leaf), TREE.format(id=id_name)), "trees")
    seeds = trees.select(F.explode("seeds").alias("s")).select("s.*")
    ranked = seeds.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("n") == k)
    least = [1] * len(block.ids)
    for row in ranked.collect():  # a row for each item of the block at most
        least[row["item"]] = row["score"]
    narrow = trees.drop("zone", "seeds")
    hits = narrow.mapInArrow(_searcher(block, given, least, k), f"item int, doc_id {id_name}, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def _arrow_type(name: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    if name not in known:
        raise TypeError(f"ids of type {name} cannot be ranked; use an integer or a string")
    return known[name]


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = TOP, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, tree_docs: int = TREE_DOCS, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's k documents of the highest scores above 0, exact in integers.

    Equal scores go by ascending document id, null ids last. Null and wordless texts have no terms: as documents they are
    found by no item and not counted, as items they find nothing. Texts are taken whole. Repeated documents are
    documents of their own, repeated items are answered each; without documents or items there are no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).cast("binary").alias("text")
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text(text_col))
    id_name, item_type = dict(named.dtypes)["doc_id"], dict(items.dtypes)[item_col]
    _arrow_type(id_name)
    given = settle(items.select(F.monotonically_increasing_id().alias("at"), F.col(f"`{item_col}`").alias("id"), text(item_text_col)), "items")
    size = given.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(-(-size["n"] // block_items), -(-(size["bytes"] or 0) // block_bytes))
    out = []
    for b in range(blocks):
        rows = given.where(F.pmod("at", F.lit(blocks)) == b).orderBy("at").collect()  # a block of items, of bounded size
        block = Block.of([r["id"] for r in rows], [bytes(r["text"]) for r in rows])
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {item_type}")
        found = _block_results(named, block, k, tree_docs, leaf).join(F.broadcast(ids), "item")
        with batches_of(spark, TREES_AT_ONCE):
            out.append(settle(found.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"), "ranked"))
    if not out:
        return spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, `{id_col}` {id_name}, score long")
    return reduce(DataFrame.unionByName, out)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
tot AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
df AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY t, n_docs),
x AS (SELECT doc_id, tf.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l))) AS v FROM tf JOIN df ON df.t = tf.t, tot),
s AS (SELECT item_id, doc_id, CAST(sum(c * v) AS BIGINT) AS score FROM x JOIN q ON q.t = x.t GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
