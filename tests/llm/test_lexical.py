"""Ranked search against plain scoring of all documents, sure bounds, and the cases of the docstring."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import lexical as L

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    split = [(i, words(t)) for i, t in docs]
    n_docs, length = sum(1 for _, w in split if w), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in items:
        query, rated = Counter(words(text)), []
        for doc, w in split:
            tf, score = Counter(w), 0
            for t, c in query.items():
                if tf[t]:
                    m = 25 + (75 * len(w) * n_docs) // length
                    score += c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                rated.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(rated, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    return sorted(map(tuple, L.rank(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options).collect()), key=str)


def corpus(seed, docs=300, items=12):
    rng = np.random.default_rng(seed)
    lexicons = [[f"{p}{i}" for i in range(60)] for p in ("ab", "Él", "日")]
    text = lambda n, z: " ".join(rng.choice(lexicons[z], n, p=np.arange(60, 0, -1) / 1830)) + rng.choice([".", "!", ""])
    asked = [(i, text(rng.integers(1, 25), i % 3)) for i in range(items)]
    made = [(i, text(rng.integers(1, 120), i % 3)) for i in range(docs)]
    for i in range(0, docs, 9):  # passages of items, and copies
        made[i] = (i, made[i][1] + " " + asked[i % items][1])
    for i in range(5, docs, 11):
        made[i] = (i, made[5][1])
    return made, asked


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    docs, items = corpus(seed)
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, tree_docs=50, leaf=4) == want
    assert run(spark, docs, items, block_items=5, tree_docs=7, leaf=1) == want
    assert run(spark, docs, items, k=3, block_bytes=100) == brute(docs, items, 3)


def test_odd_texts(spark):
    long = "common " * 200_000 + "needle"
    docs = [(1, None), (2, ""), (3, "..."), (4, "needle in hay"), (5, "needle in hay"), (None, "needle in hay"), (4, "needle in hay"), (6, long), (7, "HAY É é\x00needle9")]
    items = [(1, "Needle"), (1, "Needle"), (2, None), (3, "-"), (None, "hay é"), (4, "nothing here"), (5, "common common needle9")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] == run(spark, docs, []) == run(spark, docs[:3], items)


def test_clashing_columns_and_text_ids(spark):
    docs, items = corpus(3, 40, 4)
    names = ("n", "zone", "cols", "tf", "item", "rank", "score", "at", "id")
    crowd = lambda df: df.select("*", *[F.lit("x").alias(n) for n in names])
    got = L.rank(crowd(spark.createDataFrame(docs, DOCS)), crowd(spark.createDataFrame(items, ITEMS))).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    named = spark.createDataFrame([(f"{i:03d}", t) for i, t in docs], "doc_id string, text string")
    got = L.rank(named, spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(((r.item_id, r.rank, int(r.doc_id), r.score) for r in got), key=str) == brute(docs, items)
    with pytest.raises(TypeError):
        L.rank(spark.createDataFrame([(1.5, "a")], "doc_id double, text string"), spark.createDataFrame(items, ITEMS))


def small_tree(docs, items, leaf):
    block = L.Block.of([i for i, _ in items], [t.encode() for _, t in items])
    counted = [(i, Counter(L.terms(t.encode()))) for i, t in docs]
    counted = [(i, sum(c.values()), {block.vocabulary[t]: n for t, n in c.items() if t in block.vocabulary}) for i, c in counted]
    counted = [x for x in counted if x[2]]
    df = np.bincount([t for _, _, c in counted for t in c], minlength=len(block.vocabulary))
    given = L.weights(df, len(docs), sum(n for _, n, _ in counted))
    ptr = np.r_[0, np.cumsum([len(c) for _, _, c in counted])]
    cols = np.array([t for _, _, c in counted for t in sorted(c)])
    tf = np.array([c[t] for _, _, c in counted for t in sorted(c)])
    x = given.values(tf, np.repeat([n for _, n, _ in counted], np.diff(ptr)))
    tree = L.grow([i for i, _, _ in counted], ptr, cols, x, given.term, block.zone, leaf)
    return tree, L.Search(tree, block.counts, given.term, block.zone)


def test_bounds_are_sure_and_prune():
    docs, items = corpus(4, 400, 9)
    tree, search = small_tree(docs, items, 8)
    assert sorted(tree.ids) == sorted(set(tree.ids))
    whole = np.vstack([search.leaf(n) for n in range(len(tree.lo)) if tree.left[n] < 0])
    for n in range(len(tree.lo)):
        assert tree.hi[n] - tree.lo[n] <= 8 or tree.left[n] > 0
        assert (whole[tree.lo[n] : tree.hi[n]] <= search.bound[n]).all()
    leaves = int((tree.left < 0).sum())
    met = [search.best(j, 3, int(np.sort(whole[:, j])[-3])) for j in range(len(items))]
    for j, (found, _) in enumerate(met):
        want = sorted((-int(s), False, i) for i, s in zip(tree.ids, whole[:, j]) if s > 0)[:3]
        assert found == want
    # Zones of other items and far leaves are passed over.
    assert np.mean([n for _, n in met]) < 0.7 * leaves
