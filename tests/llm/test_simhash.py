import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyfield.llm import simhash


def plain_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(draw.choices(words, k=120)) for _ in range(12)]
    out = [None, "", " \t\n", "One", "one", "a b c", "A B C d", "É x Y z w"]
    for t in base:
        for _ in range(6):
            w = t.split()
            for _ in range(draw.randint(0, 3)):
                w[draw.randrange(len(w))] = draw.choice(words)
            out.append(" ".join(w))
    return out


def test_near_duplicates_match_brute_force(spark):
    rows = list(enumerate(texts(), 1))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")).collect()}
    prints = {i: plain_print(t) for i, t in rows}
    comps = plain_components(prints)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", comps[i]) for i in prints}
    assert len(set(comps.values())) < len(comps)


def test_links_of_planted_bits(spark):
    draw = random.Random(9)
    prints = set()
    for _ in range(60):
        x = draw.getrandbits(64)
        for _ in range(5):
            prints.add(x)
            for b in draw.sample(range(64), draw.randint(1, 5)):
                x ^= 1 << b
    center = draw.getrandbits(64)
    prints |= {center ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}  # one cell with many members
    signed = [(simhash._signed(p),) for p in sorted(prints)]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    got = {r.node: r.root for r in found}
    want = plain_components({p: simhash._signed(p) & (2**64 - 1) for (p,) in signed})
    assert {p: got.get(p, p) for (p,) in signed} == want
    # All cells divided before the shuffle: the same components.
    df = spark.createDataFrame(signed, "fp long")
    assert simhash._parted(df, 0).where("part = 0").count() == 0 and simhash._parted(df, simhash.DIVIDE).where("part > 0").count() == 0
    got = {r.node: r.root for r in simhash.components(simhash.links(df, divide=0)).collect()}
    assert {p: got.get(p, p) for (p,) in signed} == want


def test_manhattan_is_a_lower_bound():
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 2**64, (2, 500), dtype=np.uint64)
    per = lambda x: [[(int(v) >> 2 * s & 3).bit_count() for s in range(32)] for v in x]
    want = [sum(abs(p - q) for p, q in zip(x, y)) for x, y in zip(per(a), per(b))]
    got = simhash.manhattan(simhash.embed(a), simhash.embed(b))
    assert got.tolist() == want
    assert (got <= np.bitwise_count(a ^ b)).all()


def test_large_runs_divide(monkeypatch):
    draw = random.Random(4)
    fps = np.array([draw.getrandbits(12) | 7 << 40 for _ in range(600)], np.uint64)
    fps = np.unique(fps)
    monkeypatch.setattr(simhash, "DIVIDE", 50)
    found = {}
    def find(x):
        while found.get(x, x) != x:
            x = found[x]
        return x
    for a, b in simhash._large(fps):
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(x), find(y)
            found[max(p, q)] = min(p, q)
    want = plain_components({int(p): int(p) for p in fps})
    assert {int(p): find(int(p)) for p in fps} == want


def test_chain_and_empty(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(2, "x y"), (2, "x y"), (None, "x y")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(twice).collect()] == [2, 2, 2]


def test_very_long_and_repeated_texts(spark):
    draw = random.Random(9)
    long = " ".join(f"w{draw.randint(0, 5_000)}" for _ in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, "la " * 400_000), (4, "LA " * 7), (5, "x" * 2_000_000), (6, long.upper()), (6, long)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    prints = {i: plain_print(t) for i, t in rows}
    comps = plain_components(prints)
    assert got == {i: (f"{prints[i]:016x}", comps[i]) for i in prints}
    assert comps[2] == comps[6] == 1 and comps[4] == 3
