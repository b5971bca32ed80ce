import hashlib
import random
import re

import duckdb
import pytest

from tallyfield.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = split(t)
        for at in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[at : at + 10]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for at in range(len(w)):
            for size in {len(g) for g in wins}:
                got = wins.get(tuple(w[at : at + size])) if at + size <= len(w) else None
                if got:
                    hit.update(range(at, at + size))
                    found |= got
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    draw = random.Random(8)
    word = lambda: draw.choice(["the", "of", "É", "x9", "Été", "RARE", "b", "ñ"])
    items = [(i, " ".join(word() for _ in range(draw.randint(11, 16)))) for i in range(12)]
    items += [(20, "Zig"), (21, "zag zOg"), (22, "one two three four"), (23, ""), (24, None), (25, "..."), (26, items[0][1]), (27, "zig")]
    docs = [(1, None), (2, ""), (3, "?!"), (4, "zig zig"), (5, "a zag-zog b"), (6, "one two three"), (7, "one Two, three four one two three four"), (8, "the of " * 4000)]
    for i in range(30, 60):
        parts = [word() for _ in range(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 3)):
            w = split(draw.choice(items)[1])
            a = draw.randint(0, max(0, len(w) - 10))
            parts[len(parts) // 2 : 0] = w[a : a + draw.randint(8, 16)]
        docs.append((i, "; ".join(parts).upper() if i % 3 else " ".join(parts)))
    return docs + [(7, docs[6][1]), (None, "zig")], items


# Everything is sent out, only the keys are (some 200 of them, of windows of some 30 kB), or nothing is.
@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 6000, -1])
def test_matches_brute_force(spark, limit):
    docs, items = fixture()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, D.contamination(d, b, broadcast_bytes=limit).collect()), key=str)
    assert got == brute(docs, items)
    assert sum(r[-1] for r in got) > 10


def test_empty_tables(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert D.contamination(d.limit(0), b).count() == 0
    assert [r.n_hit for r in D.contamination(d, b.limit(0)).collect()] == [0] * len(docs)
    assert "Python" not in D.contamination(d, b)._jdf.queryExecution().toString()


def test_sql_states_the_same(spark):
    docs, items = fixture()
    docs = [d for d in docs[:-2]]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.execute("create table benchmark(item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(map(tuple, con.execute(D.ORACLE_SQL).fetchall()), key=str) == brute(docs, items)


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, -1])
def test_an_item_without_id_hits_but_is_not_counted(spark, limit):
    d = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "two three"), (5, "four")], "item_id long, text string")
    (r,) = D.contamination(d, b, broadcast_bytes=limit).collect()
    assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (4, 3, 1, hashlib.sha256(b"5").hexdigest(), True)
