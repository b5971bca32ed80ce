import duckdb

from tallyfield.llm import chat as C

SCHEMA = "pair_id long, turn long, role string, text string, prompt string"


def plain(turns):
    text, spans = "", []
    for role, said in turns:
        head = f"<|begin|>{role}\n"
        if role == "assistant":
            spans.append(f"{len(text) + len(head)}:{len(text) + len(head) + len(said) + 7}")
        text += head + said + "<|end|>\n"
    return text, ",".join(spans)


def want(key, chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    (c, cm), (r, rm) = plain(chosen[n:]), plain(rejected[n:])
    return (key, n, plain(chosen[:n])[0], c, r, cm, rm)


def rows(key, turns):
    return [(key, i, role, text, "x") for i, (role, text) in enumerate(turns)]


def test_pairs(spark):
    u, a, s = (lambda t: ("user", t)), (lambda t: ("assistant", t)), (lambda t: ("system", t))
    pairs = {
        1: ([s("é"), u("q"), a("good"), u("more"), a("x")], [s("é"), u("q"), a("bad 日本")]),
        2: ([u("q"), a("same")], [u("q"), a("same")]),
        3: ([u("q")], [u("z"), a("b")]),
        4: ([u("q"), a("yes")], []),
        5: ([], [a("no")]),
        6: ([u("t")] * 300 + [a("long " * 5000)], [u("t")] * 300 + [a("")]),
    }
    chosen = spark.createDataFrame([r for k, (c, _) in pairs.items() for r in rows(k, c)] + [(None, 0, None, None, None)], SCHEMA)
    rejected = spark.createDataFrame([r for k, (_, d) in pairs.items() for r in rows(k, d)], SCHEMA)
    got = {r.pair_id: tuple(r) for r in C.preference_pairs(chosen, rejected).collect()}
    assert got.pop(None) == (None, 0, "", "<|begin|>\n<|end|>\n", "", "", "")
    assert got == {k: want(k, c, d) for k, (c, d) in pairs.items()}
    assert C.preference_pairs(chosen.limit(0), rejected.limit(0)).count() == 0


def test_query_and_sql_agree(spark):
    data = [(0, 0, "user", "hi"), (0, 1, "assistant", "a0"), (0, 2, "user", "ok"), (0, 3, "assistant", "a1"), (1, 0, "user", "hey"), (1, 1, "assistant", "b1"), (2, 0, "user", None), (2, 1, "assistant", "lone"), (3, 0, "system", "sys"), (4, 0, "assistant", "dup"), (4, 0, "assistant", "dup"), (5, 0, None, "z"), (5, 1, "assistant", "q" * 999)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, C.preference_pairs(df, C.with_borrowed_reply(df), "conv_id").collect()))
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", data)
    assert got == sorted(con.execute(C.ORACLE_SQL).fetchall())
    assert [g[1] for g in got] == [3, 1, 1, 1, 0, 1]


def test_extra_columns_and_null_keys(spark):
    data = [(0, 0, "user", "hi"), (0, 1, "assistant", "a0"), (1, 0, "user", "hey"), (1, 1, "assistant", "b1"), (1, 1, "assistant", "b2"), (None, 0, "assistant", "n")]
    plain = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    extra = spark.createDataFrame([(*r, *["x"] * 8) for r in data], plain.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", lent string, last_turn string, last string, pair string, c string, r string, p string, prompt string")
    key = lambda df: sorted(map(tuple, C.preference_pairs(df, C.with_borrowed_reply(df), "conv_id").collect()), key=str)
    assert key(extra) == key(plain)
    lent = sorted(map(tuple, C.with_borrowed_reply(extra).collect()), key=str)
    # Both repeated last turns are replaced, the greater of them is lent, and the null conversation keeps its own.
    assert lent == sorted([(0, 0, "user", "hi"), (0, 1, "assistant", "b2"), (1, 0, "user", "hey"), (1, 1, "assistant", "a0"), (1, 1, "assistant", "a0"), (None, 0, "assistant", "n")], key=str)
    assert C.with_borrowed_reply(extra.limit(0)).count() == 0


def test_ties_in_turn_and_null_turns(spark):
    """Equal turns go by role and text, a null turn comes first, in whatever order the rows lie."""
    said = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, None, "system", "s"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c")]
    ordered = [("system", "s"), ("assistant", "z"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "c")]
    rejected = spark.createDataFrame(rows(1, ordered[:4]), SCHEMA)
    for own in (said, said[::-1]):
        (got,) = C.preference_pairs(spark.createDataFrame([(*r, "x") for r in own], SCHEMA).repartition(2), rejected).collect()
        assert tuple(got) == want(1, ordered, ordered[:4])
