import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm import sentences as S


def lowered(word):
    return re.sub("[A-Z]", lambda m: m[0].lower(), word)


def plain_sentences(text, whole=S.WHOLE, every=S.CUT):
    """(start, end, words) by code points: cut at stops and line ends; where longer, after marks; where longer still, after words by checksum; at last every 20 words."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]

    def split(group, ends):
        out, own = [], []
        for k in group:
            own.append(k)
            if ends(k, len(own)):
                out.append(own)
                own = []
        return [*out, own] if own else out

    groups = split(range(len(words)), lambda k, _: words[k][2][-1] in ".!?" or k + 1 < len(words) and "\n" in text[words[k][1] : words[k + 1][0]])
    most = max(whole, 20)
    for longer, ends in ((whole, lambda k, _: words[k][2][-1] in ",:;|"), (whole, lambda k, _: zlib.crc32(lowered(words[k][2]).encode()) % every == 0), (most, lambda _, n: n == most)):
        groups = [part for g in groups for part in (split(g, ends) if len(g) > longer else [g])]
    return [(words[g[0]][0] if n else 0, words[g[-1] + 1][0] if n + 1 < len(groups) else len(text), [words[k][2] for k in g]) for n, g in enumerate(groups)]


def plain_runs(parts):
    count = [len(w) for _, _, w in parts]
    found = []
    for at in range(len(parts)):
        for n in range(3, len(parts) - at + 1):
            if sum(count[at : at + n]) >= 30:
                found.append((at, n))
                break
    if not found:
        return [(0, 0, len(parts))] if sum(count) >= 15 else []
    runs = [(at, at, n) for at, n in found]
    if sum(found[-1]) < len(parts):
        at = max(a for a in range(len(parts) - 2) if sum(count[a:]) >= 30)
        runs.append((len(parts), at, len(parts) - at))
    return runs


def brute(docs):
    occ = defaultdict(set)
    parts = {d: plain_sentences(t or "") for d, t in docs}
    for d, p in parts.items():
        for label, at, n in plain_runs(p):
            occ[lowered(" ".join(x for _, _, w in p[at : at + n] for x in w))].add((d, label, at, n))
    gone = defaultdict(set)
    for places in occ.values():
        for d, _, at, n in sorted(places)[1:]:
            gone[d] |= set(range(at, at + n))
    return {d: ("".join((t or "")[a:b] for k, (a, b, _) in enumerate(parts[d]) if k not in gone[d]) if parts[d] else t, len(parts[d]), len(gone[d])) for d, t in docs}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abQ.!,? \n\tÉ")), max_size=120), max_size=4), st.sampled_from([0, 4, S.WHOLE, 25]), st.sampled_from([2, S.CUT]))
def test_sentences_and_runs_equal_the_plain_ones(texts, whole, every):
    seen = 0
    for first, data, offsets, parts in S._each(pa.array(texts, pa.string()), whole, every):
        text, label, at, end = parts.runs()
        for k in range(len(offsets) - 1):
            want = plain_sentences(texts[first + k], whole, every)
            lo, hi = parts.texts[k : k + 2]
            raw = texts[first + k].encode()
            assert [(a - offsets[k], b - offsets[k]) for a, b in zip(parts.start[lo:hi], parts.end[lo:hi])] == [(len(texts[first + k][:a].encode()), len(texts[first + k][:b].encode())) for a, b, _ in want]
            assert not want or parts.end[hi - 1] - offsets[k] == len(raw)
            assert [(m, a - lo, b - a) for t, m, a, b in zip(text, label, at, end) if t == k] == plain_runs(want)
            assert [parts.said[a:b].decode() for a, b in zip(parts.said_at[lo:hi], parts.said_at[lo + 1 : hi + 1])] == [lowered("".join(f"{x} " for x in w)) for _, _, w in want]
            seen += 1
    assert seen == len(texts)


def corpus():
    draw = random.Random(5)
    sentence = lambda: " ".join(draw.choice("red blue one two six ten sun moon".split()) + str(draw.randint(0, 99)) for _ in range(draw.randint(3, 14))).capitalize() + draw.choice([". ", "!\n", "? "])
    passages = ["".join(sentence() for _ in range(8)) for _ in range(3)]
    docs = [(i, "".join(sentence() for _ in range(draw.randint(0, 6))) + (draw.choice(passages) if i % 3 else "") + "".join(sentence() for _ in range(draw.randint(0, 6)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "Short. Text. Here."), (103, "la. " * 200), (104, "x " * 30_000), (105, " \n é " + passages[0].upper()), (106, "One sentence of fifteen words that has no stop and stands in two texts as a whole."), (107, "one sentence of fifteen words that has no stop and stands in two texts as a whole.")]
    return docs


@pytest.mark.parametrize("chunk", [S.CHUNK, 400])
def test_matches_brute_force(spark, chunk):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, own int, ats int").repartition(3)
    rows = S.remove_repeats(df, chunk_bytes=chunk).collect()
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in rows}
    assert got == brute(docs) and len(rows) == len(docs)
    assert sum(v[2] > 0 for v in got.values()) > 30 and got[102][2] == got[106][2] == 0 and got[107][0] == "" and got[104][2] > 0
    for r in rows:
        cuts = [tuple(map(int, c.split(":"))) for c in r.removed.split(",")] if r.removed else []
        old = dict(docs)[r.doc_id]
        assert r.text == (old if not cuts else "".join(old[a:b] for a, b in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(old)])))


def test_repeated_rows_and_nulls(spark):
    text = "One two three four five six seven eight nine ten. " * 2 + "Eleven twelve one two three four five six seven. " + "Seven eight nine ten eleven twelve one two three four."
    rows = [(1, text), (1, text), (None, text.upper()), (2, text), (None, None), (None, text + " z")]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = len(plain_sentences(text))
    first = sorted([text.upper(), text + " z"], key=lambda t: spark.range(1).select(S.F.xxhash64(S.F.lit(t))).first()[0])[0]
    all_gone = [(r.doc_id, r.n_removed == r.n_sentences) for r in got if r.doc_id is not None]
    # Null ids come first; of these two texts the one with the lesser hash keeps its words.
    assert sorted(all_gone) == [(1, True), (1, True), (2, True)] and len(got) == 6
    assert any(r.text == first and r.n_removed == 0 for r in got) and all(r.n_removed in (0, n) or r.doc_id is None for r in got)
    alone = S.remove_repeats(spark.createDataFrame([(1, text)] * 5, "doc_id long, text string")).collect()
    assert [r.text for r in alone] == [alone[0].text] * 5
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    names = S.remove_repeats(spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")).collect()
    assert {r.doc_id: r.n_removed for r in names} == {"a": 0, "b": n}


def test_whole_copies_go_to_their_last_word(spark):
    draw = random.Random(3)
    texts = [" ".join(f"u{draw.randint(0, 500)}" + draw.choice(["", "", "", ".", "\n"]) for _ in range(draw.randint(15, 90))) for _ in range(120)]
    rows = [(2 * k + copy, t) for k, t in enumerate(texts) for copy in range(2)]
    got = {r.doc_id: r.text for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == t and got[2 * k + 1] == "" for k, t in enumerate(texts))


def test_a_short_sentence_before_a_passage_hides_nothing(spark):
    passage = "The red sun rose over hills. A moon hung low in mist. Six ships sailed out at dawn. Ten men stood at the old gate and sang of rain and of long roads."
    rows = [(1, passage), (2, "Oh no. " + passage)]
    got = {r.doc_id: r.text for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: passage, 2: "Oh no. "}


#: Of the words of planted passages, with sentences kept whole and with all divided.
LEAST_REMOVED = {(S.WHOLE, S.CUT): 0.8, (0, 3): 0.9}


def planted_passages(texts):
    """Texts by id, pairs of which share a passage of 51 to 60 words in mid-line; words of the passage by the second's id."""
    draw = random.Random(11)
    words = lambda n: [f"v{draw.randint(0, 20_000)}" for _ in range(n)]
    docs, planted = [], {}
    for k in range(texts):
        passage: list[str] = []
        while len(passage) < 51:
            passage += [*words(draw.randint(12, 19)), words(1)[0] + "."]
        passage = passage[:60]
        docs += [(2 * k + copy, " ".join([*words(draw.randint(3, 25)), *passage, *words(draw.randint(3, 25))])) for copy in range(2)]
        planted[2 * k + 1] = len(passage)
    return docs, planted


@pytest.mark.parametrize("whole,every", LEAST_REMOVED)
def test_passages_within_lines_are_found(spark, whole, every):
    docs, planted = planted_passages(1500)
    got = {r.doc_id: len(dict(docs)[r.doc_id].split()) - len(r.text.split()) for r in S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), whole=whole, every=every).where("n_removed > 0").collect()}
    assert got.keys() <= planted.keys() and len(got) > 0.9 * len(planted)
    assert all(got[d] <= planted[d] for d in got) and sum(got.values()) > LEAST_REMOVED[whole, every] * sum(planted.values())


def test_a_sentence_is_never_broken(spark):
    """What is removed begins and ends at stops, line ends and the text's ends, where no sentence is long."""
    for r in S.remove_repeats(spark.createDataFrame([d for d in corpus() if d[0] < 100], "doc_id long, text string")).collect():
        old = dict(corpus())[r.doc_id]
        for a, b in [tuple(map(int, c.split(":"))) for c in r.removed.split(",")] if r.removed else []:
            assert (not a or old[:a].rstrip()[-1] in ".!?") and (b == len(old) or old[:b].rstrip()[-1] in ".!?")


def test_rows_are_in_proportion_and_chunks_of_one_size(spark):
    """A run that all documents share meets the others once for each chunk, and rows grow with the text alone."""
    shared = "One two three four five six seven. " * 2 + "Red and blue ships sail at dawn over the sea. Ten men sing of rain and of long roads. The moon hung low in mist."
    sent = []
    for n in (100, 200, 400, 800):
        docs = spark.createDataFrame([(i, shared + " " + " ".join(f"w{i}x{k}" for k in range(12)) + ".") for i in range(n)], "doc_id long, text string").coalesce(1)
        runs = S._runs(docs, "doc_id", "text", S.WHOLE, S.CUT, S.CHUNK).toPandas()
        sent.append(len(runs))
        assert runs[~runs.again].groupby(["d0", "d1"]).size().max() == 1
    assert [b / a for a, b in zip(sent, sent[1:])] == [2, 2, 2]
