import itertools
import math
import pickle
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tallyfield.llm import language as L

WORDS = {"aa": ["tala", "vemo", "pirut"], "bb": ["schnek", "gruft", "zwolk"], "cc": ["привет", "мир"]}


def corpus(n=300):
    draw = random.Random(3)
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(WORDS))
        rows.append((i, " ".join(draw.choices(WORDS[lang], k=draw.randint(3, 40))), lang))
    return rows


def test_viterbi_is_exact():
    model = L.Model(["x", "y", "z"])
    draw = np.random.default_rng(1)
    scores = [draw.normal(0, 9, (n, 3)).astype(np.float32) for n in (7, 5, 5, 1, 0)]
    got = L.Labeller(model)._viterbi(scores)
    for s, path in zip(scores, got):
        def value(p):
            return sum(s[i, k] for i, k in enumerate(p)) - L.SWITCH * sum(a != b for a, b in itertools.pairwise(p))
        if len(s):
            assert abs(value(path) - max(value(p) for p in itertools.product(range(3), repeat=len(s)))) < 1e-3


def test_predict(spark):
    rows = corpus() + [(1000, None, "aa"), (1001, "123 ²½ --", None), (1002, "日本語", None), (1003, "tala " * 30_000, None), (1004, "", "aa"), (None, "gruft zwolk", "bb")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in L.predict(df).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang in rows[:300])
    assert [got[i].lang_pred for i in (1000, 1001, 1004, 1003)] == ["und", "und", "und", "aa"]
    assert got[1002].lang_pred in WORDS and got[1001].score == 0
    assert L.predict(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", L.F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.predict(unlabelled).collect()} == {"und"}


def test_labels_decide_nothing_for_held_out_rows(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    swapped = spark.createDataFrame([(i, t, "aa" if zlib.crc32(str(i).encode()) % 5 == 0 else g) for i, t, g in rows], df.schema)
    key = lambda d: sorted(map(tuple, L.predict(d).collect()))
    assert key(df) == key(swapped)


def test_spans_of_mixed_text(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = L.fit(df)
    mixed = " ".join(WORDS["aa"] * 4) + ", " + " ".join(WORDS["bb"] * 3) + ". мир привет мир"
    (row,) = L.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, spans=True).collect()
    assert [s.lang for s in row.spans] == ["aa", "bb", "cc"] and row.lang_pred == "aa" and 0.3 < row.score < 0.7
    assert mixed[row.spans[1].start : row.spans[1].end] == " ".join(WORDS["bb"] * 3)


def test_cache_renewal():
    counts = [(k, c, 5) for k, w in enumerate(["abc", "xyz"]) for c in [*map(L.gram_code, L.grams(w)), L.script_code("latin")]]
    model = L._model(["p", "q"], *(np.array(x) for x in zip(*counts)))
    small, large = L.Labeller(model, keep=1), L.Labeller(model)
    for words in (["abc"], ["xyz", "abc"], ["abc", "abc", "xyz"], []):
        assert small.paths([words])[0][0].tolist() == large.paths([words])[0][0].tolist()


def test_words_of_many_texts_are_not_held_at_once():
    """900,000 words of one group take some 60 MB as strings and 4 MB as places; new words are scored in bounded steps."""
    counts = [(k, c, 5) for k, w in enumerate(["abc", "xyz"]) for c in [*map(L.gram_code, L.grams(w)), L.script_code("latin")]]
    model = L._model(["p", "q"], *(np.array(x) for x in zip(*counts)))
    column = L.pa.array([None, ("abc xyzab bcabc " * 2000).strip()] * 150, L.pa.string())
    draw = np.random.default_rng(2)
    words = ["".join(chr(97 + int(x)) for x in row) for row in draw.integers(0, 26, (60_000, 9))]
    L._verdicts(model, column.slice(0, 2))
    tracemalloc.start()
    got = [x[:2] for x in L._verdicts(model, column)]
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    model.words(words)
    scored = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == ("und", 0.0) and got[1] == ("p", 1.0) and got == got[:2] * 150
    assert held < 40_000_000 and scored < 40_000_000


def plain_predict(rows, text):
    """Language and score of a text, computed word by word from counts of the training rows (text, lang)."""
    import re
    import unicodedata

    def words(t):
        out, word = [], ""
        for c in t.lower() + " ":
            if re.match(r"[^\W\d_]", c) or word and (unicodedata.category(c)[0] == "M" or c in "‌‍"):
                word += c
            else:
                out += [word] * bool(word)
                word = ""
        return out

    langs = sorted({g for _, g in rows})
    counts = {n: {g: {} for g in langs} for n in (1, 2, 3)}
    scripts = {g: {} for g in langs}
    grams = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    for t, g in rows:
        for w in words(t):
            s = L.script(w)
            scripts[g][s] = scripts[g].get(s, 0) + 1
            for n in counts:
                for x in grams(w, n):
                    counts[n][g][x] = counts[n][g].get(x, 0) + 1
    kinds = {n: 1 + len({x for g in langs for x in counts[n][g]}) for n in counts}
    total = {(n, g): sum(counts[n][g].values()) for n in counts for g in langs}

    def score(w, g):
        seen = [h for h in langs if scripts[h].get(L.script(w), 0) >= L.SCRIPT_SHARE * max(1, sum(scripts[h].values()))]
        if not seen:
            return 0.0
        logs = [math.log((counts[n][g].get(x, 0) + 0.5) / (total[n, g] + 0.5 * kinds[n])) for n in counts for x in grams(w, n)]
        return sum(logs) / 3 + (0 if g in seen else L.FAR)

    best = {g: (0.0, []) for g in langs}
    for w in words(text):
        top = max(langs, key=lambda g: (best[g][0], [-ord(c) for c in g]))
        best = {g: max((best[g][0], best[g][1]), (best[top][0] - L.SWITCH, best[top][1]), key=lambda x: x[0]) for g in langs}
        best = {g: (v + score(w, g), [*path, (g, sum(map(str.isalpha, w)), any(L.script(w) in s for s in scripts.values()))]) for g, (v, path) in best.items()}
    _, path = max(best.values(), key=lambda x: x[0])
    letters = {g: sum(n for h, n, known in path if h == g and known) for g in langs}
    top = max(langs, key=lambda g: letters[g])
    return (top, letters[top] / sum(n for _, n, _ in path)) if path else ("und", 0.0)


def test_verdicts_equal_a_plain_version(spark):
    draw = random.Random(8)
    hindi = ["नमस्ते", "दुनिया", "किताब", "हिन्दी"]
    own = WORDS | {"hi": hindi, "ne": ["नेपाली", "किताब", "पानी"]}
    train = [(" ".join(draw.choices(own[g], k=draw.randint(2, 12))), g) for g in sorted(own) for _ in range(30)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(train)], "doc_id long, text string, lang string")
    model = L.fit(df)
    pool = [w for ws in own.values() for w in ws] + ["étale", "schnekvemo", "日本", "x²", "नम", "tala!", "7"]
    texts = [" ".join(draw.choices(pool, k=draw.randint(0, 25))) for _ in range(60)] + [" ".join(hindi * 3), "नमस्ते"]
    got = L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        lang, score = plain_predict(train, texts[r.doc_id])
        assert (r.lang_pred, round(r.score, 9)) == (lang, round(score, 9)), texts[r.doc_id]


def test_a_path_is_constant_only_where_it_is_best():
    model = L.Model(["x", "y", "z"])
    tool, draw, proved = L.Labeller(model), np.random.default_rng(5), 0
    for spread in (2, 9, 30):
        for _ in range(60):
            s = (draw.normal(0, spread, (int(draw.integers(1, 9)), 3)) + draw.choice([0, 8], 3)).astype(np.float32)
            path = tool._constant(s)
            if path is not None:
                proved += 1
                value = lambda p: sum(float(s[i, k]) for i, k in enumerate(p)) - L.SWITCH * sum(a != b for a, b in itertools.pairwise(p))  # noqa: E731, B023
                assert value(path) >= max(value(p) for p in itertools.product(range(3), repeat=len(s))) - 1e-4
                assert path.tolist() == tool._viterbi([s])[0].tolist()
    assert 40 < proved < 180


def test_unseen_scripts_score_nothing(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "日本語 中文"), (2, "tala 日本語日"), (3, "tala vemo")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(asked, L.fit(df)).collect()}
    assert got == {1: ("aa", 0.0), 2: ("aa", 0.5), 3: ("aa", 1.0)}


def test_marks_belong_to_words():
    assert L.words_of("नमस्ते दुनिया, ét́ a1b ́x") == ["नमस्ते", "दुनिया", "ét́", "a", "b", "x"]


def test_no_language_is_left_out(spark):
    # One large language and 210 rare ones of two texts each, in words of their own; one has a script of its own.
    draw = random.Random(12)
    rare = {f"l{k:03}": ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(4)] for k in range(210)} | {"qq": ["ༀཀཁ", "གངཅ"]}
    rows = [(" ".join(draw.choices(["tala", "vemo", "pirut"], k=30)), "big") for _ in range(300)] + [(" ".join(ws), g) for g, ws in rare.items() for _ in range(2)]
    df = spark.createDataFrame([(i, t, g, "z", 1) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, rate string, gram int")
    model = L.fit(df, features=40)
    assert model.languages == sorted({g for _, g in rows})
    asked = spark.createDataFrame([(g, " ".join(ws)) for g, ws in rare.items()], "doc_id string, text string")
    got = {r.doc_id: r.lang_pred for r in L.identify(asked, L.fit(df)).collect()}
    assert got == {g: g for g in rare}
    kept = L.with_known_language(spark.createDataFrame([(1, "tala", 5), (2, "--", 6), (2, "vemo", 7), (None, None, 8)], "doc_id long, text string, lang_pred long"), model)
    assert [tuple(r) for r in kept.collect()] == [(1, "tala", 5), (2, "vemo", 7)]


def test_a_model_of_200_languages_is_as_large_as_its_counts():
    """200 languages of 5,000 n-grams each, most of them in a few languages only; scores equal a dense sum."""
    draw, many, each = np.random.default_rng(4), 200, 5_000
    letters = np.array([L.gram_code(chr(97 + int(a)) + chr(97 + int(b)) + chr(97 + int(c))) for a, b, c in draw.integers(0, 26, (20_000, 3))])
    lang = np.repeat(np.arange(many), each)
    code = np.concatenate([draw.choice(np.unique(letters), each, replace=False) for _ in range(many)])
    n = draw.integers(1, 50, len(code))
    tracemalloc.start()
    model = L._model([f"l{k:03}" for k in range(many)], np.append(lang, range(many)), np.append(code, [L.script_code("latin")] * many), np.append(n, [9] * many))
    words = ["".join(chr(97 + int(x)) for x in draw.integers(0, 26, 9)) for _ in range(3_000)]
    got = model.words(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pickle.dumps(model)) < 30 * len(code) and peak < 400_000_000
    own = {(c, k): m for c, k, m in zip(code.tolist(), lang.tolist(), n.tolist())}
    total, kinds = np.bincount(lang, weights=n), 1 + len(set(code.tolist()))
    for w in (0, 7, 2_999):
        for k in (0, 50, 199):
            logs = [math.log((own.get((L.gram_code(g), k), 0) + 0.5) / ((total[k], 0)[len(g) < 3] + 0.5 * (kinds if len(g) == 3 else 1))) for g in L.grams(words[w])]
            assert got[w, k] == pytest.approx(sum(logs) / 3)


def test_ties_go_to_the_language_that_sorts_first(spark):
    rows = [(i, "tala vemo pirut", lang) for i, lang in enumerate(["zz", "mm", "zz", "mm"])]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = L.identify(spark.createDataFrame([(1, "tala vemo"), (2, "other words")], "doc_id long, text string"), model, spans=True).collect()
    assert [(r.lang_pred, r.score, [s.lang for s in r.spans]) for r in got] == [("mm", 1.0, ["mm"])] * 2
