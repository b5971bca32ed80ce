import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from tallyfield.llm import katz as K


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


class Plain:
    """The model by dictionaries, token by token."""

    def __init__(self, docs):
        train = [tokens(t) for i, t in docs if not held(i)]
        self.one = Counter(w for d in train for w in d)
        self.two = Counter(x for d in train for x in zip(["<s>", *d], d))
        self.past = Counter()
        for (h, _), n in self.two.items():
            self.past[h] += n
        self.total = sum(self.one.values())
        of = lambda c: K.discounts([sum(n == r for n in c.values()) for r in range(1, 7)])
        self.d1, self.d2 = of(self.one), of(self.two)
        self.norm, self.unseen = self._mass(self.one, self.total, self.d1)
        self.words = {}
        for h, w in self.two:
            self.words.setdefault(h, set()).add(w)

    @staticmethod
    def _mass(counts, total, d):
        loose = sum((1 - d[n]) * n for n in counts.values() if n <= 5)
        norm = total if loose > 0 else total + 1
        return norm, (norm - total + loose) / norm

    @staticmethod
    def cut(n, d):
        return n * (d[n] if n <= 5 else 1)

    def p1(self, w):
        return self.cut(self.one[w], self.d1) / self.norm if self.one[w] else self.unseen

    def p2(self, h, w):
        if not self.past[h]:
            return self.p1(w)
        norm, loose = self._mass({x: self.two[h, x] for x in self.words[h]}, self.past[h], self.d2)
        if self.two[h, w]:
            return self.cut(self.two[h, w], self.d2) / norm
        return loose / (1 - sum(self.p1(x) for x in self.words[h])) * self.p1(w)

    def row(self, i, text):
        t = tokens(text)
        base = sum(math.log10((self.one[w] + 0.1) / (self.total + 0.1 * (len(self.one) + 1))) for w in t)
        score = sum(math.log10(self.p2(h, w)) for h, w in zip(["<s>", *t], t))
        return (i, held(i), len(t), sum(self.one[w] > 0 for w in t), self.total, base, score)


def corpus(n=260):
    draw = random.Random(12)
    names = [f"w{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(draw.choices(names, weight, k=draw.randint(1, 40)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "É W1 w1 x\tnew"), (n + 3, "w1 " * 20_000), (None, "w2 w3"), (3, docs[3][1])]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g.score == pytest.approx(w[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("chunk, buckets", [(K.CHUNK, 3), (2_000, 29)])
def test_scores_match_the_plain_model(spark, monkeypatch, chunk, buckets):
    monkeypatch.setattr(K, "CHUNK", chunk)
    docs = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, held string").repartition(3)
    model = Plain(docs)
    same(K.score(df, least_buckets=buckets).collect(), [model.row(*d) for d in docs])


def test_plain_model_is_normalised():
    model = Plain(corpus())
    for h in ["<s>", "w1", "w0", "w399", "never"]:
        assert sum(model.p2(h, w) for w in [*model.one, "never seen"]) == pytest.approx(1)


def test_held_out_beats_base(spark):
    got = K.score(spark.createDataFrame(corpus(), "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_few_words(spark):
    for docs in ([(1, "a a a a a a a a a a a a")] * 3, [(1, "x"), (2, None)], [(i, "b b") for i in range(40) if held(i)]):
        model = Plain(docs)
        got = K.score(spark.createDataFrame(docs, "doc_id long, text string"), least_buckets=2).collect()
        if model.total:
            same(got, [model.row(*d) for d in docs])
        else:
            assert all(r.score == 0 and r.base_score == 0 for r in got) and len(got) == len(docs)
    assert K.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pack():
    a, b = np.arange(70_000), np.array([], int)
    assert [x.tolist() for x in K.unpack(K.pack(a, b, a * 40_000))] == [a.tolist(), [], (a * 40_000).tolist()]


def test_stored_model_scores_texts_token_by_token(spark, tmp_path):
    docs = corpus()
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, h long, word long")
    path = f"{tmp_path}/model"
    K.save(df, path, share_bytes=4000, least_buckets=3)
    plain = Plain(docs)
    counts = spark.read.parquet(f"{path}/pairs")
    assert {"bucket", "h", "w", "n"} == set(counts.columns) and sorted(r.n for r in counts.collect()) == sorted(plain.two.values())
    words = {r.word: r.n for r in spark.read.parquet(f"{path}/words").collect()}
    assert words == {w or "": n for w, n in plain.one.items()}
    weights = {r.h: (r.norm, r.log_alpha) for r in spark.read.parquet(f"{path}/histories").collect()}
    ids = {r.word: r.id for r in spark.read.parquet(f"{path}/words").collect()} | {"<s>": K.START}
    for h in ("<s>", "w1", "w399"):
        norm, loose = plain._mass({x: plain.two[h, x] for x in plain.words[h]}, plain.past[h], plain.d2)
        assert weights[ids[h]] == pytest.approx((norm, math.log10(loose / (1 - sum(plain.p1(x) for x in plain.words[h])))))
    with pytest.raises(AnalysisException):
        K.save(df, path, share_bytes=4000, least_buckets=3)
    asked = docs + [(1000, "never seen words at all"), (1001, "w1 never w2"), (1002, "ß W3")]
    got = K.evaluate(spark.createDataFrame([(*d, "x") for d in asked], "doc_id long, text string, n string"), path).collect()
    want = [plain.row(*d) for d in asked]
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=str), sorted(((w[0], w[2], w[3], w[5], w[6]) for w in want), key=str)):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9, abs=1e-9), (g, w)
    assert K.evaluate(df.limit(0).select("doc_id", "text"), path).count() == 0
    K.save(df.limit(0), f"{path}-none")
    lone = K.evaluate(spark.createDataFrame([(1, "a")], "doc_id long, text string"), f"{path}-none").first()
    assert (lone.n_tokens, lone.n_known, lone.score) == (2, 0, 0.0)
