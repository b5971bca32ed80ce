"""Pairwise ranking: held-out accuracy on the given labels, the learning step by hand, and the cases of the docstrings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import quality as Q

DIR = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"
GOOD, BAD = "The river runs slowly to the sea and takes some time.", "BUY!! NOW!! NOW!! NOW!! ### ### ###"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, f"{GOOD} {i}" if i % 2 else f"{BAD} {i}") for i in range(80)], DOCS)
    return Q.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(80)], LABELS))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    rows = Q.predict(docs, Q.fit(docs, labels)).join(labels, "doc_id").where("held_out and quality is not null").select("quality", "score", "predicted").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.99
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() >= 0.99


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"{GOOD} {i}" if i % 2 else f"{BAD} {i}") for i in range(80)], DOCS)
    right = spark.createDataFrame([(i, i % 2) for i in range(80)], LABELS)
    spoilt = right.withColumn("quality", F.when(Q.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, right), Q.fit(docs, spoilt)
    assert a.cut == b.cut and (a.weights == b.weights).all()


def test_learning_by_hand():
    good, bad = np.zeros((30, Q.N_FEATURES)), np.zeros((10, Q.N_FEATURES))
    good[:, 0], bad[:, 0] = np.linspace(2, 3, 30), np.linspace(0, 1, 10)
    model = Q.learn(good, bad, 0.25)
    raw = lambda v: model.raw(np.eye(1, Q.N_FEATURES)[0] * v)
    assert model.weights[0] > 0 and not model.weights[1:].any()
    # The cut lies halfway between the last bad and the first good score.
    assert model.cut == pytest.approx((raw(1) + raw(2)) / 2)
    assert model.score(np.eye(1, Q.N_FEATURES)[0] * 1.5) == pytest.approx(Q.THRESHOLD)
    # A loss of zero slope: the gradient of the penalised loss vanishes at the weights.
    many = 30 * Q.OPPONENTS
    first = np.arange(many)
    x = Q.scaled(good, model.mean, model.spread)[first % 30] - Q.scaled(bad, model.mean, model.spread)[(first % 30 + first // 30 * 7919) % 10]
    p = 1 / (1 + np.exp(-(x @ model.weights)))
    assert np.abs(x.T @ (p - 1) + Q.PENALTY * model.weights).max() < 1e-3


def test_odd_texts(spark, model):
    long_good, long_bad = " ".join(f"{GOOD} {i}" for i in range(20_000)), f"{BAD} " * 20_000
    rows = [(1, None), (2, ""), (3, GOOD), (4, BAD), (5, GOOD), (None, GOOD), (6, "\n \t"), (7, "日本語 текст"), (8, long_good), (9, long_bad), (3, GOOD)]
    got = Q.predict(spark.createDataFrame(rows, DOCS), model).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    assert found[1].score == found[2].score and found[3].score == found[5].score == found[None].score
    assert found[3].predicted == 1 and found[4].predicted == 0 == found[9].predicted
    assert not found[None].held_out and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert Q.predict(spark.createDataFrame([], DOCS), model).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, GOOD), (2, BAD)], DOCS)
    for labels in ([], [(1, 1)], [(None, 1), (2, None), (1, 5)]):
        model = Q.fit(docs, spark.createDataFrame(labels, LABELS))
        assert all(r.score == pytest.approx(Q.THRESHOLD) and r.predicted == 1 for r in Q.predict(docs, model).collect())
    assert Q.fit(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1), (2, 0)], LABELS)).cut == 0


def test_sample_is_bounded(spark):
    # One id that many documents share, and more labels than the sample takes.
    docs = spark.createDataFrame([(1, f"{GOOD} {i}") for i in range(300)] + [(i, BAD) for i in range(300, 400)], DOCS)
    labels = spark.createDataFrame([(1, 1)] * 5 + [(i, 0) for i in range(300, 400)], LABELS)
    assert Q.predict(docs, Q.fit(docs, labels, sample=20)).where("doc_id = 1 and predicted = 0").count() == 0


def test_clashing_columns(spark, model):
    df = spark.createDataFrame([(3, GOOD)], DOCS).select("*", *[F.lit("x").alias(n) for n in ("id", "h", "x", "quality", "held_out", "score")])
    labels = spark.createDataFrame([(3, 1)], LABELS).withColumn("text", F.lit("y"))
    assert by_id(Q.predict(df, model))[3].predicted == 1
    Q.fit(df, labels)


def test_every_label_is_learnt_from(spark, monkeypatch):
    # 2700 good documents and 2600 bad ones; the rows of one label that lie beyond 2500 count like the others.
    monkeypatch.setattr(Q, "CELL", 10_000)
    texts = {i: f"{GOOD} {i} {'word ' * (i % 40)}" if i % 53 < 27 else f"{BAD} {i} {'! ' * (i % 40)}" for i in range(7100)}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    labels = spark.createDataFrame([(i, int(i % 53 < 27)) for i in texts], LABELS)
    kept = [r.doc_id for r in labels.where(~Q.is_held_out(F.col("doc_id"))).collect()]
    side = {q: np.array([Q.features(texts[i].encode()) for i in kept if int(i % 53 < 27) == q], np.float32).astype(float) for q in (0, 1)}
    assert min(map(len, side.values())) > 2500
    model, want = Q.fit(docs, labels), Q.learn(side[1], side[0], len(side[0]) / len(kept))
    assert np.allclose(model.mean, want.mean, rtol=0, atol=1e-9) and np.allclose(model.spread, want.spread, rtol=0, atol=1e-9)
    raw = np.r_[model.raw(side[1]), model.raw(side[0])]
    assert (raw <= model.cut).sum() == len(side[0])


def test_cells_and_a_rare_label(spark, monkeypatch):
    # Three bad documents are copied to all of the cells; the model is the same to the bit however the tables lie.
    monkeypatch.setattr(Q, "CELL", 16)
    rows = [(i, f"{BAD} {i}" if i in (3, 100, 201) else f"{GOOD} {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i not in (3, 100, 201))) for i, _ in rows], LABELS)
    assert labels.where(~Q.is_held_out(F.col("doc_id")) & (F.col("quality") == 0)).count() > 0
    a, b = Q.fit(docs, labels), Q.fit(docs.union(docs.limit(50)).repartition(7), labels.repartition(5))
    assert a.cut == b.cut and (a.weights == b.weights).all() and (a.mean == b.mean).all()
    got = by_id(Q.predict(docs, a))
    assert [i for i, r in got.items() if not r.predicted] == [3, 100, 201]


def test_sums_over_pairs():
    rng = np.random.default_rng(5)
    for n_good, n_bad in ((30, 7), (7, 30), (5, 5), (1, 20)):
        good, bad, beta = rng.normal(size=(n_good, 6)), rng.normal(size=(n_bad, 6)), rng.normal(size=6)
        winners, losers = Q._opponents(n_good, n_bad)
        assert set(winners) == set(range(n_good)) and set(losers) == set(range(n_bad))
        x = good[winners] - bad[losers]
        p = 1 / (1 + np.exp(-(x @ beta)))
        loss, gradient, curve = Q._slopes(good, bad, beta)
        assert loss == pytest.approx(-np.log(p).sum()) and np.allclose(gradient, x.T @ (p - 1)) and np.allclose(curve, (x * (p * (1 - p))[:, None]).T @ x)


def test_a_step_too_far_is_halved():
    # log cosh is flat away from its lowest point, so that full steps from 2 run away to both sides.
    def slopes(beta):
        x = beta[0] - 2
        curve = np.zeros((Q.N_FEATURES, Q.N_FEATURES))
        curve[0, 0] = 1000 / np.cosh(x) ** 2
        return 1000 * np.log(np.cosh(x)), np.eye(1, Q.N_FEATURES)[0] * 1000 * np.tanh(x), curve

    beta = Q._newton(slopes)
    assert abs(1000 * np.tanh(beta[0] - 2) + Q.PENALTY * beta[0]) < 1e-2 and not beta[1:].any()


def test_cut_is_the_exact_quantile(spark, monkeypatch):
    monkeypatch.setattr(Q, "BINS", 4)
    rng = np.random.default_rng(6)
    # Some scores are equal, one lies far off.
    for raw in (np.round(rng.normal(size=200), 1), rng.normal(size=200), np.zeros(9), np.r_[rng.normal(size=50), 1e9]):
        good = rng.random(len(raw)) < 0.7
        good[:2] = True, False
        table = spark.createDataFrame(list(zip(raw.tolist(), good.tolist(), strict=True)), "raw double, good boolean")
        for share in (0.05, 0.3, 0.9):
            weight = share / (~good).sum(), (1 - share) / good.sum()
            order = np.lexsort((~good, raw))
            at = int(np.searchsorted(np.cumsum(np.where(good, weight[1], weight[0])[order]), share - 1e-9))
            assert Q._cut(table, weight, share) == (raw[order[at]] + raw[order[min(at + 1, len(raw) - 1)]]) / 2
