"""Problems fitted together, weight searches, votes of pairs, class vectors and
explanations, against plain arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.operators import classifiers as cf
from inkprint.operators import ensemble as en
from inkprint.operators import explain as ex
from inkprint.operators import solvers as so
from inkprint.runtime import persisted


def frame_of(spark, x, label, fold):
    rows = [(int(a), int(b), [float(v) for v in c]) for a, b, c in zip(label, fold, x)]
    return spark.createDataFrame(rows, "label bigint, fold bigint, features array<double>").repartition(3)


def test_quadratics_are_minimised_together():
    draw = np.random.default_rng(0)
    made = [draw.normal(size=(6, 6)) for _ in range(5)]
    a = [m @ m.T + 0.1 * np.eye(6) for m in made]
    b = draw.normal(size=(5, 6))

    def evaluate(points, active):
        loss = np.array([p @ m @ p / 2 - p @ v for p, m, v in zip(points, a, b)])
        return loss, np.array([m @ p - v for p, m, v in zip(points, a, b)])

    found, used = so.minimise_together(evaluate, np.zeros((5, 6)), 500, 1e-10)
    assert np.allclose(found, [np.linalg.solve(m, v) for m, v in zip(a, b)], atol=1e-5) and used.max() < 500
    assert so.minimise_together(evaluate, np.zeros((5, 6)), 3)[1].max() == 3


def test_folds_trained_together_have_no_gradient_left(spark):
    draw = np.random.default_rng(1)
    x, fold = draw.normal(size=(200, 4)), draw.integers(0, 3, 200)
    label = (x[:, 0] + 0.5 * draw.normal(size=200) > 0).astype(int) + (x[:, 1] > 1)
    found = so.fit_softmax_folds(frame_of(spark, x, label, fold), 3, 3, iterations=500)
    wide = np.hstack([x, np.ones((200, 1))])
    for k in range(4):
        mine = fold != k
        p = np.exp(wide[mine] @ found[k])
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(mine.sum()), label[mine]] -= 1
        penal = found[k].copy()
        penal[-1] = 0
        assert np.abs(wide[mine].T @ p + penal).max() < 1e-2
    assert not np.allclose(found[0], found[3])
    assert so.fit_softmax_folds(frame_of(spark, x[:0], label[:0], fold[:0]), 3, 2).shape[0] == 3


def test_machines_of_pairs_see_their_two_classes_only(spark):
    draw = np.random.default_rng(2)
    centres = np.array([[0, 0], [3, 0], [0, 3], [3, 3]])
    label = draw.integers(0, 4, 240)
    x = centres[label] + draw.normal(size=(240, 2))
    found = so.fit_pairs(frame_of(spark, x, label, label * 0), 4)
    wide = np.hstack([x, np.ones((240, 1))])
    for k, (a, b) in enumerate(so.class_pairs(4)):
        mine = (label == a) | (label == b)
        sign = np.where(label[mine] == a, 1.0, -1.0)
        short = np.maximum(0, 1 - (wide[mine] @ found[k]) * sign)
        penal = found[k].copy()
        penal[-1] = 0
        assert np.abs(-2 * (short * sign) @ wide[mine] + penal).max() < 1e-1
    assert (so.pair_votes(wide @ found.T, 4) == label).mean() > 0.8


def test_votes_of_pairs(spark):
    decisions = np.array([[1, 1, 1], [-1, 1, 1], [1, -1, 1], [-1, -1, -1], [0, 0, 0]], dtype=float)
    want = []
    for row in decisions:
        votes = [0, 0, 0]
        for (a, b), d in zip([(0, 1), (0, 2), (1, 2)], row):
            votes[a if d > 0 else b] += 1
        want.append(votes.index(max(votes)))
    assert so.pair_votes(decisions, 3).tolist() == want == [0, 1, 0, 2, 2]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(decisions)], "i int, d array<double>")
    assert [r.v for r in rows.select("i", cf.vote_of_pairs(F.col("d"), 3).alias("v")).orderBy("i").collect()] == want


def test_support_vector_machines_learn_a_ring(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 2))
    label = np.digitize((x**2).sum(axis=1), [0.6, 2.0]) * 5 + 2  # labels need not be 0, 1, 2
    rows = [(i, int(label[i]), [float(v) for v in x[i]]) for i in range(600)]
    frame = spark.createDataFrame(rows, "pid bigint, label bigint, features array<double>")
    predict = cf.fit_svm(frame.filter("pid < 400"), 2)
    got = {r.pid: r.uid_pred for r in predict(frame.filter("pid >= 400").select("pid", "features")).collect()}
    assert len(got) == 200 and np.mean([got[i] == label[i] for i in got]) > 0.9
    one = cf.fit_svm(frame.filter("label = 7"), 2)
    assert {r.uid_pred for r in one(frame.select("pid", "features")).collect()} == {7}


def scores(spark, n, m, classes, seed):
    draw = np.random.default_rng(seed)
    rows = [(k, p, p % classes, [float(v) for v in draw.random(classes) + 0.25 * k * (np.arange(classes) == p % classes)]) for p in range(n) for k in range(m)]
    return spark.createDataFrame(rows, "model bigint, pid bigint, uid bigint, probs array<double>")


@pytest.mark.parametrize("search", [en.weight_search, en.line_search_weights])
def test_searches_are_never_worse_than_where_they_begin(spark, search):
    frame = persisted(scores(spark, 90, 3, 4, 5))
    weights, share = search(frame, [0, 1, 2])
    assert sum(weights.values()) == pytest.approx(1) and min(weights.values()) >= 0
    assert en.objective(frame, weights).first().loss == pytest.approx(1 - share)
    rows = en.stacked(frame, [0, 1, 2])
    begin = [[1.0, 1.0, 1.0]] if search is en.line_search_weights else en.simplex_grid(3, 5) + [[1.0, 1.0, 1.0]]
    assert share * 90 >= en.best_candidate(en.score_candidates(rows, begin)).first().correct - 1e-9
    assert search(frame, [0, 1, 2]) == (weights, share)


def test_stacking_predicts_each_fold_by_the_others(spark):
    frame = persisted(scores(spark, 200, 3, 4, 6))
    found = en.stacking_cv(frame, [0, 1, 2]).collect()
    assert sorted(r.fold for r in found) == list(range(5)) and sum(r.total for r in found) == 200
    assert sum(r.correct for r in found) / 200 > 0.5
    last = en.stacking_final(frame.filter("pid < 100"), frame.filter("pid >= 100"), [0, 1, 2]).collect()
    assert len(last) == 100 and np.mean([r.uid_pred == r.pid % 4 for r in last]) > 0.5


def test_class_vectors_give_the_same_scores_for_many_classes(spark):
    draw = np.random.default_rng(7)
    labels = [0, 3, 31, 32, 70, 71]
    docs = [(i, labels[i % 6]) for i in range(30)]
    cells = [(i, int(j), float(draw.integers(1, 4))) for i in range(40) for j in draw.choice(12, 3, replace=False)]
    frame = spark.createDataFrame(cells, "pid bigint, idx bigint, value double")
    known = spark.createDataFrame(docs, "pid bigint, label bigint")
    queries = spark.createDataFrame([(i,) for i in range(30, 42)], "pid bigint")
    classes, weights = cf.fit_multinomial_nb(frame.filter("pid < 30"), known, 12)
    own = frame.filter("pid >= 30")
    got = {(r.pid, r.label): r.score for r in cf.nb_scores(queries, own, classes, weights).collect()}
    assert len(got) == 12 * 6
    n = {c: np.zeros(12) for c in labels}
    for i, j, v in cells:
        if i < 30:
            n[labels[i % 6]][j] += v
    for p in range(30, 42):
        x = np.zeros(12)
        for i, j, v in cells:
            x[j] += v if i == p else 0
        for c in labels:
            assert got[p, c] == pytest.approx(np.log(5 / 30) + (x * np.log((n[c] + 1) / (n[c].sum() + 12))).sum())
    best = cf.nb_best(cf.nb_blocks(queries, own, classes, cf.class_postings(weights)))
    want = {r.pid: r.uid_pred for r in cf.best_label(cf.nb_scores(queries, own, classes, weights)).collect()}
    assert {r.pid: r.uid_pred for r in best.collect()} == want
    p = cf.probabilities(cf.nb_scores(queries, own, classes, weights)).groupBy("pid").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in p)


def test_explanation_solves_the_weighted_ridge(spark):
    draw = np.random.default_rng(8)
    held = draw.random((40, 9)) < 0.4
    held[0] = [1, 0, 1, 0, 1, 0, 1, 0, 1]
    cells = spark.createDataFrame([(i, j, 1.0) for i in range(40) for j in range(9) if held[i, j]], "pid bigint, idx bigint, value double")
    docs = spark.createDataFrame([(i,) for i in range(40)], "pid bigint")
    vocabulary = spark.createDataFrame([(f"g{j}", j) for j in range(9)], "gram string, idx bigint")
    slopes = spark.createDataFrame([(j, float(j - 3) / 20) for j in range(9)], "idx bigint, slope double")

    def scorer(samples, own):
        score = samples.join(own.join(slopes, "idx").groupBy("pid").agg(F.sum("slope").alias("s")), "pid", "left")
        p = 0.5 + F.coalesce("s", F.lit(0.0))
        return score.select("pid", F.explode(F.array(F.struct(F.lit(0).alias("label"), (1 - p).alias("p")), F.struct(F.lit(1).alias("label"), p.alias("p"))))).select("pid", "col.*")

    found = ex.local_explanation(cells, docs, vocabulary, 0, scorer, labels=[1, 0], samples=500, top=4).collect()
    drawn = ex.perturbations(cells, docs, vocabulary, 0, 500).collect()
    present = np.zeros((500, 9))
    for r in drawn:
        present[r.pid, r.idx] = r.present
    assert (present[0] == held[0]).all() and np.abs(present[1:].mean(axis=0) - held.mean(axis=0)).max() < 0.1
    same = (present == held[0]).astype(float)
    w = np.exp(-(1 - same).sum(axis=1) / (2 * 0.75**2 * 9))
    for label, sign in ((1, 1.0), (0, -1.0)):
        y = 0.5 + sign * (present @ ((np.arange(9) - 3) / 20))

        def fit(columns, alpha):
            a, b = same[:, columns], y
            am, bm = (w @ a) / w.sum(), (w @ b) / w.sum()
            return np.linalg.solve((a - am).T @ ((a - am) * w[:, None]) + alpha * np.eye(len(columns)), (a - am).T @ (w * (b - bm)))

        chosen = sorted(np.argsort(-np.abs(fit(np.arange(9), 0.01)), kind="stable")[:4])
        want = dict(zip(chosen, fit(chosen, 1.0)))
        mine = [r for r in found if r.label == label]
        assert {r.idx: pytest.approx(r.weight, abs=1e-9) for r in mine} == want
        assert [abs(r.weight) for r in sorted(mine, key=lambda r: r.rank)] == sorted((abs(r.weight) for r in mine), reverse=True)
        assert {r.idx: r.gram for r in mine} == {j: f"g{j}" for j in chosen}
    likely = ex.local_explanation(cells, docs, vocabulary, 0, scorer, samples=200, top=2).collect()
    own = 0.5 + held[0] @ ((np.arange(9) - 3) / 20)
    assert {r.label for r in likely} == {int(own > 0.5)}
