"""Profiles, classifiers, ensembles and helpers against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.functions import tokens as tk
from inkprint.operators import analysis as an
from inkprint.operators import classifiers as cf
from inkprint.operators import ensemble as en
from inkprint.operators import profiles as pr
from inkprint.operators.grams import with_tokens
from inkprint.plans.corpus import table
from inkprint.runtime import persisted, ranked, running_sums


def brute(train, queries, n, length):
    """Plain rules: [(pid, uid, code)] -> {pid: uid}."""
    grams = lambda t: [t[i : i + n] for i in range(len(t) - n + 1)]
    profiles = {}
    for _, uid, code in sorted(train):
        profiles.setdefault(uid, Counter()).update(grams(code))
    kept = {}
    for uid, counts in profiles.items():
        order = sorted(counts, key=counts.get, reverse=True)
        kept[uid] = set(order[:length]) if length >= 0 else {g for g in order if length < -1 or counts[g] > 1}
    return {pid: max(kept, key=lambda u: len(set(grams(code)) & kept[u])) if kept else -1 for pid, _, code in queries}


def attribute(spark, train, queries, n, length, sent=pr.SENT_ENTRIES):
    schema = "pid bigint, uid bigint, code string"
    left = with_tokens(spark.createDataFrame(train, schema), tk.char_ngrams(F.col("code"), n))
    right = with_tokens(spark.createDataFrame(queries, schema), tk.char_ngrams(F.col("code"), n))
    fitted = persisted(pr.postings(pr.trim_profiles(pr.author_profiles(left), length)))
    found = pr.attribute(right, fitted, pr.author_order(left), sent)
    return {r["pid"]: r["uid_pred"] for r in found.collect()}


@pytest.mark.parametrize("length", [-2, -1, 0, 5])
@pytest.mark.parametrize("n", [1, 3])
def test_attribution_is_exact(spark, n, length):
    draw = random.Random(n * 10 + length)
    text = lambda: "".join(draw.choice("abc ") for _ in range(draw.randrange(0, 25)))
    train = [(pid, draw.randrange(4), text()) for pid in range(5, 35)]
    queries = [(pid, 0, text()) for pid in range(100, 140)] + [(200, 0, ""), (201, 0, "zzzz")]
    assert attribute(spark, train, queries, n, length) == brute(train, queries, n, length)


def test_ties_and_no_overlap_go_to_the_first_author(spark):
    train = [(9, 1, "abab"), (3, 2, "abab"), (5, 3, "zz")]
    assert attribute(spark, train, [(50, 0, "ab"), (51, 0, "q")], 2, 10) == {50: 2, 51: 2}


@pytest.mark.parametrize("n, length, correct", [(3, 50, 72), (3, 500, 186), (6, 2000, 188), (6, -1, 221)])
def test_short_programs_give_the_known_number_of_hits(spark, n, length, correct):
    """The short program text of the fixtures, 240 dev files of 20 authors."""
    nl = "char(10)"
    words = "concat(split(regexp_replace(text, '[^A-Za-z ]', ''), ' '), array('a', 'a', 'a'))"
    rows = table(spark, "/root/testdata/sf0.01", "documents").selectExpr(
        "doc_id AS pid", "doc_id % 20 AS uid", "n_chars AS n", f"{nl} AS nl", f"{words} AS w",
        "CASE WHEN floor(doc_id / 20) % 4 < 2 THEN 'train' WHEN floor(doc_id / 20) % 4 = 2 THEN 'dev' ELSE 'test' END AS split",
    ).selectExpr(
        "*", "repeat(' ', CAST(uid % 4 + 1 AS INT)) AS ind",
        "CASE WHEN uid % 2 = 0 THEN concat(' {', nl) ELSE concat(nl, '{', nl) END AS brace",
        "CASE WHEN uid % 7 < 3 THEN ' ' ELSE '' END AS sp",
        "concat(CASE WHEN uid % 6 = 0 THEN 'my_' WHEN uid % 6 = 1 THEN 'N' ELSE 'x' END, CAST(n % 97 AS STRING)) AS v",
    ).selectExpr(
        "pid", "uid", "split",
        """concat('#include <bits/stdc++.h>', nl, 'using namespace std;', nl,
        CASE WHEN uid % 3 = 0 THEN concat('#define pb(x) push_back(x)', nl) WHEN uid % 3 = 1 THEN concat('// ', w[0], nl) ELSE nl END,
        'int main()', brace, ind, 'int ', v, ' = ', n, ';', nl,
        ind, 'for (int i', sp, '=', sp, '0; i', sp, '<', sp, v, '; i++)', brace,
        CASE WHEN uid % 5 < 2 THEN concat(ind, ind, v, ' += a[i][0];') ELSE concat(ind, ind, v, ' = ', v, ' + i;') END, nl,
        ind, '}', nl, CASE WHEN uid % 4 = 0 THEN concat('/* ', w[1], ' */', nl) ELSE '' END,
        ind, 'cout << "', w[2], '" << ', v, ';', nl, ind, 'return 0;', nl, '}', nl) AS code""",
    )
    tokens = with_tokens(rows, tk.char_ngrams(F.col("code"), n))
    train, dev = tokens.filter("split = 'train'"), tokens.filter("split = 'dev'")
    fitted = persisted(pr.postings(pr.trim_profiles(pr.author_profiles(train), length)))
    found = pr.accuracy(pr.attribute(dev, fitted, pr.author_order(train))).first()
    assert (found["total"], found["correct"]) == (240, correct)


def test_one_author_with_a_third_of_everything(spark):
    draw = random.Random(4)
    text = lambda: "".join(draw.choice("abcdefgh") for _ in range(30))
    train = [(p, 0 if p % 3 == 0 else p % 7 + 1, text()) for p in range(120)]
    queries = [(1000 + p, 0, text()) for p in range(30)]
    assert attribute(spark, train, queries, 2, 20) == brute(train, queries, 2, 20)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_too_large_to_send_are_joined_by_a_shuffle(spark, monkeypatch):
    """Several parts of authors, terms in most documents dealt over several tasks, nothing sent but those terms."""
    monkeypatch.setattr(pr, "AUTHORS", 2)
    draw = random.Random(8)
    text = lambda: "".join(draw.choice("abcd") for _ in range(20))
    train = [(p, p % 5, text()) for p in range(40)]
    queries = [(100 + p, 0, text()) for p in range(3000)]
    assert attribute(spark, train, queries, 2, 8, sent=0) == brute(train, queries, 2, 8)
    schema = "pid bigint, uid bigint, code string"
    docs = [with_tokens(spark.createDataFrame(x, schema), tk.char_ngrams(F.col("code"), 2)) for x in (train, queries)]
    inverted = persisted(pr.postings(pr.author_profiles(docs[0])))
    assert max(r.n for r in inverted.select(F.size("authors").alias("n")).collect()) <= 2
    copies = [r.copies for r in pr.hot_terms(docs[1], 8).collect()]
    assert copies and max(copies) > 1
    sent, shuffled = plan(pr.overlaps(docs[1], inverted)), plan(pr.overlaps(docs[1], inverted, sent=0))
    assert "SortMergeJoin" in shuffled and "SortMergeJoin" not in sent
    assert "BuildLeft" not in sent and "BuildLeft" not in shuffled


def test_an_author_with_nearly_all_terms_is_ranked_in_parts(spark):
    terms = [(1, f"g{i}", 1 + i % 50, i) for i in range(3000)] + [(2, "a", 1, 1)]
    frame = spark.createDataFrame(terms, "uid bigint, gram string, cnt bigint, first bigint")
    got = {(r.uid, r.gram): r.rnk for r in pr.rank_profiles(frame, 40, parts=7).collect()}
    order = sorted(terms[:-1], key=lambda t: (-t[2], t[3]))
    assert got == {**{(1, t[1]): i + 1 for i, t in enumerate(order[:40])}, (2, "a"): 1}


def test_sweep_agrees_with_single_runs(spark):
    draw = random.Random(3)
    text = lambda: "".join(draw.choice("abc") for _ in range(draw.randrange(1, 25)))
    train = [(p, p % 4, text()) for p in range(40)]
    queries = [(100 + p, p % 4, text()) for p in range(30)] + [(200, 1, ""), (201, 2, "zz")]
    schema = "pid bigint, uid bigint, code string"
    both = F.concat(tk.char_ngrams(F.col("code"), 2), tk.char_ngrams(F.col("code"), 3))
    sides = [with_tokens(spark.createDataFrame(x, schema), both) for x in (train, queries)]
    for sent in (pr.SENT_ENTRIES, 0):
        found = pr.sweep(*sides, [2, 3], [0, 4, 9, -1, -2], keep=persisted, sent=sent)
        for r in found.collect():
            want = brute(train, queries, r.n, r.length)
            assert (r.total, r.correct) == (32, sum(want[pid] == uid for pid, uid, _ in queries)), (r.n, r.length)


def test_ranks_and_prefix_sums(spark):
    draw = random.Random(1)
    data = [(i, draw.randrange(50), "h" if i % 3 else draw.choice("xyz")) for i in range(500)]
    rows = spark.createDataFrame(data, "id bigint, v bigint, g string").repartition(7)
    got = {r["id"]: r["rank"] for r in ranked(rows, [F.desc("v"), F.asc("id")]).collect()}
    want = {d[0]: i for i, d in enumerate(sorted(data, key=lambda d: (-d[1], d[0])))}
    assert got == want
    got = {r["id"]: r["rank"] for r in ranked(rows, [F.col("v"), F.col("id")], ("g",)).collect()}
    for g in {d[2] for d in data}:
        for i, d in enumerate(sorted((d for d in data if d[2] == g), key=lambda d: (d[1], d[0]))):
            assert got[d[0]] == i
    steps = spark.createDataFrame([(i, i % 5) for i in range(100)], "step bigint, n bigint")
    sums = {r["step"]: r["run_n"] for r in running_sums(steps, "step", ["n"], chunk=8).collect()}
    assert sums == {i: sum(j % 5 for j in range(i + 1)) for i in range(100)}


def test_nearest_neighbours_over_many_blocks(spark):
    draw = np.random.default_rng(0)
    x = np.round(draw.random((60, 6)) * (draw.random((60, 6)) < 0.5), 1)
    cells = [(i, j, float(x[i, j])) for i in range(60) for j in range(6) if x[i, j]]
    frame = spark.createDataFrame(cells, "pid bigint, idx bigint, value double")
    train = spark.createDataFrame([(i, i % 4) for i in range(40)], "pid bigint, label bigint")
    queries = spark.createDataFrame([(i,) for i in range(40, 60)], "pid bigint")
    near = cf.neighbours(frame, train, frame, queries, k=5, block=7)
    got = {}
    for r in near.collect():
        got.setdefault(r["pid"], set()).add(r["neighbour"])
    for q in range(40, 60):
        d2 = [(round(float(((x[q] - x[t]) ** 2).sum()), 9), t) for t in range(40)]
        assert got[q] == {t for _, t in sorted(d2)[:5]}
    votes = {r["pid"]: r["uid_pred"] for r in cf.vote(near).collect()}
    for q, found in got.items():
        tally = Counter(t % 4 for t in found)
        assert votes[q] == min(tally, key=lambda label: (-tally[label], label))


def test_naive_bayes_closed_form(spark):
    cells = [(0, 0, 2.0), (0, 1, 1.0), (1, 1, 3.0), (2, 2, 1.0), (9, 0, 1.0), (9, 2, 2.0)]
    frame = spark.createDataFrame(cells, "pid bigint, idx bigint, value double")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "pid bigint, label bigint")
    queries = spark.createDataFrame([(9,), (10,)], "pid bigint")
    classes, weights = cf.fit_multinomial_nb(frame.filter("pid < 3"), labels, 3)
    got = {(r["pid"], r["label"]): r["score"] for r in cf.nb_scores(queries, frame.filter("pid = 9"), classes, weights).collect()}
    mass, seen = {0: 3, 1: 4}, {(0, 0): 2, (0, 1): 1, (1, 1): 3, (1, 2): 1}
    for c, prior in ((0, 1 / 3), (1, 2 / 3)):
        theta = lambda j: math.log((seen.get((c, j), 0) + 1) / (mass[c] + 3))  # noqa: E731, B023
        assert got[9, c] == pytest.approx(math.log(prior) + theta(0) + 2 * theta(2))
        assert got[10, c] == pytest.approx(math.log(prior))
    best = {r["pid"]: r["uid_pred"] for r in cf.best_label(cf.nb_scores(queries, frame.filter("pid = 9"), classes, weights)).collect()}
    assert best[10] == 1


def scores(spark, rows):
    return spark.createDataFrame(rows, "model bigint, pid bigint, uid bigint, probs array<double>")


def test_ensemble(spark):
    draw = np.random.default_rng(3)
    rows = [(m, p, p % 3, [float(v) for v in draw.random(3)]) for p in range(30) for m in (0, 1)]
    frame = scores(spark, rows)
    by = {(m, p): np.array(v) for m, p, _, v in rows}
    got = {r["pid"]: r["uid_pred"] for r in en.weighted_average(frame, {0: 0.3, 1: 0.7}).collect()}
    assert got == {p: int((by[0, p] * 0.3 + by[1, p] * 0.7).argmax()) for p in range(30)}
    scaled = {r["pid"]: r["uid_pred"] for r in en.weighted_average(frame, {0: 3.0, 1: 7.0}).collect()}
    assert scaled == got
    weights, share = en.weight_search(frame, [0, 1], generations=5)
    assert sum(weights.values()) == pytest.approx(1)
    assert share >= max(r["accuracy"] for r in en.model_accuracy(frame).collect())
    assert en.objective(frame, weights).first()["loss"] == pytest.approx(1 - share)
    with pytest.raises(ValueError):
        en.select_models(frame, [])
    soft = frame.select(en.softmax(F.col("probs")).alias("s")).collect()
    assert all(sum(r["s"]) == pytest.approx(1) for r in soft)


def test_argmax_takes_the_first_maximum(spark):
    rows = spark.createDataFrame([([0.1, 0.5, 0.5],)], "p array<double>")
    assert rows.select(cf.argmax(F.col("p"))).first()[0] == 1


def test_stratified_folds(spark):
    labels = [(i, [5, 1, 1, 9][i % 4]) for i in range(43)]
    got = {r["pid"]: r["fold"] for r in en.stratified_folds(spark.createDataFrame(labels, "pid bigint, uid bigint"), 5).collect()}
    order = list(dict.fromkeys(u for _, u in labels))
    sorted_y = sorted(order.index(u) for _, u in labels)
    shares = [Counter(sorted_y[i::5]) for i in range(5)]
    for k, uid in enumerate(order):
        want = [i for i in range(5) for _ in range(shares[i][k])]
        assert [got[p] for p, u in labels if u == uid] == want


def test_error_analysis(spark):
    perfect = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "pid bigint, uid bigint, uid_pred bigint")
    assert an.error_summary(perfect).first().asDict() == {"correct": 6, "incorrect": 0, "accuracy": 1.0}
    assert an.top_error_authors(an.per_author(perfect, False)).count() == 0
    failed = perfect.withColumn("uid_pred", F.lit(7))
    summary = an.error_summary(failed).first()
    assert (summary["correct"], summary["incorrect"]) == (0, 6)
    top = an.top_error_authors(an.per_author(failed, False)).collect()
    assert [tuple(r) for r in top] == [(0, 3), (1, 3)]
    two = an.authors_with_errors(an.per_author(failed.filter("pid <> 1 AND pid <> 3"), False)).first()
    assert (two["at_least_one"], two["at_least_two"]) == (2, 1)
    gold = perfect.select("pid", "uid").filter("pid < 5")
    report = an.score_files(gold, failed.select("pid", "uid_pred").filter("pid > 0")).first()
    assert (report["matched"], report["missing"], report["unexpected"], report["correct"]) == (4, 1, 1, 0)
