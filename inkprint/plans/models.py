"""Classifiers, ensembles and error analysis over the whole collections."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions import style as st
from inkprint.functions import tokens as tk
from inkprint.operators import analysis as an
from inkprint.operators import classifiers as cf
from inkprint.operators import ensemble as en
from inkprint.operators import grams as gr
from inkprint.operators import vectors as ve
from inkprint.operators import vocabulary as vo
from inkprint.plans.corpus import (
    CODE_SQL,
    DOCS_SQL,
    SCORES_SQL,
    code,
    docs,
    grams_sql,
    model_scores,
    table,
    tokens_sql,
    with_sql,
)
from inkprint.plans.features import ALPHA_SQL, COLLAPSED_SQL, WORDS_SQL, _array_cells, tfidf_sql, train_part, vocab_sql
from inkprint.plans.registry import query
from inkprint.plans.text import _SEQ, _printable_sql, tree_docs
from inkprint.runtime import persisted, scratch_dir
from inkprint.sources import files as fs

# ------------------------------------------------------------------ neighbours

_KNN = with_sql(
    CODE_SQL,
    tokens_sql("code", WORDS_SQL),
    tfidf_sql(10000, "code", True),
    """sq AS (SELECT c.pid, c.uid, c.split, coalesce(sum(value * value), 0) AS s FROM code c LEFT JOIN vec v ON v.pid = c.pid GROUP BY ALL),
dots AS (SELECT q.pid, t.pid AS neighbour, sum(q.value * t.value) AS dot FROM vec q JOIN vec t ON q.idx = t.idx
  WHERE q.pid IN (SELECT pid FROM code WHERE split <> 'train') AND t.pid IN (SELECT pid FROM code WHERE split = 'train')
  GROUP BY q.pid, t.pid),
dist AS (SELECT q.pid, t.pid AS neighbour, t.uid AS label, round(q.s + t.s - 2 * coalesce(dot, 0), 9) + 0.0 AS d2
  FROM (SELECT * FROM sq WHERE split <> 'train') q CROSS JOIN (SELECT * FROM sq WHERE split = 'train') t
  LEFT JOIN dots d ON d.pid = q.pid AND d.neighbour = t.pid),
near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d2, neighbour) <= 25)
""",
)


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = code(spark, sf)
    words = gr.with_tokens(rows, tk.words(F.col("code")))
    model = persisted(vo.fit_tfidf(train_part(words), 10_000), "tfidf")
    cells = persisted(ve.tfidf(words, model, sublinear=True), "cells")
    train = train_part(rows).select("pid", F.col("uid").alias("label"))
    return cf.neighbours(cells, train, cells, rows.filter("split <> 'train'").select("pid"), 25)


@query(_KNN + "SELECT pid, neighbour, CAST(label AS BIGINT) AS label, round(d2, 6) + 0.0 AS d2 FROM near")
def knn_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf).withColumn("d2", F.round("d2", 6) + 0.0)


@query(
    _KNN
    + """SELECT pid, CAST(label AS BIGINT) AS uid_pred FROM (SELECT pid, label, count(*) AS votes FROM near GROUP BY pid, label)
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY votes DESC, label) = 1"""
)
def knn_predict(spark: SparkSession, sf: str) -> DataFrame:
    return cf.vote(_neighbours(spark, sf))


# ------------------------------------------------------------------ naive Bayes

_LANGS = "de en es fr".split()
_LABEL = "CASE lang " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(_LANGS)) + f" ELSE {len(_LANGS)} END"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).withColumn("label", F.expr(_LABEL).cast("bigint"))


_NB = with_sql(
    DOCS_SQL,
    tokens_sql("docs", _SEQ),
    vocab_sql(1000),
    f"""lab AS (SELECT pid, split, {_LABEL} AS label FROM docs),
cells AS (SELECT pid, idx, count(*) AS value FROM grams JOIN vocab USING (gram) GROUP BY pid, idx),
ncj AS (SELECT label, idx, sum(value) AS s FROM cells JOIN lab USING (pid) WHERE split = 'train' GROUP BY label, idx),
cls AS (SELECT l.label, ln(count(*) / (SELECT count(*) FROM lab WHERE split = 'train')) AS prior,
  (SELECT coalesce(sum(s), 0) FROM ncj WHERE ncj.label = l.label) AS mass FROM lab l WHERE split = 'train' GROUP BY l.label),
theta AS (SELECT c.label, v.idx, ln((coalesce(s, 0) + 1) / (c.mass + (SELECT count(*) FROM vocab))) AS t
  FROM cls c CROSS JOIN vocab v LEFT JOIN ncj n ON n.label = c.label AND n.idx = v.idx),
joint AS (SELECT l.pid, c.label, any_value(c.prior) + coalesce(sum(x.value * t.t), 0) AS score
  FROM (SELECT pid FROM lab WHERE split <> 'train') l CROSS JOIN cls c LEFT JOIN cells x ON x.pid = l.pid
  LEFT JOIN theta t ON t.label = c.label AND t.idx = x.idx GROUP BY l.pid, c.label)
""",
)


def _nb(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = _labelled(spark, sf)
    words = gr.with_tokens(rows, tk.sequence_words(F.col("code")))
    vocabulary = persisted(vo.fit_vocabulary(train_part(words), 1000), "vocabulary")
    cells = persisted(ve.count(words, vocabulary), "cells")
    classes, weights = cf.fit_multinomial_nb(
        cells, train_part(rows).select("pid", "label"), vocabulary.agg(F.count("*")).scalar()
    )
    queries = rows.filter("split <> 'train'").select("pid")
    own = cells.join(queries, "pid", "left_semi")
    return queries, own, persisted(classes, "classes"), persisted(weights, "weights")


@query(_NB + "SELECT pid, CAST(label AS BIGINT) AS label, round(score, 6) AS score FROM joint")
def nb_scores(spark: SparkSession, sf: str) -> DataFrame:
    return cf.nb_scores(*_nb(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    _NB
    + """SELECT pid, CAST(label AS BIGINT) AS uid_pred FROM joint
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(score, 9) DESC, label) = 1"""
)
def nb_predict(spark: SparkSession, sf: str) -> DataFrame:
    queries, own, classes, weights = _nb(spark, sf)
    postings = persisted(cf.class_postings(weights), "postings")
    return cf.nb_best(cf.nb_blocks(queries, own, classes, postings)).select("pid", "uid_pred")


@query(
    with_sql(DOCS_SQL)
    + "SELECT pid, uid, CAST(CAST(concat('0x', substr(md5(concat('7:', pid)), 1, 8)) AS BIGINT) % 20 AS BIGINT) AS uid_pred FROM docs"
)
def random_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return cf.random_baseline(docs(spark, sf).select("pid", "uid"), 20, seed=7)


# ------------------------------------------------------------------ MLlib models


def _printable(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf)
    counts = st.printable_counts(F.col("code"))
    scaled = F.transform(counts, lambda c: c.cast("double"))
    return persisted(rows.select("pid", "split", "label", scaled.alias("features")), "printable")


def _ml(rows: DataFrame) -> DataFrame:
    return rows.select("pid", "split", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))


def _logistic_proba(spark: SparkSession, sf: str) -> DataFrame:
    rows = persisted(_ml(_printable(spark, sf)), "vectors")
    model = cf.fit_logistic(train_part(rows), iterations=100)
    return cf.predict_proba(model, rows.filter("split <> 'train'"))


@query()
def logistic_predict(spark: SparkSession, sf: str) -> DataFrame:
    return cf.predict_label(_logistic_proba(spark, sf)).select("pid", "uid_pred")


@query()
def predict_proba(spark: SparkSession, sf: str) -> DataFrame:
    """One probability per class; each row adds up to 1."""
    long = _logistic_proba(spark, sf).select("pid", F.posexplode_outer("probs").alias("label", "p"))
    return long.select("pid", "label", F.round("p", 4).alias("p"))


@query(
    with_sql(DOCS_SQL, f"lab AS (SELECT pid, split, {_LABEL} AS label FROM docs)")
    + """SELECT pid, CAST((SELECT max(label) + 1 FROM lab WHERE split = 'train') AS BIGINT) AS classes, 1.0::DOUBLE AS total, TRUE AS within
FROM lab WHERE split <> 'train'"""
)
def predict_proba_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's probabilities: how many, their sum, and whether all are within [0, 1]."""
    found = _logistic_proba(spark, sf)
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    return found.select(
        "pid",
        F.size("probs").cast("bigint").alias("classes"),
        F.round(total, 9).alias("total"),
        F.forall("probs", lambda p: (p >= 0) & (p <= 1)).alias("within"),
    )


@query(
    with_sql(DOCS_SQL)
    + """SELECT unnest(['logistic', 'mlp', 'svm']) AS classifier, CAST((SELECT count(*) FROM docs WHERE split <> 'train') AS BIGINT) AS documents,
TRUE AS better_than_largest_class"""
)
def solver_floors(spark: SparkSession, sf: str) -> DataFrame:
    """The models that no SQL can repeat: all documents predicted, more of them right than by
    always naming the largest class."""
    truth = persisted(_labelled(spark, sf).filter("split <> 'train'").select("pid", "label"), "truth")
    largest = truth.groupBy("label").count().agg(F.max("count")).first()[0]
    out = None
    for name, predict in (("logistic", logistic_predict), ("mlp", mlp_predict), ("svm", svm_predict)):
        hit = F.sum((F.col("label") == F.col("uid_pred")).cast("bigint"))
        found = truth.join(predict(spark, sf), "pid").agg(F.count("*").alias("documents"), (hit > largest).alias("better_than_largest_class"))
        found = found.select(F.lit(name).alias("classifier"), "documents", "better_than_largest_class")
        out = found if out is None else out.unionByName(found)
    return out


@query()
def svm_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf)
    counts = F.transform(st.alpha_counts(F.col("code")), lambda c: c.cast("double"))
    data = persisted(rows.select("pid", "split", "label", counts.alias("features")), "alpha")
    predict = cf.fit_svm(train_part(data).select("pid", "label", "features"), 26)
    return predict(data.filter("split <> 'train'").select("pid", "features"))


_PAIRS = [(i, j) for i in range(10) for j in range(i + 1, 10)]


@query(
    with_sql(
        SCORES_SQL,
        "won AS (SELECT model, pid, unnest(["
        + ", ".join(f"CASE WHEN logits[{i + 1}] - logits[{j + 1}] > 0 THEN {i} ELSE {j} END" for i, j in _PAIRS)
        + "]) AS label FROM scores)",
    )
    + """SELECT model, pid, CAST(label AS BIGINT) AS uid_pred FROM (SELECT model, pid, label, count(*) AS votes FROM won GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY model, pid ORDER BY votes DESC, label) = 1"""
)
def pair_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The vote of all pairs of classes, with differences of the models' scores as decision values."""
    rows = model_scores(spark, sf)
    decisions = F.array(*[F.col("logits")[i] - F.col("logits")[j] for i, j in _PAIRS])
    return rows.select(F.col("model").cast("bigint").alias("model"), "pid", cf.vote_of_pairs(decisions, 10).alias("uid_pred"))


@query()
def mlp_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf)
    words = gr.with_tokens(rows, tk.sequence_words(F.col("code")))
    vocabulary = persisted(vo.fit_vocabulary(train_part(words), 1000), "vocabulary")
    cells = ve.binary(words, vocabulary)
    labels = rows.select("pid", "split", F.col("label").cast("double").alias("label"))
    vectors = persisted(ve.to_vectors(cells, labels, 1000), "vectors")
    model = cf.fit_mlp(train_part(vectors), [1000, 100, len(_LANGS) + 1])
    return cf.predict_label(cf.predict_proba(model, vectors.filter("split <> 'train'"))).select("pid", "uid_pred")


_KIND_CELLS = {
    "alpha": ([], _array_cells("docs", ALPHA_SQL), "26"),
    "char": ([], _array_cells("docs", _printable_sql("code")), "100"),
    **{
        kind: (
            [tokens_sql("docs", WORDS_SQL), tfidf_sql(10000, "docs", True)],
            "SELECT pid, idx, value FROM vec",
            "(SELECT count(*) FROM tv)",
        )
        for kind in ("tfidfsk", "tfidfskt")
    },
    "tfidfskc": (
        [COLLAPSED_SQL.format("docs"), tokens_sql("low", "string_split(code, '')"), tfidf_sql(10000, "docs", True)],
        "SELECT pid, idx, value FROM vec",
        "(SELECT count(*) FROM tv)",
    ),
}


def _experiment_sql(kind: str) -> str:
    ctes, cells, width = _KIND_CELLS[kind]
    return with_sql(
        DOCS_SQL,
        *ctes,
        f"""lab AS (SELECT pid, split, {_LABEL} AS label FROM docs),
cells AS ({cells}),
ncj AS (SELECT label, idx, sum(value) AS s FROM cells JOIN lab USING (pid) WHERE split = 'train' GROUP BY label, idx),
cls AS (SELECT l.label, ln(count(*) / (SELECT count(*) FROM lab WHERE split = 'train')) AS prior,
  (SELECT coalesce(sum(s), 0) FROM ncj WHERE ncj.label = l.label) AS mass FROM lab l WHERE split = 'train' GROUP BY l.label),
joint AS (SELECT l.pid, l.label AS truth, c.label,
  any_value(c.prior) + coalesce(sum(x.value * ln((coalesce(n.s, 0) + 1) / (c.mass + {width}))), 0) AS score
  FROM (SELECT * FROM lab WHERE split = 'dev') l CROSS JOIN cls c LEFT JOIN cells x ON x.pid = l.pid
  LEFT JOIN ncj n ON n.label = c.label AND n.idx = x.idx GROUP BY l.pid, l.label, c.label),
best AS (SELECT * FROM joint QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(score, 9) DESC, label) = 1)""",
    ) + (
        f"SELECT '{kind}' AS features, 'nb' AS classifier, CAST(count(*) AS BIGINT) AS total, "
        "CAST(sum(CAST(truth = label AS INT)) AS BIGINT) AS correct, round(avg(CAST(truth = label AS INT)), 6) AS accuracy FROM best"
    )


@query(" UNION ALL ".join(f"SELECT * FROM ({_experiment_sql(kind)})" for kind in _KIND_CELLS))
def run_experiment(spark: SparkSession, sf: str) -> DataFrame:
    """Feature kind x classifier -> accuracy on dev, for every kind that needs the text only."""
    from inkprint.operators.experiment import run_experiment as run

    rows, out = _labelled(spark, sf), None
    for kind in _KIND_CELLS:
        found = run(rows, kind, "nb")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(
    with_sql(SCORES_SQL)
    + """SELECT model, pid, CAST(list_position(logits, list_max(logits)) - 1 AS BIGINT) AS uid_pred FROM scores"""
)
def predict_label(spark: SparkSession, sf: str) -> DataFrame:
    found = cf.predict_label(model_scores(spark, sf).select("model", "pid", "logits"), "logits")
    return found.withColumn("model", F.col("model").cast("bigint"))


_PROBS = """probs AS (SELECT model, pid, uid, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM (
  SELECT model, pid, uid, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM scores))"""
_P = with_sql(SCORES_SQL, _PROBS)
_LONG = "CAST(generate_subscripts(probs, 1) - 1 AS BIGINT) AS class, round(unnest(probs), 6) AS p"


@query(_P + f"SELECT model, pid, {_LONG} FROM probs")
def batch_score(spark: SparkSession, sf: str) -> DataFrame:
    """A user's scorer (soft-max of each model's scores) applied in batches."""

    def scorer(batch: pd.DataFrame) -> np.ndarray:
        logits = np.vstack(batch["logits"].to_numpy())
        powers = np.exp(logits - logits.max(axis=1, keepdims=True))
        return powers / powers.sum(axis=1, keepdims=True)

    rows = model_scores(spark, sf).select(F.col("model").cast("bigint").alias("model"), "pid", "logits")
    long = cf.batch_score(rows, scorer, 100, ("model",)).select("model", "pid", F.posexplode_outer("probs").alias("class", "p"))
    return long.select("model", "pid", F.col("class").cast("bigint").alias("class"), F.round("p", 6).alias("p"))


# ------------------------------------------------------------------ ensembles


def _probs(spark: SparkSession, sf: str) -> DataFrame:
    rows = model_scores(spark, sf)
    return rows.select(F.col("model").cast("bigint").alias("model"), "pid", "uid", en.softmax(F.col("logits")).alias("probs"))


@query(_P + f"SELECT model, pid, {_LONG} FROM probs")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    long = _probs(spark, sf).select("model", "pid", F.posexplode_outer("probs").alias("class", "p"))
    return long.select("model", "pid", F.col("class").cast("bigint").alias("class"), F.round("p", 6).alias("p"))


_HIT = "CAST(list_position(probs, list_max(probs)) - 1 = uid AS INT)"
_ACC = f"CAST(count(*) AS BIGINT) AS total, CAST(sum({_HIT}) AS BIGINT) AS correct, round(avg({_HIT}), 6) AS accuracy"


@query(_P + f"SELECT model, {_ACC} FROM probs GROUP BY model")
def model_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return en.model_accuracy(_probs(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query(_P + f"SELECT model, {_ACC} FROM probs WHERE model IN (0, 2, 4) GROUP BY model")
def select_models(spark: SparkSession, sf: str) -> DataFrame:
    chosen = en.select_models(_probs(spark, sf), [0, 2, 4])
    return en.model_accuracy(chosen).withColumn("accuracy", F.round("accuracy", 6))


_WEIGHTS = {0: 0.1, 1: 0.15, 2: 0.2, 3: 0.25, 4: 0.3}
_VIEWS = "views AS (SELECT pid, uid, list(probs ORDER BY model) AS v FROM probs GROUP BY pid, uid)"
_MIXED = (
    "mixed AS (SELECT pid, uid, list_transform(range(1, 11), lambda j: "
    + " + ".join(f"v[{m + 1}][j] * CAST({w} AS DOUBLE)" for m, w in _WEIGHTS.items())
    + ") AS mixed FROM views)"
)
_PM = with_sql(SCORES_SQL, _PROBS, _VIEWS, _MIXED)


@query(
    _PM
    + """SELECT pid, uid, round(list_max(mixed), 6) AS top, CAST(list_position(mixed, list_max(mixed)) - 1 AS BIGINT) AS uid_pred
FROM mixed"""
)
def weighted_average(spark: SparkSession, sf: str) -> DataFrame:
    found = en.weighted_average(_probs(spark, sf), _WEIGHTS)
    return found.select("pid", "uid", F.round(F.array_max("mixed"), 6).alias("top"), "uid_pred")


@query(_PM + "SELECT round(1 - avg(CAST(list_position(mixed, list_max(mixed)) - 1 = uid AS INT)), 6) AS loss FROM mixed")
def ensemble_objective(spark: SparkSession, sf: str) -> DataFrame:
    return en.objective(_probs(spark, sf), _WEIGHTS).withColumn("loss", F.round("loss", 6))


_GRID = en.simplex_grid(5, 3)
_GRID_SQL = (
    "cand AS (SELECT unnest(range(0, "
    + str(len(_GRID))
    + ")) AS candidate, unnest(["
    + ", ".join("[" + ", ".join(f"CAST({w!r} AS DOUBLE)" for w in row) + "]" for row in _GRID)
    + "]) AS w)"
)


@query(
    with_sql(SCORES_SQL, _PROBS, _VIEWS, _GRID_SQL)
    + """SELECT candidate, CAST(count(*) AS BIGINT) AS total,
CAST(sum(CAST(list_position(m, list_max(m)) - 1 = uid AS INT)) AS BIGINT) AS correct FROM (
SELECT candidate, uid, list_transform(range(1, 11), lambda j: v[1][j] * w[1] + v[2][j] * w[2] + v[3][j] * w[3] + v[4][j] * w[4] + v[5][j] * w[5]) AS m
FROM views, cand) GROUP BY candidate"""
)
def weight_grid(spark: SparkSession, sf: str) -> DataFrame:
    return en.score_candidates(en.stacked(_probs(spark, sf), [0, 1, 2, 3, 4]), _GRID)


@query()
def weight_search(spark: SparkSession, sf: str) -> DataFrame:
    """Best weights found, then the weighted average with them over every document."""
    scores = _probs(spark, sf)
    weights, _ = en.weight_search(scores, [0, 1, 2, 3, 4])
    return en.weighted_average(scores, weights).select("pid", "uid", "uid_pred")


@query(
    with_sql(SCORES_SQL, _PROBS, _VIEWS, _GRID_SQL)
    + """, grid AS (SELECT candidate, sum(CAST(list_position(m, list_max(m)) - 1 = uid AS INT)) AS correct FROM (
SELECT candidate, uid, list_transform(range(1, 11), lambda j: v[1][j] * w[1] + v[2][j] * w[2] + v[3][j] * w[3] + v[4][j] * w[4] + v[5][j] * w[5]) AS m
FROM views, cand) GROUP BY candidate)
SELECT unnest(['evolution', 'lines']) AS method, CAST((SELECT count(*) FROM views) AS BIGINT) AS total,
CAST((SELECT max(correct) FROM grid) AS BIGINT) AS grid_correct, TRUE AS not_worse, 1.0::DOUBLE AS weights"""
)
def weight_search_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Both searches over every document: never worse than the best of a grid (evolution) or
    than equal weights (lines), as counted by the weighted average itself; weights add up to 1."""
    scores, models = _probs(spark, sf), [0, 1, 2, 3, 4]
    rows = persisted(en.stacked(scores, models), "views")
    grid = en.best_candidate(en.score_candidates(rows, _GRID)).first()
    equal = en.score_candidates(rows, [[1.0] * 5]).first().correct
    out = []
    for method, search, least in (("evolution", en.weight_search, grid.correct), ("lines", en.line_search_weights, equal)):
        weights, share = search(scores, models)
        loss = en.objective(scores, weights).first().loss
        out.append((method, grid.total, grid.correct, round((1 - loss) * grid.total) >= least and abs(1 - loss - share) < 1e-9, round(sum(weights.values()), 9)))
    return spark.createDataFrame(out, "method string, total bigint, grid_correct bigint, not_worse boolean, weights double")


@query(
    with_sql(SCORES_SQL, _PROBS, _VIEWS)
    + """SELECT pid, uid, CAST(generate_subscripts(f, 1) - 1 AS BIGINT) AS idx, round(unnest(f), 6) AS value
FROM (SELECT pid, uid, flatten(v) AS f FROM views)"""
)
def stack_features(spark: SparkSession, sf: str) -> DataFrame:
    found = en.stack_features(_probs(spark, sf), [0, 1, 2, 3, 4])
    long = found.select("pid", "uid", F.posexplode_outer("features").alias("idx", "value"))
    return long.select("pid", "uid", F.col("idx").cast("bigint").alias("idx"), F.round("value", 6).alias("value"))


@query(
    with_sql(
        DOCS_SQL,
        """cls AS (SELECT uid, count(*) AS n, min(pid) AS since FROM docs GROUP BY uid),
off AS (SELECT uid, n, coalesce(sum(n) OVER (ORDER BY since ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cls),
pos AS (SELECT uid, p % 5 AS fold, count(*) AS m FROM (SELECT uid, unnest(range(CAST(s AS BIGINT), CAST(s + n AS BIGINT))) AS p FROM off) GROUP BY ALL),
upto AS (SELECT uid, fold, sum(m) OVER (PARTITION BY uid ORDER BY fold) AS u FROM pos),
rk AS (SELECT pid, uid, row_number() OVER (PARTITION BY uid ORDER BY pid) AS r FROM docs)""",
    )
    + "SELECT pid, uid, CAST(min(fold) AS BIGINT) AS fold FROM rk JOIN upto USING (uid) WHERE u >= r GROUP BY pid, uid"
)
def stratified_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return en.stratified_folds(docs(spark, sf).select("pid", "uid"), 5)


@query()
def stacking_cv(spark: SparkSession, sf: str) -> DataFrame:
    return en.stacking_cv(_probs(spark, sf), [0, 1, 2, 3, 4])


@query(
    with_sql(
        SCORES_SQL,
        """labels AS (SELECT DISTINCT pid, uid FROM scores),
cls AS (SELECT uid, count(*) AS n, min(pid) AS since FROM labels GROUP BY uid),
off AS (SELECT uid, n, coalesce(sum(n) OVER (ORDER BY since ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cls)""",
    )
    + """SELECT p % 5 AS fold, CAST(count(*) AS BIGINT) AS total, TRUE AS better_than_largest_class
FROM (SELECT unnest(range(CAST(s AS BIGINT), CAST(s + n AS BIGINT))) AS p FROM off) GROUP BY p % 5"""
)
def stacking_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each fold, and whether its accuracy is above the largest class's share."""
    scores = _probs(spark, sf)
    largest = scores.groupBy("uid").count().agg(F.max("count") / F.sum("count")).first()[0]
    found = en.stacking_cv(scores, [0, 1, 2, 3, 4])
    return found.select("fold", "total", (F.col("accuracy") > largest).alias("better_than_largest_class"))


@query()
def stacking_final(spark: SparkSession, sf: str) -> DataFrame:
    scores = _probs(spark, sf).withColumn("part", F.floor(F.col("pid") / 20) % 2)
    dev, test = scores.filter("part = 0").drop("part"), scores.filter("part = 1").drop("part")
    return en.stacking_final(dev, test, [0, 1, 2, 3, 4])


@query()
def concat_model(spark: SparkSession, sf: str) -> DataFrame:
    """One classifier on n-grams, tree paths, the 136 lexical measures and five models' scores side by side."""
    rows, paths = code(spark, sf), tree_docs(spark, sf, 2)
    grams = gr.with_tokens(rows, tk.char_ngrams(F.col("code"), 3))
    ngram = ve.binary(grams, persisted(vo.fit_vocabulary(train_part(grams), 500), "vocabulary"))
    tree = ve.binary(paths, persisted(vo.fit_tree_vocabulary(train_part(paths), 150), "vocabulary"))
    lexical = ve.cells(persisted(st.lexical_vector(rows.select("pid", "code", "code_pre")), "style"))
    score = ve.cells(en.stack_features(_probs(spark, sf), [0, 1, 2, 3, 4]).select("pid", "features"))
    views = persisted(ve.concat_views([(ngram, 500), (tree, 150), (lexical, 136), (score, 50)]), "views")
    train = rows.filter("split = 'train'").select("pid")
    model = persisted(ve.minmax_fit(views.join(train, "pid"), train.agg(F.count("*")).scalar()), "minmax")
    scaled = ve.minmax_transform(views, model, rows.select("pid"))
    labels = rows.select("pid", "split", F.col("uid").cast("double").alias("label"))
    vectors = persisted(ve.to_vectors(scaled, labels, 836), "vectors")
    fitted = cf.fit_logistic(train_part(vectors))
    return cf.predict_label(cf.predict_proba(fitted, vectors.filter("split <> 'train'"))).select("pid", "uid_pred")


@query(
    _PM
    + """SELECT 'ensemble' AS kind, CASE WHEN floor(pid / 20) % 2 = 0 THEN 'dev' ELSE 'test' END AS part, pid,
CAST(list_position(mixed, list_max(mixed)) - 1 AS INTEGER) AS uid FROM mixed
UNION ALL SELECT 'first', CASE WHEN floor(pid / 20) % 2 = 0 THEN 'dev' ELSE 'test' END, pid,
CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) FROM probs WHERE model = 0"""
)
def write_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of the first model and of the weighted average for dev and test, written as files and read back."""
    scores = _probs(spark, sf).withColumn("part", F.when(F.floor(F.col("pid") / 20) % 2 == 0, "dev").otherwise("test"))
    path = f"{scratch_dir(spark)}/inkprint/ensemble-{uuid.uuid4().hex}"
    fs.write_ensemble(scores, _WEIGHTS, path)
    return fs.read_ensemble(spark, path)


# ------------------------------------------------------------------ error analysis

_SCORED = with_sql(
    SCORES_SQL,
    "scored AS (SELECT CAST(model AS BIGINT) AS model, pid, uid, list_position(logits, list_max(logits)) - 1 AS uid_pred FROM scores)",
    "errs AS (SELECT model, uid, count(*) AS files FROM scored WHERE uid <> uid_pred GROUP BY model, uid)",
)
_MODEL = ("model",)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    found = cf.predict_label(model_scores(spark, sf), "logits")
    return found.withColumn("model", F.col("model").cast("bigint"))


@query(_SCORED + "SELECT model, round(avg(CAST(uid = uid_pred AS INT)), 6) AS accuracy FROM scored GROUP BY model")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    gold = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").alias("uid"))
    found = an.accuracy(gold, _scored(spark, sf).select("model", "pid", "uid_pred"), _MODEL)
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query(
    _SCORED
    + """SELECT model, CAST(count(g.pid) AS BIGINT) AS matched, CAST((SELECT count(*) FROM documents) - count(g.pid) AS BIGINT) AS missing,
CAST(count_if(g.pid IS NULL) AS BIGINT) AS unexpected, CAST(count_if(g.uid = p.uid_pred) AS BIGINT) AS correct,
round(count_if(g.uid = p.uid_pred) / count(g.pid), 6) AS accuracy
FROM scored p LEFT JOIN (SELECT doc_id AS pid, doc_id % 10 AS uid FROM documents) g ON g.pid = p.pid GROUP BY model"""
)
def score_files(spark: SparkSession, sf: str) -> DataFrame:
    gold = docs(spark, sf).select("pid", (F.col("pid") % 10).alias("uid"))
    return an.score_files(gold, _scored(spark, sf), _MODEL).withColumn("accuracy", F.round("accuracy", 6))


@query(_SCORED + "SELECT model, pid, uid = uid_pred AS is_correct FROM scored")
def split_errors(spark: SparkSession, sf: str) -> DataFrame:
    return an.split_errors(_scored(spark, sf)).select("model", "pid", "is_correct")


@query(
    _SCORED
    + """SELECT model, CAST(count_if(uid = uid_pred) AS BIGINT) AS correct, CAST(count_if(uid <> uid_pred) AS BIGINT) AS incorrect,
round(avg(CAST(uid = uid_pred AS INT)), 6) AS accuracy FROM scored GROUP BY model"""
)
def error_summary(spark: SparkSession, sf: str) -> DataFrame:
    return an.error_summary(_scored(spark, sf), _MODEL).withColumn("accuracy", F.round("accuracy", 6))


@query(_SCORED + "SELECT model, uid, CAST(files AS BIGINT) AS files FROM errs")
def errors_per_author(spark: SparkSession, sf: str) -> DataFrame:
    return an.per_author(_scored(spark, sf), False, _MODEL)


@query(
    _SCORED
    + """SELECT model, CAST(count(*) AS BIGINT) AS at_least_one, CAST(count_if(files <> 1) AS BIGINT) AS at_least_two
FROM errs GROUP BY model"""
)
def authors_with_errors(spark: SparkSession, sf: str) -> DataFrame:
    return an.authors_with_errors(an.per_author(_scored(spark, sf), False, _MODEL), _MODEL)


@query(
    _SCORED
    + """SELECT model, uid, CAST(files AS BIGINT) AS files FROM errs
QUALIFY row_number() OVER (PARTITION BY model ORDER BY files DESC, uid) <= 3"""
)
def top3_error_authors(spark: SparkSession, sf: str) -> DataFrame:
    return an.top_error_authors(an.per_author(_scored(spark, sf), False, _MODEL), 3, _MODEL)


@query(_SCORED + "SELECT model, uid, pid FROM scored WHERE uid <> uid_pred")
def author_files(spark: SparkSession, sf: str) -> DataFrame:
    return an.author_files(_scored(spark, sf), False, by=_MODEL)


@query(_SCORED + "SELECT model, uid, CAST(count(*) AS BIGINT) AS files FROM scored WHERE uid = uid_pred GROUP BY model, uid")
def correct_per_author(spark: SparkSession, sf: str) -> DataFrame:
    return an.per_author(_scored(spark, sf), True, _MODEL)


@query(
    _SCORED + "SELECT pid, uid FROM scored WHERE uid <> uid_pred GROUP BY pid, uid HAVING count(*) = 5"
)
def errors_common_to_all(spark: SparkSession, sf: str) -> DataFrame:
    return an.errors_common_to_all(_scored(spark, sf), 5)


@query(
    _SCORED
    + """SELECT pid, uid FROM scored WHERE model = 3 AND uid = uid_pred
EXCEPT SELECT pid, uid FROM scored WHERE model <> 3 AND uid = uid_pred"""
)
def only_correct_by(spark: SparkSession, sf: str) -> DataFrame:
    return an.only_correct_by(_scored(spark, sf), 3)


_COMMON = with_sql(
    CODE_SQL,
    grams_sql("code", 6),
    vocab_sql(5000),
    """common AS (SELECT uid, gram FROM grams SEMI JOIN vocab USING (gram) WHERE split = 'train' GROUP BY uid, gram
  HAVING count(DISTINCT pid) = (SELECT count(*) FROM code c WHERE c.uid = grams.uid AND c.split = 'train'))""",
)


def _common(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = gr.with_tokens(code(spark, sf), tk.char_ngrams(F.col("code"), 6))
    vocabulary = persisted(vo.fit_vocabulary(train_part(rows), 5000), "vocabulary")
    return an.common_ngrams(train_part(rows), vocabulary), rows


@query(_COMMON + "SELECT uid, gram FROM common")
def common_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return _common(spark, sf)[0]


@query(
    _COMMON
    + """SELECT pid, uid, CAST(count(DISTINCT gram) AS BIGINT) AS shared FROM grams JOIN common USING (uid, gram)
WHERE split <> 'train' GROUP BY pid, uid"""
)
def overlap_with_common(spark: SparkSession, sf: str) -> DataFrame:
    common, rows = _common(spark, sf)
    return an.overlap_with(persisted(common, "common"), rows.filter("split <> 'train'"))
