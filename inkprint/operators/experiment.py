"""One experiment: a feature kind, a classifier, the accuracy on dev."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.operators import classifiers as cf
from inkprint.operators import profiles as pr
from inkprint.operators import vectors as ve
from inkprint.operators.featuresets import FEATURE_SETS
from inkprint.runtime import persisted

WIDTHS = {"alpha": 26, "char": 100, "lexical": 136, "tfidfsk": 10_000, "tfidfskc": 10_000, "tfidfskt": 10_000}
CLASSIFIERS = ("nb", "logistic", "knn")


def run_experiment(docs: DataFrame, features: str, classifier: str, iterations: int = 100) -> DataFrame:
    """(features, classifier, total, correct, accuracy).

    ``docs`` has pid, split, label, code (and code_pre for ``lexical``): fitted
    on the train rows, measured on the dev rows."""
    if features not in WIDTHS or classifier not in CLASSIFIERS:
        raise ValueError(f"unknown experiment {features} x {classifier}")
    kind, width = FEATURE_SETS[features], WIDTHS[features]
    train, dev = docs.filter("split = 'train'"), docs.filter("split = 'dev'")
    model = kind.fit(train)
    if model is not None:
        model = persisted(model, "features")
    cells = persisted(kind.transform(docs.filter("split <> 'test'"), model), "cells")
    labels = train.select("pid", F.col("label").cast("bigint").alias("label"))
    queries = dev.select("pid")
    own = cells.join(labels.select("pid"), "pid", "left_semi")
    rest = cells.join(queries, "pid", "left_semi")
    if classifier == "nb":
        columns = model.agg(F.count("*")).scalar() if model is not None else width
        classes, weights = cf.fit_multinomial_nb(own, labels, columns)
        postings = persisted(cf.class_postings(weights), "weights")
        found = cf.nb_best(cf.nb_blocks(queries, rest, persisted(classes, "classes"), postings))
    elif classifier == "knn":
        found = cf.vote(cf.neighbours(own, labels, rest, queries))
    else:
        fitted = cf.fit_logistic(
            persisted(ve.to_vectors(own, labels.withColumn("label", F.col("label").cast("double")), width), "vectors"),
            iterations=iterations,
        )
        found = cf.predict_label(cf.predict_proba(fitted, ve.to_vectors(rest, queries, width)))
    truth = dev.select("pid", F.col("label").cast("bigint").alias("uid"))
    scored = pr.accuracy(truth.join(found.select("pid", "uid_pred"), "pid"))
    return scored.select(F.lit(features).alias("features"), F.lit(classifier).alias("classifier"), "total", "correct", "accuracy")
