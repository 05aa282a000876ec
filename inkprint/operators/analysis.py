"""Scoring and error analysis of predictions (pid, uid, uid_pred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkprint.operators.grams import distinct_terms


def join_truth(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(pid, uid, uid_pred) by key; ``predictions`` has (pid, uid_pred)."""
    return gold.select("pid", "uid").join(predictions.select("pid", "uid_pred"), "pid")


def accuracy(gold: DataFrame, predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of the predictions that are right, for each value of the ``by`` columns of ``predictions``."""
    hit = (F.col("uid") == F.col("uid_pred")).cast("bigint")
    matched = predictions.select(*by, "pid", "uid_pred").join(gold.select("pid", "uid"), "pid", "left")
    return matched.groupBy(*by).agg((F.coalesce(F.sum(hit), F.lit(0)) / F.count("*")).alias("accuracy"))


def score_files(gold: DataFrame, predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy over the common keys, with the number of keys on one side only
    reported instead of compared by position; a pid occurs once for each ``by``."""
    files = gold.agg(F.count("*")).scalar()
    both = predictions.select(*by, "pid", "uid_pred").join(gold.select("pid", "uid", F.lit(1).alias("has_gold")), "pid", "left")
    counted = both.groupBy(*by).agg(
        F.count_if(F.col("has_gold").isNotNull()).alias("matched"),
        F.count_if(F.col("has_gold").isNull()).alias("unexpected"),
        F.count_if(F.col("uid") == F.col("uid_pred")).alias("correct"),
    )
    return counted.select(
        *by, "matched", (files - F.col("matched")).alias("missing"), "unexpected", "correct", (F.col("correct") / F.col("matched")).alias("accuracy")
    )


def split_errors(scored: DataFrame) -> DataFrame:
    """``scored`` with ``is_correct``."""
    return scored.withColumn("is_correct", F.col("uid") == F.col("uid_pred"))


def error_summary(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    hit = F.col("uid") == F.col("uid_pred")
    return scored.groupBy(*by).agg(
        F.count_if(hit).alias("correct"), F.count_if(~hit).alias("incorrect"), F.count("*").alias("total")
    ).select(*by, "correct", "incorrect", (F.col("correct") / F.col("total")).alias("accuracy"))


def per_author(scored: DataFrame, correct: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, uid, files): (in)correctly attributed files by true author."""
    kept = split_errors(scored).filter(F.col("is_correct") == F.lit(correct))
    return kept.groupBy(*by, "uid").agg(F.count("*").alias("files"))


def authors_with_errors(errors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """From (by, uid, files): authors with at least one, and at least two, errors."""
    return errors.groupBy(*by).agg(F.count("*").alias("at_least_one"), F.count_if(F.col("files") != 1).alias("at_least_two"))


def top_error_authors(errors: DataFrame, n: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` authors with most errors, for each ``by``, ties to the smaller number."""
    if not by:
        return errors.orderBy(F.desc("files"), "uid").limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("files"), "uid"))
    return errors.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def author_files(scored: DataFrame, correct: bool, uid: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, uid, pid) of the (in)correctly attributed files of one author, or of each, sorted."""
    kept = split_errors(scored).filter(F.col("is_correct") == F.lit(correct))
    kept = kept if uid is None else kept.filter(F.col("uid") == uid)
    return kept.select(*by, "uid", "pid").orderBy(*by, "uid", "pid")


def errors_common_to_all(scored: DataFrame, models: int) -> DataFrame:
    """(pid, uid) wrong in every model; ``scored`` has one row per (model, pid)."""
    wrong = scored.filter(F.col("uid") != F.col("uid_pred"))
    return wrong.groupBy("pid", "uid").agg(F.count("*").alias("n")).filter(F.col("n") == models).select("pid", "uid")


def only_correct_by(scored: DataFrame, model: int) -> DataFrame:
    """(pid, uid) right in ``model`` and in no other model."""
    right = scored.filter(F.col("uid") == F.col("uid_pred"))
    by_doc = right.groupBy("pid", "uid").agg(
        F.count_if(F.col("model") == model).alias("own"), F.count("*").alias("all")
    )
    return by_doc.filter("own = 1 AND all = 1").select("pid", "uid")


def common_ngrams(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(uid, gram): vocabulary terms present in every document of a uid; give
    a set of files one uid to ask about that set."""
    sizes = docs.groupBy("uid").agg(F.count("*").alias("files"))
    found = distinct_terms(docs.select("pid", "uid", "tokens")).join(vocabulary.select("gram"), "gram", "left_semi")
    spread = found.groupBy("uid", "gram").agg(F.count("*").alias("n"))
    return spread.join(sizes, "uid").filter("n = files").select("uid", "gram")


def overlap_with(common: DataFrame, docs: DataFrame) -> DataFrame:
    """(pid, uid, shared): how many of its uid's common terms a document has."""
    terms = distinct_terms(docs.select("pid", "uid", "tokens"))
    return terms.join(common, ["uid", "gram"]).groupBy("pid", "uid").agg(F.count("*").alias("shared"))
