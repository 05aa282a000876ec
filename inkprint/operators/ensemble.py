"""Combining the score tables of several models: (model, pid, probs)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.operators.classifiers import argmax
from inkprint.operators.solvers import fit_softmax_folds
from inkprint.runtime import persisted, ranked


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda p: p / total)


def model_accuracy(scores: DataFrame) -> DataFrame:
    """(model, total, correct, accuracy) of each model's arg-max against ``uid``."""
    hit = (argmax(F.col("probs")) == F.col("uid")).cast("bigint")
    return (
        scores.groupBy("model")
        .agg(F.count("*").alias("total"), F.sum(hit).alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("total"))
    )


def select_models(scores: DataFrame, models: list[int]) -> DataFrame:
    if not models:
        raise ValueError("no models were chosen")
    return scores.filter(F.col("model").isin(list(models)))


def stacked(scores: DataFrame, models: list[int]) -> DataFrame:
    """(pid, uid, views): the chosen models' rows of a document, in the order
    of ``models``.  A group holds one row per model, never more."""
    position = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model").cast("int"))
    rows = select_models(scores, models).groupBy("pid", "uid").agg(
        F.array_sort(F.collect_list(F.struct(position.alias("at"), "probs"))).alias("views")
    )
    return rows.select("pid", "uid", F.transform("views", lambda v: v["probs"]).alias("views"))


def stack_features(scores: DataFrame, models: list[int]) -> DataFrame:
    """(pid, uid, features): the models' rows end to end."""
    return stacked(scores, models).select("pid", "uid", F.flatten("views").alias("features"))


def _scaled(row: Column, weight: float) -> Column:
    return F.transform(row, lambda p: p * F.lit(float(weight)))


def weighted_average(scores: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(pid, uid, mixed, uid_pred): weighted sum of the models' rows and its arg-max."""
    models = list(weights)
    scaled = [_scaled(F.col("views")[i], weights[model]) for i, model in enumerate(models)]
    mixed = scaled[0]
    for more in scaled[1:]:
        mixed = F.zip_with(mixed, more, lambda a, b: a + b)
    return stacked(scores, models).select("pid", "uid", mixed.alias("mixed")).select("*", argmax(F.col("mixed")).alias("uid_pred"))


def objective(scores: DataFrame, weights: dict[int, float]) -> DataFrame:
    """1 - accuracy of the weighted average."""
    hit = (F.col("uid_pred") == F.col("uid")).cast("bigint")
    return weighted_average(scores, weights).agg((1 - F.sum(hit) / F.count("*")).alias("loss"))


def simplex_grid(models: int, steps: int) -> list[list[float]]:
    """All weight vectors with entries i/steps that sum to 1."""
    if models == 1:
        return [[1.0]]

    def parts(left: int, slots: int) -> Iterator[list[int]]:
        if slots == 1:
            yield [left]
            return
        for first in range(left, -1, -1):
            for rest in parts(left - first, slots - 1):
                yield [first, *rest]

    return [[x / steps for x in row] for row in parts(steps, models)]


def score_candidates(rows: DataFrame, candidates: list[list[float]]) -> DataFrame:
    """(candidate, total, correct) for every weight vector, in one pass.

    ``rows`` are (pid, uid, views).  Each task mixes its rows with all
    candidates and emits one partial count per candidate and batch, so what is
    shuffled does not depend on the number of documents' classes."""
    grid = np.asarray(candidates, dtype="float64")

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            views = np.array([[np.asarray(v) for v in row] for row in frame["views"]], dtype="float64")
            truth = frame["uid"].to_numpy()
            right = []
            for w in grid:
                mixed = views[:, 0, :] * w[0]
                for i in range(1, len(w)):
                    mixed = mixed + views[:, i, :] * w[i]
                right.append(int((mixed.argmax(axis=1) == truth).sum()))
            yield pd.DataFrame({"candidate": np.arange(len(grid)), "total": len(frame), "correct": right})

    counts = rows.select("uid", "views").mapInPandas(tally, "candidate bigint, total bigint, correct bigint")
    return counts.groupBy("candidate").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))


def best_candidate(tally: DataFrame) -> DataFrame:
    """The row with most correct, ties to the lowest candidate number."""
    return tally.orderBy(F.desc("correct"), "candidate").limit(1)


def _tally(rows: DataFrame, candidates: np.ndarray) -> tuple[np.ndarray, int]:
    """(correct documents of each candidate, documents), one job."""
    found = score_candidates(rows, candidates.tolist()).collect()
    correct = np.zeros(len(candidates), dtype=np.int64)
    for r in found:
        correct[r.candidate] = r.correct
    return correct, found[0].total if found else 0


def weight_search(
    scores: DataFrame,
    models: list[int],
    population: int = 15,
    generations: int = 1000,
    tolerance: float = 1e-7,
    steps: int = 5,
    seed: int = 0,
) -> tuple[dict[int, float], float]:
    """Weights (summing to 1) with the best accuracy, by differential evolution in [0, 1]^m.

    ``population`` x m members: the corners, equal weights, the best of the simplex grid of
    ``steps`` steps, and a seeded Latin hypercube.  A generation mutates towards the best member,
    crosses over, and keeps what is not worse; all its members are scored in one job and only
    their counts reach the driver.  It ends when the losses' deviation is within ``tolerance`` of
    their mean, or after ``generations``.  The best member is never lost, so the loss is not above the grid's."""
    rows = persisted(stacked(scores, models), "stacked")
    m, draw = len(models), np.random.default_rng(seed)
    grid = np.array(simplex_grid(m, steps))
    correct, documents = _tally(rows, grid)
    if m == 1 or not documents:
        return dict.fromkeys(models, 1.0 / m), float(correct.max(initial=0) / max(documents, 1))
    size = max(population * m, m + 3)
    strata = np.stack([draw.permutation(size) for _ in range(m)], axis=1)
    members = (strata + draw.random((size, m))) / size
    members[: m + 2] = np.vstack([np.eye(m), np.ones((1, m)), grid[correct.argmax()]])
    loss = 1 - _tally(rows, members)[0] / documents
    for _ in range(generations):
        if loss.std() <= tolerance * abs(loss.mean()):
            break
        best, force = members[loss.argmin()], draw.uniform(0.5, 1.0)
        others = np.array([draw.choice(np.delete(np.arange(size), i), 2, replace=False) for i in range(size)])
        mutant = best + force * (members[others[:, 0]] - members[others[:, 1]])
        crossed = draw.random((size, m)) < 0.7
        crossed[np.arange(size), draw.integers(m, size=size)] = True
        trial = np.where(crossed, mutant, members)
        trial = np.where((trial < 0) | (trial > 1), draw.random((size, m)), trial)
        trial[trial.sum(axis=1) == 0] = 1.0
        found = 1 - _tally(rows, trial)[0] / documents
        kept = found <= loss
        members, loss = np.where(kept[:, None], trial, members), np.where(kept, found, loss)
    top = members[loss.argmin()]
    return dict(zip(models, (top / top.sum()).tolist(), strict=True)), float(1 - loss.min())


def line_search_weights(
    scores: DataFrame, models: list[int], points: int = 33, rounds: int = 50, tolerance: float = 1e-7
) -> tuple[dict[int, float], float]:
    """Weights (summing to 1) by line searches along changing directions (Powell's method)
    from all ones, within [0, 1]^m.

    A line is searched by scoring ``points`` places on it in one job, and again between the
    neighbours of the best one.  After each round of lines the direction of its whole move
    replaces the one that gained most.  Ends when a round gains at most ``tolerance``."""
    rows = persisted(stacked(scores, models), "stacked")
    m = len(models)
    at, directions = np.ones(m), list(np.eye(m))
    correct, documents = _tally(rows, at[None, :])
    if not documents:
        return dict.fromkeys(models, 1.0 / m), 0.0
    best = correct[0]

    def along(at: np.ndarray, direction: np.ndarray, best: int) -> tuple[np.ndarray, int]:
        ends = np.where(direction[:, None] != 0, (np.array([[0.0, 1.0]]) - at[:, None]) / np.where(direction == 0, 1, direction)[:, None], np.nan)
        low, high = np.nanmax(ends.min(axis=1)), np.nanmin(ends.max(axis=1))
        for _ in range(2):
            places = np.clip(at + np.linspace(low, high, points)[:, None] * direction, 0.0, 1.0)
            places[places.sum(axis=1) == 0] = at
            found, _ = _tally(rows, places)
            k = int(found.argmax())
            if found[k] > best:
                at, best = places[k], found[k]
            width = (high - low) / (points - 1)
            low, high = low + (k - 1) * width, low + (k + 1) * width
        return at, best

    for _ in range(rounds):
        begin, before, gains = at, best, []
        for direction in directions:
            was = best
            at, best = along(at, direction, best)
            gains.append(best - was)
        if best - before <= tolerance * documents:
            break
        move = at - begin
        if np.abs(move).max() > 0:
            at, best = along(at, move, best)
            directions = [d for i, d in enumerate(directions) if i != int(np.argmax(gains))] + [move]
    return dict(zip(models, (at / at.sum()).tolist(), strict=True)), float(best / documents)


def stratified_folds(labels: DataFrame, folds: int = 5) -> DataFrame:
    """(pid, uid, fold), unshuffled: with the rows sorted by class (classes in
    order of their first pid), fold i takes as many members of a class as the
    class has positions p with p mod folds = i, first members first.

    Ranks inside a class come from range partitions, so one huge class is not
    one task; class offsets are a window over one row per class."""
    classes = labels.groupBy("uid").agg(F.count("*").alias("size"), F.min("pid").alias("since"))
    before = Window.orderBy("since").rowsBetween(Window.unboundedPreceding, -1)
    offsets = classes.select("uid", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))

    def upto(fold: int) -> Column:
        """Members of the class in folds 0..fold."""
        end, start = F.col("start") + F.col("size"), F.col("start")
        share = lambda i: F.floor((end - i + folds - 1) / folds) - F.floor((start - i + folds - 1) / folds)
        return sum((share(i) for i in range(1, fold + 1)), share(0))

    placed = ranked(labels.select("pid", "uid"), [F.col("pid")], ("uid",), "place").join(offsets, "uid")
    fold = F.lit(folds - 1)
    for i in range(folds - 2, -1, -1):
        fold = F.when(F.col("place") < upto(i), i).otherwise(fold)
    return placed.select("pid", "uid", fold.cast("bigint").alias("fold"))


def _predicted(rows: DataFrame, weights: np.ndarray, fold: Column) -> DataFrame:
    """``rows`` with ``uid_pred`` by the model of number ``fold``."""

    @F.pandas_udf("bigint")
    def best(fold: pd.Series, x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int64")
        wide = np.hstack([np.vstack(x.to_numpy()), np.ones((len(x), 1))])
        out = np.zeros(len(x), dtype=np.int64)
        for k in fold.unique():
            mine = (fold == k).to_numpy()
            out[mine] = (wide[mine] @ weights[k]).argmax(axis=1)
        return pd.Series(out)

    return rows.withColumn("uid_pred", best(fold, F.col("features")))


def _classes(rows: DataFrame) -> int:
    return (rows.agg(F.max("uid")).first()[0] or 0) + 1


def stacking_cv(scores: DataFrame, models: list[int], folds: int = 5, iterations: int = 100) -> DataFrame:
    """(fold, total, correct, accuracy): logistic regression on the stacked
    rows, each fold predicted by the model of the others.

    The models of all folds are trained together, in the same passes over the rows."""
    rows = stack_features(scores, models)
    placed = rows.join(stratified_folds(rows.select("pid", "uid"), folds).select("pid", "fold"), "pid")
    data = persisted(placed.select("pid", "uid", F.col("uid").alias("label"), "fold", "features"), "folds")
    weights = fit_softmax_folds(data, _classes(data), folds, iterations=iterations)
    held = _predicted(data, weights, F.col("fold"))
    return (
        held.groupBy("fold")
        .agg(F.count("*").alias("total"), F.sum((F.col("uid_pred") == F.col("uid")).cast("bigint")).alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("total"))
    )


def stacking_final(dev: DataFrame, test: DataFrame, models: list[int], iterations: int = 100) -> DataFrame:
    """(pid, uid_pred) of the test rows by a model of all dev rows."""
    rows = stack_features(dev, models).select("uid", F.col("uid").alias("label"), F.lit(-1).alias("fold"), "features")
    data = persisted(rows, "stack")
    weights = fit_softmax_folds(data, _classes(data), 0, iterations=iterations)
    return _predicted(stack_features(test, models), weights, F.lit(0)).select("pid", "uid_pred")
