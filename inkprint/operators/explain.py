"""Local explanation of one document's prediction: perturb its binary
features, ask the model, fit a weighted linear model to the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.runtime import persisted

#: Features whose normal equations (their number squared, eight bytes each) the driver may solve.
FEATURES = 4096


def perturbations(cells: DataFrame, docs: DataFrame, vocabulary: DataFrame, pid: int, samples: int, seed: int = 0) -> DataFrame:
    """(pid, idx, present, differs): the features that a sample has, or in which it differs from the
    document.  Sample 0 is the document itself; in the others every feature is drawn
    with its frequency over ``docs``.

    A draw is a hash of (seed, sample, feature), so a lost task repeats it, and features stay a
    table: each is drawn for all samples where it is."""
    size = docs.agg(F.count("*")).scalar()
    stats = cells.groupBy("idx").agg(F.count("*").alias("df"), F.max(F.when(F.col("pid") == pid, 1).otherwise(0)).alias("own"))
    table = vocabulary.select("idx").join(stats, "idx", "left").select(
        "idx", F.coalesce(F.col("df") / size, F.lit(0.0)).alias("p"), F.coalesce("own", F.lit(0)).cast("boolean").alias("own")
    )
    drawn = table.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint"))).alias("pid"))
    share = F.pmod(F.xxhash64(F.lit(seed), "pid", "idx"), F.lit(1 << 53)) / float(1 << 53)
    present = F.when(F.col("pid") == 0, F.col("own")).otherwise(share < F.col("p"))
    return drawn.select("pid", "idx", present.alias("present"), "own").select(
        "pid", "idx", "present", (F.col("present") != F.col("own")).alias("differs")
    ).filter("present OR differs")


def normal_equations(rows: DataFrame, width: int, answers: int) -> np.ndarray:
    """A'WA for A = [differences, 1, answers] of the rows (differs: places below ``width``, w,
    y: ``answers`` numbers).

    Tasks add up their own matrices, a row of which is a row for the shuffle that adds the
    tasks'; the driver gets (width + 1 + answers)^2 numbers."""
    whole = width + 1 + answers

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((whole, whole))
        for frame in frames:
            for lo in range(0, len(frame), 1024):
                part = frame.iloc[lo : lo + 1024]
                a = np.zeros((len(part), whole))
                for i, places in enumerate(part["differs"]):
                    a[i, np.asarray(places, dtype=np.int64)] = 1.0
                a[:, width] = 1.0
                a[:, width + 1 :] = np.vstack(part["y"].to_numpy())
                out += (a * part["w"].to_numpy()[:, None]).T @ a
        yield pd.DataFrame({"i": np.arange(whole), "row": list(out)})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], "row": [np.sum(np.vstack(frame["row"].to_numpy()), axis=0)]})

    kind = "i int, row array<double>"
    out = np.zeros((whole, whole))
    for r in rows.select("differs", "w", "y").mapInPandas(add, kind).groupBy("i").applyInPandas(join, kind).collect():
        out[r.i] = r.row
    return out


def ridge(equations: np.ndarray, places: np.ndarray, answer: int, alpha: float, one: int) -> np.ndarray:
    """Coefficients of agreement in ``places`` for the column ``answer``, with a free
    intercept (column ``one``) and penalty ``alpha``; agreeing is the opposite of differing."""
    mass, means = equations[one, one], equations[one] / equations[one, one]
    centred = equations[np.ix_(places, places)] - mass * np.outer(means[places], means[places])
    right = equations[places, answer] - mass * means[places] * means[answer]
    return -np.linalg.solve(centred + alpha * np.eye(len(places)), right)


def local_explanation(
    cells: DataFrame,
    docs: DataFrame,
    vocabulary: DataFrame,
    pid: int,
    scorer: Callable[[DataFrame, DataFrame], DataFrame],
    labels: int | list[int] = 1,
    samples: int = 10_000,
    top: int = 25,
    seed: int = 0,
) -> DataFrame:
    """(label, rank, idx, gram, weight): the ``top`` features that speak most for or
    against each of ``labels``: given ones, or that many of the document's likeliest.

    ``scorer(samples, cells)`` gives (pid, label, p) of samples (pid) with cells (pid, idx, value),
    so the model may be a table of any size.  Samples weigh exp(-differences / (2 * 0.75^2 * features)).
    All features are fitted by weighted ridge regression (penalty 0.01), the largest
    ``top`` again by themselves (penalty 1); both come from one set of normal equations, added up
    where the samples are."""
    numbered = vocabulary.select("idx", "gram")
    width = numbered.agg(F.max("idx")).first()[0]
    width = 0 if width is None else width + 1
    if width > FEATURES:
        raise ValueError(f"{width} features are more than {FEATURES}")
    drawn = persisted(perturbations(cells, docs, vocabulary, pid, samples, seed), "drawn")
    ids = cells.sparkSession.range(samples).withColumnRenamed("id", "pid")
    answers = persisted(scorer(ids, drawn.filter("present").select("pid", "idx", F.lit(1.0).alias("value"))), "answers")
    if isinstance(labels, int):
        likely = answers.filter("pid = 0").orderBy(F.desc("p"), "label").limit(labels)
        labels = [r.label for r in likely.collect()]
    asked = F.array(*[F.coalesce(F.max(F.when(F.col("label") == x, F.col("p"))), F.lit(0.0)) for x in labels])
    apart = drawn.filter("differs").groupBy("pid").agg(F.collect_list("idx").alias("differs"))
    rows = answers.groupBy("pid").agg(asked.alias("y")).join(apart, "pid", "left")
    rows = rows.select("pid", F.coalesce("differs", F.array().cast("array<bigint>")).alias("differs"), "y")
    scale = 2 * 0.75**2 * max(width, 1)
    found = normal_equations(rows.withColumn("w", F.exp(-F.size("differs") / scale)), width, len(labels))
    out = []
    for k, label in enumerate(labels):
        first = ridge(found, np.arange(width), width + 1 + k, 0.01, width)
        chosen = np.sort(np.argsort(-np.abs(first), kind="stable")[:top])
        weights = ridge(found, chosen, width + 1 + k, 1.0, width)
        order = np.lexsort((chosen, -np.abs(weights)))
        out += [(int(label), r, int(chosen[i]), float(weights[i])) for r, i in enumerate(order, 1)]
    spoken = cells.sparkSession.createDataFrame(out, "label bigint, rank bigint, idx bigint, weight double")
    return spoken.join(numbered, "idx").select("label", "rank", "idx", "gram", "weight")
