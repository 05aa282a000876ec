"""Classifiers over (pid, idx, value) cells or ML vectors.

Nearest neighbours and naive Bayes are exact and written as table work; the
iterative models (MLlib's, and the machines of all class pairs) are not
numerically equal to other solvers'."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.operators.solvers import fit_pairs, pair_votes
from inkprint.runtime import persisted, small_batches


#: Classes whose scores stand side by side in a row.
CLASSES = 16


def argmax(scores: Column) -> Column:
    """Index of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("bigint")


def random_baseline(docs: DataFrame, classes: int, seed: int = 0) -> DataFrame:
    """A uniform class per document: the first 32 bits of the MD5 sum of "seed:pid", so a
    re-run, another partitioning or another engine gives the same answer."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("pid").cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return docs.select("*", F.pmod(number, F.lit(classes)).cast("bigint").alias("uid_pred"))


# ------------------------------------------------------------ nearest neighbours

_BLOCK = 1024  # documents per side of one product of blocks
_QUERY_PARTS, _SHARES = 64, 8  # partitions of the query blocks and of the training blocks at most

#: Query numbers, squared distances, neighbours and their labels.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _rows(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """One sparse row per document of ``docs``, also for those without cells."""
    packed = cells.groupBy("pid").agg(F.collect_list(F.struct("idx", "value")).alias("c"))
    return docs.join(packed, "pid", "left").select(
        *docs.columns,
        F.coalesce(F.transform("c", lambda x: x["idx"]), F.array().cast("array<bigint>")).alias("idx"),
        F.coalesce(F.transform("c", lambda x: x["value"]), F.array().cast("array<double>")).alias("value"),
    )


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]


def _packed(rows: DataFrame, blocks: int, parts: int) -> DataFrame:
    """One row for each of ``blocks`` blocks of documents (pid, label, idx, value), which a
    hash of the pid deals, over ``parts`` partitions."""

    def pack(table: pa.Table) -> pa.Table:
        cells = {c: table[c].combine_chunks() for c in ("idx", "value")}
        sizes = cells["idx"].value_lengths().to_numpy(zero_copy_only=False).astype("int32")
        flat = {c: x.flatten().to_numpy(zero_copy_only=False).astype("f8" if c == "value" else "i8") for c, x in cells.items()}
        whole = pa.array([0, len(table)], pa.int32())
        held = {c: pa.ListArray.from_arrays(whole, table[c].combine_chunks()) for c in ("pid", "label")}
        return pa.table({"block": table["block"].slice(0, 1), **held, "sizes": [sizes.tobytes()], **{c: [x.tobytes()] for c, x in flat.items()}})

    block = F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int").alias("block")
    label = F.col("label").cast("bigint").alias("label")
    packed = rows.select(block, F.col("pid").cast("bigint").alias("pid"), label, "idx", "value").groupBy("block").applyInArrow(
        pack, "block int, pid array<bigint>, label array<bigint>, sizes binary, idx binary, value binary"
    )
    return packed.repartition(parts, "block")


def _unpacked(batch: pa.RecordBatch, row: int, side: str) -> tuple[np.ndarray, np.ndarray, Cells]:
    """(pids, labels, (row number, column, value) of all cells) of a block."""
    got = {c: batch.column(batch.schema.get_field_index(f"{side}_{c}"))[row] for c in ("pid", "label", "sizes", "idx", "value")}
    pids, labels = (got[c].values.to_numpy(zero_copy_only=False) for c in ("pid", "label"))
    sizes, columns, values = (np.frombuffer(got[c].as_buffer(), kind) for c, kind in (("sizes", "i4"), ("idx", "i8"), ("value", "f8")))
    return pids, labels, (np.repeat(np.arange(len(sizes)), sizes), columns, values)


def _dense(cells: tuple[np.ndarray, np.ndarray, np.ndarray], height: int, used: np.ndarray) -> np.ndarray:
    row, column, value = cells
    out = np.zeros((height, len(used)))
    if len(used):
        at = np.minimum(np.searchsorted(used, column), len(used) - 1)
        known = used[at] == column
        out[row[known], at[known]] = value[known]
    return out


def _squares(cells: tuple[np.ndarray, np.ndarray, np.ndarray], height: int) -> np.ndarray:
    return np.bincount(cells[0], weights=cells[2] ** 2, minlength=height)


def _best(k: int, q: np.ndarray, d2: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Found:
    """The ``k`` nearest of each query, ties by pid."""
    order = np.lexsort((ids, d2, q))
    q = q[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    order = order[kept]
    return q[kept], d2[order], ids[order], labels[order]


def _nearest_in_block(k: int, left: Cells, height: int, right: Cells, ids: np.ndarray, labels: np.ndarray) -> Found:
    used = np.intersect1d(left[1], right[1])  # only shared columns add to a dot product
    dots = _dense(left, height, used) @ _dense(right, len(ids), used).T
    d2 = _squares(left, height)[:, None] + _squares(right, len(ids))[None, :] - 2 * dots
    d2 = np.round(d2, 9) + 0.0
    last = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(ids) > k else d2.max(axis=1)
    q, t = np.nonzero(d2 <= last[:, None])
    return _best(k, q, d2[q, t], ids[t], labels[t])


def _nearest(k: int):
    """Pairs of blocks to (pid, neighbour, label, d2): a task keeps the ``k`` best of a query
    block while it meets training blocks, and gives them when the next one begins."""

    def rows(pids: np.ndarray, found: Found) -> pa.RecordBatch:
        q, d2, ids, labels = found
        whole = [pa.array(x, from_pandas=True).cast(pa.int64()) for x in (pids[q], ids, labels)]
        return pa.RecordBatch.from_arrays([*whole, pa.array(d2)], ["pid", "neighbour", "label", "d2"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pids, found = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                now = batch.column(batch.schema.get_field_index("q_block"))[row].as_py()
                own, _, left = _unpacked(batch, row, "q")
                ids, labels, right = _unpacked(batch, row, "t")
                more = _nearest_in_block(k, left, len(own), right, ids, labels)
                if now == block:
                    found = _best(k, *(np.concatenate(x) for x in zip(found, more, strict=True)))
                    continue
                if found is not None:
                    yield rows(pids, found)
                block, pids, found = now, own, more
        if found is not None:
            yield rows(pids, found)

    return nearest


def neighbours(
    train_cells: DataFrame, train: DataFrame, query_cells: DataFrame, queries: DataFrame, k: int = 25, block: int = _BLOCK
) -> DataFrame:
    """(pid, neighbour, label, d2): the ``k`` training documents (pid, label)
    nearest to each query document by Euclidean distance, ties by pid.

    Exact.  Both sides are packed once into blocks of bounded size by a hash of the
    pid, and the tasks of a Cartesian product multiply a query block with one training block
    after another.  The product reads the shuffled blocks again for every task and writes
    nothing; a task emits each query's ``k`` best of its share of the training blocks, of
    which there are at most ``_SHARES``.  So disk grows with the input, only the time
    with the number of pairs."""
    small_batches(train.sparkSession)
    query_blocks = max(1, math.ceil(queries.count() / block))
    train_blocks = max(1, math.ceil(train.count() / block))
    asked = queries.select("pid", F.lit(None).cast("bigint").alias("label"))
    left = _packed(_rows(query_cells, asked), query_blocks, min(query_blocks, _QUERY_PARTS))
    right = _packed(_rows(train_cells, train.select("pid", "label")), train_blocks, min(train_blocks, _SHARES))
    pairs = left.select(*[F.col(c).alias(f"q_{c}") for c in left.columns]).hint("shuffle_replicate_nl").crossJoin(
        right.select(*[F.col(c).alias(f"t_{c}") for c in right.columns])
    )
    found = pairs.mapInArrow(_nearest(k), "pid bigint, neighbour bigint, label bigint, d2 double")
    order = Window.partitionBy("pid").orderBy("d2", "neighbour")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def vote(near: DataFrame) -> DataFrame:
    """(pid, uid_pred): most frequent label, ties to the smallest."""
    votes = near.groupBy("pid", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("pid").agg(F.max(F.struct("votes", (-F.col("label")).alias("low"))).alias("top")).select(
        "pid", (-F.col("top.low")).alias("uid_pred")
    )


# ------------------------------------------------------------------ naive Bayes


def fit_multinomial_nb(cells: DataFrame, labels: DataFrame, features: int | Column) -> tuple[DataFrame, DataFrame]:
    """(classes, weights): per class ``prior`` = ln(n_c/N) and ``base`` =
    ln(N_c + V); per (class, idx) ``weight`` = ln(N_cj + 1).  Absent weights
    are ln(1) = 0, so only cells that occur are stored."""
    width = F.lit(features) if isinstance(features, int) else features
    sums = cells.join(labels.select("pid", "label"), "pid").groupBy("label", "idx").agg(F.sum("value").alias("s"))
    totals = sums.groupBy("label").agg(F.sum("s").alias("mass"))
    size = labels.agg(F.count("*")).scalar()
    classes = (
        labels.groupBy("label")
        .agg(F.count("*").alias("docs"))
        .join(totals, "label", "left")
        .select(
            "label",
            F.log(F.col("docs") / size).alias("prior"),
            F.log(F.coalesce("mass", F.lit(0.0)) + width).alias("base"),
        )
    )
    return classes, sums.select("label", "idx", F.log(F.col("s") + 1).alias("weight"))


def class_postings(weights: DataFrame) -> DataFrame:
    """(idx, block, weights): a row for each feature and ``CLASSES`` successive classes, with a
    weight for each of them; a weight that is not stored is 0."""
    one = lambda c: F.coalesce(F.max(F.when(F.pmod("label", F.lit(CLASSES)) == c, F.col("weight"))), F.lit(0.0))
    block = F.floor(F.col("label") / CLASSES).alias("block")
    return weights.groupBy("idx", block).agg(F.array(*[one(c) for c in range(CLASSES)]).alias("weights"))


def nb_blocks(docs: DataFrame, cells: DataFrame, classes: DataFrame, postings: DataFrame) -> DataFrame:
    """(pid, block, scores): joint log likelihoods of ``CLASSES`` successive classes side by
    side, null for numbers that are no class; ``postings`` from :func:`class_postings`.

    score = prior + sum x*ln(N_cj+1) - sum x*ln(N_c+V): the first sum adds up vectors of
    classes, so a document is a row for each block of classes and never one for each
    class; the second needs only the document's mass."""
    own = cells.select("pid", "idx", "value")
    sums = [F.sum(F.col("value") * F.col("weights")[c]).alias(f"s{c}") for c in range(CLASSES)]
    met = own.join(postings, "idx").groupBy("pid", "block").agg(*sums)
    mass = own.groupBy("pid").agg(F.sum("value").alias("mass"))
    one = lambda name, c: F.max(F.when(F.pmod("label", F.lit(CLASSES)) == c, F.col(name)))
    known = classes.groupBy(F.floor(F.col("label") / CLASSES).alias("block")).agg(
        *[F.array(*[one(name, c) for c in range(CLASSES)]).alias(name) for name in ("prior", "base")]
    )
    last = classes.agg(F.coalesce(F.floor(F.max("label") / CLASSES), F.lit(0))).scalar()
    placed = docs.select("pid", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block")).join(known, "block")
    rows = placed.join(mass, "pid", "left").join(met, ["pid", "block"], "left")
    scores = [
        F.col("prior")[c] - F.coalesce("mass", F.lit(0.0)) * F.col("base")[c] + F.coalesce(f"s{c}", F.lit(0.0)) for c in range(CLASSES)
    ]
    return rows.select("pid", "block", F.array(*scores).alias("scores"))


def nb_scores(docs: DataFrame, cells: DataFrame, classes: DataFrame, weights: DataFrame) -> DataFrame:
    """(pid, label, score): joint log likelihood of every class, a row each."""
    found = nb_blocks(docs, cells, classes, class_postings(weights))
    long = found.select("pid", "block", F.posexplode("scores").alias("c", "score")).filter("score IS NOT NULL")
    return long.select("pid", (F.col("block") * CLASSES + F.col("c")).cast("bigint").alias("label"), "score")


def nb_best(blocks: DataFrame) -> DataFrame:
    """(pid, uid_pred, score) like :func:`best_label`: the best class is found in each row."""
    made = F.transform(
        "scores",
        lambda s, c: F.struct(F.round(s, 9).alias("score"), (-(F.col("block") * CLASSES + c)).cast("bigint").alias("low")),
    )
    best = F.array_max(F.filter(made, lambda x: x["score"].isNotNull()))
    top = blocks.select("pid", best.alias("best")).groupBy("pid").agg(F.max("best").alias("top"))
    return top.select("pid", (-F.col("top.low")).alias("uid_pred"), F.col("top.score").alias("score"))


def probabilities(scores: DataFrame) -> DataFrame:
    """(pid, label, p) from joint log likelihoods (pid, label, score)."""
    mine = Window.partitionBy("pid")
    power = scores.withColumn("power", F.exp(F.col("score") - F.max("score").over(mine)))
    return power.select("pid", "label", (F.col("power") / F.sum("power").over(mine)).alias("p"))


def best_label(scores: DataFrame) -> DataFrame:
    """(pid, uid_pred, score): highest score rounded to 9 places, ties to the
    smallest label."""
    best = F.struct(F.round("score", 9).alias("score"), (-F.col("label")).alias("low"))
    top = scores.groupBy("pid").agg(F.max(best).alias("top"))
    return top.select("pid", (-F.col("top.low")).alias("uid_pred"), F.col("top.score").alias("score"))


# ------------------------------------------------------------------ MLlib models


def fit_logistic(vectors: DataFrame, c: float = 1.0, iterations: int = 100):
    """Multinomial logistic regression with the L2 penalty written per sample:
    regParam = 1/(C*n), no standardisation."""
    size = vectors.count()
    return LogisticRegression(
        family="multinomial", maxIter=iterations, regParam=1.0 / (c * max(size, 1)), standardization=False
    ).fit(vectors)


def random_fourier(features: Column, width: int, gamma: float, dims: int = 256, seed: int = 0) -> Column:
    """Approximate RBF feature map: sqrt(2/D) cos(Wx + b) with seeded W and b."""
    draw = np.random.default_rng(seed)
    w = draw.normal(0.0, math.sqrt(2 * gamma), (dims, width))
    b = draw.uniform(0, 2 * math.pi, dims)
    scale = math.sqrt(2.0 / dims)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(x: pd.Series) -> pd.Series:
        mapped = scale * np.cos(np.vstack(x.to_numpy()) @ w.T + b) if len(x) else np.zeros((0, dims))
        return pd.Series(list(mapped))

    return project(features)


def fit_svm(rows: DataFrame, width: int, dims: int = 256, iterations: int = 200, c: float = 1.0):
    """RBF support vector machines, one for every two classes, and a vote of the pairs.

    The kernel is approximated by random Fourier features of the array column
    ``features``, gamma is 1 / (width * variance), and the machines of all pairs are
    trained together (:func:`inkprint.operators.solvers.fit_pairs`), until their gradients are small.  Vote ties
    go to the smallest label.  Not numerically equal to a kernel solver."""
    small_batches(rows.sparkSession)
    spread = rows.select(F.explode("features").alias("x")).agg(F.var_pop("x")).first()[0] or 1.0
    gamma = 1.0 / (width * spread)
    labels = [r.label for r in rows.select("label").distinct().orderBy("label").collect()]
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1
    mapped = rows.select(number.alias("label"), random_fourier(F.col("features"), width, gamma, dims).alias("features"))
    machines = fit_pairs(persisted(mapped, "mapped"), len(labels), c, iterations)

    @F.pandas_udf("bigint")
    def voted(x: pd.Series) -> pd.Series:
        if not len(x) or len(labels) < 2:
            return pd.Series([labels[0] if labels else -1] * len(x), dtype="int64")
        decisions = np.vstack(x.to_numpy()) @ machines[:, :-1].T + machines[:, -1]
        return pd.Series(np.array(labels, dtype=np.int64)[pair_votes(decisions, len(labels))])

    def predict(queries: DataFrame) -> DataFrame:
        return queries.select("pid", voted(random_fourier(F.col("features"), width, gamma, dims)).alias("uid_pred"))

    return predict


def vote_of_pairs(decisions: Column, classes: int) -> Column:
    """The class that wins most of its pairs, ties to the smallest, from one decision value
    for each pair (0, 1), (0, 2) ...; a value above 0 speaks for the first of the two."""

    @F.pandas_udf("bigint")
    def voted(values: pd.Series) -> pd.Series:
        return pd.Series(pair_votes(np.vstack(values.to_numpy()), classes) if len(values) else [], dtype="int64")

    return voted(decisions)


def fit_mlp(vectors: DataFrame, layers: list[int], iterations: int = 100, seed: int = 0):
    """Feed-forward network with a soft-max output over ``layers[-1]`` classes
    (MLlib's: sigmoid hidden units, no drop-out)."""
    return MultilayerPerceptronClassifier(layers=layers, maxIter=iterations, seed=seed).fit(vectors)


def persisted_vectors(vectors: DataFrame) -> DataFrame:
    """Training vectors written once: an iterative fit then re-reads files
    instead of re-tokenising on every pass."""
    return persisted(vectors, "vectors")


def predict_proba(model, vectors: DataFrame) -> DataFrame:
    """(…, probs) with one probability per class, in class order."""
    keep = [c for c in vectors.columns if c != "features"]
    return model.transform(vectors).select(*keep, vector_to_array("probability").alias("probs"))


def predict_label(probabilities: DataFrame, column: str = "probs") -> DataFrame:
    keep = [c for c in probabilities.columns if c != column]
    return probabilities.select(*keep, argmax(F.col(column)).alias("uid_pred"))


def batch_score(
    rows: DataFrame, scorer: Callable[[pd.DataFrame], np.ndarray], batch: int = 1000, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(keep, pid, probs) from a user's scorer, called on bounded batches of rows
    inside the tasks that hold them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                scores = np.asarray(scorer(part), dtype="float64")
                yield part[[*keep, "pid"]].assign(probs=list(scores))

    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInPandas(run, ", ".join([*fields, "pid bigint", "probs array<double>"]))
