"""Feature vectors as long tables (pid, idx, value) holding the non-zero cells.

The vocabulary side of each join is a fitted (stored) table, so Catalyst knows
its size: small ones are broadcast and the document side is not shuffled at
all, large ones fall back to a shuffled join with adaptive skew splitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from inkprint.operators.grams import counts, distinct_terms, places
from inkprint.runtime import small_batches


def binary(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """1 for every vocabulary term present; no aggregation needed."""
    terms = distinct_terms(docs.select("pid", "tokens"))
    return terms.join(vocabulary.select("gram", "idx"), "gram").select("pid", "idx", F.lit(1.0).alias("value"))


def count(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences of every vocabulary term; no aggregation, as a document counts its own."""
    found = counts(docs.select("pid", "tokens")).join(vocabulary.select("gram", "idx"), "gram")
    return found.select("pid", "idx", F.col("cnt").cast("double").alias("value"))


def tree_tfidf(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """count / all terms of the document (known or not) * ln(N / df), not normalised."""
    found = counts(docs.select("pid", F.size("tokens").alias("terms"), "tokens"))
    weight = F.col("cnt") / F.col("terms") * F.log(F.col("n") / F.col("df"))
    return found.join(vocabulary.select("gram", "idx", "df", "n"), "gram").select("pid", "idx", weight.alias("value"))


def tfidf(docs: DataFrame, model: DataFrame, sublinear: bool) -> DataFrame:
    """tf * (ln((1+N)/(1+df)) + 1), rows scaled to length 1; tf is the count or
    1 + ln(count).

    Documents count their own terms, so what is shuffled for the length is a number per
    known term of a document, never text."""
    found = counts(docs.select("pid", "tokens")).join(model, "gram")
    tf = 1 + F.log("cnt") if sublinear else F.col("cnt")
    weighted = found.select("pid", "idx", (tf * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("pid")))
    return weighted.select("pid", "idx", (F.col("w") / norm).alias("value"))


def positions(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(pid, ids): vocabulary numbers in text order, unknown terms dropped.

    A row per known distinct term, with its places, is joined and gathered: one
    document's terms form one group, as they do in the input row.  The places are told
    apart and sorted only in the finished group: four bytes each until then."""
    small_batches(docs.sparkSession)
    found = places(docs.select("pid", "tokens")).join(vocabulary.select("gram", F.col("idx").cast("bigint").alias("idx")), "gram")
    held = found.groupBy("pid").agg(F.collect_list(F.struct("idx", "pos")).alias("held"))
    # Sorted above the join: below it, a function would hide how the groups lie and they would be shuffled again.
    return docs.select("pid").join(held, "pid", "left").select("pid", _in_text_order("held").alias("ids"))


@arrow_udf(T.ArrayType(T.LongType()))
def _in_text_order(held: pa.Array) -> pa.Array:
    """Each row's numbers by place, then number; none for a null."""
    terms = held.flatten()
    spots = pc.struct_field(terms, "pos")
    often = spots.value_lengths().to_numpy(zero_copy_only=False)
    sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.repeat(np.arange(len(held)), sizes), often)
    ids = np.repeat(pc.struct_field(terms, "idx").to_numpy(zero_copy_only=False), often)
    order = np.lexsort((ids, row * 2**31 + spots.flatten().to_numpy(zero_copy_only=False)))
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(held))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[order], pa.int64()))


def sequence_ids(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(pid, ids): numbers from 1 in text order (0 is the padding)."""
    shifted = F.transform("ids", lambda i: (i + 1).cast("int"))
    return positions(docs, vocabulary).select("pid", shifted.alias("ids"))


def cells(dense: DataFrame, column: str = "features") -> DataFrame:
    """Long non-zero cells of an array column."""
    long = dense.select("pid", F.posexplode_outer(column).alias("idx", "value"))
    return long.select("pid", F.col("idx").cast("bigint").alias("idx"), F.col("value").cast("double").alias("value")).filter(
        "value <> 0"
    )


def minmax_fit(cells_: DataFrame, documents: int | F.Column) -> DataFrame:
    """(idx, low, high) over training cells; cells not stored count as 0."""
    size = F.lit(documents) if isinstance(documents, int) else documents
    seen = cells_.groupBy("idx").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("stored")
    )
    partial = F.col("stored") < size
    return seen.select(
        "idx",
        F.when(partial, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("low"),
        F.when(partial, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("high"),
    )


def minmax_transform(cells_: DataFrame, model: DataFrame, pids: DataFrame) -> DataFrame:
    """(x - low) / (high - low), not clipped; a constant column only loses its
    minimum.  Cells that are not stored are 0 and move too where low is not 0;
    those few columns are carried as one array, not joined.

    Cells are shuffled by document, once: nothing is saved by grouping them before, as few have
    two rows, and what gathers a document's cells afterwards finds them together."""
    span = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    moved = cells_.join(model, "idx").select(
        "pid", "idx", ((F.col("value") - F.col("low")) / span).alias("value"), F.lit(1).alias("stored")
    )
    zeros = model.filter("low <> 0").agg(
        F.collect_list(F.struct("idx", ((0 - F.col("low")) / span).alias("value"))).alias("z")
    ).scalar()
    implied = pids.select("pid", F.inline(zeros)).withColumn("stored", F.lit(0))
    return (
        moved.unionByName(implied)
        .repartition("pid")
        .groupBy("pid", "idx")
        .agg(F.max_by("value", "stored").alias("value"))
        .filter("value <> 0")
    )


def varying(cells_: DataFrame, documents: int | F.Column) -> DataFrame:
    """(idx): columns that are not constant over the training documents."""
    return minmax_fit(cells_, documents).filter("low <> high").select("idx")


def drop_invariant(cells_: DataFrame, kept: DataFrame) -> DataFrame:
    return cells_.join(kept, "idx", "left_semi")


def one_hot(uid: F.Column, classes: int) -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: i == uid)


def decode_one_hot(flags: F.Column) -> F.Column:
    return F.array_position(flags, True) - 1


def concat_views(views: list[tuple[DataFrame, int]]) -> DataFrame:
    """Features of several views side by side: each view's columns start where
    the widths of the views before it end.  A union, so nothing is joined."""
    start, out = 0, None
    for cells_, width in views:
        moved = cells_.select("pid", (F.col("idx") + start).alias("idx"), "value")
        out = moved if out is None else out.unionByName(moved)
        start += width
    return out


@F.udf(VectorUDT(), useArrow=False)
def _sparse(width, idx, values):
    return Vectors.sparse(width, idx, values)


def to_vectors(cells_: DataFrame, pids: DataFrame, width: int) -> DataFrame:
    """(…pids columns, features): one sparse ML vector per document, also for
    documents without any cell."""
    rows = cells_.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("c"))
    joined = pids.join(rows, "pid", "left")
    idx = F.coalesce(F.transform("c", lambda x: x["idx"].cast("int")), F.array().cast("array<int>"))
    values = F.coalesce(F.transform("c", lambda x: x["value"]), F.array().cast("array<double>"))
    return joined.select(*pids.columns, _sparse(F.lit(width), idx, values).alias("features"))
