"""Term tables: from a ``tokens`` array column to long (pid, gram, ...) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.runtime import small_batches

#: Terms that a worker counts at once, some 60 bytes each; a text with more is one count.
TERMS = 1 << 19


def with_tokens(docs: DataFrame, tokens: Column) -> DataFrame:
    """``docs`` with its text replaced by a ``tokens`` column (text is pruned)."""
    keep = [c for c in docs.columns if c in ("pid", "uid", "split", "label")]
    return docs.select(*keep, tokens.alias("tokens"))


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per term occurrence: the other columns, ``pos``, ``gram``.

    The outer form plus a null test is used because the plain form makes the
    optimizer add a filter on the array's size, which tokenises every text a
    second time."""
    rest = [c for c in docs.columns if c != "tokens"]
    return docs.select(*rest, F.posexplode_outer("tokens").alias("pos", "gram")).filter("gram IS NOT NULL")


def distinct_terms(docs: DataFrame) -> DataFrame:
    """One row per (document, term), deduplicated inside the row: no shuffle."""
    rest = [c for c in docs.columns if c != "tokens"]
    return docs.select(*rest, F.explode_outer(F.array_distinct("tokens")).alias("gram")).filter("gram IS NOT NULL")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Successive rows with at most ``TERMS`` terms together, or a single row."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index("tokens")).value_lengths().fill_null(0)
        ends, at = np.cumsum(sizes.to_numpy(zero_copy_only=False)), 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + TERMS, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _grouped(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The occurrences of a batch sorted by (row, term, place): sorted places, where each
    group begins, the groups' rows, their terms' numbers, and the terms."""
    lists = batch.column(batch.schema.get_field_index("tokens"))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    terms = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), sizes)
    width = max(len(terms.dictionary), 1)
    key = row * width + terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    place = order - np.repeat(np.cumsum(sizes) - sizes, sizes)[order]
    return place, begin, key[begin] // width, key[begin] % width, terms.dictionary


def counts(docs: DataFrame) -> DataFrame:
    """(other columns, gram, cnt, first_pos) per document.

    A document's terms are counted inside its own row, a bounded part of an Arrow batch at a time, so
    neither text nor terms are shuffled.  Two rows with one pid are two documents."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "tokens"]
    term = docs.schema["tokens"].dataType.elementType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            place, begin, row, code, terms = _grouped(batch)
            size = np.diff(begin, append=len(place))
            columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in rest]
            yield pa.RecordBatch.from_arrays(
                [*columns, terms.take(pa.array(code)), pa.array(size), pa.array(place[begin])], [*rest, "gram", "cnt", "first_pos"]
            )

    schema = T.StructType(
        [docs.schema[c] for c in rest]
        + [T.StructField("gram", term), T.StructField("cnt", T.LongType()), T.StructField("first_pos", T.LongType())]
    )
    return docs.select(*rest, "tokens").mapInArrow(count, schema)


def places(docs: DataFrame) -> DataFrame:
    """(other columns, gram, pos): every distinct term of a document with the array of its
    places in the text, found inside the row like :func:`counts`."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "tokens"]
    term = docs.schema["tokens"].dataType.elementType

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            place, begin, row, code, terms = _grouped(batch)
            ends = pa.array(np.append(begin, len(place)), pa.int32())
            columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in rest]
            lists = pa.ListArray.from_arrays(ends, pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, terms.take(pa.array(code)), lists], [*rest, "gram", "pos"])

    schema = T.StructType(
        [docs.schema[c] for c in rest] + [T.StructField("gram", term), T.StructField("pos", T.ArrayType(T.IntegerType()))]
    )
    return docs.select(*rest, "tokens").mapInArrow(find, schema)


def map_grams(docs: DataFrame, change) -> DataFrame:
    """Apply a column function to every term of every document."""
    return docs.withColumn("tokens", F.transform("tokens", change))
