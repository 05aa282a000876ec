"""What several training-data operators share: tables, row keys, size-checked
broadcasts, fixed-size bit maps, and UTF-8 access to Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.runtime import persisted

#: Rows of two numbers; about 80 MB as a broadcast table.
BROADCAST_ROWS = 2_000_000
_CHUNK = 15


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_hash(text: str = "text") -> Column:
    """With ``doc_id`` the key of a row: rows that share both are copies of one row."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\u0000")))


def whole_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row that tells null from other values."""
    parts = []
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        parts += [F.to_json(F.struct(value)) if "map<" in field.dataType.simpleString() else value, value.isNull()]
    return F.xxhash64(*parts)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for every row, written once: all that read it see the same
    numbers, even if a task is repeated, and copies of one row are no common key."""
    return persisted(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def same_row(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> Column:
    """Equality on ``names`` in which null equals null; can still be hashed."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` has not got, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only after counting that ``df`` has at most ``rows``
    rows; larger tables are joined by a shuffle with the same result."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """The set of ``column`` modulo 2^bits as a bit map of exactly 2^bits / 8 bytes.

    ``column`` holds uniform 64-bit hashes.  The size is fixed however many rows
    there are, so it may be broadcast; a full map only lets more rows pass."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(1 << _CHUNK, dtype=np.uint8)
        row[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "packed": [np.packbits(row, bitorder="little").tobytes()]})

    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    places = df.filter(F.col(column).isNotNull()).select(
        F.shiftright(at, _CHUNK).cast("int").alias("chunk"), at.bitwiseAND(F.lit((1 << _CHUNK) - 1)).cast("int").alias("bit")
    )
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    width = (1 << _CHUNK) // 8
    for row in places.distinct().groupBy("chunk").applyInPandas(pack, "chunk int, packed binary").collect():
        out[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(row.packed, dtype=np.uint8)
    return out


def in_bitmap(found: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.uint64(len(found) * 8 - 1)
    return (found[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null is empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or raw[2] is None:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    data = np.frombuffer(raw[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets.astype(np.int64) - offsets[0], data


def blocks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows [lo, hi) with about ``size`` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi
        lo = hi
