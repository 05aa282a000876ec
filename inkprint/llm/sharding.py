"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 64-bit hashes; a key belongs to
the first point clockwise of its hash.  A shard takes no more rows than its
bound, and keys that overflow a full shard continue clockwise to the next shard
with room.  The bounds add up to the number of rows, so shard sizes differ by
one row at most, and only overflowing keys ever leave their own shard.

The keys of one arc of the ring go the same way, so what overflows is decided
on the number of rows of each arc (shards x vnodes numbers) and a row only
needs its rank in its arc, which a range sort gives without any single task.

A null doc_id is a key like any other.  Repeated rows and a hot key lie in one
arc and overflow like others.  An empty table gives no rows.  Other columns of
``docs`` are kept.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import fresh, numbered, table, text_hash, whole_hash
from inkprint.llm.hashing import mix
from inkprint.runtime import persisted, ranked

SHARDS, VNODES = 24, 64


class Ring(NamedTuple):
    points: np.ndarray  # sorted
    owners: np.ndarray


def ring(shards: int = SHARDS, vnodes: int = VNODES) -> Ring:
    """The points of a shard depend on its number only, so one more shard moves no point."""
    owners = np.repeat(np.arange(shards), vnodes)
    points = mix((owners.astype(np.uint64) << np.uint64(32)) + np.tile(np.arange(vnodes, dtype=np.uint64), shards) + np.uint64(1))
    order = np.argsort(points, kind="stable")
    return Ring(points[order], owners[order])


def bounds(rows: int, shards: int) -> list[int]:
    """Rows each shard takes at most: they differ by one and add up to ``rows``."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


class Segments(NamedTuple):
    """Runs of the rows in the order (arc, rank): first row, shard, first slot."""

    base: np.ndarray  # first row of each arc
    begins: np.ndarray
    shards: np.ndarray
    slots: np.ndarray


def assign(counts: np.ndarray, where: Ring, most: list[int]) -> Segments:
    """Which rows of each arc stay with their shard, and where the others go."""
    room = list(most)
    filled = [0] * len(most)
    parts: list[list[tuple[int, int, int]]] = [[] for _ in counts]

    def put(arc: int, shard: int, n: int) -> None:
        parts[arc].append((n, shard, filled[shard]))
        filled[shard] += n
        room[shard] -= n

    left = []
    for arc, n in enumerate(counts.tolist()):
        own = int(where.owners[arc])
        kept = min(n, room[own])
        if kept:
            put(arc, own, kept)
        left.append(n - kept)
    for arc, n in enumerate(left):
        at = arc
        while n:
            at = (at + 1) % len(counts)
            shard = int(where.owners[at])
            taken = min(n, room[shard])
            if taken:
                put(arc, shard, taken)
                n -= taken
    flat = [x for part in parts for x in part]
    sizes = np.array([x[0] for x in flat], dtype=np.int64)
    return Segments(
        np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64),
        np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes,
        np.array([x[1] for x in flat], dtype=np.int64),
        np.array([x[2] for x in flat], dtype=np.int64),
    )


def sharded(keys: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, order: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` (doc_id and small columns) with ``shard`` and its gapless ``slot``.

    ``order`` names columns that tell rows of one doc_id apart."""
    where = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        at = np.searchsorted(where.points, h.to_numpy().view(np.uint64))
        return pd.Series(np.where(at == len(where.points), 0, at).astype(np.int32))

    hashed = keys.withColumn("_h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0000"))))
    placed = persisted(hashed.withColumn("_arc", arc_of("_h")), "arcs")
    counts = np.zeros(len(where.points), dtype=np.int64)
    for row in placed.groupBy("_arc").count().collect():  # at most shards x vnodes rows
        counts[row["_arc"]] = row["count"]
    parts = assign(counts, where, bounds(int(counts.sum()), shards))

    @F.pandas_udf("shard int, slot long")
    def place(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = parts.base[arc.to_numpy()] + rank.to_numpy()
        k = np.searchsorted(parts.begins, at, side="right") - 1
        return pd.DataFrame({"shard": parts.shards[k].astype(np.int32), "slot": parts.slots[k] + at - parts.begins[k]})

    ranks = ranked(placed, [F.col(c) for c in ("_h", *order)], group=("_arc",), name="_rank")
    return ranks.withColumn("_at", place("_arc", "_rank")).select(*keys.columns, "_at.shard", "_at.slot")


def keys_of(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(
        *[F.col(c) for c in also],
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        text_hash().alias("th"),
    )


def with_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (under other names if it has these)."""
    row, whole, shard, slot = fresh(docs, "row_number", "row_hash", "shard", "slot")
    rows = numbered(docs, row)
    keys = keys_of(rows.withColumn(whole, whole_hash(docs)), also=(row, whole))
    found = sharded(keys, shards, order=("th", whole, row))
    found = found.select(F.col(row).alias("k_row"), F.col("shard").alias("k_shard"), F.col("slot").alias("k_slot"))
    both = rows.join(found, rows[row] == found["k_row"])
    return both.select(*[rows[c] for c in docs.columns], found["k_shard"].alias(shard), found["k_slot"].alias(slot))


def op5_consistent_hash_shards(spark, sf: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by one at most."""
    found = sharded(keys_of(table(spark, sf, "documents")), order=("th",))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
