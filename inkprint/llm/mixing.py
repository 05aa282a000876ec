"""Mixing sources to target weights by subset-sum budget fitting.

A source's share of all words is its weight's share, at most ``most`` times its
own words; what is above is given to the others by weight until none is above.
A target of q whole passes and a rest takes every document q times.  The rest
is fitted: documents are counted by exact length, each length gives its even
share, and bounded-knapsack dynamic programming over the lengths picks what
still fits, so the budget is met to within the smallest sum that cannot be
made.  Which documents of a length are taken is decided by a seeded hash.

A source's table of lengths has as many rows as there are lengths, however many
documents it has; documents themselves are only ranked within (source, length)
by a range sort.  A null source is a source of its own, last in order; null and
empty texts have length 0 and are never taken.  Repeated rows are counted each.
Rows that share doc_id and text but not the rest are told apart by a hash of all columns.
The mix repeats exactly for a seed.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import fresh, numbered, table, text_hash, whole_hash
from inkprint.runtime import persisted, ranked, running_sums

MOST = 3
#: Largest budget of the dynamic programme, in words; beyond it whole documents are added first.
BUDGET = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(
        *[F.col(c) for c in also],
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        text_hash().alias("th"),
        whole_hash(docs.drop(*also)).alias("rh"),
    )


def targets(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat in
    code-point order of the sources, null last.

    A source stops at its cap if a unit of weight is worth more than cap / weight.  Sorted by that
    ratio the stopped sources come first, so sums over all before a source tell
    what a unit is worth if it is the first that does not stop; the first for which that holds is."""
    by_name = sources.withColumn("_null", F.col("source").isNull())
    placed = ranked(by_name, [F.col("_null"), F.col("source")], name="_i")
    weight = F.array(*[F.lit(float(w)) for w in cycle])[(F.col("_i") % len(cycle)).cast("int")]
    weighed = placed.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap"), "_i")
    weighed = persisted(weighed, "weights")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    ratio = F.col("cap") / F.col("w")
    sums = running_sums(ranked(weighed.withColumn("_ratio", ratio), [F.col("_ratio"), F.col("_i")], name="_place"), "_place", ["cap", "w"])
    left = F.lit(float(whole["size"] or 0)) - (F.col("run_cap") - F.col("cap"))
    unit = left / (F.lit(float(whole["w"] or 0)) - (F.col("run_w") - F.col("w")))
    first = sums.withColumn("_unit", unit).filter("_unit <= _ratio").agg(F.min_by("_unit", "_place").alias("unit")).first()["unit"]
    share = F.col("cap") if first is None else F.least("cap", F.col("w") * F.lit(first))
    return weighed.select("source", "source_size", share.alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of the ``counts`` documents of each of the ``sizes`` to take so
    that their words come as near below ``budget`` as can be made.

    Even shares first; then whole documents, longest first, until what is left
    is within ``BUDGET``; then the dynamic programme, whose set of reachable sums is a
    bit string."""
    order = np.argsort(-sizes, kind="stable")
    total = int((sizes * counts).sum())
    taken = np.zeros(len(sizes), dtype=np.int64)
    if budget <= 0 or total <= 0:
        return taken
    if budget >= total:
        return np.where(sizes > 0, counts, 0)
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((sizes * taken).sum())
    for i in order.tolist():
        if sizes[i] and left > BUDGET:
            n = min(int(counts[i] - taken[i]), (left - BUDGET) // int(sizes[i]))
            taken[i] += n
            left -= n * int(sizes[i])
    reach, steps = 1, []
    mask = (1 << (left + 1)) - 1
    for i in order.tolist():
        size, spare, bundle = int(sizes[i]), int(counts[i] - taken[i]), 1
        if not size or size > left:
            continue
        spare = min(spare, left // size)
        while spare and not reach >> left & 1:
            n = min(bundle, spare)
            more = reach | reach << n * size & mask
            if more != reach:
                steps.append((i, n, reach))
                reach = more
            spare -= n
            bundle *= 2
    sum_ = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> sum_ & 1:
            taken[i] += n
            sum_ -= n * int(sizes[i])
    return taken


def plan(lengths: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, size, passes, extra): every document of a source is taken
    ``passes`` times, and ``extra`` documents of each length once more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(int(round(target)) // own, int(target // own) + 1) if own else 0
        sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        extra = fit(sizes, counts, int(round(target)) - passes * own)
        return pd.DataFrame({"source": pdf["source"], "size": sizes, "passes": passes, "extra": extra})

    joined = lengths.join(wanted, lengths["source"].eqNullSafe(wanted["source"])).select(lengths["source"], "size", "n", "source_size", "target")
    return joined.groupBy("source").applyInPandas(run, "source string, size bigint, passes bigint, extra bigint")


def mix(
    docs: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST, seed: int = 17, also: tuple[str, ...] = ()
) -> DataFrame:
    """(also..., doc_id, th, source, size, source_size, target, copies) of each row of ``docs``.

    ``also`` names columns of ``docs`` that are carried along."""
    rows = persisted(measured(docs, also), "measured")
    lengths = persisted(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = persisted(targets(sources, cycle, most), "targets")
    chosen = persisted(plan(lengths, wanted), "plan")
    seeded = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "th"))
    out = _ranks(seeded).join(chosen.withColumnsRenamed({"source": "p_source", "size": "p_size"}), F.expr("source <=> p_source AND size = p_size"))
    out = out.join(wanted.withColumnRenamed("source", "t_source"), F.expr("source <=> t_source"))
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("_rank") < F.col("extra")).cast("bigint")).otherwise(0)
    return out.select(*also, "doc_id", "th", "source", "size", "source_size", "target", copies.alias("copies"))


def _ranks(seeded: DataFrame) -> DataFrame:
    """Rank by hash within (source, size); a null source is ranked under a name no text has."""
    named = seeded.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    return ranked(named, [F.col("_h"), F.col("doc_id"), F.col("th"), F.col("rh")], group=("_s", "size"), name="_rank").drop("_s")


def apply(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    row, other, copies, copy = fresh(docs, "row_number", "other_number", "row_copies", "row_copy")
    rows = numbered(docs, row)
    taken = mix(rows, also=(row,), **options).filter("copies > 0").select(F.col(row).alias(other), F.col("copies").alias(copies))
    both = rows.join(taken, F.col(row) == F.col(other))
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def op6_subset_sum_mix(spark, sf: str) -> DataFrame:
    """All documents with the words the mix takes from each."""
    found = mix(table(spark, sf, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")
