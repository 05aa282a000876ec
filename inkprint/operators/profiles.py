"""Author profiles and overlap attribution.

A profile is a set of n-grams typical of an author; a document goes to the
author whose profile shares the most distinct n-grams with it.  Ties, and
documents that share nothing, go to the author seen first in the training data.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.operators.grams import distinct_terms, occurrences
from inkprint.runtime import allow_group_limit, first_seen, persisted, ranked, running_sums

#: Authors of a postings row at most, each a counter of an aggregate; parts of an author's terms when they are ranked.
AUTHORS, PARTS = 32, 16
#: Eight times the postings rows (some 100 bytes each) that may be sent to every task.
SENT_ENTRIES = 4_000_000


def author_profiles(train: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(uid, gram, cnt, first) from ``tokens`` rows with ``uid``.

    One shuffle on (uid, gram) after map-side counting, so one author holding
    much of the data is still spread over all reducers.  ``first`` orders the
    terms by first appearance."""
    rows = occurrences(train)
    if extra:
        rows = rows.withColumn("n", F.char_length("gram"))
    return rows.groupBy("uid", *extra, "gram").agg(F.count("*").alias("cnt"), first_seen(rows).alias("first"))


def rank_profiles(profiles: DataFrame, length: int, extra: tuple[str, ...] = (), parts: int = PARTS) -> DataFrame:
    """The ``length`` most frequent terms per author with their ``rnk``
    (1-based; ties by first appearance).

    Three levels: the best ``length`` within every map task (Spark's group limit), then the
    best of the tasks of one of ``parts`` parts, then the best of those.  However many tasks
    and rows an author has, the last task gets at most ``parts`` x ``length`` of them.
    A part is a set of tasks; any split of the rows gives the same ranks."""
    allow_group_limit(profiles.sparkSession, length)
    order = [F.desc("cnt"), F.asc("first")]
    part = F.pmod(F.spark_partition_id(), F.lit(parts))
    within = Window.partitionBy("uid", *extra, "_part").orderBy(*order)
    best = profiles.withColumn("_part", part).withColumn("rnk", F.row_number().over(within)).filter(F.col("rnk") <= length)
    whole = Window.partitionBy("uid", *extra).orderBy(*order)
    return best.drop("_part").withColumn("rnk", F.row_number().over(whole)).filter(F.col("rnk") <= length)


def trim_profiles(profiles: DataFrame, length: int) -> DataFrame:
    """``length`` >= 0: that many top terms; -1: drop terms seen once; below: keep all."""
    if length >= 0:
        return rank_profiles(profiles, length).drop("rnk")
    return profiles.filter("cnt > 1") if length == -1 else profiles


def author_order(train: DataFrame) -> DataFrame:
    """(uid, since): the first training document of every author."""
    return train.groupBy("uid").agg(F.min("pid").alias("since"))


def _base(width: int) -> Column:
    """The first of the ``width`` successive numbers that an author is one of."""
    return F.col("uid") - F.pmod("uid", F.lit(width))


def postings(profiles: DataFrame, *entry: str, width: int | None = None) -> DataFrame:
    """(gram, authors): the inverted profiles, one row per term and at most ``width``
    (by default ``AUTHORS``) of its authors; ``entry`` columns are carried beside each uid.

    Authors are cut into blocks of that many successive numbers, so a term that every
    author uses is several rows of bounded size, and a document term meets a few rows
    where it would meet one row for each author."""
    found = F.struct("uid", *entry) if entry else F.col("uid")
    block = _base(width or AUTHORS).alias("block")
    return profiles.groupBy("gram", block).agg(F.collect_list(found).alias("authors")).drop("block")


def lanes(inverted: DataFrame, width: int) -> DataFrame:
    """(gram, base, mask) of :func:`postings`: author ``base + i`` is bit i."""
    flags = F.aggregate("authors", F.lit(0).cast("bigint"), lambda held, uid: held.bitwiseOR(_flag(uid, width)))
    rows = inverted.filter(F.size("authors") > 0)
    return rows.select("gram", F.get("authors", F.lit(0)).alias("uid"), flags.alias("mask")).select("gram", _base(width).alias("base"), "mask")


def _flag(uid: Column, width: int, mask: int | Column = 1, lengths: int = 1) -> Column:
    """``mask``, moved to the bits of an author."""
    mask = F.lit(mask) if isinstance(mask, int) else mask
    return F.call_function("shiftleft", mask.cast("bigint"), (F.pmod(uid, F.lit(width)) * lengths).cast("int"))


def _counters(bits: int) -> list[Column]:
    """How many rows have each bit of ``mask``."""
    return [F.count_if(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0).alias(f"s{i}") for i in range(bits)]


def hot_terms(queries: DataFrame, tasks: int, least: int = 32) -> DataFrame:
    """(gram, copies) for terms in so many documents that one of ``tasks`` tasks would get
    over a quarter more than its share by the term alone.

    Counted over one document in 64 by the pid's hash: it decides how rows are dealt,
    never a result.  There are at most 4 x ``tasks`` of them."""
    sample = queries.filter(F.pmod(F.xxhash64("pid", F.lit(64)), F.lit(64)) == 0)
    seen = persisted(distinct_terms(sample.select("pid", "tokens")).groupBy("gram").agg(F.count("*").alias("n")), "seen")
    share = F.col("n") * (4 * tasks) / seen.agg(F.sum("n")).scalar()
    return persisted(
        seen.filter(F.col("n") >= least)
        .filter(share > 1)
        .select("gram", F.least(F.ceil(share), F.lit(tasks)).cast("int").alias("copies")),
        "hot",
    )


def meet(queries: DataFrame, rows: DataFrame, sent: int = SENT_ENTRIES, tasks: int | None = None) -> DataFrame:
    """(pid, ...): each distinct document term with the ``rows`` (gram, ...) it meets.

    An eighth of ``sent`` rows are sent to all tasks, and then neither
    documents nor terms move.  More are joined by a shuffle on the term: never the
    documents' side is sent, whose size after exploding Catalyst cannot know.  There, terms in very
    many documents are dealt over several tasks, with a copy of their rows each."""
    terms = distinct_terms(queries.select("pid", "tokens"))
    rest = [c for c in rows.columns if c != "gram"]
    if rows.count() <= sent // 8:
        return terms.join(F.broadcast(rows), "gram").select("pid", *rest)
    tasks = tasks or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_terms(queries, tasks))
    copies = F.coalesce("copies", F.lit(1))
    dealt = terms.join(hot, "gram", "left").select("pid", "gram", F.pmod(F.xxhash64("pid"), copies).cast("int").alias("salt"))
    copied = rows.join(hot, "gram", "left").select("gram", *rest, F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    return dealt.join(copied.hint("merge"), ["gram", "salt"]).select("pid", *rest)


def overlaps(queries: DataFrame, inverted: DataFrame, sent: int = SENT_ENTRIES) -> DataFrame:
    """(pid, uid, score): distinct document terms found in the profile, from the
    :func:`postings` of the profiles.

    Document terms are deduplicated inside each row.  What a term meets stays one row: a partial
    aggregate has a counter for each author of a block, so a task sends one row for a document
    and ``AUTHORS`` authors, and no pair of a term and an author is made."""
    met = meet(queries, lanes(inverted, AUTHORS), sent)
    found = met.groupBy("pid", "base").agg(*_counters(AUTHORS))
    cells = F.array(*[F.struct((F.col("base") + i).alias("uid"), F.col(f"s{i}").alias("score")) for i in range(AUTHORS)])
    return found.select("pid", F.inline(cells)).filter("score > 0")


def _standing() -> Column:
    """Score first, then the earlier author, as one fixed-width number."""
    scale = F.lit(Decimal(2**63))
    return F.col("score").cast("decimal(10,0)") * scale - F.col("since").cast("decimal(20,0)")


def best_author(scores: DataFrame, authors: DataFrame, queries: DataFrame) -> DataFrame:
    """(pid, uid_pred, score) for every query document."""
    best = (
        scores.join(authors, "uid")
        .groupBy("pid")
        .agg(F.max_by("uid", _standing()).alias("top"), F.max("score").alias("top_score"))
    )
    fallback = authors.agg(F.min_by("uid", "since").alias("uid")).scalar()
    return queries.join(best, "pid", "left").select(
        *queries.columns,
        F.coalesce(F.col("top"), fallback, F.lit(-1)).cast("bigint").alias("uid_pred"),
        F.coalesce(F.col("top_score"), F.lit(0)).cast("bigint").alias("score"),
    )


def attribute(queries: DataFrame, inverted: DataFrame, authors: DataFrame, sent: int = SENT_ENTRIES) -> DataFrame:
    """Attribute every row of ``queries`` (pid, ..., tokens), given the
    :func:`postings` of the profiles."""
    ids = queries.drop("tokens")
    return best_author(overlaps(queries, inverted, sent), authors, ids)


def accuracy(predictions: DataFrame, truth: str = "uid", guess: str = "uid_pred", by: tuple[str, ...] = ()) -> DataFrame:
    """total, correct and ratio; partial sums merge across tasks."""
    right = (F.col(truth) == F.col(guess)).cast("bigint")
    return (
        predictions.groupBy(*by)
        .agg(F.count("*").alias("total"), F.sum(right).alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("total"))
    )


def running_accuracy(predictions: DataFrame, every: int = 250) -> DataFrame:
    """(documents, correct, accuracy) after each ``every`` documents in pid order."""
    order = ranked(predictions.select("pid", "uid", "uid_pred"), [F.col("pid")], name="place")
    steps = order.groupBy(F.floor(F.col("place") / every).alias("step")).agg(
        F.count("*").alias("documents"), F.sum((F.col("uid") == F.col("uid_pred")).cast("bigint")).alias("correct")
    )
    full = running_sums(steps, "step", ["documents", "correct"]).filter(F.col("documents") == every)
    return full.select(
        F.col("run_documents").alias("documents"),
        F.col("run_correct").alias("correct"),
        (F.col("run_correct") / F.col("run_documents")).alias("accuracy"),
    )


def profile_size_stats(profiles: DataFrame) -> DataFrame:
    """total, smallest and largest number of terms per author."""
    sizes = profiles.groupBy("uid").agg(F.count("*").alias("size"))
    return sizes.agg(
        F.sum("size").alias("total_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size")
    )


def sweep_postings(base: DataFrame, lengths: list[int]) -> DataFrame:
    """(gram, n, base, mask): postings of the profiles of all ``lengths`` at once, from (uid, n, gram, cnt, first).
    With l lengths, bit a * l + i says that the term is in the profile of author ``base + a`` for ``lengths[i]``."""
    bit = lambda i, held: F.when(held, 1 << i).otherwise(0)
    tops = [(i, x) for i, x in enumerate(lengths) if x >= 0]
    rest = [(i, x) for i, x in enumerate(lengths) if x < 0]
    out = None
    if tops and rest:
        base = persisted(base, "terms")  # read twice; terms are counted once
    if tops:
        ranks = rank_profiles(base, max(x for _, x in tops), ("n",))
        out = ranks.select("uid", "n", "gram", sum((bit(i, F.col("rnk") <= x) for i, x in tops), F.lit(0)).alias("mask"))
    if rest:
        mask = sum((bit(i, F.col("cnt") > 1 if x == -1 else F.lit(True)) for i, x in rest), F.lit(0))
        kept = base.select("uid", "n", "gram", mask.alias("mask"))
        out = kept if out is None else out.unionByName(kept)
    width = _sweep_width(lengths)
    held = out.filter("mask > 0 AND uid IS NOT NULL")
    flags = _flag(F.col("uid"), width, F.col("mask"), len(lengths))
    return held.groupBy("gram", "n", _base(width).alias("base")).agg(F.bit_or(flags).alias("mask"))


def _sweep_width(lengths: list[int]) -> int:
    """Authors side by side in a sweep's row."""
    return max(AUTHORS // len(lengths), 1)


def sweep(
    train: DataFrame, queries: DataFrame, sizes: list[int], lengths: list[int], keep=lambda df: df, sent: int = SENT_ENTRIES
) -> DataFrame:
    """Accuracy for every (n, profile length).

    ``tokens`` holds the n-grams of all ``sizes`` together: a gram's length
    says its n, so one scan, one set of postings and one join serve the whole sweep, and the
    lengths are conditional counts in one aggregate, not copies of the rows.  ``keep``
    may store the fitted postings."""
    if len(lengths) > 30:
        raise ValueError("at most 30 lengths at once")
    authors = author_order(train)
    truth = queries.select("pid", "uid")
    fallback = authors.agg(F.min_by("uid", "since")).scalar()
    whole = truth.agg(
        F.struct(
            F.count("*").alias("total"), F.sum((F.col("uid") == fallback).cast("bigint")).alias("first")
        ).alias("all")
    ).scalar()
    fitted = keep(sweep_postings(author_profiles(train, ("n",)), lengths))
    width, bits = _sweep_width(lengths), len(lengths)
    hits = meet(queries, fitted, sent).groupBy("n", "pid", "base").agg(*_counters(width * bits))
    cells = F.array(
        *[
            F.struct((F.col("base") + a).alias("uid"), F.lit(x).alias("length"), F.col(f"s{a * bits + i}").alias("score"))
            for a in range(width)
            for i, x in enumerate(lengths)
        ]
    )
    best = (
        hits.select("n", "pid", F.inline(cells))
        .filter("score > 0")
        .join(authors, "uid")
        .groupBy("n", "length", "pid")
        .agg(F.max_by("uid", _standing()).alias("top"))
    )
    # Documents without any overlap go to the first author; they are the
    # whole minus the documents found here, so no row per miss is made.
    scored = (
        best.join(truth, "pid")
        .groupBy("n", "length")
        .agg(
            F.sum((F.col("top") == F.col("uid")).cast("bigint")).alias("found"),
            F.sum((F.col("uid") == fallback).cast("bigint")).alias("found_first"),
        )
    )
    grid = train.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"), F.lit(lengths).alias("lengths")
    ).select("n", F.explode("lengths").alias("length"))
    found = grid.join(scored, ["n", "length"], "left").select(
        F.col("n").cast("bigint").alias("n"),
        F.col("length").cast("bigint").alias("length"),
        whole["total"].alias("total"),
        (F.coalesce("found", F.lit(0)) + whole["first"] - F.coalesce("found_first", F.lit(0))).alias("correct"),
    )
    return found.withColumn("accuracy", F.col("correct") / F.col("total"))
