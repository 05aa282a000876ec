"""Vocabularies: tables (gram, idx, ...) fitted on training documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.operators.grams import counts, distinct_terms, occurrences
from inkprint.runtime import first_seen, persisted, ranked

# Ranges of counts in one round of looking for the count at which the top k end, after the
# first round's: a 1024th of a power of two each, at most 64 x 1024.
BINS = 16_384


def term_stats(docs: DataFrame) -> DataFrame:
    """(gram, cnt, df, first) over all documents in one shuffle on the gram, of a row for
    each distinct term of a document."""
    rows = counts(docs.select("pid", "tokens"))
    return rows.groupBy("gram").agg(
        F.sum("cnt").alias("cnt"), F.count("*").alias("df"), first_seen(rows, pos="first_pos").alias("first")
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """(gram, cnt, first) over all documents."""
    rows = occurrences(docs)
    return rows.groupBy("gram").agg(F.count("*").alias("cnt"), first_seen(rows).alias("first"))


def _last_count(terms: DataFrame, k: int) -> int:
    """The k-th largest ``cnt``; 0 if there are fewer than ``k`` terms.

    Each round counts the terms of at most ``BINS`` ranges of counts, and the next one
    looks into the range that holds the k-th: only the bins reach the driver, however many
    terms there are.  The first ranges are single counts up to about 1,400."""
    above, low, high = 0, 1, None
    while True:
        if high is None:
            bin_, within = F.floor(F.log2("cnt") * 1024), F.lit(True)
        else:
            step = -(-(high - low + 1) // BINS)
            bin_, within = F.floor((F.col("cnt") - low) / step), F.col("cnt").between(low, high)
        ranges = (
            terms.filter(within)
            .groupBy(bin_.alias("bin"))
            .agg(F.count("*").alias("n"), F.min("cnt").alias("low"), F.max("cnt").alias("high"))
            .collect()
        )
        for found in sorted(ranges, key=lambda r: -r.low):
            if above + found.n >= k:
                break
            above += found.n
        else:
            return 0
        if found.low == found.high:
            return found.low
        low, high = found.low, found.high


def select_top(terms: DataFrame, k: int, order: list[Column], name: str) -> DataFrame:
    """The first ``k`` terms in ``order`` (by ``cnt`` descending first) with their place.

    Only terms that reach the k-th largest count are sorted, over range partitions.
    The same plan for every ``k``."""
    stored = persisted(terms, "terms")
    return ranked(stored.filter(F.col("cnt") >= _last_count(stored, k)), order, name=name).filter(F.col(name) < k)


def by_frequency() -> list[Column]:
    return [F.desc("cnt"), F.asc("first")]


def top_terms(terms: DataFrame, k: int) -> DataFrame:
    """The first ``k`` terms by count, ties by first appearance, with ``idx`` 0..;
    k <= 0 keeps all."""
    if k <= 0:
        return ranked(terms, by_frequency(), name="idx")
    return select_top(terms, k, by_frequency(), "idx")


def fit_vocabulary(train: DataFrame, k: int) -> DataFrame:
    """(gram, idx, cnt): top ``k`` terms by count, ties by first appearance."""
    return top_terms(term_counts(train), k).select("gram", "idx", "cnt")


def fit_tree_vocabulary(train: DataFrame, k: int) -> DataFrame:
    """(gram, idx, cnt, df, n): as above with document frequency and the number
    of training documents.  k = 0 keeps nothing; k < 0 is refused."""
    if k < 0:
        raise ValueError("the number of tree features cannot be negative")
    size = train.agg(F.count("*")).scalar()
    kept = top_terms(term_stats(train), max(k, 1))
    return kept.select("gram", "idx", "cnt", "df", size.alias("n")).filter(F.lit(k > 0))


def fit_tfidf(train: DataFrame, k: int = 10_000) -> DataFrame:
    """(gram, idx, df, n): top ``k`` terms by count (ties alphabetical),
    numbered alphabetically; k <= 0 keeps all."""
    terms = term_stats(train).select("gram", "cnt", "df")
    size = train.agg(F.count("*")).scalar()
    kept = select_top(terms, k, [F.desc("cnt"), F.asc("gram")], "_place") if k > 0 else terms
    return ranked(kept, [F.asc("gram")], name="idx").select("gram", "idx", "df", size.alias("n"))


def fit_all_terms(train: DataFrame) -> DataFrame:
    """(gram, idx): every training term, numbered alphabetically."""
    terms = distinct_terms(train.select("tokens")).distinct()
    return ranked(terms, [F.asc("gram")], name="idx")


def vocabulary_size(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.agg(F.count("*").alias("features"))
