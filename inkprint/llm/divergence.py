"""Source divergence audit on a cube of (group block, group block, term block) cells.

A group is a (lang, source) pair.  Terms are runs of ASCII letters and of characters
beyond ASCII, only A-Z lower-cased.  A lang keeps the terms that at least ``LEAST``
of its documents hold.  A kept term with ``count`` occurrences among the N kept ones
of a group (or lang) has the share

    1 + floor(1000000000 * (count + 5) / (N + 5 * V)),    V kept terms in the lang,

worked out in two integer divisions that stay exact up to 2.8e14 words.

*Part pair* adds |share - share| over all kept terms for every two sources of a lang.
Groups of a lang are numbered and cut into blocks, and so are its kept terms.  A
group's shares within one term block are a slice, at most ``TERMS`` numbers long by
construction; each slice is sent to the cells of its block with every other block.
A cell fills in the share of terms that a group has not got, compares its two blocks
of slices as two matrices of at most ``GROUPS`` x ``TERMS``, and gives a partial sum
for each pair; the sums over the term axis are the divergences.  A cell's memory has
this bound however many documents, groups or terms there are, and only one of the
cells (a, b) and (b, a) exists.  *Part term* lists, for each group, the terms that
are most above their lang's share.

Texts are counted inside tasks first, term by term, so a source with a third of all
rows costs no more than its distinct terms; a text is read in pieces.  Null text, lang
and source are ''.  Repeated rows count each.  A group without kept terms still
stands in every pair; in a lang with no kept term all pairs are 0 apart.  Ties rank by
item in UTF-8 order.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkprint.llm.common import broadcast_if_small, table
from inkprint.runtime import persisted, ranked

#: Documents of a lang that must hold a term for it to be kept.
LEAST = 30
#: Terms listed of each group.
TOP = 50
#: Groups of a block, and terms of a block.
GROUPS, TERMS = 16, 4096
SMOOTH = 5
#: Kept terms that may be sent to every task (some 100 bytes each).
SENT = 300_000
#: Distinct terms that a task holds before it hands its sums on; bytes of a text read at once.
_HELD, _PIECE = 400_000, 1 << 20
#: One number holds a term's occurrences, times this, and its documents.
_DOCS = 1 << 32
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(text: str) -> Counter:
    """Terms of one text, a piece at a time."""
    raw = text.encode().translate(_FOLD)
    out: Counter = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            n = len(counts) + 1
            both = [0, *counts.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    pa.array([source] * n, pa.string()),
                    pa.array([None, *counts], pa.binary()).cast(pa.string()),
                    pa.array([x // _DOCS for x in both], pa.int64()),
                    pa.array([x % _DOCS for x in both], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
            counts = held[lang, source]
            before = counts.get
            for term, n in _counted(batch.column(2)[i].as_py()).items():
                counts[term] = before(term, 0) + n * _DOCS + 1
            if i % 256 == 0 and sum(map(len, held.values())) > _HELD:
                yield from rows()
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents.  Each group has a
    row with a null term too, so that groups without any term are there."""
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = given.mapInArrow(_sums, "lang string, source string, term string, n bigint, docs bigint")
    # Most terms are rare and tasks have added up theirs: dealt by term first, sums are taken once, after the shuffle.
    return partial.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)); 10^9 is 31250 * 32000, and
    the rest of the first division carries over into the second."""
    below = total + terms * F.lit(SMOOTH)
    above = (count + F.lit(SMOOTH)) * F.lit(31250)
    whole = lambda a, b: F.call_function("div", a, b)
    return whole(above, below) * F.lit(32000) + whole((above % below) * F.lit(32000), below) + F.lit(1)


def _cell(groups_of_block: int) -> callable:
    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, a, c, _ = key
        pdf = pdf.sort_values("g")
        width = int(pdf["width"].iloc[0])
        dense = np.repeat(pdf["base"].to_numpy(dtype=np.int64)[:, None], width, axis=1)
        for k, (at, p) in enumerate(zip(pdf["at"], pdf["p"], strict=True)):
            if at is not None and len(at):
                dense[k, np.asarray(at, dtype=np.int64)] = np.asarray(p, dtype=np.int64)
        g = pdf["g"].to_numpy(dtype=np.int64)
        first, second = np.flatnonzero(g // groups_of_block == a), np.flatnonzero(g // groups_of_block == c)
        out = []
        for i in first:
            others = second[second > i]
            out.append(np.stack([np.full(len(others), g[i]), g[others], np.abs(dense[others] - dense[i]).sum(axis=1)], axis=1))
        cells = np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)
        return pd.DataFrame({"lang": key[0], "i": cells[:, 0], "j": cells[:, 1], "value": cells[:, 2]})

    return compare


class Counts:
    """The fitted tables: groups, langs, kept terms, and what each group has of them."""

    def __init__(self, docs: DataFrame, least: int = LEAST) -> None:
        counts = persisted(term_counts(docs), "terms")
        by_lang = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        #: (lang, term, n, id): ids from 0 within a lang.
        self.kept = persisted(ranked(by_lang.filter(F.col("docs") >= least).drop("docs"), [F.col("term")], ("lang",), "id"), "kept")
        #: (lang, source, term, id, n)
        self.cells = persisted(
            counts.filter(F.col("term").isNotNull()).drop("docs").join(broadcast_if_small(self.kept.select("lang", "term", "id"), SENT), ["lang", "term"]),
            "cells",
        )
        sums = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        sizes = self.kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
        numbered = ranked(counts.filter(F.col("term").isNull()).select("lang", "source"), [F.col("source")], ("lang",), "g")
        #: (lang, source, g, total, terms, lang_total)
        self.groups = persisted(
            numbered.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "terms", "lang_total"]), "groups"
        )


def pair_divergences(counts: Counts, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """(lang, i, j, value) for i < j: numbers of two groups of a lang, and their divergence."""
    here = counts.groups.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / groups).cast("int"))
    some = F.col("terms") > 0
    skeleton = here.select(
        "lang",
        "g",
        "blocks",
        F.when(some, share(F.lit(0).cast("bigint"), F.col("total"), F.greatest("terms", F.lit(1).cast("bigint")))).otherwise(F.lit(0)).alias("base"),
        "terms",
        F.explode(F.sequence(F.lit(0), F.when(some, F.call_function("div", F.col("terms") - 1, F.lit(terms))).otherwise(F.lit(0)).cast("int"))).alias("t"),
    ).withColumn("width", F.least(F.lit(terms), F.col("terms") - F.col("t") * terms).cast("int"))
    shares = counts.cells.join(counts.groups, ["lang", "source"]).select(
        "lang",
        "g",
        F.call_function("div", F.col("id"), F.lit(terms)).cast("int").alias("t"),
        F.struct((F.col("id") % terms).cast("int").alias("at"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).alias("cell"),
    )
    slices = shares.groupBy("lang", "g", "t").agg(F.collect_list("cell").alias("cells"))  # at most `terms` entries
    slices = slices.select("lang", "g", "t", F.col("cells.at").alias("at"), F.col("cells.p").alias("p"))
    block = F.floor(F.col("g") / groups).cast("int")
    replicated = (
        skeleton.join(slices, ["lang", "g", "t"], "left")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("lang", F.least(block, "other").alias("a"), F.greatest(block, "other").alias("c"), "t", "g", "base", "width", "at", "p")
    )
    partial = replicated.groupBy("lang", "a", "c", "t").applyInPandas(_cell(groups), "lang string, i bigint, j bigint, value bigint")
    return partial.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def distinctive_terms(counts: Counts, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the terms most above their lang's share."""
    per_lang = counts.kept.select("lang", "term", F.col("n").alias("lang_n"))
    gap = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = (
        counts.cells.join(counts.groups, ["lang", "source"])
        .join(per_lang, ["lang", "term"])
        .select("lang", "source", F.col("term").alias("item"), gap.alias("value"))
        .filter("value > 0")
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return above.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): both parts for every group."""
    counts = Counts(docs, least)
    apart = persisted(pair_divergences(counts, groups, terms), "apart")
    both = apart.unionByName(apart.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    name = lambda g, to: counts.groups.select("lang", F.col("g").alias(g), F.col("source").alias(to))
    pairs = both.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(distinctive_terms(counts, top), "term"))


def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return audit(table(spark, sf, "documents"))


SQL = r"""
WITH given AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM given)),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grps AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM given) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counted GROUP BY lang, source) t USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v)::HUGEINT AS p
  FROM grps g JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN counted c USING (lang, source, term)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM counted GROUP BY lang, term) JOIN vocabulary USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b USING (lang, term) GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
above AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - w.q AS value FROM shares s JOIN whole w USING (lang, term) WHERE s.n > 0 AND s.p > w.q),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM placed WHERE part = 'pair' OR rank <= 50
"""
