"""Quality classifier: perplexity under interpolated modified Kneser-Ney models
of trusted text, over words and over the characters that spell them.

*Words.*  Order 3 over words as they are written, without case, with marks for the
beginning and the end of a text.  Trusted texts are dealt into two halves by
their hash and each half is a model; a text is scored by the model of the half
it does not belong to, so that trusted texts and their copies meet no counts of
their own and the thresholds hold for all.  The logarithm of a probability is a sum over the grams that
end at a word and their contexts:

    log P(w | u v) = d(uvw) + b(uv) + d(vw) + b(v) + d(w) + b() - log(size of the vocabulary)

where b is the mass that a context leaves and d = log(1 + P's own part / the
lower orders' part); both are 0 for what the model has not seen.  ``word_buckets`` counts
grams and adds up values where the texts' grams are brought together, so neither the model nor
the pairs of a text and a gram are stored.  ``word_model`` and ``word_sums`` are the same as
tables joined by key, for a model that is wanted as such.

*Spelling.*  Order 4 over 48 character classes; its table has 48^4 cells whatever
the input, so it may be sent to every task.

*Variety.*  The share of distinct grams among a text's grams of 3 words: a model of
other texts does not see that a text repeats words which are common elsewhere.

A text is rejected when one of these lies outside quantiles of trusted texts
of its language, texts with fewer than ``short`` units being held to short ones.
Languages with fewer than ``least`` trusted texts of that kind are held to the
quantiles of all trusted texts of that kind, and without any nothing is rejected.
Texts without a word have nothing to judge and are kept; their perplexity is
null, as it is where the other half has no trusted text.  A null language is a language of its own.  Repeated
rows score alike.  Further columns may have any name; all are kept by
``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator, AccumulatorParam
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm import word_buckets
from inkprint.llm.common import bitmap, blocks, broadcast_if_small, fresh, in_bitmap, table, text_hash, utf8
from inkprint.llm.hashing import mix, windows
from inkprint.llm.word_buckets import BITS, CELLS, WORDS, cell_counts, cuts, marked
from inkprint.runtime import persisted

CLASSES, ORDER = 48, 4
#: Share of trusted texts allowed outside each threshold, and the factor by which a threshold is widened.
TAIL, SLACK = 0.001, 1.05
SHORT, LEAST = 200, 50
#: What a text is judged by, and the columns of its bounds.
MEASURES = {"perplexity": ("low", "high"), "spelling": ("spelling_low", "spelling_high"), "variety": ("variety_low", "variety_high")}
_FLUSH = 4_000_000


def _classes() -> np.ndarray:
    """Class of a byte; 0 stands for the beginning of a text."""
    out = np.full(256, 39, dtype=np.int32)
    out[[9, 10, 11, 12, 13]] = 2
    out[32] = 1
    out[97:123] = np.arange(3, 29)
    out[65:91] = 29
    out[48:58] = 30
    for k, group in enumerate((b".", b",", b"!?", b"'\"`", b"-_/\\", b"()[]{}<>|", b"$%&#*+=@^~", b":;")):
        out[list(group)] = 31 + k
    out[0x80:0xC0] = 40 + (np.arange(64) & 7)
    return out


_CLASS = _classes()


def grams(column: pa.Array, order: int) -> Iterator[np.ndarray]:
    """The gram that ends at every byte of each text, as a number in base 48."""
    offsets, data = utf8(column)
    for lo, hi in blocks(offsets):
        for i in range(lo, hi):
            units = np.zeros(offsets[i + 1] - offsets[i] + order - 1, dtype=np.int32)
            units[order - 1 :] = _CLASS[data[offsets[i] : offsets[i + 1]]]
            out = np.zeros(len(units) - order + 1, dtype=np.int32)
            for k in range(order):
                out *= CLASSES
                out += units[k : k + len(out)]
            yield out


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c) over all texts; each task sends every gram once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**order, dtype=np.int64)
        held: list[np.ndarray] = []
        n = 0

        def flush() -> None:
            np.add(total, np.bincount(np.concatenate(held), minlength=len(total)), out=total)
            held.clear()

        for batch in batches:
            for row in grams(batch.column("text"), order):
                held.append(row)
                n += len(row)
                if n > _FLUSH:
                    flush()
                    n = 0
        if held:
            flush()
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["gram", "c"])

    made = texts.select("text").mapInArrow(run, "gram int, c bigint")
    return made.groupBy("gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> np.ndarray:
    """log P(last unit | the units before) for every gram, as a dense float table."""
    spark = counts.sparkSession
    level = persisted(counts, "grams")
    table_of: dict[int, DataFrame] = {order: level}
    for k in range(order - 1, 0, -1):  # how many units precede a gram
        level = persisted(level.groupBy((F.col("gram") % CLASSES**k).alias("gram")).agg(F.count("*").alias("c")), "grams")
        table_of[k] = level
    below = np.full(1, 1.0 / CLASSES)
    for k in range(1, order + 1):
        own = table_of[k]
        most = [own.filter(f"c = {i}").count() for i in (1, 2, 3, 4)]
        cut = cuts(most)
        c = F.col("c")
        less = F.when(c == 1, cut[0]).when(c == 2, cut[1]).otherwise(cut[2])
        keyed = own.withColumn("context", F.floor(F.col("gram") / CLASSES).cast("int"))
        totals = keyed.groupBy("context").agg(F.sum("c").alias("total"), F.sum(less).alias("left"))
        seen = keyed.join(totals, "context").select("gram", ((c - less) / F.col("total")).cast("float").alias("p"))
        # at most 48^k rows each
        p = np.zeros(CLASSES**k, dtype=np.float64)
        got = seen.toPandas()
        p[got["gram"].to_numpy()] = got["p"].to_numpy()
        weight = np.ones(CLASSES ** (k - 1), dtype=np.float64)
        got = totals.select("context", (F.col("left") / F.col("total")).alias("w")).toPandas()
        weight[got["context"].to_numpy()] = got["w"].to_numpy()
        p = p.reshape(-1, CLASSES)
        p += weight[:, None] * np.tile(below.reshape(-1, CLASSES) if k > 1 else np.full((1, CLASSES), below[0]), (CLASSES if k > 1 else 1, 1))
        below = p.ravel()
    del spark
    return np.log(np.maximum(below, 1e-12)).astype(np.float32)


class _Added(AccumulatorParam):
    def zero(self, value: np.ndarray) -> np.ndarray:
        return np.zeros_like(value)

    def addInPlace(self, value1: np.ndarray, value2: np.ndarray) -> np.ndarray:  # noqa: N802
        return value1 + value2


def perplexities(docs: DataFrame, model: np.ndarray, order: int = ORDER, keep: tuple[str, ...] = (), cells: Accumulator | None = None) -> DataFrame:
    """(keep..., n_units, n_words, variety, perplexity) of each row of ``docs``; what runs
    adds the places of the texts to ``cells``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "n_units", "n_words", "variety", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            n, ppl = [], []
            n_words, variety = _words_of(batch.column("text"), found)
            for row in grams(batch.column("text"), order):
                n.append(len(row))
                ppl.append(float(np.exp(-sent.value[row].mean(dtype=np.float64))) if len(row) else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(n, pa.int64()), pa.array(n_words, pa.int64()), variety, pa.array(ppl, pa.float64())], names=names)
        if cells is not None:
            cells.add(found)

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}n_units bigint, n_words bigint, variety double, perplexity double")


def word_grams(column: pa.Array, half: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(first row, row, keys, predicted) for blocks of rows: at every place of a
    text from the second mark of its beginning to its end the keys of the grams
    of 1 to ``WORDS`` words that end there, in the model ``half`` of its row, and
    whether the place is a word or the end."""
    for lo, row, place, hashes in marked(column):
        seed = half[lo + row].astype(np.uint64) << np.uint64(8)
        inside = place >= WORDS - 2
        keys = []
        for k in range(1, WORDS + 1):
            h = np.zeros(len(hashes), dtype=np.uint64)
            h[k - 1 :] = windows(hashes, k)
            keys.append(mix(h + (seed | np.uint64(k)))[inside])
        yield lo, row[inside], keys, place[inside] >= WORDS - 1


def _words_of(column: pa.Array, cells: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and how many of its grams of ``WORDS`` words are distinct;
    adds its places to ``cells``."""
    places = np.zeros(len(column), dtype=np.int64)
    distinct = np.zeros(len(column), dtype=np.int64)
    for lo, row, place, hashes in marked(column):
        cells += cell_counts(place, hashes)
        at = np.flatnonzero(place >= WORDS - 1)
        row = row[at] + lo
        grams = pd.factorize(mix(windows(hashes, WORDS)[at - WORDS + 1] + mix(row.astype(np.uint64))))[0]
        first = np.empty(int(grams.max(initial=-1)) + 1, dtype=np.int64)
        first[grams] = row
        places += np.bincount(row, minlength=len(places))
        distinct += np.bincount(first, minlength=len(places))
    return np.maximum(places - 1, 0), pa.array(distinct / np.maximum(places, 1), pa.float64(), mask=places == 0)


def word_counts(texts: DataFrame) -> DataFrame:
    """(half, k, context, rest, rest_context, rest_rest, c): the grams of ``WORDS`` words
    of (text, half) with the keys of the shorter grams in them."""
    names = ["half", "k", "context", "rest", "rest_context", "rest_rest", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("half").to_numpy(zero_copy_only=False)
            for lo, row, (one, two, three), predicted in word_grams(batch.column("text"), half):
                at = np.flatnonzero(predicted)
                _, first, c = np.unique(three[at], return_index=True, return_counts=True)
                at = at[first]
                columns = (half[lo + row[at]].astype(np.int32), three[at], two[at - 1], two[at], one[at - 1], one[at], c.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns], names=names)

    made = texts.select("text", "half").mapInArrow(run, "half int, " + "".join(f"{x} bigint, " for x in names[1:-1]) + "c bigint")
    kept = [F.min(x).alias(x) for x in names if x not in ("k", "c")]
    return made.groupBy("k").agg(*kept, F.sum("c").alias("c"))


def _discounts(level: DataFrame) -> Column:
    """What is taken off the count of a gram, from the counts of counts of its half."""
    most = {(r.half, r.c): r.n for r in level.filter("c <= 4").groupBy("half", "c").agg(F.count("*").alias("n")).collect()}
    less = F.lit(0.0)
    for half in (0, 1):
        cut = cuts([most.get((half, i), 0) for i in (1, 2, 3, 4)])
        own = F.when(F.col("c") == 1, cut[0]).when(F.col("c") == 2, cut[1]).otherwise(cut[2])
        less = F.when(F.col("half") == half, own).otherwise(less)
    return less


def word_model(counts: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """((k, value), floor of each half): what every known gram and context adds to a
    logarithm, and what every word of a text has besides."""
    level = {3: persisted(counts, "grams")}
    level[2] = persisted(
        level[3].groupBy(F.col("rest").alias("k")).agg(F.min("half").alias("half"), F.min("rest_context").alias("context"), F.min("rest_rest").alias("rest"), F.count("*").alias("c")), "grams"
    )
    level[1] = persisted(level[2].groupBy(F.col("rest").alias("k")).agg(F.min("half").alias("half"), F.count("*").alias("c")), "grams")
    own = level[1].withColumn("less", _discounts(level[1]))
    whole = {r.half: r for r in own.groupBy("half").agg(F.sum("c").alias("total"), F.sum("less").alias("left"), F.count("*").alias("n")).collect()}
    known = {half: (r.left / r.total, 1.0 / (r.n + 1)) for half, r in whole.items()}  # one word more, for the unknown
    low = F.lit(None).cast("double")
    for half, (left, even) in known.items():
        low = F.when(F.col("half") == half, left * even).otherwise(low)
    totals = F.lit(None).cast("double")
    for half, r in whole.items():
        totals = F.when(F.col("half") == half, float(r.total)).otherwise(totals)
    up = (F.col("c") - F.col("less")) / totals
    p = persisted(own.select("k", (up + low).alias("p"), F.log1p(up / low).alias("value")), "values")
    parts = [p.select("k", "value")]
    for k in (2, 3):
        own = level[k].withColumn("less", _discounts(level[k]))
        contexts = persisted(own.groupBy("context").agg(F.sum("c").alias("total"), F.sum("less").alias("left")), "contexts")
        lower = p.select(F.col("k").alias("rest"), F.col("p").alias("lower"))
        both = own.join(contexts, "context").join(lower, "rest")
        up, down = (F.col("c") - F.col("less")) / F.col("total"), F.col("left") / F.col("total") * F.col("lower")
        p = persisted(both.select("k", (up + down).alias("p"), F.log1p(up / down).alias("value")), "values")
        parts += [contexts.select(F.col("context").alias("k"), F.log(F.col("left") / F.col("total")).alias("value")), p.select("k", "value")]
    values = parts[0]
    for part in parts[1:]:
        values = values.unionByName(part)
    return values, {half: float(np.log(left * even)) for half, (left, even) in known.items()}


def document_grams(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(doc_id, th, k, n): how often grams that hit the bit map are in each row of
    (doc_id, th, text, half); a row without any is left out."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    names = ["doc_id", "th", "k", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("half").to_numpy(zero_copy_only=False)
            for lo, row, keys, predicted in word_grams(batch.column("text"), half):
                for k, key in enumerate(keys):
                    at = np.flatnonzero(in_bitmap(sent.value, key) & (predicted | (k < WORDS - 1)))
                    if not len(at):
                        continue
                    order = at[np.lexsort((key[at], row[at]))]
                    new = np.ones(len(order), dtype=bool)
                    new[1:] = (key[order[1:]] != key[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
                    first = np.flatnonzero(new)
                    n = np.diff(np.append(first, len(order)))
                    take = pa.array(row[order[first]] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(key[order[first]].view(np.int64)), pa.array(n.astype(np.int64))], names=names
                    )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "th", "text", "half")
    return rows.mapInArrow(run, "doc_id bigint, th bigint, k bigint, n bigint")


def word_sums(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, th, known): the sum of the model's values over all rows of ``docs`` with this key."""
    bits = min(BITS, max(18, (8 * values.count()).bit_length()))
    # the number of grams cannot be estimated from the texts, so Catalyst might send either side
    hits = document_grams(docs, bitmap(values, "k", bits)).hint("merge")
    return hits.join(values, "k").groupBy("doc_id", "th").agg(F.sum(F.col("n") * F.col("value")).alias("known"))


def word_perplexities(docs: DataFrame, trusted: DataFrame, found: DataFrame, cells: np.ndarray | None = None) -> DataFrame:
    """``found`` with the perplexity of the words of each row, by the half of the
    trusted texts that the row does not belong to; ``cells`` as in ``word_buckets.sums``."""
    own = F.col("th").bitwiseAND(F.lit(1)).cast("int")
    key = F.xxhash64("th", F.col("doc_id").cast("bigint"))
    known = docs.join(trusted, F.col("doc_id") == F.col("trusted_id"), "left")
    sums, floors = word_buckets.sums(known.select(key.alias("key"), "text", own.alias("half"), F.col("trusted_id").isNotNull().alias("trusted")), cells)
    found = found.withColumn("s_key", key)
    copies = found.groupBy("s_key").agg(F.count("*").alias("copies")).withColumnRenamed("s_key", "key")
    each = copies.join(sums, "key", "left").select(F.col("key").alias("s_id"), (F.coalesce("known", F.lit(0.0)) / F.col("copies")).alias("known"))
    floor = F.lit(None).cast("double")
    for half, value in floors.items():
        floor = F.when(1 - own == half, value).otherwise(floor)
    n = F.col("n_words") + 1
    out = found.join(each, F.col("s_key") == F.col("s_id"))
    out = out.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-(F.col("known") / n + floor))))
    return out.drop("s_id", "s_key", "known")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, th, lang, n_units, n_words, each of ``MEASURES`` with its bounds, keep) for
    each row of ``docs``.

    Trusted are the documents with quality 1."""
    rows = docs.select("doc_id", "text", "lang", text_hash().alias("th"))
    trusted = broadcast_if_small(labels.filter("quality = 1").select(F.col("doc_id").alias("trusted_id")).distinct())
    model = kneser_ney(gram_counts(rows.join(trusted, F.col("doc_id") == F.col("trusted_id"), "left_semi")))
    # a task that is repeated counts twice: the sizes only say how the work is dealt
    cells = docs.sparkSession.sparkContext.accumulator(np.zeros(CELLS, dtype=np.int64), _Added())
    spelt = persisted(perplexities(rows, model, keep=("doc_id", "th", "lang"), cells=cells).withColumnRenamed("perplexity", "spelling"), "spelling")
    found = persisted(word_perplexities(rows, trusted, spelt, cells.value), "perplexities")
    found = found.withColumn("short", F.col("n_units") < SHORT)
    known = found.join(trusted, F.col("doc_id") == F.col("trusted_id"), "left_semi").filter("n_words > 0").select("lang", "short", *MEASURES)
    known = persisted(known, "known")
    tails = [F.percentile_approx(name, [TAIL, 1 - TAIL], 100_000).alias(f"q_{name}") for name in MEASURES]
    own = known.groupBy("lang", "short").agg(*tails, F.count("*").alias("n")).filter(f"n >= {LEAST}").drop("n").withColumnsRenamed({"lang": "q_lang", "short": "q_short"})
    every = {r.short: r for r in known.groupBy("short").agg(*tails).collect()}
    both = found.join(persisted(own, "quantiles"), F.col("lang").eqNullSafe(F.col("q_lang")) & (F.col("short") == F.col("q_short")), "left")
    outside = F.lit(False)
    for name, (low, high) in MEASURES.items():
        for i, (bound, factor) in enumerate(((low, 1 / SLACK), (high, SLACK))):
            rest = F.lit(None).cast("double")
            for short, r in every.items():
                rest = F.when(F.col("short") == short, (r[f"q_{name}"] or [None, None])[i]).otherwise(rest)
            both = both.withColumn(bound, F.coalesce(F.col(f"q_{name}")[i], rest) * factor)
        outside = outside | F.coalesce((F.col(name) < F.col(low)) | (F.col(name) > F.col(high)), F.lit(False))
    measures = [x for name, bounds in MEASURES.items() for x in (name, *bounds)]
    return both.select("doc_id", "th", "lang", "n_units", "n_words", *measures, (~outside).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows."""
    out = persisted(scored(docs, labels).filter("NOT keep").select("doc_id", "th").distinct(), "rejected")
    name, gone, gone_hash = fresh(docs, "row_hash", "gone_id", "gone_hash")
    out = out.select(F.col("doc_id").alias(gone), F.col("th").alias(gone_hash))
    keyed = docs.withColumn(name, text_hash())
    same = keyed["doc_id"].eqNullSafe(out[gone]) & (keyed[name] == out[gone_hash])
    return keyed.join(out, same, "left_anti").drop(name)


def op2_quality_classifier(spark, sf: str) -> DataFrame:
    """Perplexities, thresholds and decision for every document."""
    found = scored(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.drop("th")
