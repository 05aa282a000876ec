"""Benchmark decontamination by templates.

Texts become tokens without punctuation or case; a token with a digit is the
placeholder NUMBER (7.5 and 1,250 are one), a unit after a number UNIT, and a
capitalised word or a run of them within a sentence NAME (capitals of any alphabet).
At the beginning of a sentence a capital tells nothing, so texts have a second form in which
capitalised words are NAME there too; the two forms are matched apart.  Windows of ``WIDTH`` tokens are hashed and joined between
documents and benchmark items.  Matches of one document and item that lie on
one diagonal (same shift) belong together, and diagonals ``NEAR`` each other are
chained into one alignment, so that an added or missing word does not split it.
Slots must be consistent: each value of the item stands for one value of the
document (two values may stand for the same one), so
a question with other numbers or names is still found, while a chance match of
placeholders is not.  Beside these windows, windows of the words as they stand
(with numbers and names, whatever their share) are matched in the same way.  A
document is contaminated if an alignment of either kind covers ``COVER`` percent
of an item's tokens, and ``TOKENS`` of them or all, or if ``RUN`` words of an item
stand in it in a row.

Only windows that hit a bit map of the item windows (fixed size) leave a map
task; the join then removes the map's false hits.  Template windows with fewer
than ``LITERAL`` plain words say too little and are not looked up.  Items of
fewer than ``LITERAL`` words match nothing, as any text might hold them.

Null and empty texts are clean, and null or empty items match nothing.  Items
of fewer than ``WIDTH`` tokens are matched as one shorter window of a kind.  Equal items
each count.  Repeated rows are judged alike.  An empty benchmark leaves every
document clean.  Further columns may have any name and are kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import bitmap, blocks, fresh, in_bitmap, table, text_hash, utf8
from inkprint.llm.hashing import PLAIN, mix, windows, words
from inkprint.runtime import persisted

WIDTH, LITERAL, COVER, TOKENS, BITS = 8, 4, 50, 12, 24
#: Shifts of two windows of one alignment differ by so many tokens at most.
NEAR = 4
#: So many words of an item in a row, as they stand, are enough however long it is.
RUN = 50
# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years ms hz khz mhz ghz w kw mw v a n pa bar j kj kcal cal k c f percent dollar dollars euro euros usd eur cent "
    "cents meter meters metre metres kilometer kilometers mile miles foot feet inch inches pound pounds kilogram kilograms gram grams "
    "liter liters litre litres degree degrees"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (11, 12, 13))


#: Kinds of windows: over templates, over the words as they stand, and over
#: templates whose sentences may begin with a name.
TEMPLATE, RAW, OPEN = 0, 1, 2


class Templates(NamedTuple):
    canonical: np.ndarray  # hash of each token or placeholder
    slots: np.ndarray  # hash of what stands at a placeholder, 0 at words
    offsets: np.ndarray


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
    return np.sort(words(data, np.array([0, len(data)]), PLAIN).hashes)


_UNIT = _unit_hashes()
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
#: Whether a code point below 2^16 is a capital letter.
_UPPER = np.array([chr(c).isupper() or chr(c).istitle() for c in range(1 << 16)])
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n:|")] = True


def capitals(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 character at each start is a capital (of at most three bytes)."""
    one, two, three = (data[np.minimum(starts + k, len(data) - 1)].astype(np.int32) for k in range(3))
    code = np.where(one < 0x80, one, np.where(one < 0xE0, (one & 31) << 6 | two & 63, (one & 15) << 12 | (two & 63) << 6 | three & 63))
    return _UPPER[np.where(one < 0xF0, code, 0)]


def forms(data: np.ndarray, offsets: np.ndarray) -> dict[int, Templates]:
    """The tokens of texts in every kind; words are found once for all."""
    found = words(data, offsets, PLAIN)
    n = len(found.starts)
    raw = Templates(found.hashes, np.zeros(n, dtype=np.uint64), found.offsets)
    if not n:
        return {TEMPLATE: raw, RAW: raw, OPEN: raw}
    firsts = found.offsets[:-1][found.offsets[:-1] < n]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int32)])
    number = digits[found.ends] > digits[found.starts]
    stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int32)])
    inside = np.zeros(n, dtype=bool)
    inside[1:] = stops[found.starts[1:]] == stops[found.ends[:-1]]
    inside[firsts] = False
    capital = capitals(data, found.starts) & ~number
    unit = np.zeros(n, dtype=bool)
    unit[1:] = number[:-1]
    unit[firsts] = False
    follows = np.flatnonzero(unit)
    at = np.minimum(np.searchsorted(_UNIT, found.hashes[follows]), len(_UNIT) - 1)
    unit[follows] = (_UNIT[at] == found.hashes[follows]) & ~number[follows]
    # a whole number and a run of names are one token each
    gap = found.starts[1:] - found.ends[:-1]
    between = data[found.ends[:-1]]
    figures = _DIGIT[data[found.ends[:-1] - 1]] & _DIGIT[data[found.starts[1:]]] & ((between == 44) | (between == 46))
    parts = (gap == 1) & number[:-1] & number[1:] & figures
    blank = (gap == 1) & inside[:-1] & (between == 32)

    def form(name: np.ndarray) -> Templates:
        canonical = found.hashes.copy()
        for where, mark in ((name, NAME), (number, NUMBER), (unit, UNIT)):
            canonical[where] = mark
        slots = np.where(number | name | unit, found.hashes, np.uint64(0))
        more = np.zeros(n, dtype=bool)
        more[1:] = parts | (name[:-1] & name[1:] & blank)
        more[firsts] = False
        if not more.any():
            return Templates(canonical, slots, found.offsets)
        first = np.flatnonzero(~more)
        size = np.diff(np.append(first, n))
        place = np.arange(n) - np.repeat(first, size)
        slots[more] = mix(slots[more] + place[more].astype(np.uint64))
        return Templates(canonical[first], np.add.reduceat(slots, first), np.searchsorted(first, found.offsets))

    return {TEMPLATE: form(capital & inside), RAW: raw, OPEN: form(capital)}


def item_windows(benchmark: DataFrame, width: int = WIDTH, literal: int = LITERAL) -> DataFrame:
    """(h, kind, wide, item, tokens, item_pos, item_slots): windows of the items; short items have one window of a kind."""
    names = ["h", "kind", "wide", "item", "tokens", "item_pos", "item_slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            items = batch.column("item").to_pylist()
            offsets, data = utf8(batch.column("text"))
            for kind, t in forms(data, offsets).items():
                for item, a, b in zip(items, t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True):
                    wide = min(width, b - a)
                    if wide < literal:
                        continue
                    hashes = mix(windows(t.canonical[a:b], wide) + np.uint64(wide + (kind << 32))).view(np.int64)
                    plain = np.convolve(t.slots[a:b] == 0, np.ones(wide, dtype=np.int64), "valid")
                    for p in np.flatnonzero(plain >= literal).tolist():
                        slots = t.slots[a + p : a + p + wide].view(np.int64).tolist()
                        for k, v in zip(names, (int(hashes[p]), kind, wide, item, b - a, p, slots), strict=True):
                            out[k].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=names)

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item"), "text")
    return rows.mapInArrow(run, "h bigint, kind int, wide int, item bigint, tokens int, item_pos int, item_slots array<bigint>")


def document_windows(docs: DataFrame, wanted: np.ndarray, wides: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, th, h, pos, slots): windows of documents that hit the bit map."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    names = ["doc_id", "th", "h", "pos", "slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            for lo, hi in blocks(offsets):
                t = forms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for kind, wide in wides:
                    tokens = t[kind]
                    h = mix(windows(tokens.canonical, wide) + np.uint64(wide + (kind << 32)))
                    at = np.flatnonzero(in_bitmap(sent.value, h))
                    row = np.searchsorted(tokens.offsets, at, side="right") - 1
                    whole = at + wide <= tokens.offsets[row + 1]
                    at, row = at[whole], row[whole]
                    if not len(at):
                        continue
                    take = pa.array(row + lo)
                    slots = tokens.slots[at[:, None] + np.arange(wide)].view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * wide), pa.array(slots.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(h[at].view(np.int64)), pa.array((at - tokens.offsets[row]).astype(np.int32)), lists],
                        names=names,
                    )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("th"), "text")
    return rows.mapInArrow(run, "doc_id bigint, th bigint, h bigint, pos int, slots array<bigint>")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, cover: int = COVER, least: int = TOKENS, run: int = RUN) -> DataFrame:
    """(doc_id, th, item, covered, tokens, begin): each document with each item
    found in it, by the alignment that covers most."""
    items = persisted(item_windows(benchmark, width), "items")
    wides = [(r.kind, r.wide) for r in items.select("kind", "wide").distinct().collect()]  # at most ``width`` numbers of a kind
    hits = persisted(document_windows(docs, bitmap(items, "h", BITS), wides), "hits")
    matched = hits.join(items, "h").filter("size(slots) = wide").withColumn("shift", F.col("pos") - F.col("item_pos"))
    key = ["doc_id", "th", "item", "kind", "shift"]
    matched = persisted(
        matched.select(*key, "tokens", "item_pos", "wide", "pos", F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda x: x["i"] != 0).alias("pairs")).distinct(),
        "matched",
    )
    # a diagonal has at most one window per place of its item
    places = F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(item_pos, item_pos + wide - 1)"))))
    pairs = F.array_distinct(F.flatten(F.collect_set("pairs")))
    diagonals = matched.groupBy(*key, "tokens").agg(places.alias("places"), F.min("pos").alias("begin"), pairs.alias("pairs"))
    diagonals = diagonals.select(*key, "tokens", "places", "begin", F.transform("pairs", lambda x: x["i"]).alias("i"), F.transform("pairs", lambda x: x["d"]).alias("d"))
    diagonals = diagonals.filter("size(i) = size(array_distinct(i))")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for kind, own in pdf.groupby("kind"):
            tokens = int(own["tokens"].iloc[0])
            for places, begin in chains(own):
                if (len(places) * 100 >= tokens * cover and len(places) >= min(tokens, least)) or (kind == RAW and any(longest(x) >= run for x in own["places"])):
                    found.append((len(places), begin, tokens))
        covered, begin, tokens = max(found, default=(0, 0, 0))
        out = pdf[["doc_id", "th", "item"]].iloc[: min(1, len(found))]
        return out.assign(covered=covered, tokens=tokens, begin=begin)

    # a group costs time and few bytes, so adaptive execution, which merges by bytes, would make one task of many
    spread = diagonals.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "th", "item")
    return spread.groupBy("doc_id", "th", "item").applyInPandas(chain, "doc_id bigint, th bigint, item bigint, covered int, tokens int, begin int")


def longest(places: list[int]) -> int:
    """Length of the longest run of numbers in a row."""
    at = np.sort(np.asarray(places))
    return int(max(map(len, np.split(at, np.flatnonzero(np.diff(at) != 1) + 1)))) if len(at) else 0


def chains(diagonals: pd.DataFrame) -> Iterator[tuple[set[int], int]]:
    """(places of the item, begin) of alignments: diagonals with shifts at most
    ``NEAR`` from the next, from the longest on, as far as their slots agree.

    Diagonals are linked in the order of their shifts, so each alignment looks at its neighbours only."""
    rows = sorted(zip(diagonals["shift"], diagonals["places"], diagonals["begin"], diagonals["i"], diagonals["d"], strict=True), key=lambda r: r[0])
    before, after = list(range(-1, len(rows) - 1)), list(range(1, len(rows) + 1))
    free = [True] * len(rows)

    def unlink(k: int) -> None:
        free[k] = False
        if before[k] >= 0:
            after[before[k]] = after[k]
        if after[k] < len(rows):
            before[after[k]] = before[k]

    for seed in sorted(range(len(rows)), key=lambda k: -len(rows[k][1])):
        if not free[seed]:
            continue
        shift, places, begin, i, d = rows[seed]
        places, stands = set(places), dict(zip(i, d, strict=True))
        for link in (before, after):
            edge, k = shift, link[seed]
            while 0 <= k < len(rows) and abs(rows[k][0] - edge) <= NEAR:
                at, more, start, i, d = rows[k]
                if all(stands.get(x, y) == y for x, y in zip(i, d, strict=True)):
                    places |= set(more)
                    stands |= dict(zip(i, d, strict=True))
                    edge, begin = at, min(begin, start)
                    unlink(k)
                k = link[k]
        unlink(seed)
        yield places, begin


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows."""
    out = persisted(contaminated(docs, benchmark).select("doc_id", "th").distinct(), "contaminated")
    name, gone, gone_hash = fresh(docs, "row_hash", "gone_id", "gone_hash")
    out = out.select(F.col("doc_id").alias(gone), F.col("th").alias(gone_hash))
    keyed = docs.withColumn(name, text_hash())
    same = keyed["doc_id"].eqNullSafe(out[gone]) & (keyed[name] == out[gone_hash])
    return keyed.join(out, same, "left_anti").drop(name)


def op9_template_decontamination(spark, sf: str) -> DataFrame:
    """Every document, whether it holds a benchmark item, how many and the best covered."""
    docs = table(spark, sf, "documents")
    found = contaminated(docs, table(spark, sf, "benchmark"))
    per_row = found.groupBy("doc_id", "th").agg(
        F.count("*").alias("n_items"), F.max_by("item", F.struct("covered", F.negative("item"))).alias("item_id"), F.max("covered").alias("covered")
    )
    per_row = persisted(per_row.withColumnsRenamed({"doc_id": "f_id", "th": "f_th"}), "found")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("th"))
    joined = rows.join(per_row, F.expr("doc_id <=> f_id AND th = f_th"), "left")
    return joined.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id",
        F.coalesce("covered", F.lit(0)).alias("covered"),
    )
