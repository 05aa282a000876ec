"""Sums of a Kneser-Ney model's values over texts, made where the grams lie.

A place of a text is a word (or the end) ``w`` with the two words ``u v`` before it.  All
that it adds to a logarithm but the part of ``w`` alone is decided by places with
the same ``v``: the grams ``u v w``, their context ``u v``, the grams ``v w`` and their context ``v``.
So places are dealt by ``v`` into buckets, each packed with a list of its own words and
numbers of one to four bytes into it, and a bucket counts the model's grams and adds up
the values of all texts at once: no gram is stored, and no pair of a text and a gram leaves its bucket but
as part of the text's sum.

* Buckets hold about as many places each.  A word that would fill more than one is
  dealt over several by ``u``; how many words follow it is then added up between the two sweeps below
  and sent to each of them.
* The first sweep takes the trusted texts only, in ``COUNTS`` runs.  It finds the counts of counts, and for every
  word how many words it follows.
* The ``TOP`` most frequent words of a model are known to all buckets.  Of the others,
  those of a bucket's grams are sent to it, and their own part is added up in buckets by ``w``.
* The second sweep takes all texts in ``SWEEPS`` runs, each for a share of the buckets, and the shuffle
  files of a run are deleted as it ends.  So disk is a share of the places, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import bitmap, blocks, in_bitmap, utf8
from inkprint.llm.hashing import SPACED, mix, words
from inkprint.runtime import discard, persisted

WORDS = 3
BEGIN, END = (np.uint64(x) for x in (21, 22))
CELLS, BUCKETS, LEAST, MOST = 1 << 14, 64, 1 << 18, 3 << 18
COUNTS, SWEEPS, TOP, BITS = 2, 4, 1 << 18, 28
SHARE = 2
#: Places of a task that are packed at once.
_HELD = 3 << 19
_PACKED = "bucket int, common int, words int, docs int, places int, data binary"
#: What the first sweep finds: counts of counts of three and of two words, words, followers of dealt words.
_THREE, _TWO, _ONE, _DEALT = range(4)
_FOUND = "kind int, bucket int, half int, v bigint, w bigint, c bigint"


def cuts(most: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and above, from how many grams have counts 1 to 4."""
    y = most[0] / (most[0] + 2 * most[1]) if most[0] and most[1] else 0.5
    return [min(max(i - (i + 1) * y * most[i] / most[i - 1], 0.1), i - 0.1) if most[i - 1] else 0.5 * i for i in (1, 2, 3)]


def _less(c: np.ndarray, cut: list[float]) -> np.ndarray:
    return np.array([0.0, *cut])[np.minimum(c, 3)]


def marked(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, place, hash) of the words of blocks of rows, with ``WORDS`` - 1 marks
    before and one after the words of every text that has any."""
    offsets, data = utf8(column)
    for lo, hi in blocks(offsets):
        found = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SPACED)
        size = np.diff(found.offsets)
        full = np.flatnonzero(size)
        size = size[full] + WORDS
        ends = np.cumsum(size)
        hashes = np.full(int(size.sum()), BEGIN, dtype=np.uint64)
        row = np.repeat(full, size)
        place = np.arange(len(hashes)) - np.repeat(ends - size, size)
        hashes[(place >= WORDS - 1) & (place < np.repeat(size, size) - 1)] = found.hashes
        hashes[ends - 1] = END
        yield lo, row, place, hashes


class Plan(NamedTuple):
    """The first bucket of a cell of words, and over how many its places are dealt.
    Words that not all buckets know have buckets of their own after those, one for each ``SHARE``."""

    first: np.ndarray
    parts: np.ndarray
    buckets: int

    def alone(self, w: np.ndarray) -> np.ndarray:
        return self.buckets + (mix(w) % np.uint64(-(-self.buckets // SHARE))).astype(np.int64)

    def cell(self, v: np.ndarray) -> np.ndarray:
        return (v & np.uint64(CELLS - 1)).astype(np.int64)

    def bucket(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        at = self.cell(v)
        out = self.first[at]
        many = np.flatnonzero(self.parts[at] > 1)
        out[many] += (mix(u[many]) % self.parts[at[many]].astype(np.uint64)).astype(np.int64)
        return out

    def dealt(self, v: np.ndarray) -> np.ndarray:
        return self.parts[self.cell(v)] > 1


def made_plan(sizes: np.ndarray, most: int) -> Plan:
    """Buckets of at most about ``most`` places, from the places of each cell."""
    first, parts = np.zeros(CELLS, dtype=np.int64), np.maximum(1, -(-sizes // most))
    whole = parts == 1
    first[whole] = (np.cumsum(sizes[whole]) - sizes[whole]) // most
    n = int(first[whole].max(initial=-1)) + 1
    first[~whole] = n + np.cumsum(parts[~whole]) - parts[~whole]
    return Plan(first, parts, n + int(parts[~whole].sum()))


def cell_counts(row_places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of each cell of words, from what :func:`marked` gives."""
    at = np.flatnonzero(row_places >= WORDS - 1)
    return np.bincount((hashes[at - 1] & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)


def cell_sizes(docs: DataFrame) -> np.ndarray:
    """Places of each cell of words in the texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for _, _, place, hashes in marked(batch.column("text")):
                n += cell_counts(place, hashes)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])

    sizes = np.zeros(CELLS, dtype=np.int64)
    got = docs.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    sizes[got["cell"].to_numpy()] = got["n"].to_numpy()
    return sizes


def _kind(n: int) -> type:
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def _layout(common: int, n_words: int, n_docs: int, n_places: int) -> list[tuple[type, int]]:
    return [(np.uint32, common), (np.uint64, n_words - common), (np.int64, n_docs), (np.uint8, n_docs), (_kind(n_words), 3 * n_places), (_kind(n_docs), n_places), (np.uint32, n_places)]


def _pack(at: int, known: dict[str, np.ndarray], places: dict[str, np.ndarray], common: np.ndarray, table: np.ndarray) -> tuple:
    """A row of ``_PACKED`` from hashes u, v, w, numbers of texts and counts.  Words of the
    sorted list ``common`` that ``table`` has are differences of their numbers in it."""
    codes, vocabulary = pd.factorize(np.concatenate([places["u"], places["v"], places["w"]]))
    number = table[vocabulary & np.uint64(len(table) - 1)]
    listed = common[number] == vocabulary if len(common) else np.zeros(len(vocabulary), dtype=bool)
    order = np.argsort(np.where(listed, number, len(common)))
    n = int(listed.sum())
    place_of = np.empty(len(order), dtype=np.int64)
    place_of[order] = np.arange(len(order))
    doc, texts = pd.factorize(places["doc"])
    kinds = _layout(n, len(vocabulary), len(texts), len(doc))
    parts = [np.diff(number[order[:n]], prepend=0), vocabulary[order[n:]], known["key"][texts], known["flag"][texts], place_of[codes], doc, places["n"]]
    data = pa.compress(b"".join(x.astype(kind, copy=False).tobytes() for x, (kind, _) in zip(parts, kinds, strict=True)), codec="zstd", asbytes=True)
    return at, n, len(vocabulary), len(texts), len(doc), data


def _unpacked(table: pa.Table, common: np.ndarray) -> dict[str, np.ndarray]:
    """Words, texts and places of a bucket; u, v and w are numbers of words, doc is one of texts."""
    sets: dict[str, list[np.ndarray]] = {k: [] for k in ("words", "key", "flag", "u", "v", "w", "doc", "n")}
    n_words = n_docs = 0
    rows = [table.column(k).to_pylist() for k in ("common", "words", "docs", "places")]
    for c, w, d, p, data in zip(*rows, table.column("data"), strict=True):
        kinds = _layout(c, w, d, p)
        raw = pa.decompress(data.as_buffer(), decompressed_size=sum(np.dtype(k).itemsize * n for k, n in kinds), codec="zstd")
        found, at = [], 0
        for kind, n in kinds:
            found.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
            at += found[-1].nbytes
        listed = common[np.cumsum(found[0], dtype=np.int64)] if c else found[1][:0]
        codes = found[4].reshape(3, p).astype(np.int32) + n_words
        for name, x in zip(sets, (np.concatenate([listed, found[1]]), *found[2:4], *codes, found[5].astype(np.int32) + n_docs, found[6]), strict=True):
            sets[name].append(x)
        n_words, n_docs = n_words + w, n_docs + d
    out = {k: np.concatenate(x) if x else np.zeros(0, dtype=np.uint64 if k == "words" else np.int32) for k, x in sets.items()}
    same, out["words"] = pd.factorize(out["words"])
    return out | {k: same.astype(np.int32)[out[k]] for k in "uvw"}


def _merged(places: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each gram of a text once, with its count."""
    codes, grams = pd.factorize(mix(mix(mix(places["u"]) + places["doc"].astype(np.uint64)) + places["v"]) + mix(places["w"]))
    first = np.empty(len(grams), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return {k: x[first] for k, x in places.items()} | {"n": np.bincount(codes, weights=places["n"]).astype(np.int64)}


def packed(docs: DataFrame, sent: Broadcast, part: int, parts: int, whole: bool, rare: Broadcast | None = None) -> DataFrame:
    """The places of (key, flag, text) by bucket, given a :class:`Plan` and a sorted list of words:
    those of the buckets whose number modulo ``parts`` is ``part``.  If not ``whole``,
    texts are told apart by their flag only, as counting asks no more.  Places of words
    that hit the bit map ``rare`` by the half that their text is not in go to those words' buckets besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, common = sent.value[:2]
        table = np.zeros(1 << 21 if len(common) else 1, dtype=np.int32)  # of words with the same last bits the last
        table[common & np.uint64(len(table) - 1)] = np.arange(len(common))
        ours = np.zeros(CELLS, dtype=bool)  # cells with a bucket of this run
        ours[plan.parts >= parts] = True
        for k in range(parts - 1):
            ours |= (plan.parts > k) & ((plan.first + k) % parts == part)
        held: list[dict[str, np.ndarray]] = []
        known: dict[str, list[np.ndarray]] = {"key": [], "flag": []}
        n_places = n_docs = 0
        names = ["bucket", "common", "words", "docs", "places", "data"]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_places, n_docs
            every = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            texts = {k: np.concatenate(x) for k, x in known.items()}
            if not whole:
                every["doc"] = texts["flag"][every["doc"]].astype(np.int64)
                texts = {"key": np.zeros(4, dtype=np.int64), "flag": np.arange(4, dtype=np.uint8)}
                every = _merged(every)
            bucket = every["bucket"]
            order = np.argsort(bucket.astype(_kind(int(bucket.max()) + 1)), kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for lo, hi in zip(starts, np.append(starts[1:], len(order)), strict=True):
                own = order[lo:hi]
                row = _pack(int(bucket[own[0]]), texts, {k: x[own] for k, x in every.items()}, common, table)
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in row[:-1]), pa.array([row[-1]], pa.binary())], names=names)
            held.clear()
            known["key"].clear()
            known["flag"].clear()
            n_places = n_docs = 0

        for batch in batches:
            key, flag = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "flag"))
            known["key"].append(key)
            known["flag"].append(flag.astype(np.uint8))
            base = n_docs
            n_docs += len(key)
            for lo, row, place, hashes in marked(batch.column("text")):
                at = np.flatnonzero(ours[plan.cell(hashes[:-1])] & (place[1:] >= WORDS - 1)) + 1
                bucket = plan.bucket(hashes[at - 2], hashes[at - 1])
                own = bucket % parts == part
                at, bucket = at[own], bucket[own]
                found = [{"u": hashes[at - 2], "v": hashes[at - 1], "w": hashes[at], "doc": row[at] + lo + base, "bucket": bucket}]
                if rare is not None:
                    at = np.flatnonzero(place >= WORDS - 1)
                    at = at[in_bitmap(rare.value, hashes[at] ^ (1 - (flag[lo + row[at]] & 1)).astype(np.uint64))]
                    bucket = plan.alone(hashes[at])
                    own = bucket % parts == part
                    at, bucket = at[own], bucket[own]
                    same = np.full(len(at), BEGIN, dtype=np.uint64)
                    found.append({"u": same, "v": same, "w": hashes[at], "doc": row[at] + lo + base, "bucket": bucket})
                for x in found:
                    if len(x["w"]):
                        held.append(_merged(x | {"n": np.ones(len(x["w"]), dtype=np.int64)}))
                        n_places += len(held[-1]["n"])
                if n_places > _HELD:
                    yield from flush()
                    known["key"].append(key)  # the rest of the batch, numbered from 0 again
                    known["flag"].append(flag.astype(np.uint8))
                    base, n_docs = 0, len(key)
        if held:
            yield from flush()

    return docs.select("key", "flag", "text").mapInArrow(run, _PACKED)


class Grams(NamedTuple):
    """Grams of a bucket: the gram, context and pair of each place, and what they are made of."""

    t: np.ndarray
    x: np.ndarray
    b: np.ndarray
    context: np.ndarray  # of a gram
    pair: np.ndarray  # of a gram
    v: np.ndarray  # of a pair
    w: np.ndarray  # of a pair


def _grams(p: dict[str, np.ndarray]) -> Grams:
    n = np.int64(max(1, len(p["words"])))
    x = pd.factorize(p["u"] * n + p["v"])[0]
    b, pairs = pd.factorize(p["v"] * n + p["w"])
    t, grams = pd.factorize(x * n + p["w"])
    x, b, t = (k.astype(np.int32) for k in (x, b, t))
    pair = np.zeros(len(grams), dtype=np.int64)
    pair[t] = b
    return Grams(t, x, b, grams // n, pair, pairs // n, pairs % n)


def _counted(p: dict[str, np.ndarray], g: Grams, half: int) -> np.ndarray:
    """Count of each gram in the trusted texts of a half."""
    own = p["flag"][p["doc"]] == 2 + half
    return np.bincount(g.t[own], weights=p["n"][own], minlength=len(g.context)).astype(np.int64)


def _found(plan: Plan, common: np.ndarray) -> Callable[[tuple, pa.Table], pa.Table]:
    """The first sweep's rows of ``_FOUND`` of a bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p = _unpacked(table, common)
        g = _grams(p)
        dealt = plan.dealt(p["words"])[g.v]
        out = []

        def add(kind: int, half: int, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> None:
            n = len(c)
            out.append([np.full(n, kind, np.int32), np.full(n, key[0].as_py(), np.int32), np.full(n, half, np.int32), *(np.asarray(x).astype(np.uint64).view(np.int64) for x in (v, w, c))])

        for half in (0, 1):
            c = _counted(p, g, half)
            followed = np.bincount(g.pair[c > 0], minlength=len(g.v))
            whole = (followed > 0) & ~dealt
            for kind, counts in ((_THREE, c), (_TWO, followed[whole])):
                add(kind, half, np.arange(1, 5), np.zeros(4), np.bincount(np.minimum(counts, 5), minlength=6)[1:5])
            n = np.bincount(g.w[whole], minlength=len(p["words"]))
            at = np.flatnonzero(n)
            add(_ONE, half, np.zeros(len(at)), p["words"][at], n[at])
            at = np.flatnonzero((followed > 0) & dealt)
            add(_DEALT, half, p["words"][g.v[at]], p["words"][g.w[at]], followed[at])
        names = ["kind", "bucket", "half", "v", "w", "c"]
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    return run


class Model(NamedTuple):
    """What every bucket has to know; by half."""

    three: list[list[float]]  # discounts of grams of three words
    two: list[list[float]]
    words: list[np.ndarray]  # the most frequent words, in order
    counts: list[np.ndarray]  # how many words each follows
    cut: list[list[float]]
    total: list[float]
    low: list[float]  # what a word has that was never seen


def _values(plan: Plan, common: np.ndarray, model: Model) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """(key, known) of a bucket: what its places add to the texts."""

    def by_text(p: dict[str, np.ndarray], known: np.ndarray) -> pa.Table:
        sums = np.bincount(p["doc"], weights=known, minlength=len(p["key"]))
        return pa.table([pa.array(p["key"], pa.int64()), pa.array(sums, pa.float64())], names=["key", "known"])

    def alone(p: dict[str, np.ndarray], more: pa.Table) -> pa.Table:
        """Of the words that not all buckets know: what they add of their own."""
        known, other = np.zeros(len(p["w"])), 1 - (p["flag"] & 1)[p["doc"]]
        number = pd.Index(p["words"])
        half, w, c = (more.column(k).to_numpy() for k in ("half", "w", "c"))
        for k in (0, 1):
            values, at = np.zeros(len(p["words"])), number.get_indexer(w[half == k].view(np.uint64))
            count = c[half == k][at >= 0]
            if len(count):
                values[at[at >= 0]] = np.log1p((count - _less(count, model.cut[k])) / model.total[k] / model.low[k])
            known += np.where(other == k, values[p["w"]] * p["n"], 0.0)
        return by_text(p, known)

    def run(key: tuple, table: pa.Table, more: pa.Table) -> pa.Table:
        p = _unpacked(table, common)
        if key[0].as_py() >= plan.buckets:
            return alone(p, more)
        g = _grams(p)
        dealt = plan.dealt(p["words"])
        extra = {k: more.column(k).to_numpy() for k in ("kind", "half", "v", "w", "c")}
        own_half = (p["flag"] & 1)[p["doc"]]
        known = np.zeros(len(g.t))
        number = pd.Index(p["words"])

        def parted(num: np.ndarray, by: np.ndarray) -> np.ndarray:
            return np.divide(num, by, out=np.zeros(len(num)), where=by > 0)

        for half in (0, 1):
            if not model.total[half]:
                continue
            c = _counted(p, g, half)
            pairs = np.bincount(g.pair[c > 0], minlength=len(g.v)).astype(np.int64)
            own = {k: x[extra["half"] == half] for k, x in extra.items()}
            # how many words each follows: here, in all for the most frequent, as sent to this bucket
            follows = np.bincount(g.w[(pairs > 0) & ~dealt[g.v]], minlength=len(p["words"]))
            top = np.zeros(len(p["words"]), dtype=bool)
            at = number.get_indexer(model.words[half])
            follows[at[at >= 0]] = model.counts[half][at >= 0]
            top[at[at >= 0]] = True
            up = np.where(top, follows - _less(follows, model.cut[half]), 0.0) / model.total[half]
            values = np.log1p(up / model.low[half])[p["w"]]
            sent = own["kind"] == _ONE
            at = number.get_indexer(own["w"][sent].view(np.uint64))
            follows[at[at >= 0]] = own["c"][sent][at >= 0]
            lower = (follows - _less(follows, model.cut[half])) / model.total[half] + model.low[half]
            # words that follow a word dealt over several buckets
            sent = own["kind"] == _DEALT
            v, w, c_two = (own[k][sent] for k in ("v", "w", "c"))
            v, w = (number.get_indexer(x.view(np.uint64)) for x in (v, w))
            totals = np.bincount(g.v, weights=np.where(dealt[g.v], 0, pairs), minlength=len(p["words"]))
            left = np.bincount(g.v, weights=np.where(dealt[g.v], 0, _less(pairs, model.two[half])), minlength=len(p["words"]))
            here = v >= 0
            totals += np.bincount(v[here], weights=c_two[here], minlength=len(totals))
            left += np.bincount(v[here], weights=_less(c_two[here], model.two[half]), minlength=len(totals))
            n = np.int64(max(1, len(p["words"])))
            both = here & (w >= 0)
            if dealt.any():
                at = pd.Index(g.v * n + g.w).get_indexer(v[both] * n + w[both])
                pairs[dealt[g.v]] = 0
                pairs[at[at >= 0]] = c_two[both][at >= 0]
            # grams of two words, then of three
            seen = pairs > 0
            down = parted(left, totals)[g.v] * lower[g.w]
            up = parted(pairs - _less(pairs, model.two[half]), totals[g.v])
            two = np.where(seen, np.log1p(parted(up, down)), 0.0)
            lower = (up + down)[g.pair]
            totals_x = np.bincount(g.context, weights=c, minlength=int(g.x.max(initial=-1)) + 1)
            left_x = np.bincount(g.context, weights=_less(c, model.three[half]), minlength=len(totals_x))
            up = parted(c - _less(c, model.three[half]), totals_x[g.context])
            three = np.where(c > 0, np.log1p(parted(up, parted(left_x, totals_x)[g.context] * lower)), 0.0)
            for one, whole, place in ((left, totals, p["v"]), (left_x, totals_x, g.x)):
                mass = parted(one, whole)
                values += np.where(mass > 0, np.log(np.where(mass > 0, mass, 1.0)), 0.0)[place]
            values += two[g.b] + three[g.t]
            known += np.where(own_half == 1 - half, values * p["n"], 0.0)
        return by_text(p, known)

    return run


def _sent(dealt: DataFrame, plan: Plan) -> DataFrame:
    """Followers of dealt words, once for each bucket that has places of the word."""
    names = ["kind", "bucket", "half", "v", "w", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = plan.cell(batch.column("v").to_numpy().view(np.uint64))
            n = plan.parts[cell]
            row = np.repeat(np.arange(len(cell)), n)
            bucket = plan.first[cell][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            took = batch.take(pa.array(row))
            columns = [pa.array(np.full(len(row), _DEALT, np.int32)), pa.array(bucket.astype(np.int32)), *(took.column(k) for k in names[2:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.select("half", "v", "w", "c").mapInArrow(run, _FOUND)


def _most(rows: DataFrame) -> list[list[float]]:
    """Discounts of both halves from rows of (half, v, c): how many grams have a count of v."""
    n = {(r.half, r.v): r.c for r in rows.groupBy("half", "v").agg(F.sum("c").alias("c")).collect()}
    return [cuts([n.get((half, i), 0) for i in (1, 2, 3, 4)]) for half in (0, 1)]


def sums(docs: DataFrame, sizes: np.ndarray | None = None, most: int | None = None, top: int | None = None) -> tuple[DataFrame, dict[int, float]]:
    """((key, known), floor of each half) of (key, text, half, trusted).

    ``sizes`` is :func:`cell_sizes` if known; it, ``most`` places of a bucket and ``top`` only say how the work is dealt.
    ``known`` is what the places of all rows of a key add to the floor by the model of
    the trusted texts of the other half; a key may be missing where nothing is known."""
    top = top or TOP
    docs = docs.select("key", "text", (F.col("half") + F.when(F.col("trusted"), 2).otherwise(0)).cast("int").alias("flag"))
    sizes = cell_sizes(docs) if sizes is None or not sizes.sum() else sizes
    plan = made_plan(sizes, most or int(np.clip(sizes.sum() // BUCKETS, LEAST, MOST)))
    context = docs.sparkSession.sparkContext
    first = context.broadcast((plan, np.zeros(0, dtype=np.uint64)))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        return _found(*first.value)(key, table)

    counted = [persisted(packed(docs.filter("flag >= 2"), first, part, COUNTS, False).groupBy("bucket").applyInArrow(count, _FOUND), "found") for part in range(COUNTS)]
    found = reduce(DataFrame.unionByName, counted)
    dealt = found.filter(f"kind = {_DEALT}").groupBy("half", "v", "w").agg(F.sum("c").alias("c"))
    dealt = persisted(dealt, "dealt")
    three = _most(found.filter(f"kind = {_THREE}").select("half", "v", "c"))
    more = dealt.filter("c <= 4").groupBy("half", F.col("c").alias("v")).agg(F.count("*").alias("c"))
    two = _most(found.filter(f"kind = {_TWO}").select("half", "v", "c").unionByName(more))
    one = found.filter(f"kind = {_ONE}").select("half", "w", "c").unionByName(dealt.select("half", "w", F.lit(1).cast("bigint").alias("c")))
    one = persisted(one.groupBy("half", "w").agg(F.sum("c").alias("c")), "words")
    counts = one.groupBy("half", F.least("c", F.lit(4096)).alias("c")).agg(F.count("*").alias("n"), F.sum("c").alias("sum")).collect()
    whole = {half: [r for r in counts if r.half == half] for half in (0, 1)}
    cut = [cuts([sum(r.n for r in whole[half] if r.c == i) for i in (1, 2, 3, 4)]) for half in (0, 1)]
    total, n = ([float(sum(r[name] for r in whole[half])) for half in (0, 1)] for name in ("sum", "n"))
    left = [sum(r.n * cut[half][min(r.c, 3) - 1] for r in whole[half]) for half in (0, 1)]
    low = [left[half] / total[half] / (n[half] + 1) if total[half] else 0.0 for half in (0, 1)]  # one word more, for the unknown
    least, kept = 1, int(sum(n))
    for c in sorted({r.c for r in counts}):
        if kept <= top:
            break
        kept, least = kept - sum(r.n for r in counts if r.c == c), c + 1
    least = min(least, 4096)
    n_rare = sum(r.n for r in counts if r.c < least)
    got = one.filter(F.col("c") >= least).toPandas()
    parts = []
    for half in (0, 1):
        rows = got[got["half"] == half]
        words_ = rows["w"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(words_)
        parts.append((words_[order], rows["c"].to_numpy(dtype=np.int64)[order]))
    model = Model(three, two, [x[0] for x in parts], [x[1] for x in parts], cut, total, low)
    send, hits = _sent(dealt, plan), None
    if n_rare:
        rare = persisted(one.filter(F.col("c") < least), "rare")
        own = found.filter((F.col("kind") == _ONE) & (F.col("c") < least)).select("bucket", "half", "w")
        own = own.unionByName(_sent(dealt, plan).select("bucket", "half", "w").distinct())  # a word may be sent twice
        kind, none = F.lit(_ONE).alias("kind"), F.lit(0).cast("bigint").alias("v")
        asked = own.join(rare, ["half", "w"])
        send = send.unionByName(asked.select(kind, "bucket", "half", none, "w", "c"))

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = plan.alone(batch.column("w").to_numpy().view(np.uint64)).astype(np.int32)
                yield batch.set_column(batch.schema.get_field_index("bucket"), "bucket", pa.array(at))

        send = send.unionByName(rare.select(kind, F.lit(0).alias("bucket"), "half", none, "w", "c").mapInArrow(alone, _FOUND))
        bits = min(BITS, max(18, (8 * n_rare).bit_length()))
        hits = context.broadcast(bitmap(rare.select(F.col("w").bitwiseXOR(F.col("half").cast("bigint")).alias("k")), "k", bits))
    send = persisted(send, "sent")
    for done in (*counted, dealt, one, *([rare] if n_rare else [])):
        discard(done)
    shared = context.broadcast((plan, np.unique(np.concatenate(model.words)), model))

    def run(key: tuple, table: pa.Table, more: pa.Table) -> pa.Table:
        return _values(*shared.value)(key, table, more)

    # several buckets to a task: it sends one sum for a text
    out, tasks = None, max(3 * context.defaultParallelism, plan.buckets // (8 * SWEEPS))
    for part in range(SWEEPS):
        places = packed(docs, shared, part, SWEEPS, True, hits).repartition(tasks, "bucket")
        more = send.filter(F.col("bucket") % SWEEPS == part).repartition(tasks, "bucket")
        known = places.groupBy("bucket").cogroup(more.groupBy("bucket")).applyInArrow(run, "key bigint, known double")
        known = persisted(known.groupBy("key").agg(F.sum("known").alias("known")), "sums")
        out = known if out is None else out.unionByName(known)
    floors = {half: float(np.log(low[half])) for half in (0, 1) if total[half]}
    return persisted(out.groupBy("key").agg(F.sum("known").alias("known")), "sums"), floors
