"""Toxic spans by a linear-chain conditional random field.

A token is a run of letters and digits.  Its features are the word and its
first four and five bytes, hashed; its tag is clean or toxic.  The field is
trained on labelled tokens of a bounded sample of labelled documents: tokens of
a toxic document are toxic if their word or beginning is far more frequent in
toxic than in clean documents.  Forward-backward gives each token's marginal;
runs of likely tokens are spans, and a document's score is the chance that at
least one of its spans is toxic.

All texts are scored whole.  The recursions run over segments of 64 tokens of
all documents side by side, so one long text costs what its tokens cost.

Null and empty texts have no tokens and score 0.  Without labels of both kinds
every score is 0.  Ties between sampled rows are broken by a hash of the id.
Repeated rows score alike.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import blocks, broadcast_if_small, table, text_hash, utf8
from inkprint.llm.hashing import PLAIN, words

BITS = 18
SEGMENT = 64
#: Bounds of the training sample: rows of each kind, and bytes of a text in it.
SAMPLE, SAMPLE_BYTES = 1000, 50_000
ROUNDS, RATE, RIDGE = 30, 0.5, 1e-4
#: A feature marks toxic tokens if in at least 5 toxic documents and this many times as frequent as in clean ones.
LIFT, LEAST = 20.0, 5


class Field(NamedTuple):
    features: np.ndarray  # 3 x 2^BITS weights of the toxic tag
    bias: float
    moves: np.ndarray  # 2 x 2 weights of tag after tag


class Tokens(NamedTuple):
    cells: np.ndarray  # 3 x n feature numbers
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # of each text's first token
    base: np.ndarray  # byte at which each text begins
    data: np.ndarray


def tokens(offsets: np.ndarray, data: np.ndarray) -> Tokens:
    found = words(data, offsets, PLAIN, heads=(4, 5))
    shift = np.uint64(64 - BITS)
    cells = np.stack([(h >> shift).astype(np.int32) for h in (found.hashes, *found.heads)])
    return Tokens(cells, found.starts, found.ends, found.offsets, offsets, data)


def _layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Place of every token in a (segment, step) table whose rows belong to one
    text each; first segment of every text; number of segments."""
    n = np.diff(offsets)
    segments = -(-n // SEGMENT)
    first = np.concatenate([[0], np.cumsum(segments)])
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
    return np.repeat(first[:-1], n) * SEGMENT + inside, first, int(first[-1])


def marginals(field: Field, emission: np.ndarray, offsets: np.ndarray, pairs: bool = False):
    """P(toxic) of every token; with ``pairs`` also the expected number of moves between tags."""
    place, first, n = _layout(offsets)
    t = np.exp(field.moves)
    if not n:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    e = np.zeros(n * SEGMENT)
    e[place] = np.clip(emission, -30, 30)
    real = np.zeros(n * SEGMENT, dtype=bool)
    real[place] = True
    begin = np.zeros(n * SEGMENT, dtype=bool)
    begin[place[offsets[:-1][np.diff(offsets) > 0]]] = True
    e, real, begin = (np.ascontiguousarray(x.reshape(n, SEGMENT).T) for x in (np.exp(e), real, begin))

    def step(k: int) -> list[np.ndarray]:
        """The 2 x 2 matrix of each segment's step: move, then emit; nothing for padding."""
        free, own = begin[k], e[k]
        m = [np.where(free, 1.0, t[0, 0]), np.where(free, own, t[0, 1] * own), np.where(free, 1.0, t[1, 0]), np.where(free, own, t[1, 1] * own)]
        return [np.where(real[k], x, unit) for x, unit in zip(m, (1.0, 0.0, 0.0, 1.0), strict=True)]

    # product of each segment's matrices
    p = [np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)]
    for k in range(SEGMENT):
        m = step(k)
        p = [p[0] * m[0] + p[1] * m[2], p[0] * m[1] + p[1] * m[3], p[2] * m[0] + p[3] * m[2], p[2] * m[1] + p[3] * m[3]]
        scale = 1 / np.maximum(np.maximum(p[0], p[1]), np.maximum(p[2], p[3]))
        p = [x * scale for x in p]
    # along the segments of each text
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    left, right = np.ones((2, n)), np.ones((2, n))
    left[1] = 0.0
    for k in range(1, int(count.max())):
        here = order[: np.searchsorted(-count[order], -k, side="left")]
        s = first[:-1][here] + k
        a, b = left[0, s - 1], left[1, s - 1]
        x, y = a * p[0][s - 1] + b * p[2][s - 1], a * p[1][s - 1] + b * p[3][s - 1]
        left[0, s], left[1, s] = x / (x + y), y / (x + y)
        s = first[1:][here] - 1 - k
        a, b = right[0, s + 1], right[1, s + 1]
        x, y = p[0][s + 1] * a + p[1][s + 1] * b, p[2][s + 1] * a + p[3][s + 1] * b
        right[0, s], right[1, s] = x / (x + y), y / (x + y)
    # inside the segments
    forward = np.empty((2, SEGMENT, n))
    a, b = left
    for k in range(SEGMENT):
        m = step(k)
        x, y = a * m[0] + b * m[2], a * m[1] + b * m[3]
        a, b = x / (x + y), y / (x + y)
        forward[0, k], forward[1, k] = a, b
    toxic = np.empty((SEGMENT, n))
    moved = np.zeros((2, 2))
    a, b = right
    for k in range(SEGMENT - 1, -1, -1):
        x, y = forward[0, k] * a, forward[1, k] * b
        toxic[k] = y / (x + y)
        m = step(k)
        if pairs:
            f = forward[:, k - 1] if k else left
            cell = [f[0] * m[0] * a, f[0] * m[1] * b, f[1] * m[2] * a, f[1] * m[3] * b]
            use = real[k] & ~begin[k]
            total = np.maximum(sum(cell), 1e-300)
            moved += np.array([(c / total)[use].sum() for c in cell]).reshape(2, 2)
        x, y = m[0] * a + m[1] * b, m[2] * a + m[3] * b
        a, b = x / (x + y), y / (x + y)
    out = toxic.T.ravel()[place]
    return (out, moved) if pairs else out


def emissions(field: Field, cells: np.ndarray) -> np.ndarray:
    return field.features[0][cells[0]] + field.features[1][cells[1]] + field.features[2][cells[2]] + field.bias


def token_labels(cells: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tags of tokens from labels of documents, by features far more frequent in toxic ones."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(offsets))
    marked = np.zeros(cells.shape[1], dtype=bool)
    for row in cells:
        once = np.unique(doc.astype(np.int64) << BITS | row)
        bad = toxic[once >> BITS] == 1
        at = once & ((1 << BITS) - 1)
        in_bad, in_good = np.bincount(at[bad], minlength=1 << BITS), np.bincount(at[~bad], minlength=1 << BITS)
        often = in_bad / max(1, (toxic == 1).sum()) >= LIFT * (in_good + 0.5) / max(1, (toxic == 0).sum())
        marked |= (often & (in_bad >= LEAST))[row]
    return (marked & (toxic[doc] == 1)).astype(np.float64)


def train(texts: list[str | None], toxic: np.ndarray) -> Field:
    """Maximum likelihood with a ridge, by gradient steps scaled per weight."""
    field = Field(np.zeros((3, 1 << BITS), dtype=np.float32), 0.0, np.zeros((2, 2)))
    got = tokens(*utf8(pa.array(texts, pa.large_string())))
    if not got.cells.shape[1] or len(np.unique(toxic)) < 2:
        return field._replace(bias=-30.0)
    tags = token_labels(got.cells, got.offsets, toxic)
    n = np.diff(got.offsets)
    first = got.offsets[:-1][n > 0]
    later = np.ones(len(tags), dtype=bool)
    later[first] = False
    before = np.concatenate([[0], tags[:-1]])[later]
    now = tags[later]
    seen = np.array([[((1 - before) * (1 - now)).sum(), ((1 - before) * now).sum()], [(before * (1 - now)).sum(), (before * now).sum()]])
    weights, bias, moves = field.features.astype(np.float64), 0.0, np.zeros((2, 2))
    size = [np.full_like(weights, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(ROUNDS):
        field = Field(weights, bias, moves)
        p, moved = marginals(field, emissions(field, got.cells), got.offsets, pairs=True)
        miss = tags - p
        slope = [np.stack([np.bincount(row, weights=miss, minlength=1 << BITS) for row in got.cells]) - RIDGE * weights, miss.sum(), seen - moved]
        size = [s + g * g for s, g in zip(size, slope, strict=True)]
        weights, bias, moves = (v + RATE * g / np.sqrt(s) for v, g, s in zip((weights, bias, moves), slope, size, strict=True))
    return Field(weights.astype(np.float32), float(bias), moves)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): at most ``SAMPLE`` labelled rows of each kind, least hashes first."""
    docs = docs.select("doc_id", "text")
    known = broadcast_if_small(labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumnRenamed("doc_id", "known"))
    rows = docs.filter(f"octet_length(text) <= {SAMPLE_BYTES}").join(known, F.col("doc_id") == F.col("known"))
    ids = rows.select("doc_id", "toxic", text_hash().alias("th"), F.xxhash64("doc_id", "text").alias("h"))
    kinds = [ids.filter(F.col("toxic") == k).orderBy("h", "doc_id").limit(SAMPLE).drop("h") for k in (0, 1)]
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]).distinct())  # two samples at most
    return docs.withColumn("th", text_hash()).join(chosen, ["doc_id", "th"]).select("text", F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """The field, trained in one task on the bounded sample."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = train(pdf["text"].tolist(), pdf["toxic"].to_numpy())
        return pd.DataFrame({"features": [made.features.tobytes()], "bias": [made.bias], "moves": [made.moves.ravel().tolist()]})

    rows = training_rows(docs, labels).groupBy(F.lit("sample")).applyInPandas(run, "features binary, bias double, moves array<double>").collect()
    if not rows:
        return Field(np.zeros((3, 1 << BITS), dtype=np.float32), -30.0, np.zeros((2, 2)))
    made = rows[0]
    return Field(np.frombuffer(made.features, dtype=np.float32).reshape(3, -1), made.bias, np.array(made.moves).reshape(2, 2))


def spans_of(got: Tokens, p: np.ndarray, doc: int) -> tuple[list[tuple[int, int, float]], float]:
    """Spans (first and last code point, end exclusive, best marginal) of one text, and its score."""
    lo, hi = got.offsets[doc], got.offsets[doc + 1]
    if lo == hi:
        return [], 0.0
    own = p[lo:hi]
    likely = np.flatnonzero(own >= 0.5)
    if not len(likely):
        return [], float(own.max())
    runs = np.split(likely, np.flatnonzero(np.diff(likely) > 1) + 1)
    text = got.data[got.base[doc] : got.base[doc + 1]]
    points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    found = [
        (int(points[got.starts[lo + r[0]] - got.base[doc]]), int(points[got.ends[lo + r[-1]] - got.base[doc]]), float(own[r].max())) for r in runs
    ]
    return found, float(1 - np.prod([1 - s for _, _, s in found]))


def toxicity(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score, spans) of each row; spans are (begin, end, score) in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            scores, spans = [], []
            for lo, hi in blocks(offsets, 1 << 22):
                got = tokens(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
                p = marginals(sent.value, emissions(sent.value, got.cells), got.offsets)
                for k in range(hi - lo):
                    own, score = spans_of(got, p, k)
                    spans.append([{"begin": a, "end": b, "score": s} for a, b, s in own])
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, score double, spans array<struct<begin: bigint, end: bigint, score: double>>")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_toxicity_crf(spark, sf: str) -> DataFrame:
    """Toxicity of every document; labels of held-out documents are not learnt from."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    field = fit(docs, labels.filter(~held_out()))
    found = toxicity(docs, field)
    texts = F.transform("spans", lambda s: F.concat_ws(":", s["begin"], s["end"]))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(texts, ",").alias("spans"),
    )
