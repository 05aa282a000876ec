"""Token counts of whole texts under a public byte-level BPE vocabulary, with
huge texts encoded in overlapping chunks.

A chunk is encoded with offsets.  In the overlap of two chunks a place is a
common stable boundary if both have a token beginning there and it is white
space after something else: the vocabulary's splitting pattern never joins
these two characters, whatever stands around them, so the encoding of the whole
text has a boundary there too and the counts on both sides add up.  Where an
overlap has no such place, it is widened, in the end to the rest of the text.

Null and empty texts have 0 tokens.  Special strings in texts are read as the
library's default does.  Repeated rows count alike.  Only ``doc_id`` and
``text`` are read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK, OVERLAP = 1 << 16, 1 << 10
_LOADED: dict[str, object] = {}
#: White space of the splitting pattern within ASCII; others are not needed as boundaries.
_SPACE = " \t\n\x0b\x0c\r"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _tokenizer(path: str):
    if path not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _LOADED[path] = made
    return _LOADED[path]


def _encoded(tokenizer, text: str):
    return tokenizer.encode_batch([text], add_special_tokens=False)[0]


def stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in _SPACE and not text[at - 1].isspace()


def count_tokens(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, never encoding more than a chunk and its overlap at
    once unless no boundary can be proven."""
    if len(text) <= chunk + overlap:
        return len(_encoded(tokenizer, text).ids)
    total, begin = 0, 0
    while True:  # one turn per chunk; text[begin:] starts at a proven boundary
        end, wide = begin + chunk, overlap
        while True:
            stop = min(len(text), end + wide)
            left = _encoded(tokenizer, text[begin:stop])
            if stop == len(text):
                return total + len(left.ids)
            starts = {begin + a for a, _ in left.offsets if a + begin >= end}
            right = {end + a for a, _ in _encoded(tokenizer, text[end:stop]).offsets}
            common = next((p for p in sorted(starts & right) if stable(text, p)), None)
            if common is not None:
                break
            wide *= 4  # alignment failed
        total += sum(1 for a, _ in left.offsets if begin + a < common)
        begin = common


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            texts = batch.column("text")
            counts: list[int] = []
            for lo in range(0, len(texts), 64):
                part = [t or "" for t in texts[lo : lo + 64].to_pylist()]
                short = [t for t in part if len(t) <= chunk + overlap]
                found = iter(tokenizer.encode_batch_fast(short, add_special_tokens=False))
                counts += [len(next(found).ids) if len(t) <= chunk + overlap else count_tokens(tokenizer, t, chunk, overlap) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    )
    found = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark, sf: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(table(spark, sf, "documents"), vocabulary_path())
