"""Tokenisers: column expressions from text (or bytes, or tree text) to an
ordered ``ARRAY<STRING>`` of terms.  All downstream operators work on any of
them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the sequence tokeniser turns into spaces.
SEQUENCE_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'


def char_ngrams(code: Column, n: int) -> Column:
    """Every overlapping window of ``n`` code points, in text order; none if
    the text is shorter.  One linear regex pass: a lookahead captures the
    window, and positions inside a surrogate pair are not window starts."""
    window = r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{%d}))" % n
    return F.regexp_extract_all(code, F.lit(window), 1)


def byte_ngrams(content: Column, n: int) -> Column:
    """Windows of ``n`` bytes of a binary column.  Each byte is carried as the
    character with the same number; :func:`gram_bytes` gives the bytes back."""
    return char_ngrams(F.decode(content, "ISO-8859-1"), n)


def gram_bytes(gram: Column) -> Column:
    return F.encode(gram, "ISO-8859-1")


def words(code: Column) -> Column:
    """Lowercased runs of two or more word characters (Unicode)."""
    return F.regexp_extract_all(F.lower(code), F.lit(r"(?U)\b\w\w+\b"), 0)


def sequence_words(code: Column) -> Column:
    """Lowercased, punctuation (but not the apostrophe), tab and newline as
    spaces, split on space, empties dropped."""
    spaced = F.translate(F.lower(code), SEQUENCE_FILTERS, " " * len(SEQUENCE_FILTERS))
    return F.regexp_extract_all(spaced, F.lit("[^ ]+"), 0)


def chars(code: Column) -> Column:
    """Every lowercased character, white space included."""
    return _each(code, F.lower(code))


def collapsed_chars(code: Column) -> Column:
    """Lowercased characters after runs of 2+ white-space characters became one space."""
    squeezed = F.regexp_replace(F.lower(code), r"(?U)\s\s+", " ")
    return _each(code, squeezed)


def _each(code: Column, changed: Column) -> Column:
    """The code points of ``changed``, which is empty where ``code`` is; a split of an empty text is one empty string."""
    return F.when(code == "", F.array().cast("array<string>")).otherwise(F.split(changed, ""))


def head(gram: Column) -> Column:
    """Tree term reduced to node types: word 2 of each ``:``-separated part."""
    parts = F.transform(F.split(gram, ":"), lambda p: F.split(F.trim(p), r"\s+")[1])
    return F.array_join(parts, ":")


def pad_left(ids: Column, length: int) -> Column:
    """Last ``length`` ids, filled up with zeros on the left."""
    kept = F.slice(ids, F.greatest(F.size(ids) - length, F.lit(0)) + 1, length)
    return F.concat(F.array_repeat(F.lit(0).cast("int"), F.lit(length) - F.size(kept)), kept)


def encode_fixed(ids: Column, length: int, begin: int = 1, end: int = 2, pad: int = 0) -> Column:
    """``begin ids.. end`` cut and padded on the right to ``length``, with the
    attention mask and all-zero type ids."""
    body = F.slice(ids, 1, length - 2)
    used = F.concat(F.array(F.lit(begin).cast("int")), body, F.array(F.lit(end).cast("int")))
    missing = F.lit(length) - F.size(used)
    return F.struct(
        F.concat(used, F.array_repeat(F.lit(pad).cast("int"), missing)).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(1).cast("int"), F.size(used)), F.array_repeat(F.lit(0).cast("int"), missing)
        ).alias("attention_mask"),
        F.array_repeat(F.lit(0).cast("int"), F.lit(length)).alias("token_type_ids"),
    )
