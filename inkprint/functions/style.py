"""The 36 style measures of a program, one projection over (code, code_pre).

Order and meaning of the output are fixed; seven measures are constant 0 by
definition and keep their places so that vectors stay 36 wide."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from inkprint.functions import cleaning as cl
from inkprint.runtime import small_batches

#: Bytes of a text whose characters are counted at once, eight times as large as numbers.
BYTES = 1 << 20

# Output names, in vector order.
STYLE_NAMES = """
tl1 tl2 tl3 tl4 ts1 ts2 ts3 ts4 ts5 ts7 ts8 ts9 ts10 ts11 ts12 ts13 ts14 ts15 ts16 ts17 ts18 ts19 ts20 ts21 ts22 tr1
fl2 fl3 fs1 fs2 fs3 fs5 fs6 fs7 fs8 fs9
""".split()
CONSTANT_ZERO = ("ts5", "ts7", "ts8", "ts9", "ts12", "ts13", "ts14")

# The printable ASCII characters, in vector order.
PRINTABLE = (
    "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\r\x0b\x0c"
)
ALPHABET = "abcdefghijklmnopqrstuvwxyz"

# Patterns of operator runs, variables and operator characters.
_OPERATORS = r"[ \t]*[+\-*/%=&|^><!]+[ \t]*"
_VARIABLE = r"(?U)\b[a-zA-Z_]\w*\b(?!\s*[(<>\"])(?![ \t]*[a-zA-Z_])"
_SYMBOL = r"[+\-*/%=&|^><!]"


_BRACKETS = T.StructType([T.StructField("two_d", T.IntegerType()), T.StructField("formula", T.IntegerType())])


@pandas_udf(_BRACKETS)
def bracket_flags(code: pd.Series) -> pd.DataFrame:
    """Square-bracket structure, which needs matching brackets at any depth:
    two adjacent balanced groups (not after ``]``, not before ``[``), and a
    balanced outermost group whose first line holds more than word characters
    and parentheses."""
    marks = re.compile(r"[\[\]]")
    blank = re.compile(r"[ \t]*")
    formula = re.compile(r".*[^\w\n)(]")

    def flags(text: str) -> tuple[int, int]:
        close: dict[int, int] = {}
        stack: list[int] = []
        for mark in marks.finditer(text):
            if mark[0] == "[":
                stack.append(mark.start())
            elif stack:
                close[stack.pop()] = mark.start()
        two = one = 0
        outer_end = -1
        for start in sorted(close):
            end = close[start]
            if start > outer_end:
                outer_end = end
                one = one or int(formula.match(text[start + 1 : end]) is not None)
            following = blank.match(text, end + 1).end()
            second = close.get(following)
            if second is not None and text[start - 1 : start] != "]" and text[second + 1 : second + 2] != "[":
                two = 1
        return two, one

    return pd.DataFrame([flags(t or "") for t in code], columns=["two_d", "formula"])


def _n(code: Column, pattern: str) -> Column:
    return F.regexp_count(code, F.lit(pattern))


def _flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def _total_length(items: Column) -> Column:
    return F.char_length(F.array_join(items, ""))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def style_columns(docs: DataFrame) -> DataFrame:
    """``docs`` (…, code, code_pre) with the 36 measures as double columns."""
    rest = [c for c in docs.columns if c not in ("code", "code_pre")]
    raw = F.col("code")
    base = docs.select(
        *rest,
        raw,
        cl.drop_line_comments(cl.drop_block_comments(raw)).alias("partly"),
        cl.mask_literals(F.col("code_pre")).alias("nodef"),
    )
    base = base.withColumn("nc", cl.drop_trailing_comments(F.col("partly")))
    base = base.withColumn("clean", cl.mask_literals(F.col("nc"))).withColumn(
        # Only texts with a bracket travel to Python.
        "brackets",
        bracket_flags(F.when(F.contains("nodef", F.lit("[")), F.col("nodef"))),
    )
    nodef, clean = F.col("nodef"), F.col("clean")

    definitions = F.array_distinct(
        F.transform(
            F.regexp_extract_all(clean, F.lit(r"(?d)#define.+"), 0),
            lambda d: F.split(F.trim(F.regexp_replace(d, r"[ \t]*#define[ \t]*", "")), r"(?U)\s+")[0],
        )
    )
    base = base.select(
        "*",
        cl.count_lines(raw).alias("lines"),
        cl.count_lines(F.col("nc")).alias("lines_nc"),
        (cl.count_lines(raw) - cl.count_lines(F.col("partly"))).alias("gone"),
        _n(F.col("partly"), r"(?d)//.*").alias("trailing"),
        cl.count_lines(F.col("partly")).alias("lines_partly"),
        F.regexp_extract_all(nodef, F.lit(_OPERATORS), 0).alias("ops"),
        F.regexp_extract_all(cl.strip_directives_keywords(clean), F.lit(_VARIABLE), 0).alias("names"),
        definitions.alias("definitions"),
        F.regexp_extract_all(
            cl.strip_keywords(cl.strip_defines(clean)), F.lit(r"(?U)\b\w+\b(?=[ \t]+\b\w+\b[ \t]*\()"), 0
        ).alias("methods"),
        F.regexp_extract_all(nodef, F.lit(r"(?dU)\bfor\b[ \t]*\((.+)\)"), 1).alias("fors"),
    )
    bare_ops = F.transform("ops", lambda o: F.translate(o, " \t", ""))
    base = base.select(
        "*",
        bare_ops.alias("bare_ops"),
        F.array_except(F.array_distinct("names"), "definitions").alias("vars"),
        F.regexp_replace(F.array_join("fors", ""), "[^ ]", "").alias("for_spaces"),
    )
    lines, lines_nc = F.col("lines"), F.col("lines_nc")
    comments = F.col("gone") + F.col("trailing")
    fors, whiles = _n(nodef, r"(?U)\bfor\b"), _n(nodef, r"(?U)\bwhile\b")
    short = _n(nodef, rf"(?<!{_SYMBOL})\+=(?!{_SYMBOL})")
    normal = _n(nodef, r"(?U)\b\w+\b[ \t]*=[ \t]*\b\w+\b[ \t]*\+[ \t]*\b\w+\b")
    indent = F.char_length(raw) - F.char_length(F.regexp_replace(raw, r"(?dmU)^[\s&&[^\n]]+", ""))
    measures = {
        "tl1": _ratio(_total_length(F.col("ops")) - _total_length(F.col("bare_ops")), F.size("ops")),
        "tl2": _flag(
            _n(nodef, r"(?dU)\bif\b[ \t]*\(.*\)[ \t]*\{") > _n(nodef, r"(?U)\bif\s*\([^)]*\)[ \t]*\n\s*\{")
        ),
        "tl3": _n(raw, r"(?<=\n)[ \t]*(?=\n)") / lines,
        "tl4": indent / lines,
        "ts1": _flag(F.col("gone") < F.col("trailing")),
        "ts2": comments / F.col("lines_partly"),
        "ts3": _ratio(_total_length(F.col("vars")), F.size("vars")),
        "ts4": _flag(fors < whiles),
        "ts10": F.size(F.array_distinct("bare_ops")),
        "ts11": F.size("ops") / lines_nc,
        "ts15": F.size(F.filter("methods", lambda m: m == "string")),
        "ts16": F.size("methods") / lines_nc,
        "ts17": _flag(F.exists("vars", lambda v: v.contains("_"))),
        "ts18": _flag(F.exists("vars", lambda v: v.rlike("[0-9]"))),
        "ts19": _flag(F.exists("vars", lambda v: v.rlike("[A-Z]"))),
        "ts20": F.size("names") / lines_nc,
        "ts21": F.size("names"),
        "ts22": _flag(_n(clean, r"(?U)\bgo\b[ \t]+\bto\b") > 0),
        "tr1": F.char_length(raw) / lines,
        "fl2": _ratio(F.char_length("for_spaces"), F.size("fors")),
        "fl3": _flag(F.char_length("for_spaces") > 0),
        "fs1": comments / lines,
        "fs2": _n(clean, cl.KEYWORD_PATTERN) / lines_nc,
        "fs3": (fors + whiles) / lines_nc,
        "fs5": F.col("brackets.two_d"),
        "fs6": F.col("brackets.formula"),
        "fs7": _ratio(short, F.when(short > 0, short + normal).otherwise(0)),
        "fs8": _flag(F.contains(nodef, F.lit("return 0;"))),
        "fs9": _n(nodef, "#import") / lines,
    }
    measures.update({name: F.lit(0.0) for name in CONSTANT_ZERO})
    return base.select(*rest, raw, *[measures[name].cast("double").alias(name) for name in STYLE_NAMES])


def style_vector(docs: DataFrame) -> DataFrame:
    """(…, features): the 36 measures as one array."""
    rest = [c for c in docs.columns if c not in ("code", "code_pre")]
    return style_columns(docs).select(*rest, F.array(*STYLE_NAMES).alias("features"))


def lexical_vector(docs: DataFrame) -> DataFrame:
    """(…, features): 36 style measures followed by 100 character counts."""
    rest = [c for c in docs.columns if c not in ("code", "code_pre")]
    counts = F.transform(character_counts(F.col("code"), PRINTABLE), lambda c: c.cast("double"))
    return style_columns(docs).select(*rest, F.concat(F.array(*STYLE_NAMES), counts).alias("features"))


def character_counts(code: Column, characters: str) -> Column:
    """How often each of ``characters`` (ASCII) occurs, as an array in that order; of a null, nulls.

    One pass over the text's bytes, where no byte of a longer character is an ASCII one."""
    small_batches(SparkSession.active())
    place = [ord(c) for c in characters]

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def count(code: pa.Array) -> pa.Array:
        found = np.zeros((len(code), len(place)), np.int32)
        for row, text in enumerate(code):
            raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
            for lo in range(0, len(raw), BYTES):
                found[row] += np.bincount(raw[lo : lo + BYTES], minlength=256)[place].astype(np.int32)
        empty = np.repeat(code.is_null().to_numpy(zero_copy_only=False), len(place))
        ends = pa.array(np.arange(len(code) + 1) * len(place), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(found.ravel(), mask=empty))

    return count(code)


def alpha_counts(code: Column) -> Column:
    return character_counts(F.lower(code), ALPHABET)


def printable_counts(code: Column) -> Column:
    return character_counts(code, PRINTABLE)
