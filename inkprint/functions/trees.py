"""Syntax-tree strings: ``id type{child{}...}`` with the root at level 0.

A node is the text before a brace; its level is the number of open braces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from inkprint.runtime import small_batches

_PIECE = re.compile(r"([^{}]*)([{}])")


def unigrams(tree: Column) -> Column:
    """All nodes in text order; levels are not needed, so this stays a regex."""
    return F.regexp_extract_all(tree, F.lit(r"([^{}]+)[{}]"), 1)


def _walk(tree: str) -> Iterator[tuple[int, str]]:
    level = 0
    for text, brace in _PIECE.findall(tree):
        if text:
            yield level, text
        level += 1 if brace == "{" else -1


_NODES = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("node", T.StringType())]))
_GRAMS = T.StructType([T.StructField("grams", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


@pandas_udf(_NODES)
def _nodes(tree: pd.Series) -> pd.Series:
    return tree.map(lambda t: [{"level": a, "node": b} for a, b in _walk(t)])


def nodes(tree: Column | str) -> Column:
    """(level, node) of every node in text order."""
    small_batches(SparkSession.active(), size=1 << 20)  # a node is some 50 times its text here
    return _nodes(tree)


def paths(n: int):
    """UDF: tree -> (grams, error).  A gram is a node and its n-1 ancestors,
    outermost first, joined by ``:``; nodes with fewer ancestors give none.  A
    level keeps its last text, which an unnamed ancestor therefore shows; one
    that never had a text is an error."""

    small_batches(SparkSession.active())

    @pandas_udf(_GRAMS)
    def extract(tree: pd.Series) -> pd.DataFrame:
        known: dict[str, str] = {}  # equal grams of the batch are held once

        def one(text: str):
            latest: dict[int, str] = {}
            grams = []
            for level, node in _walk(text):
                latest[level] = node
                if level >= n - 1:
                    chain = [latest.get(level - up) for up in range(n - 1, -1, -1)]
                    if None in chain:
                        return None, f"unnamed ancestor of {node!r} at level {level}"
                    gram = ":".join(chain)
                    grams.append(known.setdefault(gram, gram))
            return grams, None

        return pd.DataFrame([one(t) for t in tree], columns=["grams", "error"])

    return extract


def tree_ngrams(tree: Column, n: int) -> Column:
    """Struct (grams, error) for any n; n < 1 yields no grams."""
    if n < 1:
        return F.struct(F.array().cast("array<string>").alias("grams"), F.lit(None).cast("string").alias("error"))
    if n == 1:
        return F.struct(unigrams(tree).alias("grams"), F.lit(None).cast("string").alias("error"))
    return paths(n)(tree)
