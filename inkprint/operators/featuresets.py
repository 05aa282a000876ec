"""Named feature kinds.  ``fit`` turns training documents into a model table
(or None where nothing is learned); ``transform`` gives (pid, idx, value)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions import style as st
from inkprint.functions import tokens as tk
from inkprint.operators import vectors as ve
from inkprint.operators import vocabulary as vo
from inkprint.operators.grams import with_tokens


@dataclass(frozen=True)
class FeatureSet:
    learn: Callable[[DataFrame], DataFrame] | None
    apply: Callable[[DataFrame, DataFrame | None], DataFrame]

    def fit(self, train: DataFrame) -> DataFrame | None:
        return self.learn(train) if self.learn else None

    def transform(self, docs: DataFrame, model: DataFrame | None) -> DataFrame:
        if self.learn and model is None:
            raise ValueError("this feature kind must be fitted on training documents first")
        return self.apply(docs, model)


def _array(column) -> FeatureSet:
    return FeatureSet(None, lambda docs, _: ve.cells(docs.select("pid", column(F.col("code")).alias("features"))))


def _tfidf(tokens) -> FeatureSet:
    return FeatureSet(
        lambda train: vo.fit_tfidf(with_tokens(train, tokens(F.col("code"))), 10_000),
        lambda docs, model: ve.tfidf(with_tokens(docs, tokens(F.col("code"))), model, sublinear=True),
    )


def _sequence_cells(docs: DataFrame, model: DataFrame) -> DataFrame:
    ids = ve.sequence_ids(with_tokens(docs, tk.chars(F.col("code"))), model)
    return ve.cells(ids, "ids")


FEATURE_SETS = {
    "alpha": _array(st.alpha_counts),
    "char": _array(st.printable_counts),
    "tfidfsk": _tfidf(tk.words),
    "tfidfskc": _tfidf(tk.collapsed_chars),
    # The tokeniser of this kind is never passed on, so it equals the word kind.
    "tfidfskt": _tfidf(tk.words),
    # Character ids in text order: idx is the place in the text.
    "token": FeatureSet(
        lambda train: vo.fit_vocabulary(with_tokens(train, tk.chars(F.col("code"))), 9_999), _sequence_cells
    ),
    "lexical": FeatureSet(None, lambda docs, _: ve.cells(st.lexical_vector(docs.select("pid", "code", "code_pre")))),
}
