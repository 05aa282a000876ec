"""Vocabularies and feature vectors over the whole collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions import style as st
from inkprint.functions import tokens as tk
from inkprint.operators import grams as gr
from inkprint.operators import vectors as ve
from inkprint.operators import vocabulary as vo
from inkprint.operators.featuresets import FEATURE_SETS
from inkprint.plans.corpus import CODE_SQL, DOCS_SQL, code, docs, grams_sql, tokens_sql, with_sql
from inkprint.plans.registry import query
from inkprint.plans.text import _STYLE_CTES, WORDS_SQL, _printable_sql, tree_docs, tree_grams_sql
from inkprint.runtime import persisted



def train_part(df: DataFrame) -> DataFrame:
    return df.filter("split = 'train'")


def vocab_sql(k: int | None, grams: str = "grams", name: str = "vocab") -> str:
    """CTE (gram, idx, cnt, df, n) in frequency order from the training rows."""
    limit = f" QUALIFY idx < {k}" if k else ""
    return (
        f"{name}0 AS (SELECT gram, count(*) AS cnt, count(DISTINCT pid) AS df, "
        f"min(CAST(pid AS HUGEINT) * 2147483648 + pos) AS f FROM {grams} WHERE split = 'train' GROUP BY gram),\n"
        f"{name} AS (SELECT gram, row_number() OVER (ORDER BY cnt DESC, f) - 1 AS idx, cnt, df FROM {name}0{limit})"
    )


def tfidf_sql(k: int, source: str, sublinear: bool) -> str:
    """CTEs up to vec(pid, idx, value) from grams."""
    tf = "1 + ln(cnt)" if sublinear else "cnt"
    return f"""tv AS (SELECT gram, df, row_number() OVER (ORDER BY gram) - 1 AS idx FROM (SELECT gram, count(DISTINCT pid) AS df,
  row_number() OVER (ORDER BY count(*) DESC, gram) AS r FROM grams WHERE split = 'train' GROUP BY gram) WHERE r <= {k}),
tw AS (SELECT pid, idx, ({tf}) * (ln((1 + (SELECT count(*) FROM {source} WHERE split = 'train')) / (1 + df)) + 1) AS w
  FROM (SELECT pid, idx, df, count(*) AS cnt FROM grams JOIN tv USING (gram) GROUP BY pid, idx, df)),
vec AS (SELECT pid, idx, w / sqrt(sum(w * w) OVER (PARTITION BY pid)) AS value FROM tw)"""


_G3 = [DOCS_SQL, grams_sql("docs", 3)]


def _grams(spark: SparkSession, sf: str, n: int = 3) -> DataFrame:
    return gr.with_tokens(docs(spark, sf), tk.char_ngrams(F.col("code"), n))


@query(with_sql(*_G3, vocab_sql(2000)) + "SELECT gram, CAST(idx AS BIGINT) AS idx, CAST(cnt AS BIGINT) AS cnt FROM vocab")
def fit_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vo.fit_vocabulary(train_part(_grams(spark, sf)), 2000)


@query(with_sql(*_G3, vocab_sql(None)) + "SELECT gram, CAST(idx AS BIGINT) AS idx, CAST(cnt AS BIGINT) AS cnt FROM vocab")
def fit_vocab_unlimited(spark: SparkSession, sf: str) -> DataFrame:
    return vo.fit_vocabulary(train_part(_grams(spark, sf)), -1)


@query(
    with_sql(tree_grams_sql(2), vocab_sql(150))
    + """SELECT gram, CAST(idx AS BIGINT) AS idx, CAST(cnt AS BIGINT) AS cnt, CAST(df AS BIGINT) AS df,
CAST((SELECT count(*) FROM lines0 WHERE split = 'train') AS BIGINT) AS n FROM vocab"""
)
def fit_ast_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vo.fit_tree_vocabulary(train_part(tree_docs(spark, sf, 2)), 150)


@query(with_sql(*_G3, vocab_sql(2000)) + "SELECT CAST(count(*) AS BIGINT) AS features FROM vocab")
def vocab_size(spark: SparkSession, sf: str) -> DataFrame:
    return vo.vocabulary_size(vo.fit_vocabulary(train_part(_grams(spark, sf)), 2000))


@query(
    with_sql(*_G3, vocab_sql(200))
    + "SELECT DISTINCT pid, CAST(idx AS BIGINT) AS idx, CAST(1 AS DOUBLE) AS value FROM grams JOIN vocab USING (gram)"
)
def vectorize_binary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _grams(spark, sf)
    return ve.binary(rows, persisted(vo.fit_vocabulary(train_part(rows), 200), "vocabulary"))


@query(
    with_sql(*_G3, vocab_sql(200))
    + "SELECT pid, CAST(idx AS BIGINT) AS idx, CAST(count(*) AS DOUBLE) AS value FROM grams JOIN vocab USING (gram) GROUP BY pid, idx"
)
def vectorize_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = _grams(spark, sf)
    return ve.count(rows, persisted(vo.fit_vocabulary(train_part(rows), 200), "vocabulary"))


@query(
    with_sql(tree_grams_sql(2), vocab_sql(150))
    + "SELECT DISTINCT pid, CAST(idx AS BIGINT) AS idx, CAST(1 AS DOUBLE) AS value FROM grams JOIN vocab USING (gram)"
)
def vectorize_tree_binary(spark: SparkSession, sf: str) -> DataFrame:
    rows = tree_docs(spark, sf, 2)
    return ve.binary(rows, persisted(vo.fit_tree_vocabulary(train_part(rows), 150), "vocabulary"))


@query(
    with_sql(tree_grams_sql(2), vocab_sql(150))
    + """SELECT g.pid, CAST(idx AS BIGINT) AS idx, round(count(*) / any_value(t.total)
* ln((SELECT count(*) FROM lines0 WHERE split = 'train') / any_value(df)), 6) AS value
FROM grams g JOIN vocab USING (gram) JOIN (SELECT pid, count(*) AS total FROM grams GROUP BY pid) t ON t.pid = g.pid
GROUP BY g.pid, idx"""
)
def vectorize_tree_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    rows = tree_docs(spark, sf, 2)
    found = ve.tree_tfidf(rows, persisted(vo.fit_tree_vocabulary(train_part(rows), 150), "vocabulary"))
    return found.withColumn("value", F.round("value", 6))


_VEC = "SELECT pid, CAST(idx AS BIGINT) AS idx, round(value, 6) AS value FROM vec"


def _tfidf(rows: DataFrame, k: int, sublinear: bool) -> DataFrame:
    model = persisted(vo.fit_tfidf(train_part(rows), k), "tfidf")
    return ve.tfidf(rows, model, sublinear).withColumn("value", F.round("value", 6))


@query(
    with_sql(DOCS_SQL, "low AS (SELECT * REPLACE (lower(code) AS code) FROM docs)", grams_sql("low", 3), tfidf_sql(200, "docs", False))
    + _VEC
)
def vectorize_ngram_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    rows = gr.with_tokens(docs(spark, sf), tk.char_ngrams(F.lower("code"), 3))
    return _tfidf(rows, 200, False)


_WORD_TFIDF = with_sql(CODE_SQL, tokens_sql("code", WORDS_SQL), tfidf_sql(10000, "code", True)) + _VEC


@query(_WORD_TFIDF)
def vectorize_word_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return _tfidf(gr.with_tokens(code(spark, sf), tk.words(F.col("code"))), 10000, True)


@query(
    with_sql(
        DOCS_SQL,
        r"low AS (SELECT * REPLACE (regexp_replace(lower(code), '\s\s+', ' ', 'g') AS code) FROM docs)",
        tokens_sql("low", "string_split(code, '')"),
        tfidf_sql(10000, "docs", True),
    )
    + _VEC
)
def vectorize_char_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return _tfidf(gr.with_tokens(docs(spark, sf), tk.collapsed_chars(F.col("code"))), 10000, True)


@query(_WORD_TFIDF)
def vectorize_custom_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    """The custom-tokeniser kind never uses its tokeniser: same as the word kind."""
    rows = code(spark, sf)
    kind = FEATURE_SETS["tfidfskt"]
    model = persisted(kind.fit(train_part(rows)), "tfidf")
    return kind.transform(rows, model).withColumn("value", F.round("value", 6))


@query(
    with_sql(DOCS_SQL, grams_sql("docs", 4), vocab_sql(500))
    + """SELECT d.pid, coalesce(n, 0) AS terms, coalesce(digest, md5('')) AS digest FROM docs d LEFT JOIN (
SELECT pid, CAST(count(*) AS INTEGER) AS n, md5(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY pos)) AS digest
FROM grams JOIN vocab USING (gram) GROUP BY pid) s ON s.pid = d.pid"""
)
def token_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _grams(spark, sf, 4)
    found = ve.positions(rows, persisted(vo.fit_vocabulary(train_part(rows), 500), "vocabulary"))
    return found.select("pid", F.size("ids").alias("terms"), F.md5(F.array_join("ids", ",")).alias("digest"))


@query(
    with_sql(
        CODE_SQL,
        tokens_sql("code", WORDS_SQL),
        "v AS (SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS idx FROM (SELECT DISTINCT gram FROM grams WHERE split = 'train'))",
    )
    + "SELECT DISTINCT pid, CAST(idx AS BIGINT) AS idx, CAST(1 AS DOUBLE) AS value FROM grams JOIN v USING (gram)"
)
def bow_binary(spark: SparkSession, sf: str) -> DataFrame:
    rows = gr.with_tokens(code(spark, sf), tk.words(F.col("code")))
    return ve.binary(rows, persisted(vo.fit_all_terms(train_part(rows)), "terms"))


# --------------------------------------------------------- scaling and shaping

_MINMAX = """cells AS ({cells}),
dense AS (SELECT d.pid, d.split, i.idx, coalesce(c.value, 0) AS value FROM {source} d CROSS JOIN (SELECT DISTINCT idx FROM cells
  JOIN {source} USING (pid) WHERE split = 'train') i LEFT JOIN cells c ON c.pid = d.pid AND c.idx = i.idx),
mm AS (SELECT idx, min(value) AS low, max(value) AS high FROM dense WHERE split = 'train' GROUP BY idx)
"""


def _style_cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    programs = code(spark, sf)
    vectors = st.style_vector(programs.select("pid", "split", "code", "code_pre"))
    stored = persisted(vectors, "style")
    return ve.cells(stored), stored.select("pid", "split")


def _minmax(cells: DataFrame, pids: DataFrame) -> DataFrame:
    train = pids.filter("split = 'train'")
    model = persisted(
        ve.minmax_fit(cells.join(train.select("pid"), "pid"), train.agg(F.count("*")).scalar()), "minmax"
    )
    return ve.minmax_transform(cells, model, pids).withColumn("value", F.round("value", 6))


_STYLE_CELLS = (
    "SELECT pid, idx, value FROM (SELECT pid, generate_subscripts(v, 1) - 1 AS idx, unnest(v) AS value FROM ("
    + "SELECT pid, ["
    + ", ".join(f"CAST({n} AS DOUBLE)" for n in st.STYLE_NAMES)
    + "] AS v FROM style))"
)


_SCALED = """SELECT pid, CAST(idx AS BIGINT) AS idx,
  round((value - low) / CASE WHEN high = low THEN 1 ELSE high - low END, 6) AS value
FROM dense JOIN mm USING (idx) WHERE value <> low"""


@query(with_sql(CODE_SQL, _STYLE_CTES, _MINMAX.format(cells=_STYLE_CELLS, source="code")) + _SCALED)
def minmax_style(spark: SparkSession, sf: str) -> DataFrame:
    return _minmax(*_style_cells(spark, sf))


@query(
    with_sql(
        *_G3,
        vocab_sql(100),
        _MINMAX.format(
            cells="SELECT pid, idx, CAST(count(*) AS DOUBLE) AS value FROM grams JOIN vocab USING (gram) GROUP BY pid, idx",
            source="docs",
        ),
    )
    + _SCALED
)
def minmax_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _grams(spark, sf)
    vocabulary = persisted(vo.fit_vocabulary(train_part(rows), 100), "vocabulary")
    cells = persisted(ve.count(rows, vocabulary), "cells")
    return _minmax(cells, docs(spark, sf).select("pid", "split"))


@query(
    with_sql(CODE_SQL, _STYLE_CTES, _MINMAX.format(cells=_STYLE_CELLS, source="code"))
    + """SELECT pid, CAST(idx AS BIGINT) AS idx, round(value, 6) AS value FROM dense JOIN mm USING (idx)
WHERE low <> high AND value <> 0"""
)
def drop_invariant(spark: SparkSession, sf: str) -> DataFrame:
    cells, pids = _style_cells(spark, sf)
    train = pids.filter("split = 'train'")
    kept = ve.varying(cells.join(train.select("pid"), "pid"), train.agg(F.count("*")).scalar())
    return ve.drop_invariant(cells, persisted(kept, "kept")).withColumn("value", F.round("value", 6))


@query(
    with_sql(DOCS_SQL)
    + """SELECT pid, array_to_string(list_transform(range(0, 20), lambda i: CASE WHEN i = uid THEN '1' ELSE '0' END), '') AS flags,
CAST(uid AS BIGINT) AS decoded FROM docs"""
)
def one_hot_labels(spark: SparkSession, sf: str) -> DataFrame:
    coded = docs(spark, sf).select("pid", ve.one_hot(F.col("uid"), 20).alias("hot"))
    return coded.select(
        "pid",
        F.array_join(F.transform("hot", lambda h: h.cast("int").cast("string")), "").alias("flags"),
        ve.decode_one_hot(F.col("hot")).alias("decoded"),
    )


@query(
    with_sql(
        CODE_SQL,
        grams_sql("code", 3),
        vocab_sql(100),
        _STYLE_CTES,
        tree_grams_sql(2).replace("grams AS (", "tgrams AS (", 1),
        vocab_sql(150, "tgrams", "tvocab"),
    )
    + f"""SELECT DISTINCT pid, CAST(idx AS BIGINT) AS idx, CAST(1 AS DOUBLE) AS value FROM grams JOIN vocab USING (gram)
UNION ALL SELECT DISTINCT pid, CAST(100 + idx AS BIGINT), CAST(1 AS DOUBLE) FROM tgrams JOIN tvocab USING (gram)
UNION ALL SELECT pid, CAST(250 + idx AS BIGINT), round(value, 6) FROM ({_STYLE_CELLS}) WHERE value <> 0"""
)
def concat_views(spark: SparkSession, sf: str) -> DataFrame:
    programs, paths = code(spark, sf), tree_docs(spark, sf, 2)
    grams = gr.with_tokens(programs, tk.char_ngrams(F.col("code"), 3))
    ngram = ve.binary(grams, persisted(vo.fit_vocabulary(train_part(grams), 100), "vocabulary"))
    tree = ve.binary(paths, persisted(vo.fit_tree_vocabulary(train_part(paths), 150), "vocabulary"))
    style, _ = _style_cells(spark, sf)
    return ve.concat_views([(ngram, 100), (tree, 150), (style, 36)]).withColumn("value", F.round("value", 6))


ALPHA_SQL = "[" + ", ".join(f"length(lower(code)) - length(replace(lower(code), '{chr(c)}', ''))" for c in range(97, 123)) + "]"
COLLAPSED_SQL = r"low AS (SELECT * REPLACE (regexp_replace(lower(code), '\s\s+', ' ', 'g') AS code) FROM {})"


def _array_cells(source: str, array: str) -> str:
    return (
        "SELECT pid, generate_subscripts(v, 1) - 1 AS idx, CAST(unnest(v) AS DOUBLE) AS value FROM "
        f"(SELECT pid, {array} AS v FROM {source})"
    )


def _kind_sql(kind: str, cells: str, *ctes: str) -> str:
    return (
        f"SELECT '{kind}' AS kind, CAST(idx AS BIGINT) AS idx, CAST(count(*) AS BIGINT) AS documents, round(sum(value), 4) AS total "
        f"FROM ({with_sql(CODE_SQL, *ctes)}{cells}) WHERE value <> 0 GROUP BY idx"
    )


_WORDS = (tokens_sql("code", WORDS_SQL), tfidf_sql(10000, "code", True))
_LEXICAL = f"""list_concat([{', '.join(f'CAST({n} AS DOUBLE)' for n in st.STYLE_NAMES)}],
list_transform({_printable_sql('code')}, lambda x: CAST(x AS DOUBLE)))"""
_VEC_CELLS = "SELECT pid, idx, value FROM vec"
_KINDS = {
    "alpha": (_array_cells("code", ALPHA_SQL),),
    "char": (_array_cells("code", _printable_sql("code")),),
    "tfidfsk": (_VEC_CELLS, *_WORDS),
    "tfidfskt": (_VEC_CELLS, *_WORDS),
    "tfidfskc": (_VEC_CELLS, COLLAPSED_SQL.format("code"), tokens_sql("low", "string_split(code, '')"), tfidf_sql(10000, "code", True)),
    "token": (
        """SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY pos) - 1 AS idx, CAST(v.idx + 1 AS DOUBLE) AS value
FROM grams g JOIN vocab v ON v.gram = g.gram""",
        tokens_sql("code", "string_split(lower(code), '')"),
        vocab_sql(9999),
    ),
    "lexical": (_array_cells("style", _LEXICAL), _STYLE_CTES),
}


@query(" UNION ALL ".join(_kind_sql(kind, *parts) for kind, parts in _KINDS.items()))
def vectorize_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Every named feature kind, fitted and applied through the table of kinds."""
    rows, out = code(spark, sf), None
    for name in _KINDS:
        kind = FEATURE_SETS[name]
        model = kind.fit(train_part(rows))
        cells = kind.transform(rows, persisted(model, "features") if model is not None else None)
        found = cells.groupBy("idx").agg(F.count("*").alias("documents"), F.round(F.sum("value"), 4).alias("total"))
        found = found.select(F.lit(name).alias("kind"), "idx", "documents", "total")
        out = found if out is None else out.unionByName(found)
    return out
