"""Cleaning, style measures and tokenisers over the whole collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions import cleaning as cl
from inkprint.functions import style as st
from inkprint.functions import tokens as tk
from inkprint.functions import trees as tr
from inkprint.operators import grams as gr
from inkprint.operators import vectors as ve
from inkprint.operators import vocabulary as vo
from inkprint.plans.corpus import (
    CODE_SQL,
    DOCS_SQL,
    code,
    docs,
    grams_sql,
    table,
    tokens_sql,
    trees,
    with_sql,
)
from inkprint.plans.registry import query
from inkprint.runtime import persisted

# ------------------------------------------------------------------ cleaning

# Inside a class: what a word is made of.  The SQL engine's \w and \b know ASCII only.
_W = r"\p{L}\p{M}\p{Nd}\p{Pc}"
WORDS_SQL = f"regexp_extract_all(lower(code), '[{_W}]{{2,}}')"
_KW = "[" + ", ".join(f"'{k}'" for k in cl.KEYWORDS) + "]"


def _gsub(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


_PARTLY = _gsub(_gsub("code", r"(?s)/\*.*?\*/\n"), r"\n\s*//.*")
_NC = _gsub(_PARTLY, "//.*")
_MASK = r"""["''].*?["'']"""


def _lines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')) + 1)"


@query(with_sql(CODE_SQL) + f"SELECT pid, {_NC} AS cleaned FROM code")
def strip_comments(spark: SparkSession, sf: str) -> DataFrame:
    return code(spark, sf).select("pid", cl.strip_comments(F.col("code")).alias("cleaned"))


@query(
    with_sql(CODE_SQL)
    + f"""SELECT pid, CAST(gone < tail AS INT) AS ts1, round((gone + tail) / kept, 6) AS ts2,
round((gone + tail) / total, 6) AS fs1 FROM (SELECT pid, total, kept, total - kept AS gone,
len(regexp_extract_all(partly, '//.*')) AS tail FROM (SELECT pid, partly, {_lines('code')} AS total,
{_lines('partly')} AS kept FROM (SELECT pid, code, {_PARTLY} AS partly FROM code)))"""
)
def comment_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = code(spark, sf).select("pid", cl.comment_stats(F.col("code")).alias("c")).select("pid", "c.*")
    return found.withColumn("ts2", F.round("ts2", 6)).withColumn("fs1", F.round("fs1", 6))


@query(
    with_sql(CODE_SQL)
    + f"SELECT 'code' AS source, pid, {_gsub('code', _MASK, cl.PLACEHOLDER)} AS masked FROM code UNION ALL "
    + f"SELECT 'page' AS source, page_id AS pid, {_gsub('html', _MASK, cl.PLACEHOLDER)} AS masked FROM pages"
)
def mask_literals(spark: SparkSession, sf: str) -> DataFrame:
    programs = code(spark, sf).select(F.lit("code").alias("source"), "pid", "code")
    pages = table(spark, sf, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("pid"), F.col("html").alias("code"))
    return programs.unionByName(pages).select("source", "pid", cl.mask_literals(F.col("code")).alias("masked"))


@query(with_sql(CODE_SQL) + f"SELECT pid, {_gsub('code', '#' + chr(92) + 'bdefine' + chr(92) + 'b.*')} AS cleaned FROM code")
def strip_defines(spark: SparkSession, sf: str) -> DataFrame:
    return code(spark, sf).select("pid", cl.strip_defines(F.col("code")).alias("cleaned"))


def _no_keywords(text: str) -> str:
    parts = f"regexp_extract_all({text}, '[{_W}]+|[^{_W}]+')"
    return f"array_to_string(list_filter({parts}, lambda x: NOT list_contains({_KW}, x)), '')"


def _no_directives(text: str) -> str:
    return _no_keywords(_gsub(_gsub(text, f"#[{_W}]+.*"), r"\btypedef\b.*"))


@query(with_sql(CODE_SQL) + f"SELECT pid, {_no_directives('code')} AS cleaned FROM code")
def strip_directives_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return code(spark, sf).select("pid", cl.strip_directives_keywords(F.col("code")).alias("cleaned"))


@query(
    with_sql(CODE_SQL)
    + r"""SELECT pid, CASE WHEN uid % 3 = 0 THEN regexp_replace(body, '\bpb[ \t]*\(([^()]*)\)', 'push_back(\1)', 'g')
ELSE body END AS code, CAST(NULL AS VARCHAR) AS error
FROM (SELECT pid, uid, regexp_replace(code, '#define.+', '', 'g') AS body FROM code)"""
)
def expand_macros(spark: SparkSession, sf: str) -> DataFrame:
    return code(spark, sf).select("pid", cl.expand_macros("code").alias("e")).select("pid", "e.code", "e.error")


@query(
    with_sql(DOCS_SQL, CODE_SQL)
    + f"SELECT 'code' AS source, pid, CAST({_lines('code')} AS INTEGER) AS lines FROM code UNION ALL "
    + f"SELECT 'text' AS source, pid, CAST({_lines('code')} AS INTEGER) AS lines FROM docs"
)
def count_lines(spark: SparkSession, sf: str) -> DataFrame:
    both = code(spark, sf).select(F.lit("code").alias("source"), "pid", "code").unionByName(
        docs(spark, sf).select(F.lit("text").alias("source"), "pid", "code")
    )
    return both.select("source", "pid", cl.count_lines(F.col("code")).alias("lines"))


# ------------------------------------------------------------------ style


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _count_words(text: str, words: str) -> str:
    return f"len(list_filter(regexp_extract_all({text}, '[{_W}]+'), lambda x: list_contains({words}, x)))"


def _word_after(kind: str) -> str:
    blank = r"^[ \t]+$"
    if kind == "name":
        return (
            r"regexp_matches(t[i], '^[A-Za-z_]') AND NOT (CASE WHEN regexp_matches(coalesce(t[i+1], ''), '^\s') "
            r"""THEN coalesce(t[i+2], '') ELSE coalesce(t[i+1], '') END IN ('(', '<', '>', '"')) """
            rf"AND NOT (regexp_matches(coalesce(t[i+1], ''), '{blank}') AND regexp_matches(coalesce(t[i+2], ''), '^[A-Za-z_]'))"
        )
    return (
        rf"regexp_matches(t[i], '^[{_W}]') AND regexp_matches(coalesce(t[i+1], ''), '{blank}') "
        rf"AND regexp_matches(coalesce(t[i+2], ''), '^[{_W}]') AND (coalesce(t[i+3], '') = '(' OR "
        rf"(regexp_matches(coalesce(t[i+3], ''), '{blank}') AND coalesce(t[i+4], '') = '('))"
    )


def _pick(tokens: str, kind: str) -> str:
    return (
        f"(SELECT list_transform(list_filter(range(1, len(t) + 1), lambda i: {_word_after(kind)}), lambda i: t[i]) "
        f"FROM (SELECT {tokens} AS t))"
    )


_TOK = rf"[{_W}]+|\s+|[^{_W}\s]"
_LEN = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
_OPS = r"[ \t]*[+\-*/%=&|^><!]+[ \t]*"
_STYLE_CTES = f"""s1 AS (SELECT pid, code, {_PARTLY} AS partly, {_gsub('code_pre', _MASK, cl.PLACEHOLDER)} AS nodef FROM code),
s2 AS (SELECT *, {_gsub('partly', '//.*')} AS nc FROM s1),
s3 AS (SELECT *, {_gsub('nc', _MASK, cl.PLACEHOLDER)} AS clean, {_lines('code')} AS l, {_lines('nc')} AS lnc,
  {_lines('code')} - {_lines('partly')} AS gone, {_count('partly', '//.*')} AS tail, string_split(code, chr(10)) AS ls,
  regexp_extract_all(nodef, '{_OPS}') AS ops FROM s2),
s4 AS (SELECT *, list_transform(ops, lambda o: trim(o, ' ' || chr(9))) AS bare,
  regexp_extract_all({_no_directives('clean')}, '{_TOK}') AS vt,
  regexp_extract_all({_no_keywords(_gsub('clean', '#' + chr(92) + 'bdefine' + chr(92) + 'b.*'))}, '{_TOK}') AS mt,
  list_transform(regexp_extract_all(clean, '#define.+'), lambda d: regexp_extract(d, '#define[ \\t]*(\\S+)', 1)) AS defs,
  regexp_extract_all(nodef, '\\bfor\\b[ \\t]*\\((.+)\\)', 1) AS fors FROM s3),
s5 AS (SELECT *, list_transform(list_filter(range(1, len(vt) + 1), lambda i: {_word_after('name').replace('t[', 'vt[')}), lambda i: vt[i]) AS names,
  list_transform(list_filter(range(1, len(mt) + 1), lambda i: {_word_after('method').replace('t[', 'mt[')}), lambda i: mt[i]) AS methods,
  {_count_words('nodef', "['for']")} AS nfor, {_count_words('nodef', "['while']")} AS nwhile,
  len(list_filter(regexp_extract_all(nodef, '[+\\-*/%=&|^><!]+'), lambda r: r = '+=')) AS short,
  {_count('nodef', rf'[{_W}]+[ \t]*=[ \t]*[{_W}]+[ \t]*\+[ \t]*[{_W}]+')} AS normal FROM s4),
s6 AS (SELECT *, list_filter(list_distinct(names), lambda v: NOT list_contains(defs, v)) AS vars FROM s5),
style AS (SELECT pid, code,
  CASE WHEN len(ops) > 0 THEN ({_LEN.format('ops')} - {_LEN.format('bare')}) / len(ops) ELSE 0 END AS tl1,
  CASE WHEN {_count('nodef', r'\bif\b[ \t]*\(.*\)[ \t]*\{')} > {_count('nodef', r'\bif\s*\([^)]*\)[ \t]*\n\s*\{')} THEN 1 ELSE 0 END AS tl2,
  len(list_filter(ls[2:len(ls) - 1], lambda x: regexp_full_match(x, '[ \\t]*'))) / l AS tl3,
  list_sum(list_transform(ls, lambda x: length(x) - length(ltrim(x, ' ' || chr(9))))) / l AS tl4,
  CAST(gone < tail AS INT) AS ts1, (gone + tail) / lnc AS ts2,
  CASE WHEN len(vars) > 0 THEN {_LEN.format('vars')} / len(vars) ELSE 0 END AS ts3,
  CAST(nfor < nwhile AS INT) AS ts4, 0 AS ts5, 0 AS ts7, 0 AS ts8, 0 AS ts9, len(list_distinct(bare)) AS ts10,
  len(ops) / lnc AS ts11, 0 AS ts12, 0 AS ts13, 0 AS ts14, len(list_filter(methods, lambda m: m = 'string')) AS ts15,
  len(methods) / lnc AS ts16,
  CAST(len(list_filter(vars, lambda v: contains(v, '_'))) > 0 AS INT) AS ts17,
  CAST(len(list_filter(vars, lambda v: regexp_matches(v, '[0-9]'))) > 0 AS INT) AS ts18,
  CAST(len(list_filter(vars, lambda v: regexp_matches(v, '[A-Z]'))) > 0 AS INT) AS ts19,
  len(names) / lnc AS ts20, len(names) AS ts21, CAST({_count('clean', r'\bgo\b[ \t]+\bto\b')} > 0 AS INT) AS ts22,
  length(code) / l AS tr1,
  CASE WHEN len(fors) > 0 THEN coalesce(list_sum(list_transform(fors, lambda f: length(f) - length(replace(f, ' ', '')))), 0) / len(fors) ELSE 0 END AS fl2,
  CASE WHEN coalesce(list_sum(list_transform(fors, lambda f: length(f) - length(replace(f, ' ', '')))), 0) > 0 THEN 1 ELSE 0 END AS fl3,
  (gone + tail) / l AS fs1, {_count_words('clean', _KW)} / lnc AS fs2, (nfor + nwhile) / lnc AS fs3,
  CAST(regexp_matches(nodef, '(^|[^\\]])\\[[^\\[\\]]*\\][ \\t]*\\[[^\\[\\]]*\\]($|[^\\[])') AS INT) AS fs5,
  CAST(regexp_matches(nodef, '\\[[^\\[\\]\\n]*[^{_W}\\n()\\[\\]][^\\[\\]]*\\]') AS INT) AS fs6,
  CASE WHEN short = 0 THEN 0 ELSE short / (short + normal) END AS fs7,
  CAST(contains(nodef, 'return 0;') AS INT) AS fs8, {_count('nodef', '#import')} / l AS fs9 FROM s6)"""

_ROUNDED = ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in st.STYLE_NAMES)


@query(with_sql(CODE_SQL, _STYLE_CTES) + f"SELECT pid, {_ROUNDED} FROM style")
def style_features(spark: SparkSession, sf: str) -> DataFrame:
    found = st.style_columns(code(spark, sf).select("pid", "code", "code_pre"))
    return found.select("pid", *[F.round(n, 6).alias(n) for n in st.STYLE_NAMES])


def _printable_sql(text: str) -> str:
    return (
        "list_transform([" + ", ".join(f"chr({ord(c)})" for c in st.PRINTABLE) + "], "
        f"lambda ch: length({text}) - length(replace({text}, ch, '')))"
    )


@query(
    with_sql(CODE_SQL, _STYLE_CTES)
    + f"""SELECT pid, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS idx, round(unnest(v), 6) AS value FROM (
SELECT pid, list_concat([{', '.join(f'CAST({n} AS DOUBLE)' for n in st.STYLE_NAMES)}],
list_transform({_printable_sql('code')}, lambda x: CAST(x AS DOUBLE))) AS v FROM style)"""
)
def lexical_vector(spark: SparkSession, sf: str) -> DataFrame:
    vectors = st.lexical_vector(code(spark, sf).select("pid", "code", "code_pre"))
    long = vectors.select("pid", F.posexplode_outer("features").alias("idx", "value"))
    return long.select("pid", F.col("idx").cast("bigint").alias("idx"), F.round("value", 6).alias("value"))


@query(
    with_sql(DOCS_SQL)
    + f"""SELECT pid, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS idx, CAST(unnest(v) AS BIGINT) AS value
FROM (SELECT pid, {_printable_sql('code')} AS v FROM docs)"""
)
def printable_counts(spark: SparkSession, sf: str) -> DataFrame:
    long = docs(spark, sf).select("pid", F.posexplode_outer(st.printable_counts(F.col("code"))).alias("idx", "value"))
    return long.select("pid", F.col("idx").cast("bigint").alias("idx"), F.col("value").cast("bigint").alias("value"))


@query(
    with_sql(DOCS_SQL)
    + """SELECT pid, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS idx, CAST(unnest(v) AS BIGINT) AS value
FROM (SELECT pid, list_transform(range(97, 123), lambda ch: length(lower(code)) - length(replace(lower(code), chr(CAST(ch AS INTEGER)), ''))) AS v FROM docs)"""
)
def alpha_counts(spark: SparkSession, sf: str) -> DataFrame:
    long = docs(spark, sf).select("pid", F.posexplode_outer(st.alpha_counts(F.col("code"))).alias("idx", "value"))
    return long.select("pid", F.col("idx").cast("bigint").alias("idx"), F.col("value").cast("bigint").alias("value"))


# ------------------------------------------------------------------ tokenisers

_TALLY = "CAST(count(*) AS BIGINT) AS cnt, CAST(sum(pos) AS BIGINT) AS pos_sum, CAST(min(pid) AS BIGINT) AS first_pid"


def _tally(df: DataFrame, tokens) -> DataFrame:
    rows = gr.occurrences(gr.with_tokens(df, tokens))
    return rows.groupBy("gram").agg(
        F.count("*").alias("cnt"), F.sum("pos").alias("pos_sum"), F.min("pid").alias("first_pid")
    )


@query(with_sql(DOCS_SQL, grams_sql("docs", 3)) + f"SELECT gram, {_TALLY} FROM grams GROUP BY gram")
def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return _tally(docs(spark, sf), tk.char_ngrams(F.col("code"), 3))


@query(
    with_sql(
        DOCS_SQL,
        "bytes AS (SELECT pid, regexp_extract_all(hex(encode(code)), '..') AS c FROM docs)",
        "grams AS (SELECT * FROM (SELECT pid, generate_subscripts(c, 1) - 1 AS pos, "
        "unnest(c) || unnest(c[2:]) || unnest(c[3:]) AS gram FROM bytes) WHERE gram IS NOT NULL)",
    )
    + f"SELECT gram, {_TALLY} FROM grams GROUP BY gram"
)
def byte_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    found = _tally(docs(spark, sf), tk.byte_ngrams(F.encode(F.col("code"), "utf-8"), 3))
    return found.withColumn("gram", F.hex(tk.gram_bytes(F.col("gram"))))


@query(
    with_sql(DOCS_SQL, grams_sql("docs", 6), "c AS (SELECT pid, gram, count(*) AS cnt, min(pos) AS f FROM grams GROUP BY pid, gram)")
    + """SELECT pid, CAST(count(*) AS BIGINT) AS terms, CAST(sum(cnt) AS BIGINT) AS occurrences,
CAST(max(cnt) AS BIGINT) AS most, CAST(sum(f * cnt) AS BIGINT) AS weighted_first FROM c GROUP BY pid"""
)
def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    per_doc = gr.counts(gr.with_tokens(docs(spark, sf), tk.char_ngrams(F.col("code"), 6)).select("pid", "tokens"))
    return per_doc.groupBy("pid").agg(
        F.count("*").alias("terms"),
        F.sum("cnt").alias("occurrences"),
        F.max("cnt").alias("most"),
        F.sum(F.col("first_pos") * F.col("cnt")).alias("weighted_first"),
    )


@query(
    with_sql(DOCS_SQL, grams_sql("docs", 4))
    + """SELECT d.pid, CAST(coalesce(n, 0) AS INTEGER) AS terms, coalesce(digest, md5('')) AS digest FROM docs d LEFT JOIN (
SELECT pid, count(*) AS n, md5(string_agg(gram, '|' ORDER BY pos)) AS digest FROM grams GROUP BY pid) g ON g.pid = d.pid"""
)
def ngram_token_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = gr.with_tokens(docs(spark, sf), tk.char_ngrams(F.col("code"), 4))
    return rows.select("pid", F.size("tokens").alias("terms"), F.md5(F.array_join("tokens", "|")).alias("digest"))


@query(
    with_sql(CODE_SQL, tokens_sql("code", WORDS_SQL))
    + f"SELECT gram, {_TALLY} FROM grams GROUP BY gram"
)
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _tally(code(spark, sf), tk.words(F.col("code")))


_SEQ = (
    "list_filter(string_split(translate(lower(code), '"
    + tk.SEQUENCE_FILTERS.replace("'", "''").replace("\t", "").replace("\n", "")
    + "' || chr(9) || chr(10), repeat(' ', "
    + str(len(tk.SEQUENCE_FILTERS))
    + ")), ' '), lambda x: x <> '')"
)


@query(with_sql(DOCS_SQL, tokens_sql("docs", _SEQ)) + f"SELECT gram, {_TALLY} FROM grams GROUP BY gram")
def sequence_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _tally(docs(spark, sf), tk.sequence_words(F.col("code")))


@query(
    with_sql(DOCS_SQL, tokens_sql("docs", "string_split(lower(code), '')"))
    + f"SELECT gram, {_TALLY} FROM grams GROUP BY gram"
)
def char_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _tally(docs(spark, sf), tk.chars(F.col("code")))


def _ids_sql(k: int) -> str:
    return f"""vocab AS (SELECT gram, row_number() OVER (ORDER BY cnt DESC, f) AS id FROM (
  SELECT gram, count(*) AS cnt, min(CAST(pid AS HUGEINT) * 2147483648 + pos) AS f FROM grams WHERE split = 'train' GROUP BY gram)
  QUALIFY id < {k}),
seqs AS (SELECT d.pid, coalesce(ids, []) AS ids FROM docs d LEFT JOIN (SELECT g.pid, list(v.id ORDER BY g.pos) AS ids
  FROM grams g JOIN vocab v ON v.gram = g.gram GROUP BY g.pid) s ON s.pid = d.pid)"""


def _sequence(spark: SparkSession, sf: str) -> DataFrame:
    rows = gr.with_tokens(docs(spark, sf), tk.sequence_words(F.col("code")))
    vocabulary = persisted(vo.fit_vocabulary(rows.filter("split = 'train'"), 2047), "vocabulary")
    return ve.sequence_ids(rows, vocabulary)


_SEQS = with_sql(DOCS_SQL, tokens_sql("docs", _SEQ), _ids_sql(2048))


@query(_SEQS + "SELECT pid, array_to_string(ids, ',') AS ids FROM seqs")
def tokens_to_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _sequence(spark, sf).select("pid", F.array_join("ids", ",").alias("ids"))


@query(
    _SEQS
    + """SELECT pid, array_to_string(list_concat(list_transform(range(0, 512 - least(len(ids), 512)), lambda z: 0),
list_slice(ids, greatest(len(ids) - 511, 1), len(ids))), ',') AS padded FROM seqs"""
)
def pad_sequences(spark: SparkSession, sf: str) -> DataFrame:
    padded = tk.pad_left(F.col("ids"), 512)
    return _sequence(spark, sf).select("pid", F.array_join(padded, ",").alias("padded"))


@query(
    _SEQS
    + """SELECT pid, array_to_string(list_concat(used, list_transform(range(0, 100 - len(used)), lambda z: 0)), ',') AS input_ids,
repeat('1', len(used)) || repeat('0', 100 - len(used)) AS attention_mask, repeat('0', 100) AS token_type_ids
FROM (SELECT pid, list_concat(list_concat([1], list_transform(list_slice(ids, 1, 98), lambda x: x + 2)), [2]) AS used FROM seqs)"""
)
def encode_fixed(spark: SparkSession, sf: str) -> DataFrame:
    shifted = F.transform("ids", lambda i: i + 2)
    encoded = _sequence(spark, sf).select("pid", tk.encode_fixed(shifted, 100).alias("e"))
    return encoded.select(
        "pid",
        F.array_join("e.input_ids", ",").alias("input_ids"),
        F.array_join("e.attention_mask", "").alias("attention_mask"),
        F.array_join("e.token_type_ids", "").alias("token_type_ids"),
    )


# ------------------------------------------------------------------ trees

# The paths follow from the documents; the SQL never parses a tree.
TREE_PATHS_SQL = (
    """lines0 AS (SELECT doc_id AS pid, doc_id % 20 AS uid, CASE WHEN CAST(floor(doc_id / 20) AS BIGINT) % 4 < 2 THEN 'train'
  WHEN CAST(floor(doc_id / 20) AS BIGINT) % 4 = 2 THEN 'dev' ELSE 'test' END AS split, string_split(text, chr(10)) AS ls FROM documents),
lines1 AS (SELECT pid, uid, split, generate_subscripts(ls, 1) AS li, string_split(unnest(ls), ' ') AS ws FROM lines0),
lines2 AS (SELECT pid, uid, split, li, '1 ' || (len(ws) % 7) AS ln, ws FROM lines1),
leaves AS (SELECT pid, uid, split, li, ln, generate_subscripts(ws, 1) AS wi,
  list_transform(ws, lambda t: length(t) || ' ' || (length(t) % 5))[generate_subscripts(ws, 1)] AS wn FROM lines2),
tpaths AS (SELECT pid, uid, split, 0 AS level, '0 0' AS a, NULL AS b, NULL AS c, 0 AS li, 0 AS wi FROM lines0
  UNION ALL SELECT pid, uid, split, 1, '0 0', ln, NULL, li, 0 FROM lines2
  UNION ALL SELECT pid, uid, split, 2, '0 0', ln, wn, li, wi FROM leaves)""".replace(
        """list_transform(ws, lambda t: length(t) || ' ' || (length(t) % 5))[generate_subscripts(ws, 1)] AS wn""",
        """unnest(list_transform(ws, lambda t: length(t) || ' ' || (length(t) % 5))) AS wn""",
    )
)


def tree_grams_sql(n: int, head: bool = False) -> str:
    part = (lambda x: f"string_split({x}, ' ')[2]") if head else (lambda x: x)
    a, b, c = part("a"), part("b"), part("c")
    gram = {
        1: f"CASE level WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END",
        2: f"CASE level WHEN 1 THEN {a} || ':' || {b} ELSE {b} || ':' || {c} END",
        3: f"{a} || ':' || {b} || ':' || {c}",
    }[n]
    return (
        f"{TREE_PATHS_SQL}, grams AS (SELECT pid, uid, split, {gram} AS gram, "
        f"row_number() OVER (PARTITION BY pid ORDER BY li, wi) - 1 AS pos FROM tpaths WHERE level >= {n - 1})"
    )


def tree_docs(spark: SparkSession, sf: str, n: int, head: bool = False) -> DataFrame:
    rows = gr.with_tokens(trees(spark, sf), tr.tree_ngrams(F.col("tree"), n)["grams"])
    return gr.map_grams(rows, tk.head) if head else rows


@query(
    with_sql(TREE_PATHS_SQL)
    + """SELECT pid, CAST(level AS INTEGER) AS level, CASE level WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS node,
CAST(count(*) AS BIGINT) AS cnt FROM tpaths GROUP BY ALL"""
)
def ast_nodes(spark: SparkSession, sf: str) -> DataFrame:
    found = trees(spark, sf).select("pid", F.inline(tr.nodes("tree")))
    return found.groupBy("pid", "level", "node").agg(F.count("*").alias("cnt"))


def _tree_counts(n: int, head: bool):
    sql = (
        with_sql(tree_grams_sql(n, head))
        + "SELECT pid, gram, CAST(count(*) AS BIGINT) AS cnt, CAST(min(pos) AS BIGINT) AS first_pos FROM grams GROUP BY pid, gram"
    )

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return gr.counts(tree_docs(spark, sf, n, head).select("pid", "tokens"))

    run.__name__ = f"ast_{n}grams" + ("_head" if head else "")
    query(sql)(run)


for _n in (1, 2, 3):
    _tree_counts(_n, False)
_tree_counts(2, True)


@query(
    with_sql(tree_grams_sql(3))
    + """SELECT gram, string_split(string_split(gram, ':')[1], ' ')[2] || ':' || string_split(string_split(gram, ':')[2], ' ')[2]
|| ':' || string_split(string_split(gram, ':')[3], ' ')[2] AS head, CAST(count(*) AS BIGINT) AS cnt FROM grams GROUP BY gram"""
)
def ast_head(spark: SparkSession, sf: str) -> DataFrame:
    rows = gr.occurrences(tree_docs(spark, sf, 3))
    return rows.groupBy("gram").agg(F.count("*").alias("cnt")).select("gram", tk.head(F.col("gram")).alias("head"), "cnt")


@query(
    """SELECT doc_id AS pid, concat('unnamed ancestor of ', chr(39), '1 ', len(string_split(string_split(text, chr(10))[1], ' ')) % 7, chr(39), ' at level 1')
AS error FROM documents WHERE doc_id % 7 = 0"""
)
def ast_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Trees whose root has no name, every seventh one here, give an error instead of paths."""
    unnamed = F.expr("CASE WHEN pid % 7 = 0 THEN substring(tree, 4) ELSE tree END")
    rows = trees(spark, sf).select("pid", tr.tree_ngrams(unnamed, 2)["error"].alias("error"))
    return rows.filter("error IS NOT NULL")
