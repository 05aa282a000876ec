"""The collections the registered queries run on, derived from the given
tables by Spark, and the same derivations as SQL text for the cross-check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.runtime import spread

_SPLIT = (
    "CASE WHEN CAST(floor(doc_id / 20) AS BIGINT) % 4 < 2 THEN 'train' "
    "WHEN CAST(floor(doc_id / 20) AS BIGINT) % 4 = 2 THEN 'dev' ELSE 'test' END"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """(pid, uid, lang, split, code): the documents themselves, 20 authors."""
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang")).selectExpr(
        "doc_id AS pid", "doc_id % 20 AS uid", "lang", f"{_SPLIT} AS split", "text AS code"
    )


# One program text per document.  Indent, brace style, spacing, comment style,
# naming and macro use follow the author; every line of the document, with its
# backslashes and double quotes escaped, becomes a statement, so the program
# holds the whole document.
_CODE = """
SELECT pid, uid, split, concat('#include <bits/stdc++.h>', nl, 'using namespace std;', nl,
  CASE WHEN uid % 3 = 0 THEN concat('#define pb(x) push_back(x)', nl)
       WHEN uid % 3 = 1 THEN concat('// ', first, nl) ELSE nl END,
  'int main()', brace, ind, 'int ', v, ' = ', n, ';', nl,
  ind, 'for (int i', sp, '=', sp, '0; i', sp, '<', sp, v, '; i++)', brace,
  CASE WHEN uid % 5 < 2 THEN concat(ind, ind, v, ' += a[i][0];') ELSE concat(ind, ind, v, ' = ', v, ' + i;') END, nl,
  ind, '}}', nl,
  CASE WHEN uid % 3 = 0 THEN concat(ind, 'pb(', v, ');', nl) ELSE '' END,
  CASE WHEN uid % 4 = 0 THEN concat('/* ', first, ' */', nl) ELSE '' END,
  {body}, nl,
  ind, 'if (', v, sp, '>', sp, '0)', brace, ind, ind, 'cout << "', first, '" << ', v, ';', nl, ind, '}}', nl,
  ind, 'return 0;', nl, '}}', nl) AS code
FROM (SELECT pid, uid, split, n, ls, {first} AS first, {nl} AS nl, {ind} AS ind,
   CASE WHEN uid % 2 = 0 THEN concat(' {{', {nl}) ELSE concat({nl}, '{{', {nl}) END AS brace,
   CASE WHEN uid % 7 < 3 THEN ' ' ELSE '' END AS sp,
   concat(CASE WHEN uid % 6 = 0 THEN 'my_' WHEN uid % 6 = 1 THEN 'N' ELSE 'x' END, {n97}) AS v
  FROM (SELECT doc_id AS pid, doc_id % 20 AS uid, n_chars AS n, {split} AS split, {lines} AS ls FROM documents) t) u
"""

_STMT = """CASE ({i} + uid) % 4
   WHEN 0 THEN concat(ind, '// ', l)
   WHEN 1 THEN concat(ind, 'puts("', l, '");')
   WHEN 2 THEN concat(ind, 'int ', replace(l, ' ', ', '), ';')
   ELSE concat(ind, v, '[i', sp, '+', sp, '1]', sp, '+=', sp, 'f(', replace(l, ' ', ' + '), ');') END"""

_PRE = (r"/\*[^*]*\*/", r"//[^\n]*", r"#define[^\n]*")


def code(spark: SparkSession, sf: str) -> DataFrame:
    """(pid, uid, split, code, code_pre): programs, and the programs without
    comments and definitions."""
    spread(table(spark, sf, "documents").select("doc_id", "text", "n_chars")).createOrReplaceTempView("inkprint_documents")
    sql = _CODE.format(
        nl="char(10)",
        ind="repeat(' ', CAST(uid % 4 + 1 AS INT))",
        n97="CAST(n % 97 AS STRING)",
        split=_SPLIT,
        lines=r"split(replace(replace(text, '\\', '\\\\'), char(34), concat('\\', char(34))), '\n')",
        first="split(ls[0], ' ')[0]",
        body="array_join(transform(ls, (l, i) -> " + _STMT.format(i="i") + "), '\\n')",
    )
    df = spark.sql(sql.replace("FROM documents)", "FROM inkprint_documents)"))
    pre = F.col("code")
    for pattern in _PRE:
        pre = F.regexp_replace(pre, pattern, "")
    return df.withColumn("code_pre", pre)


def trees(spark: SparkSession, sf: str) -> DataFrame:
    """(pid, uid, split, tree): root / one node per line / one leaf per word."""
    return spread(table(spark, sf, "documents").select("doc_id", "text")).selectExpr(
        "doc_id AS pid",
        "doc_id % 20 AS uid",
        f"{_SPLIT} AS split",
        r"""concat('0 0{', array_join(transform(split(text, '\n'), l -> concat('1 ', size(split(l, ' ')) % 7, '{',
            array_join(transform(split(l, ' '), t -> concat(length(t), ' ', length(t) % 5, '{}')), ''), '}')), ''), '}')
            AS tree""",
    )


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(model, pid, uid, logits): five score tables over ten classes."""
    return table(spark, sf, "embeddings").selectExpr(
        "explode(sequence(0, 4)) AS model", "vec_id AS pid", "label AS uid", "embedding"
    ).selectExpr(
        "model",
        "pid",
        "CAST(uid AS BIGINT) AS uid",
        """transform(sequence(0, 9), j -> round(CAST(element_at(embedding, model * 12 + j + 1) AS DOUBLE)
             + CASE WHEN j = uid AND pid % (model + 2) <> 0 THEN 0.5D ELSE 0.0D END, 6)) AS logits""",
    )


# ---------------------------------------------------------------- SQL text

DOCS_SQL = (
    "docs AS (SELECT doc_id AS pid, doc_id % 20 AS uid, lang, "
    + _SPLIT
    + " AS split, text AS code FROM documents)"
)

_CODE_SQL = _CODE.format(
    nl="chr(10)",
    ind="repeat(' ', CAST(uid % 4 + 1 AS INT))",
    n97="CAST(n % 97 AS VARCHAR)",
    split=_SPLIT,
    lines=r"string_split(replace(replace(text, '\', '\\'), chr(34), '\' || chr(34)), chr(10))",
    first="string_split(ls[1], ' ')[1]",
    body="array_to_string(list_transform(ls, lambda l, i: " + _STMT.format(i="i - 1") + "), chr(10))",
)
CODE_SQL = (
    "code0 AS ("
    + _CODE_SQL
    + r"), code AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(code, '/\*[^*]*\*/', '', 'g'),"
    r" '//[^\n]*', '', 'g'), '#define[^\n]*', '', 'g') AS code_pre FROM code0)"
)

TREES_SQL = (
    "trees AS (SELECT doc_id AS pid, doc_id % 20 AS uid, " + _SPLIT + " AS split, concat('0 0{', "
    "array_to_string(list_transform(string_split(text, chr(10)), lambda l: concat('1 ', len(string_split(l, ' ')) % 7, "
    "'{', array_to_string(list_transform(string_split(l, ' '), lambda t: concat(length(t), ' ', length(t) % 5, '{}')), "
    "''), '}')), ''), '}') AS tree FROM documents)"
)

SCORES_SQL = (
    "scores AS (SELECT m.model, e.vec_id AS pid, CAST(e.label AS BIGINT) AS uid, list_transform(range(0, 10), lambda j: "
    "round(CAST(e.embedding[m.model * 12 + j + 1] AS DOUBLE) + CASE WHEN j = e.label AND e.vec_id % (m.model + 2) <> 0 "
    "THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6)) AS logits "
    "FROM embeddings e, (SELECT unnest(range(0, 5)) AS model) m)"
)


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def grams_sql(source: str, n: int, column: str = "code", name: str = "grams", keep: str = "pid, uid, split") -> str:
    """CTE of (keep, pos, gram): all character n-grams of ``source.column``."""
    gram = " || ".join(["unnest(c)"] + [f"unnest(c[{k}:])" for k in range(2, n + 1)])
    return (
        f"{name} AS (SELECT * FROM (SELECT {keep}, generate_subscripts(c, 1) - 1 AS pos, {gram} AS gram "
        f"FROM (SELECT {keep}, string_split({column}, '') AS c FROM {source})) WHERE gram IS NOT NULL)"
    )


def tokens_sql(source: str, tokens: str, name: str = "grams", keep: str = "pid, uid, split") -> str:
    """CTE of (keep, pos, gram) from a SQL list expression ``tokens``."""
    return (
        f"{name} AS (SELECT {keep}, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS gram "
        f"FROM (SELECT {keep}, {tokens} AS c FROM {source}))"
    )
