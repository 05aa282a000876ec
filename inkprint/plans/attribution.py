"""Author profiles and overlap attribution over the program collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions import tokens as tk
from inkprint.operators import profiles as pr
from inkprint.operators.grams import with_tokens
from inkprint.plans.corpus import CODE_SQL, DOCS_SQL, code, docs, grams_sql, with_sql
from inkprint.plans.registry import query
from inkprint.runtime import first_pid, persisted


def _sides(df: DataFrame, tokens) -> tuple[DataFrame, DataFrame]:
    """Training and query documents."""
    train = with_tokens(df.filter("split = 'train'"), tokens)
    return train, with_tokens(df.filter("split <> 'train'"), tokens)


def _scap(df: DataFrame, tokens, length: int) -> DataFrame:
    """Fit on train (stored), attribute dev and test."""
    train, rest = _sides(df, tokens)
    fitted = persisted(pr.postings(pr.trim_profiles(pr.author_profiles(train), length)), "postings")
    return pr.attribute(rest, fitted, pr.author_order(train))


def _scap_sql(grams: str, trim: str, source: str = "code") -> str:
    """CTEs up to attributed(pid, uid, split, uid_pred, score)."""
    return f"""{grams},
prof0 AS (SELECT uid, gram, count(*) AS cnt, min(CAST(pid AS HUGEINT) * 2147483648 + pos) AS first
  FROM grams WHERE split = 'train' GROUP BY uid, gram),
prof AS ({trim}),
authors AS (SELECT uid, min(pid) AS since FROM {source} WHERE split = 'train' GROUP BY uid),
qs AS (SELECT DISTINCT pid, gram FROM grams WHERE split <> 'train'),
sc AS (SELECT q.pid, p.uid, count(*) AS score FROM qs q JOIN prof p ON q.gram = p.gram GROUP BY q.pid, p.uid),
best AS (SELECT pid, uid, score FROM (SELECT sc.*, row_number() OVER (PARTITION BY pid ORDER BY score DESC, since) AS r
  FROM sc JOIN authors USING (uid)) WHERE r = 1),
attributed AS (SELECT d.pid, d.uid, d.split,
  CAST(coalesce(b.uid, (SELECT arg_min(uid, since) FROM authors)) AS BIGINT) AS uid_pred,
  CAST(coalesce(b.score, 0) AS BIGINT) AS score
  FROM {source} d LEFT JOIN best b ON b.pid = d.pid WHERE d.split <> 'train')
"""


def _top_sql(length: int, by: str = "uid") -> str:
    return (
        f"SELECT uid, gram, cnt FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY cnt DESC, first) AS r "
        f"FROM prof0) WHERE r <= {length}"
    )


_CODE6 = with_sql(CODE_SQL, _scap_sql(grams_sql("code", 6), _top_sql(2000)))


@query(_CODE6 + "SELECT pid, uid, split, uid_pred, score FROM attributed")
def scap_attribute(spark: SparkSession, sf: str) -> DataFrame:
    return _scap(code(spark, sf), tk.char_ngrams(F.col("code"), 6), 2000)


@query(
    with_sql(CODE_SQL, _scap_sql(grams_sql("code", 6), "SELECT * FROM prof0 WHERE cnt > 1"))
    + "SELECT pid, uid, split, uid_pred, score FROM attributed"
)
def scap_attribute_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return _scap(code(spark, sf), tk.char_ngrams(F.col("code"), 6), -1)


@query(
    with_sql(CODE_SQL, _scap_sql(grams_sql("code", 4), "SELECT * FROM prof0"))
    + "SELECT pid, uid, split, uid_pred, score FROM attributed"
)
def scap_attribute_full(spark: SparkSession, sf: str) -> DataFrame:
    return _scap(code(spark, sf), tk.char_ngrams(F.col("code"), 4), -2)


@query(
    with_sql(CODE_SQL, _scap_sql(grams_sql("code", 4), _top_sql(0)))
    + "SELECT pid, uid, split, uid_pred, score FROM attributed"
)
def scap_attribute_empty(spark: SparkSession, sf: str) -> DataFrame:
    return _scap(code(spark, sf), tk.char_ngrams(F.col("code"), 4), 0)


@query(
    with_sql(CODE_SQL, _scap_sql(grams_sql("code", 5, "code_pre"), _top_sql(500)))
    + "SELECT pid, uid, split, uid_pred, score FROM attributed"
)
def scap_attribute_preprocessed(spark: SparkSession, sf: str) -> DataFrame:
    return _scap(code(spark, sf), tk.char_ngrams(F.col("code_pre"), 5), 500)


@query(
    with_sql(DOCS_SQL, _scap_sql(grams_sql("docs", 3), _top_sql(1000), "docs"))
    + "SELECT pid, uid, split, uid_pred, score FROM attributed"
)
def scap_attribute_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _scap(docs(spark, sf), tk.char_ngrams(F.col("code"), 3), 1000)


@query(
    with_sql(
        DOCS_SQL,
        "bytes AS (SELECT pid, uid, split, regexp_extract_all(hex(encode(code)), '..') AS c FROM docs)",
        "grams AS (SELECT * FROM (SELECT pid, uid, split, generate_subscripts(c, 1) - 1 AS pos, "
        "unnest(c) || unnest(c[2:]) || unnest(c[3:]) || unnest(c[4:]) AS gram FROM bytes) WHERE gram IS NOT NULL)",
        _scap_sql("unused AS (SELECT 1)", _top_sql(1000), "docs"),
    )
    + "SELECT pid, uid, split, uid_pred, score FROM attributed"
)
def scap_attribute_bytes(spark: SparkSession, sf: str) -> DataFrame:
    content = F.encode(F.col("code"), "utf-8")
    return _scap(docs(spark, sf), tk.byte_ngrams(content, 4), 1000)


@query(
    with_sql(CODE_SQL, grams_sql("code", 3))
    + """SELECT uid, gram, CAST(count(*) AS BIGINT) AS cnt, CAST(min(pid) AS BIGINT) AS first_pid
FROM grams WHERE split = 'train' GROUP BY uid, gram"""
)
def author_profiles(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _sides(code(spark, sf), tk.char_ngrams(F.col("code"), 3))
    rows = pr.author_profiles(train)
    return rows.select("uid", "gram", "cnt", first_pid(F.col("first")).alias("first_pid"))


@query(
    with_sql(CODE_SQL, _scap_sql(grams_sql("code", 6), _top_sql(500)))
    + "SELECT uid, gram, CAST(cnt AS BIGINT) AS cnt FROM prof"
)
def trimmed_profiles(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _sides(code(spark, sf), tk.char_ngrams(F.col("code"), 6))
    return pr.trim_profiles(pr.author_profiles(train), 500).select("uid", "gram", "cnt")


@query(
    with_sql(CODE_SQL, _scap_sql(grams_sql("code", 6), "SELECT * FROM prof0 WHERE cnt > 1"))
    + "SELECT uid, CAST(count(*) AS BIGINT) AS terms, CAST(sum(cnt) AS BIGINT) AS occurrences FROM prof GROUP BY uid"
)
def repeated_profiles(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _sides(code(spark, sf), tk.char_ngrams(F.col("code"), 6))
    kept = pr.trim_profiles(pr.author_profiles(train), -1)
    return kept.groupBy("uid").agg(F.count("*").alias("terms"), F.sum("cnt").alias("occurrences"))


@query(
    with_sql(CODE_SQL, _scap_sql(grams_sql("code", 6), "SELECT * FROM prof0"))
    + "SELECT uid, CAST(count(*) AS BIGINT) AS terms, CAST(sum(cnt) AS BIGINT) AS occurrences FROM prof GROUP BY uid"
)
def full_profiles(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _sides(code(spark, sf), tk.char_ngrams(F.col("code"), 6))
    kept = pr.trim_profiles(pr.author_profiles(train), -2)
    return kept.groupBy("uid").agg(F.count("*").alias("terms"), F.sum("cnt").alias("occurrences"))


@query(
    with_sql(CODE_SQL, _scap_sql(grams_sql("code", 5), _top_sql(800)))
    + "SELECT pid, uid, CAST(score AS BIGINT) AS score FROM sc"
)
def profile_overlap(spark: SparkSession, sf: str) -> DataFrame:
    train, rest = _sides(code(spark, sf), tk.char_ngrams(F.col("code"), 5))
    fitted = persisted(pr.postings(pr.trim_profiles(pr.author_profiles(train), 800)), "postings")
    return pr.overlaps(rest, fitted)


@query(
    _CODE6
    + """SELECT split, CAST(count(*) AS BIGINT) AS total, CAST(sum(CAST(uid = uid_pred AS INT)) AS BIGINT) AS correct,
round(avg(CAST(uid = uid_pred AS INT)), 6) AS accuracy FROM attributed GROUP BY split"""
)
def attribution_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    scored = pr.accuracy(scap_attribute(spark, sf), by=("split",))
    return scored.withColumn("accuracy", F.round("accuracy", 6))


@query(
    with_sql(CODE_SQL, _scap_sql(grams_sql("code", 5), _top_sql(500)))
    + """SELECT CAST(documents AS BIGINT) AS documents, CAST(correct AS BIGINT) AS correct,
round(correct / documents, 6) AS accuracy FROM (
SELECT row_number() OVER (ORDER BY pid) AS documents,
  sum(CAST(uid = uid_pred AS INT)) OVER (ORDER BY pid ROWS UNBOUNDED PRECEDING) AS correct FROM attributed)
WHERE documents % 25 = 0"""
)
def running_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    found = _scap(code(spark, sf), tk.char_ngrams(F.col("code"), 5), 500)
    return pr.running_accuracy(found, every=25).withColumn("accuracy", F.round("accuracy", 6))


def _sweep_sql() -> str:
    sizes, lengths = (3, 4), (50, 500, 1000)
    grams = ", ".join([grams_sql("code", n, name=f"g{n}") for n in sizes])
    union = " UNION ALL ".join(f"SELECT {n} AS n, pid, uid, split, pos, gram FROM g{n}" for n in sizes)
    kept = " UNION ALL ".join([f"SELECT {x} AS length, n, uid, gram FROM ranked WHERE r <= {x}" for x in lengths]
                              + ["SELECT -1 AS length, n, uid, gram FROM ranked WHERE cnt > 1"])
    return with_sql(CODE_SQL) .rstrip() + f""", {grams}, grams AS ({union}),
prof0 AS (SELECT n, uid, gram, count(*) AS cnt, min(CAST(pid AS HUGEINT) * 2147483648 + pos) AS first
  FROM grams WHERE split = 'train' GROUP BY n, uid, gram),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n, uid ORDER BY cnt DESC, first) AS r FROM prof0),
prof AS ({kept}),
authors AS (SELECT uid, min(pid) AS since FROM code WHERE split = 'train' GROUP BY uid),
qs AS (SELECT DISTINCT n, pid, gram FROM grams WHERE split <> 'train'),
sc AS (SELECT p.n, p.length, q.pid, p.uid, count(*) AS score FROM qs q JOIN prof p ON q.gram = p.gram AND q.n = p.n
  GROUP BY p.n, p.length, q.pid, p.uid),
best AS (SELECT n, length, pid, arg_max(uid, score * 1000000000000 - since) AS uid FROM sc JOIN authors USING (uid)
  GROUP BY n, length, pid),
grid AS (SELECT n, length FROM (SELECT unnest([3, 4]) AS n), (SELECT unnest([50, 500, 1000, -1]) AS length))
SELECT CAST(g.n AS BIGINT) AS n, CAST(g.length AS BIGINT) AS length, CAST(count(*) AS BIGINT) AS total,
  CAST(sum(CAST(coalesce(b.uid, (SELECT arg_min(uid, since) FROM authors)) = d.uid AS INT)) AS BIGINT) AS correct,
  round(avg(CAST(coalesce(b.uid, (SELECT arg_min(uid, since) FROM authors)) = d.uid AS INT)), 6) AS accuracy
FROM grid g CROSS JOIN (SELECT * FROM code WHERE split <> 'train') d
LEFT JOIN best b ON b.n = g.n AND b.length = g.length AND b.pid = d.pid GROUP BY g.n, g.length"""


@query(_sweep_sql())
def profile_sweep(spark: SparkSession, sf: str) -> DataFrame:
    both = F.concat(tk.char_ngrams(F.col("code"), 3), tk.char_ngrams(F.col("code"), 4))
    train, rest = _sides(code(spark, sf), both)
    found = pr.sweep(train, rest, [3, 4], [50, 500, 1000, -1], keep=lambda df: persisted(df, "sweep"))
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query(
    with_sql(CODE_SQL, _scap_sql(grams_sql("code", 6), "SELECT * FROM prof0 WHERE cnt > 1"))
    + """SELECT CAST(sum(s) AS BIGINT) AS total_size, CAST(min(s) AS BIGINT) AS min_size, CAST(max(s) AS BIGINT) AS max_size
FROM (SELECT uid, count(*) AS s FROM prof GROUP BY uid)"""
)
def profile_size_stats(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _sides(code(spark, sf), tk.char_ngrams(F.col("code"), 6))
    return pr.profile_size_stats(pr.trim_profiles(pr.author_profiles(train), -1))
