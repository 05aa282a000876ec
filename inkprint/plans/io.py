"""Sources and sinks: the given tables written in each file format to the
shared folder and read back, and the local explanation."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkprint.functions import tokens as tk
from inkprint.operators import classifiers as cf
from inkprint.operators import explain as ex
from inkprint.operators import grams as gr
from inkprint.operators import vectors as ve
from inkprint.operators import vocabulary as vo
from inkprint.plans.corpus import DOCS_SQL, TREES_SQL, docs, grams_sql, table, trees, with_sql
from inkprint.plans.features import train_part, vocab_sql
from inkprint.plans.models import _labelled, _ml, _printable
from inkprint.plans.registry import query
from inkprint.runtime import persisted, scratch_dir
from inkprint.sources import files as fs

_D = with_sql(DOCS_SQL)


def _place(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/inkprint/{label}-{uuid.uuid4().hex}"


def _label_file(spark: SparkSession, rows: DataFrame, label: str) -> str:
    path = _place(spark, label)
    rows.select("uid", "pid").write.option("header", True).csv(path)
    return path


@query(_D + "SELECT CAST(uid AS INTEGER) AS uid, pid FROM docs")
def read_labels(spark: SparkSession, sf: str) -> DataFrame:
    return fs.read_labels(spark, _label_file(spark, docs(spark, sf), "labels"))


@query(_D + "SELECT CAST(uid AS INTEGER) AS uid, pid FROM docs")
def read_labels_validated(spark: SparkSession, sf: str) -> DataFrame:
    return fs.read_labels(spark, _label_file(spark, docs(spark, sf), "labels"), validate=True)


def _corpus_files(spark: SparkSession, sf: str) -> str:
    """One file per document under pid=<pid>/, with Windows line ends after full stops."""
    path = _place(spark, "corpus")
    text = F.replace(F.col("code"), F.lit(". "), F.lit(".\r\n"))
    rows = docs(spark, sf).select("pid", text.alias("value"))
    # On a local disk Hadoop starts a process (chmod) for every file and folder it makes, which is most of the time.
    # A checksum file beside each file is one more, and so is each folder that a task makes again to
    # commit it; the driver moves whole folders into place.  Stores other than local disks take no notice of the first two.
    local = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    rows.write.options(**local).option("mapreduce.fileoutputcommitter.algorithm.version", "1").partitionBy("pid").text(path)
    return path


_IN_FOLDER = r"pid=([0-9]+)/"


@query(_D + r"SELECT pid, md5(replace(code, '. ', '.' || chr(10)) || chr(10)) AS digest FROM docs")
def read_corpus_text(spark: SparkSession, sf: str) -> DataFrame:
    found = fs.read_corpus(spark, _corpus_files(spark, sf), "text", _IN_FOLDER)
    return found.select("pid", F.md5(F.encode("code", "utf-8")).alias("digest"))


@query(
    _D
    + "SELECT pid, md5(replace(code, '. ', '.' || chr(13) || chr(10)) || chr(10)) AS digest, "
    + "CAST(octet_length(encode(replace(code, '. ', '.' || chr(13) || chr(10)))) + 1 AS INTEGER) AS bytes FROM docs"
)
def read_corpus_bytes(spark: SparkSession, sf: str) -> DataFrame:
    found = fs.read_corpus(spark, _corpus_files(spark, sf), "bytes", _IN_FOLDER)
    return found.select("pid", F.md5("code").alias("digest"), F.octet_length("code").alias("bytes"))


@query("SELECT item_id AS pid FROM benchmark")
def read_unlabeled_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select(F.lit("").alias("uid"), F.col("item_id").alias("pid"))
    return fs.read_unlabeled_ids(spark, _label_file(spark, rows, "ids")).select("pid")


@query(
    _D
    + "SELECT k.kind, split, pid, CASE WHEN split <> 'test' THEN CAST(uid AS INTEGER) END AS uid, "
    + "md5(replace(code, '. ', '.' || k.line_end) || chr(10)) AS digest "
    + "FROM docs, (VALUES ('text', chr(10)), ('bytes', chr(13) || chr(10))) AS k(kind, line_end)"
)
def load_split(spark: SparkSession, sf: str) -> DataFrame:
    """All splits with their texts and with their bytes."""
    labels = _split_files(spark, sf)
    files = fs.corpus_files(spark, _corpus_files(spark, sf))
    text, raw = (fs.load_split(labels, fs.read_corpus(spark, files, mode, _IN_FOLDER)) for mode in ("text", "bytes"))
    text, raw = text.withColumn("code", F.encode("code", "utf-8")), raw.withColumn("kind", F.lit("bytes"))
    both = text.withColumn("kind", F.lit("text")).unionByName(raw)
    return both.select("kind", "split", "pid", "uid", F.md5("code").alias("digest"))


@query(
    _D
    + """SELECT CAST(count_if(d.pid IS NULL) AS BIGINT) AS labels_without_file, CAST(count_if(l.doc_id IS NULL) AS BIGINT) AS files_without_label,
CAST(count_if(d.pid IS NOT NULL AND l.doc_id IS NOT NULL) AS BIGINT) AS matched FROM docs d FULL JOIN labels l ON l.doc_id = d.pid"""
)
def audit_split(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("pid"))
    return fs.audit_split(labels, docs(spark, sf))


def _split_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf)
    return fs.read_split_labels(
        spark, {s: _label_file(spark, rows.filter(F.col("split") == s), s) for s in fs.SPLITS}
    )


@query(_D + "SELECT split, CAST(uid AS INTEGER) AS uid FROM docs WHERE split <> 'test'")
def load_all_labels(spark: SparkSession, sf: str) -> DataFrame:
    return fs.load_all_labels(_split_files(spark, sf))


@query(_D + "SELECT split, pid FROM docs")
def load_all_pids(spark: SparkSession, sf: str) -> DataFrame:
    return fs.load_all_pids(_split_files(spark, sf))


@query(with_sql(TREES_SQL) + "SELECT split, pid, tree FROM trees")
def read_asts(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "asts")
    fs.write_asts(trees(spark, sf), path)
    return fs.read_asts(spark, path)


@query(with_sql(TREES_SQL) + "SELECT split, pid, tree FROM trees")
def read_asts_indented(spark: SparkSession, sf: str) -> DataFrame:
    """Indented objects with an entry per line, several to a file."""
    path = _place(spark, "asts-indented")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = trees(spark, sf).withColumn("part", F.pmod(F.xxhash64("pid"), F.lit(parts)))
    # Headings and ends stand in the lines of a group's first and last entry: as rows of their own in
    # a union they may be left in other files than the entries.
    group = Window.partitionBy("split", "part").orderBy("pid")
    first, last = F.lag(F.lit(1)).over(group).isNull(), F.lead(F.lit(1)).over(group).isNull()
    entry = F.to_json(F.create_map(F.col("pid").cast("string"), "tree"))
    line = F.concat(F.lit("\t\t"), F.substring(entry, F.lit(2), F.length(entry) - 2))
    opened = F.when(first, F.concat(F.lit('{\n\t"'), "split", F.lit('": {\n'))).otherwise("")
    closed = F.when(last, F.lit("\n\t}\n}")).otherwise(",")
    rows.select(F.concat(opened, line, closed).alias("value")).write.text(path)
    return fs.read_asts(spark, path)


def _ast_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Every tree under its path, an older copy before it, and temporary files."""
    rows = trees(spark, sf)
    old = rows.select(F.lit(0).alias("o"), "pid", F.lit("0 0{}").alias("tree"), F.concat(F.lit("d/"), "pid", F.lit(".cpp")).alias("key"))
    new = rows.select(F.lit(2).alias("o"), "pid", "tree", F.concat(F.lit("d/"), "pid", F.lit(".cpp")).alias("key"))
    tmp = rows.select(F.lit(1).alias("o"), "pid", "tree", F.concat(F.lit("d/tmp"), "pid", F.lit(".cpp")).alias("key"))
    path = _place(spark, "asts-csv")
    every = old.unionByName(tmp).unionByName(new)
    every.orderBy("o", "pid").select("key", "tree").write.csv(path)
    return fs.read_ast_csv(spark, path)


@query(with_sql(TREES_SQL) + "SELECT split, pid, tree FROM trees")
def import_asts(spark: SparkSession, sf: str) -> DataFrame:
    return fs.import_asts(_ast_csv(spark, sf), docs(spark, sf).select("split", "pid"))


@query(
    _D
    + "SELECT split AS part, CAST(count(*) AS BIGINT) AS keys FROM docs GROUP BY split UNION ALL "
    + "SELECT 'skipped' AS part, CAST(count(*) AS BIGINT) AS keys FROM docs"
)
def import_asts_report(spark: SparkSession, sf: str) -> DataFrame:
    return fs.import_report(_ast_csv(spark, sf), docs(spark, sf).select("split", "pid"))


_NAMES = "SELECT pid, CASE WHEN pid % 2 = 0 THEN pid || '.cpp' WHEN pid % 3 = 0 THEN pid || '.cpp.cpp' ELSE CAST(pid AS {}) END AS name"


@query(
    _D
    + "SELECT pid, replace(name, '.cpp', '') AS removed, CASE WHEN contains(name, '.cpp') THEN name ELSE name || '.cpp' END AS added FROM ("
    + _NAMES.format("VARCHAR")
    + " FROM docs)"
)
def normalise_key(spark: SparkSession, sf: str) -> DataFrame:
    docs(spark, sf).createOrReplaceTempView("key_docs")
    rows = spark.sql(_NAMES.format("STRING") + " FROM key_docs")
    return rows.select(
        "pid",
        fs.normalise_key(F.col("name"), remove=True).alias("removed"),
        fs.normalise_key(F.col("name"), remove=False).alias("added"),
    )


@query("SELECT vec_id AS pid, CAST(label AS BIGINT) AS uid_pred FROM embeddings")
def write_predictions(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "predictions")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").alias("uid_pred"))
    fs.write_predictions(rows, path)
    return fs.read_predictions(spark, path)


@query(
    with_sql(DOCS_SQL, grams_sql("docs", 3), vocab_sql(100))
    + "SELECT split, pid, CAST(idx AS BIGINT) AS idx, CAST(count(*) AS FLOAT) AS value FROM grams JOIN vocab USING (gram) GROUP BY ALL"
)
def write_read_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = gr.with_tokens(docs(spark, sf), tk.char_ngrams(F.col("code"), 3))
    vocabulary = persisted(vo.fit_vocabulary(train_part(rows), 100), "vocabulary")
    path = _place(spark, "vectors")
    fs.write_vectors(ve.count(rows, vocabulary).join(rows.select("pid", "split"), "pid"), path)
    return fs.read_vectors(spark, path)


@query(
    with_sql(DOCS_SQL, grams_sql("docs", 3), vocab_sql(500))
    + "SELECT gram, CAST(idx AS BIGINT) AS idx, CAST(cnt AS BIGINT) AS cnt FROM vocab"
)
def save_load_vocab(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "vocabulary")
    rows = gr.with_tokens(docs(spark, sf), tk.char_ngrams(F.col("code"), 3))
    fs.save_vocabulary(vo.fit_vocabulary(train_part(rows), 500), path)
    return fs.load_vocabulary(spark, path)


@query(_D + "SELECT CAST(count(*) AS BIGINT) AS documents, CAST(0 AS BIGINT) AS differing FROM docs WHERE split <> 'train'")
def save_load_model(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, and those whose probabilities by a model and by its stored copy differ."""
    rows = persisted(_ml(_printable(spark, sf)), "vectors")
    path = _place(spark, "model")
    fitted = cf.fit_logistic(train_part(rows))
    fs.save_model(fitted, path)
    rest = rows.filter("split <> 'train'").select("pid", "features")
    both = cf.predict_proba(fitted, rest).join(
        cf.predict_proba(fs.load_model(LogisticRegressionModel, path), rest).withColumnRenamed("probs", "again"), "pid"
    )
    return both.agg(F.count("*").alias("documents"), F.count_if(F.col("probs") != F.col("again")).alias("differing"))


@query()
def local_explanation(spark: SparkSession, sf: str) -> DataFrame:
    """Which words speak for and against the two likeliest languages of a document."""
    rows = _labelled(spark, sf)
    words = gr.with_tokens(rows, tk.sequence_words(F.col("code")))
    vocabulary = persisted(vo.fit_vocabulary(train_part(words), 300), "vocabulary")
    cells = persisted(ve.binary(words, vocabulary), "cells")
    classes, weights = cf.fit_multinomial_nb(cells, train_part(rows).select("pid", "label"), 300)
    classes, weights = persisted(classes, "classes"), persisted(weights, "weights")

    def scorer(samples: DataFrame, own: DataFrame) -> DataFrame:
        return cf.probabilities(cf.nb_scores(samples, own, classes, weights))

    found = ex.local_explanation(cells, rows, vocabulary, pid=40, scorer=scorer, labels=2)
    return found.withColumn("weight", F.round("weight", 6))
