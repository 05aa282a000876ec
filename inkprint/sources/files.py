"""Reading and writing the collection's files: label CSVs, one-file-per-document
corpora, syntax-tree stores, predictions, feature vectors, vocabularies.

Rows are aligned by ``pid``, never by position; nothing is sorted at a source,
only at sinks whose order is part of the format."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.functions.cleaning import universal_newlines
from inkprint.operators.classifiers import predict_label
from inkprint.operators.ensemble import weighted_average
from inkprint.runtime import persisted

LABELS = T.StructType([T.StructField("uid", T.IntegerType()), T.StructField("pid", T.LongType())])
SPLITS = ("train", "dev", "test")


def _file_order() -> Column:
    """Sorts rows as they stand in the files: by file, by split of the file, by row."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def read_labels(spark: SparkSession, path: str, validate: bool = False) -> DataFrame:
    """(uid, pid) of a label CSV with a header row.  Anything but two integers
    fails; ``validate`` also demands the header names uid,pid."""
    reader = spark.read.schema(LABELS).option("header", True).option("mode", "FAILFAST")
    return reader.option("enforceSchema", not validate).csv(path)


def read_unlabeled_ids(spark: SparkSession, path: str) -> DataFrame:
    """(pid, ord): second column of a CSV with a header; ``ord`` increases in
    file order."""
    schema = T.StructType([T.StructField("_skip", T.StringType()), T.StructField("pid", T.LongType())])
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.select("pid", _file_order().alias("ord"))


def corpus_files(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder, listed once for all that reads them.

    Spark lists many folders in a job with a task for each, up to 10,000 tasks of a
    few milliseconds' work; here the tasks are a few for each core."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    finally:
        spark.conf.set(key, before)


def read_corpus(spark: SparkSession, path: str | DataFrame, mode: str = "text", pid_pattern: str = r"([0-9]+)$") -> DataFrame:
    """(pid, code) from one file per document whose path holds the pid, given their
    folder or their :func:`corpus_files`.

    ``text`` decodes UTF-8 and turns \\r\\n and \\r into \\n; ``bytes`` leaves
    the content as it is.  Zero-length files give no row; see :func:`load_split`."""
    if mode not in ("text", "bytes"):
        raise ValueError(f"mode must be text or bytes, not {mode}")
    files = corpus_files(spark, path) if isinstance(path, str) else path
    code = F.col("content")
    if mode == "text":
        code = universal_newlines(F.decode(code, "utf-8"))
    return files.select(F.regexp_extract("path", pid_pattern, 1).cast("bigint").alias("pid"), code.alias("code"))


def load_split(labels: DataFrame, corpus: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """``labels`` rows with their document's text, by key.

    A label without a document is an error.  Spark's file readers pass over
    zero-length files; the pids of those are given as ``empty`` (pid) and get an
    empty text.  :func:`audit_split` counts the rest before a job is started."""
    nothing = F.lit("").cast(corpus.schema["code"].dataType)
    if empty is not None:
        known = empty.select("pid").distinct().join(corpus, "pid", "left_anti")
        corpus = corpus.select("pid", "code").unionByName(known.select("pid", nothing.alias("code")))
    missing = F.raise_error(F.concat(F.lit("no file for pid "), F.coalesce(F.col("pid").cast("string"), F.lit("null"))))
    found = labels.join(corpus.withColumn("_found", F.lit(True)), "pid", "left")
    return found.withColumn("code", F.when(F.col("_found"), F.col("code")).otherwise(missing.cast(corpus.schema["code"].dataType))).drop("_found")


def audit_split(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: labels without a (non-empty) file and files without a label."""
    both = labels.select("pid", F.lit(1).alias("l")).join(corpus.select("pid", F.lit(1).alias("f")), "pid", "full")
    return both.agg(
        F.count_if(F.col("f").isNull()).alias("labels_without_file"),
        F.count_if(F.col("l").isNull()).alias("files_without_label"),
        F.count_if(F.col("l").isNotNull() & F.col("f").isNotNull()).alias("matched"),
    )


def read_split_labels(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(split, uid, pid) of several label files; a ``test`` file has ids only."""
    out = None
    for split, path in paths.items():
        if split == "test":
            rows = read_unlabeled_ids(spark, path).select(F.lit(None).cast("int").alias("uid"), "pid")
        else:
            rows = read_labels(spark, path)
        rows = rows.select(F.lit(split).alias("split"), "uid", "pid")
        out = rows if out is None else out.unionByName(rows)
    return out


def load_all_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("uid IS NOT NULL").select("split", "uid")


def load_all_pids(labels: DataFrame) -> DataFrame:
    return labels.select("split", "pid")


# ------------------------------------------------------------------ trees

_ENTRY = T.MapType(T.StringType(), T.StringType())
_STORE = T.MapType(T.StringType(), _ENTRY)


def read_asts(spark: SparkSession, path: str, one_object: bool = False) -> DataFrame:
    """(split, pid, tree) from ``{split: {pid: tree}}`` JSON.

    A line may hold a whole object, or the store is one indented object with an
    entry per line; both are read in parallel.  JSON strings hold no line ends,
    so an indented entry is whole in its line and belongs to the last split
    opened before it in its file; these headings, a few per file, are looked up
    first.  ``one_object`` reads a file of any other layout as a single value,
    which Spark cannot split.  What cannot be read is an error, never left out."""
    bare = F.trim(F.col("value"), F.lit(" \t\r\n,"))
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path, wholetext=one_object)
    lines = lines.select(bare.alias("text"), F.col("_metadata.file_path").alias("file"), at.alias("at"))
    lines = lines.filter("text NOT IN ('', '{', '}')")
    opens = F.endswith("text", F.lit("{"))
    whole = F.startswith("text", F.lit("{")) | F.endswith("text", F.lit("}"))

    def read(text: Column, kind: T.MapType) -> Column:
        unread = F.raise_error(F.concat(F.lit("no object or entry of a tree store: "), F.left("text", F.lit(80))))
        return F.coalesce(F.from_json(text, kind), unread.cast(kind))

    braced = F.when(F.startswith("text", F.lit("{")), F.col("text")).otherwise(F.concat(F.lit("{"), "text", F.lit("}")))
    objects = lines.filter(~opens & whole).select(F.explode(read(braced, _STORE)).alias("split", "trees"))
    objects = objects.select("split", F.explode("trees").alias("pid", "tree"))

    name = F.map_keys(read(F.concat(F.lit("{"), "text", F.lit("}}")), _STORE))[0]
    heads = lines.filter(opens).select("file", F.struct("at", name.alias("split")).alias("head"))
    heads = persisted(heads.groupBy("file").agg(F.sort_array(F.collect_list("head")).alias("heads")), "headings")
    entries = lines.filter(~opens & ~whole).select("file", "at", F.explode(read(braced, _ENTRY)).alias("pid", "tree"))
    split = F.expr("try_element_at(filter(heads, h -> h.at < at), -1).split")
    homeless = F.raise_error(F.concat(F.lit("no split is open at pid "), "pid"))
    entries = entries.join(heads, "file", "left").select(F.coalesce(split, homeless).alias("split"), "pid", "tree")
    return objects.unionByName(entries).select("split", F.col("pid").cast("bigint").alias("pid"), "tree")


def write_asts(trees: DataFrame, path: str) -> None:
    """(split, pid, tree) as one small JSON object per line."""
    entry = F.create_map(F.col("split"), F.create_map(F.col("pid").cast("string"), F.col("tree")))
    trees.select(F.to_json(entry).alias("value")).write.text(path)


class _Piece(NamedTuple):
    """Lines of a record that stand in one split: ``head`` if it begins there, ``whole``
    if it also ends there or, without a head, if it only ends there."""

    file: str
    start: int
    at: int
    text: str
    head: bool
    closed: bool


def _pieces(lines: Iterator[tuple[str, int, bool, str]]) -> Iterator[_Piece]:
    """Records and parts of records from (file, split start, odd, line) in order: ``odd``
    says that an odd number of quotes stands before the split, so that it begins inside a cell."""
    key, at, held, head, inside = None, 0, [], True, False
    for file, start, odd, line in lines:
        if (file, start) != key:
            if held:
                yield _Piece(*key, at, "\n".join(held), head, not inside)
            key, at, held, inside = (file, start), 0, [], odd
            head = not odd
        held.append(line)
        inside ^= line.count('"') % 2 == 1
        if not inside:
            yield _Piece(file, start, at, "\n".join(held), head, True)
            at, held, head = at + 1, [], True
    if held:
        yield _Piece(*key, at, "\n".join(held), head, not inside)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def lines() -> Iterator[tuple[str, int, bool, str]]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

    held, size = [], 0
    for piece in _pieces(lines()):
        held.append(piece)
        size += len(piece.text)
        if size > 1 << 22 or len(held) > 10_000:
            yield pa.RecordBatch.from_pylist([p._asdict() for p in held])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([p._asdict() for p in held])


def read_ast_csv(spark: SparkSession, path: str) -> DataFrame:
    """(key, tree, ord) of a two-column CSV without header; quoted cells may hold
    line breaks, and a quote in them is doubled.

    Files are read in splits like any text.  Doubled quotes count twice, so a line
    begins a record if an even number of quotes stands before it in its file: the splits' numbers
    of quotes, a row each, are summed along each file, and then every split cuts its own lines into
    records.  Only the two pieces at most that a split leaves open are brought
    together, so a record may reach over any number of splits."""
    name, start = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    lines = spark.read.option("lineSep", "\n").text(path).select(name, start, F.col("value").alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    odd = odd.select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    # One row a split: sent to the tasks, as a shuffle would lose the order of lines.
    placed = lines.join(F.broadcast(persisted(odd, "splits")), ["file", "start"]).select("file", "start", "odd", "line")
    kind = "file string, start bigint, at bigint, text string, head boolean, closed boolean"
    pieces = persisted(placed.mapInArrow(_cut, kind), "pieces")
    order = Window.partitionBy("file").orderBy("start", "at")
    open_ = pieces.filter("NOT (head AND closed)").withColumn("record", F.count_if("head").over(order))
    joined = open_.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("start", "at", "text"))).alias("parts")
    )
    records = pieces.filter("head AND closed").select("file", "start", "at", "text").unionByName(
        joined.select("file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["at"].alias("at"),
                      F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    )
    cells = F.from_csv(F.regexp_replace("text", "\r$", ""), "key string, tree string", {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return (
        records.filter("text NOT IN ('', '\r')")
        .select(cells.alias("cells"), F.struct("file", "start", "at").alias("ord"))
        .select("cells.key", "cells.tree", "ord")
    )


def _tree_pid() -> Column:
    """Last path segment without its last four characters, as a number or null."""
    segment = F.element_at(F.split(F.expr("left(key, greatest(length(key) - 4, 0))"), "/"), -1)
    return F.trim(segment).try_cast("bigint")


def _routed(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The last row per key and pid with the first split, in order, that lists the pid."""
    keyed = rows.withColumn("pid", _tree_pid()).filter("pid IS NOT NULL")
    last = keyed.groupBy("pid").agg(F.max_by("tree", "ord").alias("tree"))
    priority = F.create_map(*[x for i, s in enumerate(SPLITS) for x in (F.lit(s), F.lit(i))])
    home = index.groupBy("pid").agg(F.min_by("split", priority[F.col("split")]).alias("split"))
    return last.join(home, "pid", "left")


def import_asts(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(split, pid, tree): ``rows`` (key, tree, ord) routed by ``index``
    (split, pid) to train, else dev, else test.  Keys that are no number are
    skipped, the last row of a pid wins, a pid in no split fails the job."""
    missing = F.raise_error(F.concat(F.lit("no split holds pid "), F.col("pid").cast("string")))
    return _routed(rows, index).select(F.coalesce("split", missing).alias("split"), "pid", "tree")


def import_report(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(part, keys): trees per split, and skipped keys."""
    placed = import_asts(rows, index).groupBy(F.col("split").alias("part")).agg(F.count("*").alias("keys"))
    bad = rows.filter(_tree_pid().isNull()).select("key").distinct()
    return placed.unionByName(bad.agg(F.count("*").alias("keys")).select(F.lit("skipped").alias("part"), "keys"))


def normalise_key(name: Column, remove: bool) -> Column:
    """Names with ``.cpp`` taken out, or put on where it is nowhere in the name."""
    if remove:
        return F.replace(name, F.lit(".cpp"), F.lit(""))
    return F.when(F.contains(name, F.lit(".cpp")), name).otherwise(F.concat(name, F.lit(".cpp")))


# ------------------------------------------------------------------ sinks


def write_ensemble(scores: DataFrame, weights: dict[int, float], path: str) -> None:
    """Prediction files of the first model alone (``kind=first``) and of the weighted
    average (``kind=ensemble``), a folder for each ``part`` of (model, pid, uid, probs, part)."""
    first = predict_label(scores.filter(F.col("model") == next(iter(weights))).select("pid", "part", "probs"))
    mixed = weighted_average(scores, weights).select("pid", "uid_pred")
    mixed = mixed.join(scores.select("pid", "part").distinct(), "pid")
    for kind, found in (("first", first), ("ensemble", mixed)):
        for part in ("dev", "test"):
            write_predictions(found.filter(F.col("part") == part).select("pid", "uid_pred"), f"{path}/kind={kind}/part={part}")


def read_ensemble(spark: SparkSession, path: str) -> DataFrame:
    """(kind, part, pid, uid) of the files that :func:`write_ensemble` wrote."""
    rows = spark.read.schema(LABELS).option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.select("kind", "part", "pid", "uid")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """CSV uid,pid with header, in pid order (range-partitioned files)."""
    rows = predictions.select(F.col("uid_pred").alias("uid"), "pid")
    rows.orderBy("pid").write.option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_labels(spark, path).select("pid", F.col("uid").cast("bigint").alias("uid_pred"))


def write_vectors(cells: DataFrame, path: str) -> None:
    """(split, pid, idx, value) as 32-bit values, one folder per split so that
    readers of one split skip the others."""
    rows = cells.select("split", "pid", "idx", F.col("value").cast("float").alias("value"))
    rows.write.partitionBy("split").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.write.parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    """An MLlib model, by its own writer."""
    model.save(path)


def load_model(kind: type, path: str):
    return kind.load(path)
