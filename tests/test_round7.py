"""A file a document: what is written beside the files, and how they are listed."""

import tempfile
from pathlib import Path

from inkprint.plans import io
from inkprint.plans.registry import QUERIES
from inkprint.sources import files


def _tables(spark, rows=70):
    folder = tempfile.mkdtemp(prefix="inkprint-round7-")
    docs = spark.range(rows).selectExpr("id AS doc_id", "concat('Text of ', id, '. More') AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_a_file_for_each_document_and_nothing_beside_it(spark):
    root = Path(io._corpus_files(spark, _tables(spark)).removeprefix("file://"))
    folders = [p for p in root.iterdir() if p.is_dir()]
    assert len(folders) == 70
    assert all(len(list(p.iterdir())) == 1 for p in folders)
    assert next((root / "pid=5").iterdir()).read_bytes() == b"Text of 5.\r\nMore\n"


def test_many_folders_are_listed_by_a_few_tasks(spark):
    path = io._corpus_files(spark, _tables(spark))
    key, context = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(key)
    context.setJobGroup("listed", "listed")
    try:
        assert files.corpus_files(spark, path).count() == 70
    finally:
        context._jsc.clearJobGroup()
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listed")]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if tracker.getStageInfo(s)]
    assert tasks and max(tasks) <= 4 * context.defaultParallelism < 70
    assert spark.conf.get(key) == before


def test_readers_find_every_document(spark):
    folder = _tables(spark)
    for name, rows in (("read_corpus_text", 70), ("read_corpus_bytes", 70), ("load_split", 140)):
        assert QUERIES[name](spark, folder).distinct().count() == rows, name
