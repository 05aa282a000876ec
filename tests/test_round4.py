"""Findings of round 3: results and bounded steps."""

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry

QUERIES = entry.queries()


def _documents(spark, path, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{path}/documents.parquet")
    return str(path)


def _with(spark, settings, run):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_indented_store_of_many_partitions(spark, tmp_path):
    """Headings stay with their entries when shuffled partitions are joined by their sizes."""
    sf = _documents(spark, tmp_path, [" ".join(["ab"] * (i % 400 + 1)) for i in range(1500)])
    settings = {
        "spark.sql.shuffle.partitions": "24",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    got = _with(spark, settings, lambda: QUERIES["read_asts_indented"](spark, sf).collect())
    from inkprint.plans.corpus import trees

    want = trees(spark, sf).select("split", "pid", "tree").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def _limits(spark):
    names = ("maxRecordsPerBatch", "maxBytesPerBatch")
    return [int(spark.conf.get(f"spark.sql.execution.arrow.{n}")) for n in names]


def test_python_gets_small_batches(spark):
    """What a worker holds does not grow with the texts of its task; results stay."""
    from inkprint.functions import trees as tr
    from inkprint.operators import grams as gr

    rows = spark.range(3000).repartition(1).select(F.col("id").alias("pid"), F.array_repeat(F.lit("a"), 3).alias("tokens"))

    def run(make):
        frame = make()
        rows_, size = _limits(spark)
        assert rows_ <= 512 and size <= 4 << 20
        return frame.count()

    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 30)}
    tree = rows.select("pid", F.lit("0 0{1 2{}}").alias("tree"))
    assert _with(spark, settings, lambda: run(lambda: gr.counts(rows))) == 3000
    assert _with(spark, settings, lambda: run(lambda: gr.places(rows))) == 3000
    assert _with(spark, settings, lambda: run(lambda: tree.select(F.inline(tr.nodes("tree"))))) == 6000
    assert _with(spark, settings, lambda: run(lambda: tree.select(F.explode(tr.tree_ngrams(F.col("tree"), 2)["grams"])))) == 3000


def test_batches_are_cut_by_terms(monkeypatch):
    from inkprint.operators import grams as gr

    monkeypatch.setattr(gr, "TERMS", 10)
    lists = [["a"] * n for n in (3, 3, 3, 3, 25, 0)] + [None, ["a"] * 10, ["a"]]
    batch = pa.RecordBatch.from_pydict({"pid": list(range(9)), "tokens": pa.array(lists, pa.list_(pa.string()))})
    parts = [p.column(0).to_pylist() for p in gr._parts(iter([batch, batch.slice(0, 0)]))]
    assert parts == [[0, 1, 2], [3], [4], [5, 6, 7], [8]]


def test_places_are_gathered_whole(spark):
    """Equal pids, unknown terms, empty and null token lists; places are not told apart before the group."""
    from inkprint.operators import vectors as ve

    rows = [(1, ["b", "a", "x", "b"]), (2, ["x"]), (3, None), (4, ["a"] * 300 + ["b"]), (5, [])]
    docs = spark.createDataFrame(rows, "pid bigint, tokens array<string>")
    known = spark.createDataFrame([("a", 0), ("b", 1)], "gram string, idx bigint")
    found = ve.positions(docs, known)
    got = {r.pid: list(r.ids) for r in found.collect()}
    assert got == {1: [1, 0, 1], 2: [], 3: [], 4: [0] * 300 + [1], 5: []}
    gathered = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x]
    assert gathered and all("collect_list(struct(idx, " in x for x in gathered)


def test_neighbours_write_no_pairs(spark):
    """Blocks meet in a Cartesian product; nulls and ties as by brute force."""
    from inkprint.operators import classifiers as cf

    cells = [(p, i, float((p * 7 + i * 3) % 5)) for p in range(40) for i in range(p % 6)]
    frame = spark.createDataFrame(cells, "pid bigint, idx bigint, value double")
    train = spark.range(25).select(F.col("id").alias("pid"), F.when(F.col("id") % 4 > 0, F.col("id") % 3).alias("label"))
    queries = spark.range(20, 40).select(F.col("id").alias("pid"))
    found = cf.neighbours(frame, train, frame, queries, k=4, block=6)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    vectors = {p: {i: v for q, i, v in cells if q == p} for p in range(40)}
    far = lambda a, b: sum((vectors[a].get(i, 0) - vectors[b].get(i, 0)) ** 2 for i in range(6))
    want = {q: sorted((far(q, t), t) for t in range(25))[:4] for q in range(20, 40)}
    got = {}
    for r in found.collect():
        got.setdefault(r.pid, []).append((r.d2, r.neighbour))
        assert r.label == (r.neighbour % 3 if r.neighbour % 4 else None)
    assert {q: sorted(x) for q, x in got.items()} == want


def test_files_are_listed_once(spark, tmp_path):
    from inkprint.sources import files as fs

    (tmp_path / "7").write_bytes(b"a\r\nb")
    listed = fs.corpus_files(spark, str(tmp_path))
    assert [tuple(r) for r in fs.read_corpus(spark, listed).collect()] == [(7, "a\nb")]
    assert [bytes(r.code) for r in fs.read_corpus(spark, listed, "bytes").collect()] == [b"a\r\nb"]
