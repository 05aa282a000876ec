"""File formats."""

import json
import random

import pytest
from pyspark.sql import functions as F

from inkprint.operators import classifiers as cf
from inkprint.sources import files as fs


def test_labels(spark, tmp_path):
    good = tmp_path / "train.csv"
    good.write_text("uid,pid\n3,12\n4,7\n")
    assert sorted(map(tuple, fs.read_labels(spark, str(good)).collect())) == [(3, 12), (4, 7)]
    assert fs.read_labels(spark, str(good), validate=True).count() == 2
    other = tmp_path / "other.csv"
    other.write_text("user,file\n3,12\n")
    assert fs.read_labels(spark, str(other)).count() == 1
    with pytest.raises(Exception):
        fs.read_labels(spark, str(other), validate=True).collect()
    broken = tmp_path / "broken.csv"
    broken.write_text("uid,pid\nx,12\n")
    with pytest.raises(Exception):
        fs.read_labels(spark, str(broken)).collect()


def test_corpus_line_ends(spark, tmp_path):
    (tmp_path / "12").write_bytes(b"a\r\nb\rc\n\xc3\xa9")
    (tmp_path / "7").write_bytes(b"")
    text = {r["pid"]: r["code"] for r in fs.read_corpus(spark, str(tmp_path)).collect()}
    assert text == {12: "a\nb\nc\né"}  # Spark passes over empty files
    raw = {r["pid"]: bytes(r["code"]) for r in fs.read_corpus(spark, str(tmp_path), "bytes").collect()}
    assert raw == {12: b"a\r\nb\rc\n\xc3\xa9"}
    (tmp_path / "5").write_bytes(b"x")
    labels = spark.createDataFrame([(1, 12), (2, 7)], "uid int, pid bigint")
    corpus = fs.read_corpus(spark, str(tmp_path))
    empty = spark.createDataFrame([(7,), (12,)], "pid bigint")
    got = sorted(map(tuple, fs.load_split(labels, corpus, empty).select("pid", "uid", "code").collect()))
    assert got == [(7, 2, ""), (12, 1, "a\nb\nc\né")]
    with pytest.raises(Exception, match="no file for pid 7"):
        fs.load_split(labels, corpus).collect()
    assert tuple(fs.audit_split(labels, corpus).first()) == (1, 1, 1)


def test_unlabelled_ids_keep_their_order(spark, tmp_path):
    path = tmp_path / "unlabeled_test.csv"
    path.write_text("uid,pid\n,9\n,2\n,5\n")
    rows = fs.read_unlabeled_ids(spark, str(path)).orderBy("ord").collect()
    assert [r["pid"] for r in rows] == [9, 2, 5]


def test_tree_import(spark, tmp_path):
    path = tmp_path / "asts.csv"
    path.write_text('d/12.cpp,"1 1{}"\nd/tmp.cpp,"x{}"\nd/3.cpp,"5 5{}"\nd/12.cpp,"2 2{}"\n')
    index = spark.createDataFrame([("test", 12), ("dev", 12), ("train", 3)], "split string, pid bigint")
    rows = fs.read_ast_csv(spark, str(path))
    got = sorted(map(tuple, fs.import_asts(rows, index).collect()))
    assert got == [("dev", 12, "2 2{}"), ("train", 3, "5 5{}")]
    report = {r["part"]: r["keys"] for r in fs.import_report(rows, index).collect()}
    assert report == {"dev": 1, "train": 1, "skipped": 1}
    with pytest.raises(Exception, match="no split holds pid"):
        fs.import_asts(rows, index.filter("pid = 3")).collect()
    store = tmp_path / "ast.json"
    store.write_text(json.dumps({"train": {"10": "a{}", "9": "b{}"}, "dev": {}, "test": {"1": "c{}"}}, indent="\t"))
    got = sorted(map(tuple, fs.read_asts(spark, str(store), one_object=True).collect()))
    assert got == [("test", 1, "c{}"), ("train", 9, "b{}"), ("train", 10, "a{}")]
    fs.write_asts(fs.import_asts(rows, index), str(tmp_path / "lines"))
    assert fs.read_asts(spark, str(tmp_path / "lines")).count() == 2


def test_tree_store_layouts(spark, tmp_path):
    trees = {"train": {str(i): f'n{i}{{"x",\\\n}}' for i in range(300)}, "dev": {}, "test": {"7": "{", "8": "}", "9": ""}}
    want = sorted((s, int(p), t) for s, part in trees.items() for p, t in part.items())
    for indent in (None, 1, "\t"):
        path = tmp_path / f"store-{indent!r}.json".replace("\\", "_")
        path.write_text(json.dumps(trees, indent=indent))
        assert sorted(map(tuple, fs.read_asts(spark, str(path)).collect())) == want
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many splits of one file
    try:
        assert sorted(map(tuple, fs.read_asts(spark, str(path)).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for text in ('{"train": {\n"1": "a",\nrest\n}}', '"1": "a"\n'):
        path.write_text(text)
        with pytest.raises(Exception):
            fs.read_asts(spark, str(path)).collect()


def test_tree_csv_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('d/1.cpp,"0 0{a\nb{}}"\nd/2.cpp,"say ""x""\n\n"\n')
    got = sorted(tuple(r)[:2] for r in fs.read_ast_csv(spark, str(tmp_path)).collect())
    assert got == [("d/1.cpp", "0 0{a\nb{}}"), ("d/2.cpp", 'say "x"\n\n')]


@pytest.mark.parametrize("size", ["40", "97", "1000", "128m"])
def test_tree_csv_cut_into_splits_inside_cells(spark, tmp_path, size):
    """Cells with line breaks, commas and quotes, some longer than a split, last line without an end."""
    draw = random.Random(size)
    want, text = {}, {}
    for name in ("a.csv", "b.csv"):
        rows = []
        for i in range(25):
            cell = "".join(draw.choice(['{', '}', '\n', ',', '"', 'x 1', ' ', '\n\n']) for _ in range(draw.choice([0, 5, 30, 120])))
            rows.append((f"d/{name[0]}{i}.cpp", cell))
        want[name] = rows
        text[name] = "\n".join(f'{k},"{c.replace(chr(34), chr(34) * 2)}"' for k, c in rows) + ("\n" if name == "a.csv" else "")
        (tmp_path / name).write_text(text[name])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        frame = fs.read_ast_csv(spark, str(tmp_path))
        got = frame.orderBy("ord").collect()
        splits = {(r.ord.file, r.ord.start) for r in got}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.key, r.tree or "") for r in got] == want["a.csv"] + want["b.csv"]
    assert len(splits) > 10 or size in ("1000", "128m")


def test_names(spark):
    rows = spark.createDataFrame([("12",), ("a.cpp",), ("a.cpp.bak.cpp",)], "n string")
    assert [r[0] for r in rows.select(fs.normalise_key(F.col("n"), True)).collect()] == ["12", "a", "a.bak"]
    assert [r[0] for r in rows.select(fs.normalise_key(F.col("n"), False)).collect()] == ["12.cpp", "a.cpp", "a.cpp.bak.cpp"]


def test_predictions_are_sorted_csv(spark, tmp_path):
    rows = spark.createDataFrame([(5, 1), (2, 0), (9, 3)], "pid bigint, uid_pred bigint")
    fs.write_predictions(rows, str(tmp_path / "p"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*.csv")))
    assert [x for x in text.split("\n") if x and x != "uid,pid"] == ["0,2", "1,5", "3,9"]
    assert fs.read_predictions(spark, str(tmp_path / "p")).count() == 3


def test_random_baseline_repeats(spark):
    rows = spark.range(200).withColumnRenamed("id", "pid")
    one = {r["pid"]: r["uid_pred"] for r in cf.random_baseline(rows, 10, 1).collect()}
    two = {r["pid"]: r["uid_pred"] for r in cf.random_baseline(rows.repartition(7), 10, 1).collect()}
    assert one == two and set(one.values()) == set(range(10))
