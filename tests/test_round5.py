"""Findings of round 3, second time: one pass over a text where there were many, and the same results."""

from pyspark.sql import functions as F

from inkprint.functions import style as st
from inkprint.functions import tokens as tk

TEXTS = ["", None, "aB cK \U0001f600x\xe9\n\t \r\n zz\x0b\x0c\x00", "İstanbul \U0001d538    a", "  ", "y" * 3000]


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def _texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "pid bigint, code string").repartition(2)


def test_characters_are_counted_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(st, "BYTES", 1000)
    code = F.col("code")
    found = _texts(spark).select("pid", st.printable_counts(code).alias("all"), st.alpha_counts(code).alias("letters"))
    assert "replace(" not in _plan(found)
    for r in found.collect():
        text = TEXTS[r.pid]
        assert r["all"] == [None if text is None else text.count(c) for c in st.PRINTABLE]
        lower = spark.createDataFrame([(text,)], "t string").select(F.lower("t")).first()[0]
        assert r.letters == [None if text is None else lower.count(c) for c in st.ALPHABET]


def test_characters_are_split_without_a_pattern(spark):
    found = _texts(spark).select("pid", tk.chars(F.col("code")).alias("c"), tk.collapsed_chars(F.col("code")).alias("s"))
    assert "regexp_extract_all" not in _plan(found)
    rows = {r.pid: r for r in found.collect()}
    assert rows[0].c == rows[0].s == [] and rows[1].c is rows[1].s is None
    assert rows[2].c == list(TEXTS[2].lower()) and rows[4].c == [" ", " "] and rows[4].s == [" "]
    assert rows[3].s[-5:] == ["l", " ", "\U0001d538", " ", "a"]


def test_places_are_sorted_as_numbers(spark):
    """Equal pids: by place, then number; a null pid has no ids."""
    from inkprint.operators import vectors as ve

    rows = [(7, ["b", "x", "a"]), (7, ["a", "b"]), (8, ["x"]), (None, ["a"]), (9, ["b"] * 700 + ["a"])]
    docs = spark.createDataFrame(rows, "pid bigint, tokens array<string>")
    found = ve.positions(docs, spark.createDataFrame([("a", 0), ("b", 1)], "gram string, idx bigint"))
    assert "sort_array" not in _plan(found)
    assert "_in_text_order" in _plan(found).split("Join LeftOuter")[0]  # above the join, so that groups are not shuffled again
    got = sorted((str(r.pid), list(r.ids)) for r in found.collect())
    assert got == [("7", [0, 1, 1, 0]), ("7", [0, 1, 1, 0]), ("8", []), ("9", [1] * 700 + [0]), ("None", [])]


def test_first_place_costs_no_decimals(spark):
    """Pids below 2^32 are counted as bigint; negative and larger ones stay right."""
    from inkprint.runtime import first_pid, first_seen

    rows = [("a", 5, 9), ("a", 5, 3), ("a", 2**40, 0), ("b", -1, 7), ("b", 0, 0), ("c", 2**40 + 1, 4), ("c", 2**40, 8),
            ("d", 2**32 - 1, 2**31 - 1), ("d", 2**32, 0), ("e", None, 1)]
    frame = spark.createDataFrame(rows, "g string, pid bigint, pos int")
    found = frame.groupBy("g").agg(first_seen(frame).alias("k"))
    assert "CASE WHEN" in _plan(found)
    want = {"a": 5 * 2**31 + 3, "b": -(2**31) + 7, "c": 2**71 + 8, "d": 2**63 - 1, "e": None}
    assert {r.g: None if r.k is None else int(r.k) for r in found.collect()} == want
    assert {r.g: r.p for r in found.select("g", first_pid(F.col("k")).alias("p")).collect()}["d"] == 2**32 - 1
