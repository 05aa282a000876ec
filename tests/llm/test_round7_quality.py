"""Word sums made in buckets against the same sums by joins, and disk that is given back."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.llm import quality, word_buckets
from inkprint.runtime import persisted


def _texts(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    share = 1 / np.arange(1, 401)
    rows = [(i, " ".join(rng.choice(words, 60, p=share / share.sum())), int(i % 2), i % 3 > 0) for i in range(90)]
    rows += [(200, None, 0, True), (201, "", 1, True), (202, "w0 w0 w0 w0", 0, False), (203, "never seen", 1, False), (5, "w1 w2", 1, True)]
    return spark.createDataFrame(rows, "key bigint, text string, half int, trusted boolean").repartition(3)


@pytest.mark.parametrize(("most", "top"), [(None, None), (40, None), (None, 5), (40, 30)])
def test_sums_in_buckets_equal_joins_by_key(spark, most, top):
    """Few places to a bucket deal frequent words over many; few known words make the others rare."""
    rows = _texts(spark)
    values, floors = quality.word_model(quality.word_counts(rows.filter("trusted").select("text", "half")))
    asked = rows.select(F.col("key").alias("doc_id"), F.lit(0).cast("bigint").alias("th"), "text", (1 - F.col("half")).alias("half"))
    want = {r.doc_id: r.known for r in quality.word_sums(asked, values).collect()}
    got, low = word_buckets.sums(rows, None, most, top)
    got = {r.key: r.known for r in got.collect()}
    assert low == pytest.approx(floors)
    for key in want.keys() | got.keys():
        assert math.isclose(got.get(key, 0.0), want.get(key, 0.0), rel_tol=1e-9, abs_tol=1e-9), key


def test_buckets_hold_what_they_should(spark):
    sizes = np.zeros(word_buckets.CELLS, dtype=np.int64)
    sizes[[3, 9, 50, 51]] = [1000, 30, 60, 70]
    plan = word_buckets.made_plan(sizes, 100)
    assert plan.parts[3] == 10 and plan.parts[[9, 50, 51]].max() == 1 and plan.buckets == 12
    assert not set(plan.first[[9, 50, 51]]) & set(range(plan.first[3], plan.first[3] + 10))


def test_no_trusted_text(spark):
    got, floors = word_buckets.sums(_texts(spark).withColumn("trusted", F.lit(False)))
    assert floors == {} and not any(r.known for r in got.collect())


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        root = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
        return {p for p in root.rglob("shuffle_*.data")}

    before = files()
    stored = persisted(spark.range(50_000).groupBy((F.col("id") % 40_000).alias("k")).count())
    assert stored.count() == 40_000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    left = [p for p in files() - before if p.stat().st_size > 100_000]
    assert not left
