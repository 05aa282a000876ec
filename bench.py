"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from inkprint.plans import load_all
from inkprint.plans.registry import QUERIES
from inkprint.runtime import session

HEADLINE = (
    "ngram_counts",
    "fit_vocab",
    "scap_attribute",
    "scap_attribute_documents",
    "vectorize_word_tfidf",
    "style_features",
    "nb_predict",
    "knn_predict",
    "weighted_average",
    "ast_2grams",
    "profile_sweep",
    "import_asts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = session(f"local[{cpus}]", cpus, **{"spark.driver.memory": "20g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the executors
    seconds = {}
    for name in wanted:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    found = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found[1]) if found else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
