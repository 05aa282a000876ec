"""The whole pipeline on a small table, held to what each stage promises."""

import re
from collections import defaultdict

import corpus_pipeline
from inkprint.llm import decontaminate
from inkprint.llm.common import table

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_keeps_its_promises(spark):
    docs = {(r.doc_id, r.text, r.lang, r.source) for r in table(spark, SF, "documents").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {(r.doc_id, r.text, r.lang, r.source) for r in out} <= docs
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    sets = {(r.doc_id, r.text): shingles(r.text) for r in out}
    kept = [s for s in sets.values() if s]
    for i, a in enumerate(kept):
        for b in kept[:i]:
            assert 100 * len(a & b) < 75 * len(a | b)
    left = spark.createDataFrame(list(sets), "doc_id bigint, text string")
    assert decontaminate.contaminated(left, table(spark, SF, "benchmark")).count() == 0
