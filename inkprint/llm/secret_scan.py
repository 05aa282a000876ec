"""Secrets in texts, told apart by how widely a value is copied; built-in functions only.

Candidates are matches of three kinds with their places in code points.  The
value of each is hashed, and over the whole corpus the distinct owners and
repositories of each hash are counted.  A value that ``SPREAD`` owners or more
share, or that stands in ``WIDE`` repositories or more, is a copied example; one that stays with
its owner and in few repositories is live-looking.

Places come from cutting the text at the matches: pieces and matches alternate,
so their lengths add up to every begin and end.  They are added up in about as many runs as a run has
matches, so n matches cost n^1.5 steps.  Only texts that hold a match are cut.

Null and empty texts have no matches.  A null owner or repository counts as
one.  Repeated rows each get their findings; their values count once.  Columns
other than those named are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import table
from inkprint.runtime import persisted

SPREAD, WIDE = 3, 30
# The patterns of the three kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex")
#: The same matches where short ones need not be seen: a run that is long enough is found at once.
LONG_ACCESS, LONG_HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a ``value`` that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str, kind: str, value: str | None = None, least: int = 1) -> Column:
    """Array of (start, end, kind, value) of the leftmost matches, without those
    whose value (group ``value`` of the match, else all of it) is shorter than ``least``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if value else found
    between = F.split(text, pattern, -1)
    parts = F.arrays_zip(between.alias("gap"), found.alias("hit"), values.alias("value"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,value:string>>")
    zero = F.lit(0).cast("bigint")
    hit = lambda x: F.coalesce(F.length(x["hit"]), F.lit(0))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + hit(x)
        one = F.struct(begin.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["value"].alias("value"))
        kept = F.when(F.length(x["value"]) >= least, F.concat(state["out"], F.array(one))).otherwise(state["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    def runs(p: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(p))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(p) - 1, width), lambda i: F.slice(p, i + 1, width))

    def begins(r: Column) -> Column:
        sizes = F.transform(r, lambda run: F.aggregate(run, zero, lambda at, x: at + F.length(x["gap"]) + hit(x)))
        first = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(sizes, first, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def placed(r: Column) -> Column:
        return F.flatten(
            F.zip_with(r, begins(r), lambda run, at: F.aggregate(run, F.struct(at.alias("at"), empty.alias("out")), step, lambda s: s["out"]))
        )

    made = let(let(parts, runs), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), made).otherwise(empty)


def candidates(text: Column) -> Column:
    """All spans by start, then kind."""
    return F.array_sort(
        F.concat(
            spans(text, ASSIGN, "assign", value="group", least=8),
            spans(text, LONG_ACCESS, "access"),
            spans(text, LONG_HEX, "hex"),
        ),
        lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"])), -1)
        .when((a["start"] == b["start"]) & (a["kind"] == b["kind"]), 0)
        .otherwise(1),
    )


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """(value_hash, n_owners, n_repositories) of every candidate value.

    Distinct pairs first, so a value in a third of all rows is reduced in every task."""
    named = found.select(
        F.explode("spans").alias("s"),
        F.coalesce(F.col(owner).cast("string"), F.lit("\u0000")).alias("o"),
        F.coalesce(F.col(repository).cast("string"), F.lit("\u0000")).alias("r"),
    ).select(F.sha2("s.value", 256).alias("value_hash"), "o", "r")
    owners = named.select("value_hash", "o").distinct().groupBy("value_hash").agg(F.count("*").alias("n_owners"))
    places = named.select("value_hash", "r").distinct().groupBy("value_hash").agg(F.count("*").alias("n_repositories"))
    return owners.join(places, "value_hash")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", spread: int = SPREAD, wide: int = WIDE) -> DataFrame:
    """(doc_id, spans, n_live, n_example) of each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), candidates(text).alias("spans"))
    rows = persisted(rows, "spans")
    clean, dirty = rows.filter("size(spans) = 0"), rows.filter("size(spans) > 0")
    known = persisted(ownership(dirty, "owner", "repository"), "ownership")
    # equal rows are one row with a count, and are dealt out again at the end
    dirty = dirty.groupBy("doc_id", "spans").agg(F.count("*").alias("copies"))
    each = dirty.select("doc_id", "spans", "copies", F.explode("spans").alias("s")).withColumn("value_hash", F.sha2("s.value", 256))
    copied = (F.col("n_owners") >= spread) | (F.col("n_repositories") >= wide)
    judged = each.join(known, "value_hash").groupBy("doc_id", "spans", "copies").agg(
        F.count_if(~copied).alias("n_live"), F.count_if(copied).alias("n_example")
    )
    judged = judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    none = F.lit(0).cast("bigint")
    return judged.select("doc_id", "spans", "n_live", "n_example").unionByName(
        clean.select("doc_id", "spans", none.alias("n_live"), none.alias("n_example"))
    )


def op7_secret_ownership(spark, sf: str) -> DataFrame:
    """Secrets of every document, and how many of them look live."""
    found = scan(table(spark, sf, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    text = listed(F.col("spans"))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(text, 256).alias("base_sha256"),
        text.alias("spans"),
        "n_live",
        "n_example",
    )
