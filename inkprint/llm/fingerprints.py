"""Merkle fingerprints of documents, in built-in functions only.

The tree has four levels.  A *leaf* is a run of words of a paragraph that ends
with a word whose hash says so (about every fourth), a *paragraph* is a line, a
*section* is a run of paragraphs that ends where a paragraph's digest says so
(about every fourth): every border depends on what stands at it, so an edit moves none but
near it.  A leaf's digest is over its text, a paragraph's over its leaves'
digests, a section's over its paragraphs' and the root's over the sections'.  Equal roots
mean equal texts; unequal ones are told apart by the differing branches.

A fingerprint is written ``root:sections:paragraphs:leaves`` with short digests of the
branches, so two fingerprints are compared without the texts: their likeness is
the share of common ones among their distinct leaves and roots, 1 for equal texts only.  Null and
empty texts have one empty paragraph without leaves.  Only ``doc_id`` and ``text`` are read.
Repeated rows stay; rows with one doc_id follow each other by text, and null
ids come first.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.common import table
from inkprint.runtime import persisted

#: What leaves are made of: a word with the blanks after it, or one character of scripts written without blanks.
UNIT = r"[^\x20\n\u3000-\uffff]{1,32}\x20*|[^\n]"
#: A leaf ends after a unit whose hash has these bits all 0.
LEAF_BITS = 3
#: A section ends after a paragraph whose digest begins with one of these.
BORDERS = ("0", "1", "2", "3")
#: Hexadecimal digits of a leaf, and of a paragraph or section, in a written fingerprint.
LEAF_DIGITS, DIGITS = 8, 16


def leaf_digests(paragraph: Column) -> Column:
    """Digests of the leaves of a paragraph.  Paragraphs have no line break, so one can stand for a border."""
    units = F.regexp_extract_all(paragraph, F.lit(f"({UNIT})"), F.lit(0))
    marked = F.transform(units, lambda u: F.when(F.xxhash64(u).bitwiseAND(F.lit(LEAF_BITS)) == 0, F.concat(u, F.lit("\n"))).otherwise(u))
    leaves = F.filter(F.split(F.array_join(marked, ""), "\n", -1), lambda x: x != "")
    return F.transform(leaves, lambda x: F.sha2(x, 256))


def paragraph_digests(leaves: Column) -> Column:
    return F.transform(leaves, lambda x: F.sha2(F.array_join(x, ""), 256))


def section_ends(paragraphs: Column) -> tuple[Column, Column]:
    """How many paragraphs stand before each section, and up to its end."""
    n = F.size(paragraphs)
    ends = F.filter(
        F.sequence(F.lit(1), n), lambda i: (i == n) | F.substring(F.element_at(paragraphs, i), 1, 1).isin(*BORDERS)
    )
    return F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), ends


def section_digests(paragraphs: Column) -> Column:
    """Digests of the runs of paragraphs up to and with each border."""
    begins, ends = section_ends(paragraphs)
    return F.transform(
        F.arrays_zip(begins.alias("b"), ends.alias("e")),
        lambda x: F.sha2(F.concat_ws("", F.slice(paragraphs, x["b"] + 1, x["e"] - x["b"])), 256),
    )


def with_tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}leaves`` (of each paragraph), ``{prefix}paragraphs``, ``{prefix}sections`` and ``{prefix}root``."""
    df = df.withColumn(f"{prefix}leaves", F.transform(F.split(F.col(text), "\n", -1), leaf_digests))
    df = df.withColumn(f"{prefix}paragraphs", paragraph_digests(F.col(f"{prefix}leaves")))
    df = df.withColumn(f"{prefix}sections", section_digests(F.col(f"{prefix}paragraphs")))
    return df.withColumn(f"{prefix}root", F.sha2(F.concat_ws("", f"{prefix}sections"), 256))


def written(prefix: str = "") -> Column:
    """A tree as one string: the root, then short digests of every section, paragraph and
    leaf, those of different paragraphs with commas between them."""
    short = lambda digests, n: F.array_join(F.transform(digests, lambda d: F.substring(d, 1, n)), "")
    leaves = F.array_join(F.transform(F.col(f"{prefix}leaves"), lambda x: short(x, LEAF_DIGITS)), ",")
    upper = [short(F.col(f"{prefix}{name}"), DIGITS) for name in ("sections", "paragraphs")]
    return F.concat_ws(":", F.col(f"{prefix}root"), *upper, leaves)


def branches(fingerprint: str) -> Column:
    """The distinct leaves of a written fingerprint, and its root."""
    leaves = F.regexp_extract_all(F.substring_index(fingerprint, ":", -1), F.lit(f"[0-9a-f]{{{LEAF_DIGITS}}}"), F.lit(0))
    return F.array_distinct(F.concat(F.array(F.substring_index(fingerprint, ":", 1)), leaves))


def likeness(a: str, b: str) -> Column:
    """Common branches among all branches of two columns of :func:`branches`."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _open(a: str, b: str) -> Column:
    """(i, d, before) of the paragraphs of tree ``a`` below sections that tree ``b`` has
    not got, and of the end of the text: number, digest and the digest before."""
    own = F.col(f"{a}paragraphs")
    begins, ends = section_ends(own)
    new = F.array_except(F.col(f"{a}sections"), F.col(f"{b}sections"))
    runs = F.arrays_zip(begins.alias("b"), ends.alias("e"), F.col(f"{a}sections").alias("s"))
    place = lambda i: F.struct(
        i.alias("i"), F.coalesce(F.get(own, i), F.lit("")).alias("d"), F.coalesce(F.get(own, i - 1), F.lit("")).alias("before")
    )
    below = F.transform(F.filter(runs, lambda r: F.array_contains(new, r["s"])), lambda r: F.transform(F.sequence(r["b"], r["e"] - 1), place))
    return F.concat(F.flatten(below), F.array(place(F.size(own))))


def differing(a: str, b: str) -> Column:
    """Numbers (from 0) of the paragraphs of tree ``a`` that differ from tree ``b``.

    Sections are compared first, and only paragraphs below differing ones are read.  Among
    those differ the ones that tree ``b`` has not got there, and those that follow another
    known paragraph than there: a moved or repeated paragraph, or the first after a deletion (the number of
    paragraphs where the end of the text was deleted)."""
    mine, theirs = _open(a, b), _open(b, a)
    pair = lambda x: F.concat(x["before"], F.lit("/"), x["d"])
    missing = F.array_except(F.transform(mine, lambda x: x["d"]), F.transform(theirs, lambda x: x["d"]))
    moved = F.array_except(F.transform(mine, pair), F.transform(theirs, pair))
    found = F.filter(
        mine, lambda x: F.array_contains(missing, x["d"]) | (F.array_contains(moved, pair(x)) & ~F.array_contains(missing, x["before"]))
    )
    return F.when(F.col(f"{a}root") == F.col(f"{b}root"), F.array().cast("array<int>")).otherwise(F.transform(found, lambda x: x["i"]))


def block_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``, found in two steps
    of about the square root of their number each."""
    wide = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    longs = lambda values: F.array(*[F.lit(c) for c in values]).cast("array<bigint>")
    up_to = lambda values: F.size(F.filter(values, lambda c: c <= key))
    whole = F.greatest(up_to(longs(g[0] for g in groups)) - 1, F.lit(0))
    nested = F.array(*[longs(g) for g in groups]) if groups else F.array(longs([]))
    return whole * wide + up_to(F.get(nested, whole))


def with_next(docs: DataFrame, rows_per_block: int = 20_000, bytes_per_block: int = 1 << 25, most: int = 32_768) -> DataFrame:
    """(doc_id, text, next): each row with the text of the row after it by
    (doc_id, text), the last with that of the first.

    Ids are cut into blocks of about ``rows_per_block`` rows or ``bytes_per_block`` bytes on
    average, whichever is less, by quantiles (at most ``most`` blocks); a window runs inside a block, and only the first row
    of each block crosses to the block before, so no task sees more than one."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    whole = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    parts = min(most, max(1, -(-whole.n // rows_per_block), -(-whole.size // bytes_per_block)))
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    dealt = docs.withColumn("block", block_of(key, sorted(set(cuts or []))))
    around = Window.orderBy("block")  # over one row a block, without texts
    least = dealt.groupBy("block").agg(F.min(key).alias("least"))
    least = least.withColumn("before", F.coalesce(F.lag("block").over(around), F.max("block").over(Window.partitionBy())))
    firsts = dealt.join(F.broadcast(persisted(least, "least")), "block").filter(key == F.col("least"))
    heads = persisted(firsts.groupBy(F.col("before").alias("block")).agg(F.min("text").alias("first")), "heads")
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    inside = dealt.withColumn("next", F.lead("text").over(order))
    return inside.join(heads, "block", "left").select("doc_id", "text", F.coalesce("next", "first").alias("next"))


def edited(text: Column, following: Column) -> Column:
    """``text`` whose last half is replaced by as many first characters of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text, and how alike they are."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(rows).withColumnRenamed("next", "next_text")
    pairs = pairs.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    trees = with_tree(with_tree(with_tree(pairs, "text"), "edited_text", "edited_"), "next_text", "next_")
    trees = trees.withColumns({"fingerprint": written(), "edited_fingerprint": written("edited_"), "next_fingerprint": written("next_")})
    trees = trees.withColumns({f"b_{name}": branches(name) for name in ("fingerprint", "edited_fingerprint", "next_fingerprint")})
    return trees.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("b_fingerprint", "b_edited_fingerprint").alias("near_edited"),
        likeness("b_fingerprint", "b_next_fingerprint").alias("near_next"),
        F.size("paragraphs").alias("n_paragraphs"),
        F.size("sections").alias("n_sections"),
        F.size(F.array_except("edited_paragraphs", "paragraphs")).alias("n_edited_paragraphs"),
    )


def op1_merkle_fingerprints(spark, sf: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf, "documents"))
