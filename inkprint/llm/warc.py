"""WARC archives of pages, and their capture index by external merge.

Writing: a page is a record, its payload the page in UTF-8.  Of equal payloads
of at least ``SMALLEST`` bytes that of the smallest page_id is written whole,
the others as revisits that name it.  Records are rows of Spark's text sink
whose line end is the blank line that ends a WARC record, so the files are
plain WARC files, committed by Spark, on any file system Spark can write.

Reading: archives are read whole (each is kept small), split by their
Content-Length, and every file gives a capture run sorted by URL key and
timestamp.  Runs are cut into key ranges, and each range merges its slices of
all runs with a loser tree.  Ranges follow each other in key order, so the rows
in the order (range, place) are the global capture histories; the rows of one
URL, however many, may lie in several ranges.

A null html is empty; a null url is an empty key and comes first; a null
page_id is written as such and never named by a revisit unless no other copy
has an id.  Copies of the row that is the response are responses too.  Columns
other than page_id, url and html are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import table
from inkprint.runtime import persisted, scratch_dir

SMALLEST = 100
RECORDS_PER_FILE = 2_000
EOL = "\r\n"
INDEX = "run string, url_key string, ts string, page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))


def captured(page_id: Column) -> Column:
    """A capture date for pages that carry none: seconds from 2020 on, by id."""
    return F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10**8))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame) -> DataFrame:
    """One WARC record per page as (value)."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("bigint")})
    large = rows.filter(F.col("size") >= SMALLEST)
    # ids only; counts and minima are taken in every task before the shuffle
    first = large.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1")
    first = persisted(first.select(F.col("digest").alias("o_digest"), "original"), "originals")
    rows = rows.join(first, F.col("digest") == F.col("o_digest"), "left")
    revisit = (F.col("size") >= SMALLEST) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    clean = F.regexp_replace("url", r"[\x00-\x1F]", "")
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name(F.col("page_id")), F.lit(">"))),
        _header("WARC-Date", captured(F.col("page_id"))),
        _header("WARC-Target-URI", clean),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), name(F.col("original")), F.lit(">")))).otherwise(""),
        F.when(revisit, _header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        _header("Content-Length", F.octet_length(body).cast("string")),
        F.lit(EOL),
    )
    return rows.select(F.concat(head, body).alias("value"))


def write_archives(pages: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of at most ``per_file`` records each under ``path``, compressed."""
    made = records(pages).write.option("lineSep", EOL + EOL).option("maxRecordsPerFile", per_file)
    made.option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: pages of a site sort together."""
    try:
        parts = urlsplit(url.lower())
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}" if host else url.lower()


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of every record of an archive; anything else is an error."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:end].decode().split(EOL)[1:]
        head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        begin = end + 4
        stop = begin + int(head["content-length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has a wrong length")
        yield head, content[begin:stop]
        at = stop + 4


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives; those of one file are one sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        name = re.compile(r"<urn:page:(.*)>")
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for head, payload in parsed(gzip.decompress(content.as_py())):
                    full = head["warc-type"] == "response"
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    if full and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    url = head["warc-target-uri"]
                    refers = name.fullmatch(head["warc-refers-to"])[1] if "warc-refers-to" in head else None
                    page = name.fullmatch(head["warc-record-id"])[1]
                    rows.append((file, url_key(url), head["warc-date"], page, url, head["warc-type"], len(payload) if full else None, digest, refers))
                rows.sort(key=lambda r: (r[1], r[2], r[3]))
                kinds = [pa.int64() if k == "payload_bytes" else pa.string() for k in _NAMES]
                columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, INDEX)


class LoserTree:
    """Merges sorted sequences: inner nodes hold the loser of their match, so the
    next row costs one match per level."""

    def __init__(self, runs: list[Iterator[Any]], key: Callable[[Any], Any]) -> None:
        self._runs = [iter(r) for r in runs]
        self._key = key
        self._heads: list[Any] = [self._pull(i) for i in range(len(runs))]
        self._tree = [-1] * max(1, len(runs))
        for i in range(len(runs)):
            self._replay(i)

    def _pull(self, i: int) -> Any:
        row = next(self._runs[i], None)
        return None if row is None else (self._key(row), i, row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        return y is None if x is None or y is None else x[:2] < y[:2]

    def _replay(self, i: int) -> None:
        winner, node = i, (i + len(self._runs)) // 2
        while node:
            held = self._tree[node]
            if held < 0:  # the first to come waits for the other side
                self._tree[node] = winner
                return
            if self._before(held, winner):
                self._tree[node], winner = winner, held
            node //= 2
        self._tree[0] = winner

    def __iter__(self) -> Iterator[Any]:
        while self._heads and self._heads[self._tree[0]] is not None:
            i = self._tree[0]
            yield self._heads[i][2]
            self._heads[i] = self._pull(i)
            self._replay(i)


def merged(runs: DataFrame) -> DataFrame:
    """``runs`` (columns run, url_key, ts, page_id and others) in key order, with
    ``key_range`` and the ``place`` in it: each range merges its slices of all runs."""
    order = ["url_key", "ts", "page_id"]
    schema = pa.schema([(f.name, pa.int64() if f.dataType.simpleString() == "bigint" else pa.string()) for f in runs.schema])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slices: dict[str, list[tuple]] = {}  # a range holds a partition's rows, not more
        names: list[str] = []
        for batch in batches:
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slices.setdefault(row[names.index("run")], []).append(row)
        if not slices:
            return
        at = [names.index(c) for c in order]
        part = TaskContext.get().partitionId()
        tree = LoserTree([iter(s) for s in slices.values()], lambda r: tuple(r[i] for i in at))
        rows: list[tuple] = []
        place = 0
        for row in tree:
            rows.append(row)
            place += 1
            if len(rows) == 10_000:
                yield _rows(rows, schema, part, place)
                rows = []
        if rows:
            yield _rows(rows, schema, part, place)

    cut = runs.repartitionByRange(*order).sortWithinPartitions("run", *order)  # the slices as their runs have them
    return cut.mapInArrow(run, f"{kinds}, key_range int, place bigint")


def _rows(rows: list[tuple], schema: pa.Schema, part: int, place: int) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    columns += [pa.array([part] * len(rows), pa.int32()), pa.array(range(place - len(rows), place), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[*schema.names, "key_range", "place"])


def resolved(captures: DataFrame) -> DataFrame:
    """Revisits with the payload size of the response they refer to."""
    revisits, whole = captures.filter("record_type = 'revisit'"), captures.filter("record_type = 'response'")
    sizes = whole.groupBy(F.col("payload_digest").alias("r_digest"), F.col("page_id").alias("r_page")).agg(F.max("payload_bytes").alias("r_bytes"))
    same = (F.col("payload_digest") == F.col("r_digest")) & (F.col("refers_to") == F.col("r_page"))
    found = revisits.join(sizes, same, "left").withColumn("payload_bytes", F.col("r_bytes"))
    missing = F.raise_error(F.concat(F.lit("no response for revisit "), F.col("page_id"))).cast("bigint")
    found = found.withColumn("payload_bytes", F.coalesce("payload_bytes", missing))
    return whole.unionByName(found.select(captures.columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of ``pages``, written to the shared folder, read back and indexed."""
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/inkprint/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return merged(resolved(persisted(capture_runs(spark, path), "captures")))


def op10_warc_index_merge(spark, sf: str) -> DataFrame:
    """Every page as its archive has it, in the order of the capture index."""
    number = lambda c: F.when(F.col(c) != "null", F.col(c).cast("bigint"))
    return round_trip(table(spark, sf, "pages")).select(
        number("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"),
        "url_key", "ts", "key_range", "place",
    )
