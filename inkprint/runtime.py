"""Session set-up, fitted-table storage, and rank / prefix-sum helpers that
never funnel a whole table through one task."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName("inkprint")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session.

    Sends a few kilobytes of code once per application; harmless where the
    package is installed on the workers or was given with ``--py-files``."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="inkprint-code-")) / "inkprint.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for fitted tables: the session's ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a machine-local folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="inkprint-")
    return _LOCAL_SCRATCH[app]


def persisted(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used at fit steps.  The lineage ends there, so a lost executor re-reads
    files instead of repeating the fit, and later joins are planned with the
    table's real size: Catalyst broadcasts it only if it is under the session's
    broadcast threshold and otherwise shuffles both sides."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/inkprint/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._inkprint_path = path
    return stored


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: each action's are deleted as it ends,
    where Spark would keep them until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(stored: DataFrame) -> None:
    """Delete the files of a table that :func:`persisted` gave, once nothing
    reads it any more."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored._inkprint_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one split per core.

    A large scan already has more splits than cores and is left alone, so bulk
    text is never shuffled just to be read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2)


def allow_group_limit(spark: SparkSession, limit: int) -> None:
    """Let Spark cut each group to ``limit`` rows inside every map task before
    the shuffle.  It does so only up to this threshold (default 1000); results
    are the same either way, but a hot group is then never shuffled whole."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    current = int(spark.conf.get(key, "1000"))
    if current != -1 and current < limit:
        spark.conf.set(key, str(limit))


def small_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Let Spark hand at most ``rows`` rows, of about ``size`` bytes, to Python at once
    (default 10,000 rows of any size).  Results are the same either way, but what a
    worker holds no longer grows with the texts of a task."""
    for key, limit in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        current = spark.conf.get(key, None) or ""
        if not (current.isdigit() and 0 < int(current) <= limit):
            spark.conf.set(key, str(limit))


def first_seen(df: DataFrame, pid: str = "pid", pos: str = "pos") -> Column:
    """The least (pid, pos) of a group, as one fixed-width number ordered like the pair.

    ``min`` over a struct forces a sort-based aggregate; over this number it
    stays a hash aggregate.  ``pos`` is a string offset, so it is below 2^31.  Only pids that
    would not fit beside it in 63 bits are counted as decimals, which cost far more a row."""
    kind = df.schema[pid].dataType
    key = lambda wide: wide * F.lit(2**31) + F.col(pos)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.min(key(F.col(pid).cast("bigint")))
    decimal = key(F.col(pid).cast("decimal(20,0)"))
    if not isinstance(kind, T.LongType):
        return F.min(decimal)
    fits = F.col(pid).between(0, 2**32 - 1)
    return F.least(F.min(F.when(fits, key(F.col(pid)))), F.min(F.when(~fits, decimal)))


def first_pid(key: Column) -> Column:
    """The ``pid`` part of :func:`first_seen`."""
    return ((key - F.pmod(key, F.lit(2**31))) / F.lit(2**31)).cast("bigint")


def ranked(df: DataFrame, order: list[Column], group: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """0-based position of every row in ``order`` (a total order), per group.

    The rows are range-partitioned and sorted once; a row's rank is its place
    in its partition plus the number of rows of its group in earlier
    partitions.  Only that small per-partition count table is ever windowed, so
    neither a global order nor a hot group goes through a single task."""
    keys = [F.col(g) for g in group] + list(order)
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mono", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mono", 33))
        .withColumn("_at", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mono")
    )
    placed = persisted(placed, "ranked")
    starts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = starts.select(
        *group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start")).alias("_shift")
    )
    return (
        placed.join(shifts, [*group, "_part"])
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_at", "_part", "_shift")
    )


def running_sums(df: DataFrame, index: str, values: list[str], chunk: int = 4096) -> DataFrame:
    """Inclusive prefix sums of ``values`` in the order of the dense 0-based
    integer column ``index``, by chunk totals plus sums inside each chunk."""
    placed = df.withColumn("_chunk", F.floor(F.col(index) / chunk))
    totals = placed.groupBy("_chunk").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_chunk", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    inside = Window.partitionBy("_chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(offsets, "_chunk")
        .select("*", *[(F.sum(v).over(inside) + F.col(f"_o_{v}")).alias(f"run_{v}") for v in values])
        .drop("_chunk", *[f"_o_{v}" for v in values])
    )
