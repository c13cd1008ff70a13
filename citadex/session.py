"""Session set-up and the few helpers that look at the session or at data sizes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex.settings import BROADCAST_LIMIT_BYTES

_LOCAL_FOLDERS: dict[str, str] = {}
_SCOPES: list[list[str]] = []
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "citadex", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; `conf` entries win over the defaults."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    Only a local master may run without the setting; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-citadex-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end whatever was staged inside; what must last is written to a path taken before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What a job inside has shuffled is deleted when that job ends, not when the driver collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write `df` once and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, label)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_alone(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Stage what `make` returns and delete what it staged on the way."""
    path = scratch_path(spark, label)
    with scratch_scope(spark):
        return staged(make(), label, path)


def measured_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes held by `columns` over all rows, measured by one aggregate (8 per fixed-width cell)."""
    types = dict(df.dtypes)
    cell = F.lit(0)
    for name in columns:
        kind = types[name]
        if kind == "string":
            size = F.octet_length(name)
        elif kind.startswith("array"):
            size = F.size(name) * 8
        else:
            size = F.lit(8)
        cell = cell + F.coalesce(size, F.lit(0)) + F.lit(16)
    return int(df.select(F.sum(cell.cast("long"))).first()[0] or 0)


def small_enough(n_bytes: int) -> bool:
    return n_bytes <= BROADCAST_LIMIT_BYTES


def broadcast_within(df: DataFrame, n_bytes: int | None) -> DataFrame:
    """Broadcast hint, given only when a known upper bound on the size is within the limit."""
    return F.broadcast(df) if n_bytes is not None and small_enough(n_bytes) else df


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores is spread over them; others stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
