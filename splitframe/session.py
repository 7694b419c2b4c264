"""Session helpers: a tuned local session and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def local_session(cores: str = "*", app: str = "splitframe", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local
    folder would be lost with the machine, so a missing setting is an error there.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="splitframe-")
    spark.sparkContext.setCheckpointDir(made)
    return made


@contextmanager
def writing_to(folder: str | None) -> Iterator[None]:
    """Have :func:`materialise` write into ``folder``, which all executors share; None changes nothing."""
    before = _folder.set(folder or _folder.get())
    try:
        yield
    finally:
        _folder.reset(before)


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, or that of :func:`writing_to`, and read it back.

    Cuts lineage and survives lost executors, unlike a cache; later readers get column
    pruning and row-group skipping. Values that depend on the physical layout (for example
    ``monotonically_increasing_id``) are frozen by it.
    """
    spark = df.sparkSession
    path = f"{_folder.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
