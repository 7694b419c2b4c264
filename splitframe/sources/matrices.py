"""Dense matrix files: whitespace-separated text and ``.npy``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NPY_ROWS = 65_536


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text with their number, in the order of file and line.

    A file block is read by one task from front to back, so a line's place in its block is its
    id less the block's smallest id; blocks are then stacked by (file, offset). The block table
    has one row per input split.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    blocks = lines.groupBy("_file", "_block").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts, before = [], 0
    for b in blocks.orderBy("_file", "_block").collect():
        starts.append((b["_file"], b["_block"], b["_first"], before))
        before += b["_n"]
    table = spark.createDataFrame(starts, "_file string, _block bigint, _first bigint, _start bigint")
    numbered = lines.join(F.broadcast(table), ["_file", "_block"])
    return numbered.select((F.col("_start") + F.col("_mid") - F.col("_first")).alias("row"), "value")


def scan_dense_matrix(spark: SparkSession, path: str, labels: str | None = None) -> DataFrame:
    """Matrix file, one row a line, as ``(row, x)`` with an array; optionally with labels.

    The label file has one label a line; both are joined on the line number.
    """
    words = F.split(F.trim("value"), r"\s+")
    numbers = F.transform(words, lambda w: w.cast("double"))
    matrix = scan_lines(spark, path).where(F.trim("value") != "").select("row", numbers.alias("x"))
    if labels is None:
        return matrix
    y = scan_lines(spark, labels).where(F.trim("value") != "").select("row", F.trim("value").cast("double").alias("y"))
    return matrix.join(y, "row")


def spread_columns(matrix: DataFrame, width: int, prefix: str = "x") -> DataFrame:
    """Array rows as ``width`` columns x0, x1, ..."""
    kept = [c for c in matrix.columns if c != "x"]
    return matrix.select(*kept, *[F.col("x")[j].alias(f"{prefix}{j}") for j in range(width)])


def scan_npy(spark: SparkSession, path: str, columns: list[str] | None = None, row: str = "row") -> DataFrame:
    """Rows of a two-dimensional ``.npy`` file on a file system all executors mount.

    The driver reads the header only; each task maps the file and copies its own row range.
    """
    shape = np.load(path, mmap_mode="r").shape
    rows, width = shape[0], (shape[1] if len(shape) > 1 else 1)
    names = columns or [f"x{j}" for j in range(width)]
    if len(names) != width:
        raise ValueError(f"{path} has {width} columns, not {len(names)}")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = np.load(path, mmap_mode="r").reshape(rows, width)
        for batch in batches:
            for start in batch["id"]:
                part = pd.DataFrame(np.asarray(data[start : start + NPY_ROWS], dtype=float), columns=names)
                part.insert(0, row, np.arange(start, start + len(part)))
                yield part

    schema = f"`{row}` bigint, " + ", ".join(f"`{n}` double" for n in names)
    return spark.range(0, rows, NPY_ROWS).mapInPandas(read, schema)
