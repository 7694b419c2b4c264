"""Dense global row positions without a single-task window."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Fixed value: monotonically_increasing_id keeps the partition number above these bits.
ROW_BITS = 33
_MID = "_mid"


def free_name(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass(frozen=True)
class Positioned:
    """A table written in global order, with the first position of every written part.

    ``starts`` holds one number per partition, so it is bounded by the partition count.
    """

    df: DataFrame
    parts: tuple[int, ...]
    starts: tuple[int, ...]
    rows: int
    mid: str = _MID

    def with_position(self, out: str = "pos") -> DataFrame:
        """Add positions 0..n-1. The offset table has one row per partition."""
        columns = [f"`{c}`" for c in self.df.columns if c != self.mid]
        part, start = free_name("_part", self.df.columns), free_name("_start", self.df.columns)
        position = F.col(start) + F.col(self.mid).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
        offsets = self.df.sparkSession.createDataFrame(list(zip(self.parts, self.starts)), f"{part} bigint, {start} bigint")
        placed = self.df.withColumn(part, F.shiftright(self.mid, ROW_BITS)).join(F.broadcast(offsets), part)
        return placed.select(*columns, position.alias(out))

    def slice(self, low: int, high: int) -> DataFrame:
        """Rows at positions ``[low, high)``.

        The stored id grows with the position, so this is one range of it, found by binary search
        whatever the number of parts; it is sorted in every file, so Parquet statistics skip the row
        groups outside the slice.
        """
        low, high = max(low, 0), min(high, self.rows)
        if low >= high:
            return self.df.where(F.lit(False)).drop(self.mid)
        keep = F.col(self.mid) >= F.lit(self._id(low))
        if high < self.rows:
            keep = keep & (F.col(self.mid) < F.lit(self._id(high)))
        return self.df.where(keep).drop(self.mid)

    def _id(self, position: int) -> int:
        """The stored id of the row at a position."""
        k = bisect_right(self.starts, position) - 1
        return (self.parts[k] << ROW_BITS) + position - self.starts[k]


def position_rows(df: DataFrame, *order_by: str) -> Positioned:
    """Order ``df`` globally by ``order_by`` (which must identify rows) and number the rows.

    One range shuffle and one write: the in-partition index comes from
    ``monotonically_increasing_id`` of the sorted partition, so no second shuffle by
    partition number is needed. The table is written because range boundaries are sampled
    anew by every plan, and both uses must see the same layout.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    mid = free_name(_MID, df.columns)
    placed = materialise(ordered.withColumn(mid, F.monotonically_increasing_id()), "ordered")
    sizes = (
        placed.groupBy(F.shiftright(mid, ROW_BITS).alias("part"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("part")
        .collect()
    )
    ends = list(accumulate((r["n"] for r in sizes), initial=0))
    return Positioned(placed, tuple(r["part"] for r in sizes), tuple(ends[:-1]), ends[-1], mid)


def global_position(df: DataFrame, *order_by: str, out: str = "pos") -> DataFrame:
    """``df`` with dense positions in the order of ``order_by``."""
    return position_rows(df, *order_by).with_position(out)


def concat_by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Put two tables side by side by row position; the shorter one decides the length."""
    a = global_position(left, *left_order, out="pos")
    b = global_position(right, *right_order, out="pos")
    return a.join(b, "pos", "inner")
