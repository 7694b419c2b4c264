"""Projections, filters, splits and label coding."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import digest_word, keyed_digest
from ..spec import COMPANY, LABEL, PARTNER
from .position import Positioned, position_rows

# Rows of a sample that are merged at one place; larger samples are cut off by a threshold.
TOP_ROWS = 10_000
# Fixed value: numbers that 32 bits of a digest take.
WORDS = 2**32


def find_label_party(company: DataFrame, partner: DataFrame, label: str = LABEL) -> str:
    """Name of the party whose table has the label; company first. Reads schemas only."""
    if label in company.columns:
        return COMPANY
    if label in partner.columns:
        return PARTNER
    raise ValueError(f"no party holds the label column {label!r}")


def split_x_y(df: DataFrame, label: str = LABEL, keep: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Features and label as two tables; ``keep`` names id columns that go into both."""
    keep = list(keep)
    return df.drop(label), df.select(*keep, label)


def project_label_columns(df: DataFrame, id: str = "id", label: str = LABEL) -> DataFrame:
    """Drop the id and the label and keep the features."""
    return df.drop(id, label)


def merged_columns(company: list[str], partner: list[str], id: str = "id") -> list[tuple[str, str, str]]:
    """``(party, column, output name)`` in output order: company's columns, then partner's.

    A name used by both parties gets the party as a prefix on both sides.
    """
    c = [x for x in company if x != id]
    p = [x for x in partner if x != id]
    both = set(c) & set(p)
    pick = lambda party, x: (party, x, f"{party}_{x}" if x in both else x)
    return [pick(COMPANY, x) for x in c] + [pick(PARTNER, x) for x in p]


def merge_headers(company: DataFrame, partner: DataFrame, id: str = "id", label: str = LABEL) -> tuple[list[str], int]:
    """Column names of the aligned table without the id, and the label's place in it."""
    names = [out for _, _, out in merged_columns(company.columns, partner.columns, id)]
    return names, names.index(label)


def vertical_split(df: DataFrame, id: str, columns: list[str], split_index: int) -> tuple[DataFrame, DataFrame]:
    """First ``split_index`` columns to company, the rest to partner, both with the id."""
    return df.select(id, *columns[:split_index]), df.select(id, *columns[split_index:])


def train_rows(rows: int, test_size: float = 0.25) -> int:
    """Rows of the train part: the test part is rounded up."""
    return rows - math.ceil(rows * test_size)


def ordered_train_test_split(df: DataFrame, *order_by: str, test_size: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """First rows train, last rows test, in the order of ``order_by``."""
    placed = position_rows(df, *order_by)
    cut = train_rows(placed.rows, test_size)
    return placed.slice(0, cut), placed.slice(cut, placed.rows)


def hashed_train_test_split(df: DataFrame, id: str, seed: str | int, test_size: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Shuffled split, repeatable: a row's side depends on its id and the seed only."""
    held_out = digest_word(keyed_digest(seed, id)) < F.lit(round(test_size * WORDS))
    return df.where(~held_out), df.where(held_out)


def recode_label_01(y: Column) -> Column:
    """-1 becomes 0, other labels stay."""
    return F.when(y == -1, F.lit(0).cast("double")).otherwise(y)


def recode_label_pm1(y: Column) -> Column:
    """0 becomes -1, other labels stay."""
    return F.when(y == 0, F.lit(-1).cast("double")).otherwise(y)


def label_classes(df: DataFrame, label: str = LABEL, most: int | None = None) -> list:
    """Sorted classes of a label column on the driver; more than ``most`` are an error."""
    found = df.select(label).where(F.col(label).isNotNull()).distinct()
    rows = (found if most is None else found.limit(most + 1)).collect()
    if most is not None and len(rows) > most:
        raise ValueError(f"{label!r} has more than {most} classes")
    return sorted(r[0] for r in rows)


def one_hot(y: Column, classes: list, off: float = 0.0) -> Column:
    """Indicator vector over ``classes``; ``off=-1`` gives the coding of one-vs-rest SVMs."""
    return F.array(*[F.when(y == F.lit(c), F.lit(1.0)).otherwise(F.lit(float(off))) for c in classes])


def class_index(df: DataFrame, label: str = LABEL) -> tuple[DataFrame, int]:
    """Table of distinct labels with their place in sorted order, and their number. Nulls are no class."""
    labels = df.select(F.col(label).alias("label")).where(F.col(label).isNotNull()).distinct()
    placed = position_rows(labels, "label")
    return placed.with_position("at"), placed.rows


def one_hot_label(df: DataFrame, label: str = LABEL, classes: list | None = None, out: str = "y_vec", sparse: bool = False) -> DataFrame:
    """Integer class to indicator vector over the sorted classes of the data, unless they are given.

    Any number of classes: a row finds the place of its class by a join, which is a broadcast as
    long as the classes are few. ``sparse`` gives struct(size, at) instead of an array, which is
    what to ask for with many classes; rows without a label have a null place or only zeros.
    """
    if classes is not None and not sparse:
        return df.withColumn(out, one_hot(F.col(label), classes))
    if classes is not None:
        rows = [(c, i) for i, c in enumerate(classes)]
        index, size = df.sparkSession.createDataFrame(rows, f"label {df.schema[label].dataType.simpleString()}, at bigint"), len(rows)
    else:
        index, size = class_index(df, label)
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("given"), F.col(label).alias("label"))
    found = given.join(index, "label", "left")
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == F.col("at"), 1.0).otherwise(0.0))
    vector = F.struct(F.lit(size).cast("bigint").alias("size"), "at") if sparse else dense if size else F.array().cast("array<double>")
    kept = [F.col(f"given.`{c}`").alias(c) for c in df.columns if c != out]
    return found.select("given", vector.alias("vector")).select(*kept, F.col("vector").alias(out))


def batch_assign(df: DataFrame, *order_by: str, batch_size: int = 64, out: str = "batch") -> DataFrame:
    """Number contiguous mini-batches in row order; the last one may be short."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    placed = position_rows(df, *order_by).with_position("_pos")
    return placed.withColumn(out, F.floor(F.col("_pos") / F.lit(batch_size))).drop("_pos")


def iter_batches(placed: Positioned, batch_size: int) -> Iterable[DataFrame]:
    """The mini-batches of a positioned table as filtered tables."""
    for low in range(0, placed.rows, batch_size):
        yield placed.slice(low, min(low + batch_size, placed.rows))


def sample_batch(df: DataFrame, id: str, seed: str | int, step: int, size: int = 64, top_rows: int = TOP_ROWS) -> DataFrame:
    """``size`` rows without replacement, drawn anew for each step and repeatable.

    The rows whose keyed digests come first. A small sample is the top of a sort that tasks cut
    off; for a large one two counting passes find the digest word up to which rows belong, and a
    filter takes them where they are. Only rows of that very word are merged.
    """
    draw = keyed_digest(seed, F.lit(step), F.col(id))
    if size <= top_rows:
        return df.orderBy(draw, F.col(id)).limit(size)
    word = digest_word(draw)
    high = _crossing(df.select(F.shiftright(word, 16).alias("b")), size)
    if high is None:
        return df
    part, before = high
    low = _crossing(df.where(F.shiftright(word, 16) == part).select(word.bitwiseAND(F.lit(0xFFFF)).alias("b")), size - before)
    last, more = (part << 16) + low[0], before + low[1]
    return df.where(word < last).unionAll(df.where(word == last).orderBy(draw, F.col(id)).limit(size - more))


def _crossing(buckets: DataFrame, size: int) -> tuple[int, int] | None:
    """The bucket (of at most 65,536) in which the ``size``-th row lies, and the rows before it."""
    before = 0
    for r in buckets.groupBy("b").count().orderBy("b").collect():
        if before + r["count"] >= size:
            return r["b"], before
        before += r["count"]
    return None


def party_sample(df: DataFrame, id: str, seed: str | int, party: str, share: float = 0.9) -> DataFrame:
    """About ``share`` of the rows, drawn separately for each party."""
    return df.where(digest_word(keyed_digest(seed, F.lit(party), F.col(id))) < F.lit(round(share * WORDS)))


def random_reorder(df: DataFrame, seed: str | int, *row_key: str) -> DataFrame:
    """Random permutation of the rows, as a sort by keyed hash."""
    return df.orderBy(keyed_digest(seed, *row_key), *row_key)


def party_apply(df: DataFrame, fn: Callable, schema: str | None = None, num_returns: int = 1):
    """Run a function on one party's table.

    Without ``schema`` the function maps DataFrame to DataFrame (or to ``num_returns`` of
    them) and stays in the plan. With ``schema`` it gets pandas batches, one at a time.
    """
    if schema is not None:
        return df.mapInPandas(lambda batches: (fn(b) for b in batches), schema)
    if num_returns == 1:
        return df.transform(fn)
    out = tuple(fn(df))
    if len(out) != num_returns:
        raise ValueError(f"expected {num_returns} results, got {len(out)}")
    return out


def stack_rows(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, matched by column name, duplicates kept."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
