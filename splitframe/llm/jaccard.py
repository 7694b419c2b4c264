"""Jaccard join of documents on word n-grams, over prefixes of a sparse matrix's rows.

The matrix has a row for each distinct set of shingles and a column for each shingle. Columns are
in one order for all rows: rare before frequent, long before short. A pair can only reach the
similarity if its first common column lies in the prefix of both rows that their sizes allow, so
only these prefixes are joined; pairs whose sizes, places or counts by column block bound the
overlap too low are discarded, and the full rows of the others are intersected.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.position import free_name
from ..session import materialise
from .common import Vocabulary, mixed, unit
from .components import components

#: Columns that so many rows share go last, if there are not more than ``LAST`` of them.
FREQUENT, LAST = 8, 200_000
#: Column blocks: where the counts of two rows differ in parity, a column is in one of them only.
BLOCKS = 512
#: Ids broadcast at most (some 100 bytes each once hashed); beyond, tables are shuffled instead.
BROADCAST_IDS = 500_000
#: Shingles (eight bytes each) of compared rows broadcast at most.
BROADCAST_GRAMS = 2_000_000
#: Rows of a list that all of its rows meet.
HEADS = 16
#: Columns before an entry that tell whether two rows have met already.
EARLIER = 16


def shingles(text: bytes, words: Vocabulary, k: int) -> np.ndarray:
    """Sorted distinct shingles of ``k`` lower-cased words; fewer words are one shingle.

    The upper eight bits fall with a shingle's length, so long ones, which are rare, come first;
    the rest is a hash.
    """
    numbers = words.numbers(text.lower().split())
    if not len(numbers):
        return np.empty(0, np.uint64)
    hashes, lengths = words.hashes[numbers], words.lengths[numbers]
    width = min(k, len(numbers))
    stop = len(numbers) - width + 1
    grams, size = hashes[:stop], lengths[:stop]
    for j in range(1, width):
        grams, size = mixed(grams, hashes[j : stop + j]), size + lengths[j : stop + j]
    if width < k:
        grams = mixed(grams, np.full(stop, width, np.uint64))
    rank = (255 - np.minimum(size, 255)).astype(np.uint64) << np.uint64(56)
    return np.unique(rank | (grams >> np.uint64(8)))


def prefix_size(n: int, percent: int) -> int:
    """Columns of a row of ``n`` of which one is common with any similar row."""
    return n - (percent * n + 99) // 100 + 1


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    """Lists of uint64 as an Arrow list of longs."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _leading(k: int, percent: int):
    """The first columns of each row in the order without counts: a little more than its prefix."""

    def zones(batches):
        words = Vocabulary()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                out = []
                for x in batch.column(0)[start : start + 2000]:
                    grams = shingles(x.as_py(), words, k)
                    out.append(grams[: prefix_size(len(grams), percent) * 5 // 4 + 8])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["gram"])

    return zones


def _rows(k: int, percent: int, last: np.ndarray):
    """Size, identity, block parities and prefix of each row; frequent columns come last."""

    def rows(batches):
        words = Vocabulary()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sizes, digests, parities, prefixes = [], [], [], []
                for x in part.column(2):
                    grams = shingles(x.as_py(), words, k)
                    n = len(grams)
                    p = prefix_size(n, percent) if n else 0
                    if len(last) and n:
                        frequent = last[np.minimum(np.searchsorted(last, grams), len(last) - 1)] == grams
                        first = grams[~frequent][:p]
                        prefix = np.concatenate([first, grams[frequent][: p - len(first)]])
                    else:
                        prefix = grams[:p]
                    sizes.append(n)
                    digests.append(blake2b(grams.tobytes(), digest_size=16).digest())
                    counts = np.bincount((grams & np.uint64(BLOCKS - 1)).astype(np.int64), minlength=BLOCKS)
                    parities.append(np.packbits((counts & 1).astype(np.uint8)).view(np.uint64))
                    prefixes.append(prefix)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        _longs(parities),
                        _longs(prefixes),
                    ],
                    names=["row", "id", "n", "digest", "parity", "prefix"],
                )

    return rows


def _sets(k: int):
    def sets(batches):
        words = Vocabulary()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                grams = [shingles(x.as_py(), words, k) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), _longs(grams)], names=["node", "grams"])

    return sets


def _few(ids: DataFrame) -> DataFrame:
    """Broadcast a written table of ids if it is small, else leave the join to Spark."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def frequent_columns(texts: DataFrame, k: int, percent: int) -> np.ndarray:
    """Columns that stand early in many rows, ``LAST`` at most.

    Counts cover all rows. The set only decides the order of columns, which may be any; if more
    than ``LAST`` pass the threshold it is doubled until they fit.
    """
    counts = texts.select("text").mapInArrow(_leading(k, percent), "gram bigint").groupBy("gram").count().where(F.col("count") >= FREQUENT)
    counts = materialise(counts, "frequent")
    floor = F.floor(F.log2("count")).cast("int")
    by = {r[0]: r[1] for r in counts.groupBy(floor.alias("f")).count().collect()}
    least, held = 64, 0  # counts are below 2**64
    for f in sorted(by, reverse=True):
        held += by[f]
        if held > LAST:
            break
        least = f
    chosen = counts.where(floor >= least).select("gram").toPandas()["gram"].to_numpy(np.int64)
    return np.sort(chosen.view(np.uint64))


def _overlap_needed(percent: int, a: Column, b: Column) -> Column:
    """Times 100 + percent: the overlap that two sizes need."""
    return F.lit(percent) * (a + b)


def _differ_little(percent: int, na: str, a: str, nb: str, b: str) -> Column:
    """Whether the parities allow the similarity: each one that differs is a column of one row only."""
    apart = F.lit(0)
    for i in range(BLOCKS // 64):
        apart = apart + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    both = F.col(na) + F.col(nb)
    return (both - apart) * F.lit(100 + percent) >= F.lit(2 * percent) * both


def _verified(pairs: DataFrame, texts: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full rows reach the similarity."""
    light = rows.select("row", "n", "parity")
    bounded = (
        pairs.join(light.toDF("a", "na", "ca"), "a")
        .join(light.toDF("b", "nb", "cb"), "b")
        .where(_differ_little(percent, "na", "ca", "nb", "cb"))
        .select("a", "b", "na", "nb")
    )
    bounded = materialise(bounded, "bounded")
    nodes = materialise(bounded.select(F.col("a").alias("node")).unionByName(bounded.select(F.col("b").alias("node"))).distinct(), "nodes")
    wanted = texts.select(F.col("row").alias("node"), "text").join(_few(nodes), "node", "left_semi")
    sets = materialise(wanted.mapInArrow(_sets(k), "node bigint, grams array<bigint>"), "sets")
    size = sets.agg(F.sum(F.size("grams"))).first()[0] or 0
    sets = F.broadcast(sets) if size <= BROADCAST_GRAMS else sets
    common = F.size(F.array_intersect("ga", "gb"))
    return (
        bounded.join(sets.toDF("a", "ga"), "a")
        .join(sets.toDF("b", "gb"), "b")
        .where(common * F.lit(100 + percent) >= _overlap_needed(percent, F.col("na"), F.col("nb")))
        .select("a", "b")
    )


def _shared(rows: DataFrame) -> DataFrame:
    """(gram, node, n, pos, c, parity) of the prefixes' columns that c > 1 rows have.

    Counted with map-side sums and joined with what is left, so that a column that very many rows
    have is never gathered.
    """
    entries = rows.select(F.col("row").alias("node"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "gram"))
    many = materialise(entries.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "many")
    held = materialise(entries.join(many, "gram").select("gram", "node", "n", "pos", "c"), "held")
    return materialise(held.join(rows.select(F.col("row").alias("node"), "parity"), "node").select("gram", "node", "n", "pos", "c", "parity"), "shared")


def _near(percent: int, na: str, pa_: str, nb: str, pb: str) -> Column:
    """What sizes and the places of a first common column allow; ``na <= nb``."""
    need = _overlap_needed(percent, F.col(na), F.col(nb))
    left = F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
    return (F.lit(100) * F.col(na) >= F.lit(percent) * F.col(nb)) & (left * F.lit(100 + percent) >= need)


def _meetings(x: DataFrame, y: DataFrame, percent: int, apart: Column) -> DataFrame:
    """Pairs (a, b) of the entries x (.., a) and y (.., b) of the same lists that may link, once a list.

    Entries with ``ea`` and ``eb``, the columns before them, leave out pairs that have one of these in
    common: they meet in that list, so what is left is their first common column and few others.
    """
    first = (F.col("na") < F.col("nb")) & _near(percent, "na", "pa", "nb", "pb") | (F.col("na") >= F.col("nb")) & _near(percent, "nb", "pb", "na", "pa")
    near = apart & first & _differ_little(percent, "na", "ca", "nb", "cb")
    if "ea" in x.columns:
        near = near & ~F.arrays_overlap("ea", "eb")
    return x.join(y, "gram").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _with_earlier(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """``entries`` with the ``EARLIER`` columns of a row's prefix that stand before each."""
    nodes = materialise(entries.select("node").distinct(), "open-nodes")
    prefixes = rows.select(F.col("row").alias("node"), "prefix").join(_few(nodes), "node", "left_semi")
    earlier = F.slice("prefix", F.greatest(F.col("pos") - EARLIER, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(EARLIER)))
    return entries.join(prefixes, "node").select(*entries.columns, earlier.alias("earlier"))


def link_classes(texts: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of rows (one for each distinct set) that links join.

    First the rows of each column's list meet about ``HEADS`` of them, chosen by a hash: all of them
    in short lists. Near copies of one text mostly become one component that way, by pairs that grow
    with the rows. Then rows of longer lists that are still in different components meet each
    other, at their first common column: if its list is short they have met before, and in later
    lists they need not meet again. Components lose no link between them.
    """
    shared = _shared(rows)
    heads = shared.where(unit(F.lit(17), "node") * F.col("c") < HEADS)
    x = shared.select("gram", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("parity").alias("ca"))
    y = heads.select("gram", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("parity").alias("cb"))
    star = materialise(_meetings(x, y, percent, F.col("a") != F.col("b")).distinct(), "star")
    links = materialise(_verified(star, texts, rows, k, percent), "links")
    found = materialise(components(links), "components")
    long = shared.where(F.col("c") > HEADS).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    long = materialise(long, "long")
    split = materialise(long.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram"), "split")
    open_ = materialise(long.join(split, "gram").select("gram", "node", "n", "pos", "parity", "root"), "open")
    open_ = materialise(_with_earlier(open_, rows), "open-earlier")
    x, y = open_.toDF("gram", "a", "na", "pa", "ca", "ra", "ea"), open_.toDF("gram", "b", "nb", "pb", "cb", "rb", "eb")
    rest = _meetings(x, y, percent, (F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b"))).distinct()
    rest = materialise(rest.join(star, ["a", "b"], "left_anti"), "rest")
    more = materialise(_verified(rest, texts, rows, k, percent), "more-links")
    return components(links.unionByName(more))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """(row, id, n_shingles, class_id, component_id, first_row) for each row of ``docs``.

    Words are runs of other characters than ASCII white space, A to Z lower-cased; a set is the
    distinct shingles of ``k`` words, or the whole sequence if it is shorter. Sets link when
    100 * common >= percent * union. ``class_id`` is the smallest id with the same set,
    ``component_id`` the smallest that links reach, ``first_row`` a row that has it. A null or empty text, or one of white space,
    has no set and is its own class and component. A null id comes after all others; rows may
    repeat. ``row`` is the place in the stored table ``docs``, which tells rows apart.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    last = frequent_columns(texts, k, percent)
    made = texts.mapInArrow(
        _rows(k, percent, last), "row bigint, id bigint, n bigint, digest binary, parity array<bigint>, prefix array<bigint>"
    )
    made = materialise(made, "rows")
    # One row stands for each set: the one with the smallest id, nulls last.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    copies = made.where("n > 0").groupBy("digest", "n").agg(first.alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = materialise(copies.select("digest", "n", F.col("first.row").alias("node")), "copies")
    classed = made.where("n > 0").select("row", "digest", "n").join(copies, ["digest", "n"]).where("row <> node").select("row", "node")
    classed = materialise(classed, "classed")
    single = made.where("n > 0").join(_few(classed.select("row")), "row", "left_anti")
    found = materialise(link_classes(texts, single, k, percent), "linked")
    members = made.select("row", "id", "n").join(classed, "row", "left").withColumn("node", F.coalesce("node", "row"))
    members = members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = materialise(members, "members")
    order = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    least = lambda key, out: materialise(members.groupBy(key).agg(order.alias(out), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), out)
    of = lambda out, field, own: F.when(F.col(out).isNotNull(), F.col(out)[field]).otherwise(F.col(own))
    return (
        members.join(least("node", "same"), "node", "left")
        .join(least("root", "reached"), "root", "left")
        .select(
            "row",
            "id",
            F.col("n").alias("n_shingles"),
            of("same", "id", "id").alias("class_id"),
            of("reached", "id", "id").alias("component_id"),
            of("reached", "row", "row").alias("first_row"),
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, of several the first."""
    found = jaccard_components(docs, id_col, text_col, k, percent)
    own = free_name("_row", docs.columns)
    gone = materialise(found.where("row <> first_row").select(F.col("row").alias(own)), "gone")
    marked = docs.withColumn(own, F.monotonically_increasing_id())
    return marked.join(_few(gone), own, "left_anti").select(*docs.columns)
