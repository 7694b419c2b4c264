"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

Main path in DataFrame functions only. A fingerprint holds the hashes (the first 16 hex digits of
the MD5 of a shingle) that lie below ``fraction`` of their range, sorted, and always the least one,
so that texts too short for the fraction are told apart as well. Which hashes are kept does not
depend on the length of a text: fingerprints of parts merge into that of the whole set, and the
share of a short text's hashes found in a long one estimates how much of it the long one holds.

Shingles are five words in a row (runs of other characters than ASCII white space, as written);
a text of fewer words is one shingle, a text without words has none and an empty fingerprint.
Null texts count as empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unit

WORDS = 5
FRACTION = 1 / 8

# Ranges of the key that `with_next` sorts by themselves: as many a shuffle partition, and at most.
RANGES, MOST_RANGES = 8, 65_536

# Fixed value: hex digits of a hash.
DIGITS = 16


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, also where a lambda inside uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _limit(fraction: float) -> str:
    """The least hash that is not below the fraction, in the order of hex digits."""
    return f"{int(fraction * 16**DIGITS):0{DIGITS}x}" if fraction < 1 else "g"


def _kept(hashes: Column, fraction: float) -> Column:
    """Distinct hashes below the fraction and the least of all, sorted."""
    low = lambda h: F.filter(h, lambda x: x < _limit(fraction))
    return _let(hashes, lambda h: F.array_sort(F.array_distinct(F.when(F.size(h) > 0, F.array_append(low(h), F.array_min(h))).otherwise(h))))


def fingerprint(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """Fingerprint as a sorted array of hashes; the first is the least of all."""
    digest = lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS)

    def hashes(parts: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(parts) - F.lit(words))
        runs = F.transform(starts, lambda i: digest(F.concat_ws(" ", *[F.get(parts, i + k) for k in range(words)])))
        whole = F.array(digest(F.array_join(parts, " ")))
        return F.when(F.size(parts) >= words, runs).when(F.size(parts) > 0, whole).otherwise(F.array().cast("array<string>"))

    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _kept(_let(split, hashes), fraction)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Fingerprint of the shingles of two texts together, from their fingerprints."""
    return _kept(F.concat(a, b), fraction)


def written(fp: Column) -> Column:
    """Fingerprint as text: its hashes in a row."""
    return F.array_join(fp, "")


def parsed(text: Column) -> Column:
    """Fingerprint from its text."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), (F.length(text) / DIGITS - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i * DIGITS + 1, F.lit(DIGITS)))


def _compared(a: Column, b: Column, fraction: float, then: Callable[[Column, Column], Column]) -> Column:
    """``then`` on the hashes below the fraction, or on the least ones where neither text has such."""
    limit = _limit(fraction)
    low = lambda x: F.exists(x, lambda h: h < limit)
    below = lambda x: F.filter(x, lambda h: h < limit)
    pick = lambda p: F.when(low(p["a"]) | low(p["b"]), F.struct(below(p["a"]).alias("a"), below(p["b"]).alias("b"))).otherwise(p)
    pair = _let(F.struct(a.alias("a"), b.alias("b")), pick)
    return _let(pair, lambda p: then(p["a"], p["b"]))


def likeness(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of common shingles in all shingles of two texts; 1 if neither has any.

    Where neither has a hash below the fraction, equality of the least ones is the estimate.
    """

    def share(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return _let(both, lambda n: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(n / (F.size(x) + F.size(y) - n)))

    return _compared(a, b, fraction, share)


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of the first text's shingles that the second holds; 1 if the first has none.

    0 where only the second has hashes to compare by.
    """
    part = lambda x, y: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))
    return F.when(F.size(a) == 0, 1.0).otherwise(_compared(a, b, fraction, part))


def _range_of(key: Column, cuts: list[int], step: int = 256) -> Column:
    """Number of sorted cuts that are at most the key, by a coarse and a fine search."""
    if not cuts:
        return F.lit(0)
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    coarse = F.greatest(upto(F.lit(cuts[::step]).cast("array<bigint>")) - 1, F.lit(0)) * step
    return coarse + upto(F.slice(F.lit(cuts).cast("array<bigint>"), coarse + 1, F.lit(step)))


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows as ``given`` (a struct of all but the text), with ``text``, its ``fp`` and those of the next row.

    The next row is the one with the next smaller ``key`` (an integer); nulls come last, rows of
    equal keys follow by a hash of their text, and the last row is followed by the first. Equal rows
    (key and text) follow in either order. ``df`` must be a stored table: rows are told apart by
    their place in it.

    Texts move once. Ranges of the key are sorted by themselves, a key that fills several ranges in
    stretches of the hash; the head of each range, one row, is sent along to the range before it.
    """
    spark = df.sparkSession
    ranges = min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("given"),
        F.col(key).cast("bigint").alias("key"),
        body.alias("text"),
        unit(body).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    shares = [i / ranges for i in range(1, ranges)]
    seen = rows.agg(F.percentile_approx("key", shares, 20 * ranges).alias("cuts"), F.count("key").alias("known"), F.count(F.lit(1)).alias("n")).first()
    if not seen["n"]:
        ranges, shares = 1, []
    fills = Counter(seen["cuts"] or [])
    cuts = sorted(fills)

    # Ranges count downwards from the largest key; the key a range begins with may fill several.
    hot = F.when(F.col("key").isNull(), F.lit(1 + (seen["n"] - seen["known"]) * ranges // max(seen["n"], 1)))
    for value, n in fills.items():
        if n > 1:
            hot = hot.when(F.col("key") == value, F.lit(n))
    stretch = F.coalesce(F.floor(F.col("tie") * hot) + 1, F.lit(0))
    at = F.coalesce(F.lit(len(cuts)) - _range_of(F.col("key"), cuts), F.lit(len(cuts) + 1))
    rows = rows.withColumn("part", at.cast("bigint") * F.lit(1 << 32) + stretch)

    first = F.max(F.struct(F.col("key"), -F.col("tie"), -F.col("row")))
    heads = rows.groupBy("part").agg(first.alias("h")).select("part", (-F.col("h.col3")).alias("row")).orderBy("part").collect()
    before = [(h["row"], heads[i - 1]["part"]) for i, h in enumerate(heads)]
    # One row a range, whose number is bounded above.
    sent = rows.drop("part", "given").join(F.broadcast(spark.createDataFrame(before, "row bigint, part bigint")), "row")
    dealt = rows.withColumn("sent", F.lit(False)).unionByName(sent.withColumn("sent", F.lit(True)), allowMissingColumns=True)
    dealt = dealt.repartition("part").withColumn("fp", fingerprint(F.col("text")))
    w = Window.partitionBy("part").orderBy("sent", F.col("key").desc_nulls_last(), "tie", "row")
    follows = {"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)}
    return dealt.withColumns(follows).where(~F.col("sent")).select("given", "text", "fp", *follows)


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text with its last half exchanged, and their likenesses.

    The last half (rounded down, in code points) gives way to as many first code points of the next
    row's text (see ``with_next``), or to all of it. Returns ``given``, ``text``, ``n_chars``,
    ``edited``, ``fp``, ``edited_fp``, ``near_edited``, ``near_next``, ``held_by_edited`` and
    ``held_by_next`` (containment). An empty table has no rows; extra columns of any name may be
    there.
    """
    pairs = with_next(df, key, text)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    done = pairs.select("given", "text", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    done = done.withColumn("edited_fp", fingerprint(F.col("edited")))
    a, e, x = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    near = {"near_edited": likeness(a, e), "near_next": likeness(a, x), "held_by_edited": containment(a, e), "held_by_next": containment(a, x)}
    return done.withColumns(near).drop("next_fp")
