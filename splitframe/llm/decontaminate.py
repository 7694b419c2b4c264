"""Benchmark decontamination by templates, with a check of what fills their slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.position import free_name
from ..session import materialise

# Units that may follow a number.
UNITS = (
    "mg|kg|g|t|mm|cm|km|m|ml|l|s|min|h|kmh|mph|lb|lbs|oz|ft|in|inch|inches|feet|yards|miles|mile|pounds|ounces|"
    "gram|grams|kilograms|meters|metres|liters|litres|seconds|minutes|hours|days|weeks|months|years|dollars|euros|cents|percent|degrees"
)
MARK = "\x01"
# Fixed values, in order: what is replaced, and the placeholder that stands before the value.
_STEPS = (
    (MARK, " "),
    ("([0-9])[.,]([0-9])", "$1_$2"),
    ("([0-9][0-9_]*)", f" {MARK}n$1 "),
    (f"({MARK}n[0-9_]+) +({UNITS})([^\\p{{L}}]|$)", f"$1 {MARK}u$2$3"),
    ("(\\p{Lu}\\p{Ll}+)", f"{MARK}a$1"),
)
_BETWEEN = f"[^\\p{{L}}\\p{{M}}\\p{{N}}_{MARK}]+"

#: Tokens of a window, of what a leak covers at least, and of an item that can leak at least.
WINDOW, COVERED, LEAST = 8, 13, 4
#: Covered tokens that must be the same, as placeholders alone say nothing: any list of numbers has those of another.
SAME = 3
#: Shifts this close count together: words were put in or left out between their windows.
CLOSE = 8
#: Template windows broadcast at most; beyond, Spark shuffles them.
BROADCAST_WINDOWS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased words; numbers, units after them and capitalised words carry a typed mark."""
    for pattern, to in _STEPS:
        text = F.regexp_replace(text, pattern, to)
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda t: t != "")


def _slot(token: Column) -> Column:
    return F.startswith(token, F.lit(MARK))


def template(token: Column) -> Column:
    """A placeholder without its value, a word as it is."""
    return F.when(_slot(token), F.left(token, F.lit(2))).otherwise(token)


def plain(token: Column) -> Column:
    """A capitalised word as a word, other tokens as they are."""
    return F.when(F.startswith(token, F.lit(MARK + "a")), F.substr(token, F.lit(3))).otherwise(token)


def _windows(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, pos, h): hashes of the template windows of ``width`` tokens of (key, tokens).

    Each place has two: with placeholders for capitalised words, and with those as words, so that a
    copy in other case is found too.
    """
    names = F.transform("tokens", lambda t: F.xxhash64(template(t)))
    words = F.transform("tokens", lambda t: F.xxhash64(template(plain(t))))
    hashed = rows.where(F.size("tokens") >= width).select(key, F.explode(F.array_distinct(F.array(names, words))).alias("hashes"))
    # Places are unfolded before they are hashed: a function over an array would run outside generated code.
    placed = hashed.select(key, "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - width)).alias("pos"))
    return placed.select(key, "pos", F.xxhash64(*(F.get("hashes", F.col("pos") + i) for i in range(width))).alias("h"))


def _few(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= most else rows


def _with_names(tokens: str) -> Column:
    """(value, names) of each token; ``names`` of a capitalised word has also those right beside it."""

    def one(token, at):
        beside = F.array(F.get(F.col(tokens), at - 1), token, F.get(F.col(tokens), at + 1))
        names = F.transform(F.filter(beside, lambda t: F.startswith(t, F.lit(MARK + "a"))), plain)
        return F.struct(token.alias("value"), F.when(F.startswith(token, F.lit(MARK + "a")), names).otherwise(F.array(token)).alias("names"))

    return F.transform(tokens, one)


def _other_leaks(windows: DataFrame, item: DataFrame, text: DataFrame, covered: int) -> DataFrame:
    """Leaks among ``windows`` (row, item, near, shift, item_tokens, at, width); those of one ``near`` count together."""
    group = ["row", "item", "near", "item_tokens"]
    places = windows.select(*group, F.col("at").alias("start"), "shift", F.explode(F.expr("sequence(at, at + width - 1)")).alias("at"))
    pairs = places.join(item, ["item", "at"]).withColumn("pos", F.col("at") + F.col("shift")).join(text, ["row", "pos"])
    pairs = pairs.withColumn("same", plain(F.col("given")) == plain(F.col("value")))
    pairs = pairs.groupBy(*group, "start", "shift").agg(F.collect_list(F.struct("at", "given", "names", "same")).alias("p"), F.bool_and("same").alias("verbatim"), F.count_if("same").alias("alike"))
    by_place = (
        pairs.select(*group, "verbatim", "alike", F.inline("p"))
        .groupBy(*group, "at", "given")
        .agg(F.flatten(F.collect_set("names")).alias("values"), F.bool_or("verbatim").cast("bigint").alias("verbatim"), F.bool_or("same").alias("same"), F.max("alike").alias("alike"))
    )
    all_values = F.collect_list("values")
    by_given = by_place.groupBy(*group, "given").agg(
        F.count(F.lit(1)).alias("places"),
        F.sum("verbatim").alias("verbatim"),
        (F.size(F.aggregate(all_values, F.get(all_values, F.lit(0)), F.array_intersect)) > 0).alias("agrees"),
        F.max("alike").alias("alike"),
        F.bool_and("same").alias("exact"),
    )
    named = F.startswith("given", F.lit(MARK + "a"))
    found = by_given.groupBy(*group).agg(
        F.sum("verbatim").alias("verbatim"),
        F.when(F.bool_and(F.col("agrees") | ~named), F.sum(F.when(F.col("agrees"), F.col("places")).otherwise(0))).otherwise(F.lit(0)).alias("agreed"),
        F.max("alike").alias("alike"),
        F.bool_and("exact").alias("exact"),
    )
    found = found.where(F.col("alike") >= SAME).withColumn("covered", F.greatest("verbatim", "agreed")).where(F.col("covered") >= F.least(F.lit(covered), F.col("item_tokens")))
    return found.groupBy("row", "item").agg(F.max("covered").alias("covered"), F.max("item_tokens").alias("item_tokens"), F.bool_or("exact").alias("exact"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", window: int = WINDOW, covered: int = COVERED) -> DataFrame:
    """(row, item_id, covered, item_tokens, exact) for each document and item that it repeats.

    ``row`` is the place of the document in the stored table ``docs``. Texts become templates:
    numbers, units after numbers and capitalised words are typed placeholders. Windows of
    ``window`` template tokens are joined by hash. Windows on one alignment of an item with a
    document cover tokens; they are a leak if they cover at least ``covered`` tokens, or all of a
    shorter item, and the values in the slots correspond one to one: so a question asked with
    other numbers or names is found, while a chance likeness of templates, which puts different
    names for one, is not. At least ``SAME`` of the tokens covered must be the same in both, so lists of
    other numbers or names are none. A capitalised word also matches as the word it is. ``exact`` says that
    the values are the same.

    Where none corresponds one to one, alignments whose shifts differ by at most ``CLOSE`` count
    together, as words put in or left out shift what follows. They are a leak if they cover as much
    by windows copied word for word, in any case of letters; or, if each name stands for names that
    share a word, without the numbers that stand for several. ``covered`` then counts these
    tokens, and one of the windows must have the ``SAME`` tokens. The SQL counterpart of the query has the one-to-one rule of single alignments alone.

    Items of fewer than four tokens never leak; null or empty texts have no tokens; equal items are
    items of their own. All rows of the benchmark are matched, also those that share an item id or
    have none; what they find is reported once for an id, and once for the null id.
    """
    items = benchmark.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    items = items.select("item_id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") >= LEAST)
    items = materialise(items.withColumn("item", F.monotonically_increasing_id()), "items")
    lengths = items.select(F.least(F.size("tokens"), F.lit(window)).alias("width")).distinct().collect()  # ``window`` values at most
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = texts.select("row", tokens(F.col("text")).alias("tokens"))
    found = None
    for width in sorted(r["width"] for r in lengths):
        own = items if width == window else items.where(F.size("tokens") == width)
        wanted = materialise(_windows(own, "item", width).withColumnRenamed("pos", "at").distinct(), "windows")
        some = _windows(parts, "row", width).join(_few(wanted, BROADCAST_WINDOWS), "h")
        some = some.select("row", "item", (F.col("pos") - F.col("at")).alias("shift"), "at", F.lit(width).alias("width"))
        found = some if found is None else found.unionByName(some)
    if found is None:
        return docs.select(F.monotonically_increasing_id().alias("row")).limit(0).selectExpr(
            "row", f"cast(null as {dict(benchmark.dtypes)[id_col]}) as item_id", "0L as covered", "0L as item_tokens", "true as exact"
        )
    found = materialise(found, "windows-found")
    # Only alignments that cover enough, alone or with those close to them, are looked into.
    sizes = materialise(items.select("item", F.size("tokens").cast("bigint").alias("item_tokens")), "item-sizes")
    width = 2 * CLOSE  # two shifts that are close meet in a stretch of one of two grids
    near = [("shift", F.col("shift")), ("even", F.floor(F.col("shift") / width)), ("odd", F.floor((F.col("shift") + CLOSE) / width))]
    near = F.array(*(F.struct(F.lit(kind).alias("kind"), at.cast("bigint").alias("at")) for kind, at in near))
    within = F.flatten(F.transform("windows", lambda w: F.sequence(w["at"], w["at"] + w["width"] - 1)))
    spans = (
        found.withColumn("near", F.explode(near))
        .groupBy("row", "item", "near")
        .agg(F.collect_set(F.struct("shift", "at", "width")).alias("windows"))
        .join(sizes, "item")
        .withColumn("covered", F.size(F.array_distinct(within)).cast("bigint"))
        .where(F.col("covered") >= F.least(F.lit(covered), F.col("item_tokens")))
    )
    spans = materialise(spans, "spans")
    rows = materialise(spans.select("row").distinct(), "span-rows")
    text = texts.join(_few(rows, BROADCAST_WINDOWS), "row", "left_semi").select("row", tokens(F.col("text")).alias("tokens"))
    text = materialise(text, "span-texts").select("row", F.posexplode(_with_names("tokens")).alias("pos", "v")).select("row", "pos", "v.*")
    item = items.select("item", F.posexplode("tokens").alias("at", "given"))
    places = spans.where("near.kind = 'shift'").select("row", "item", "covered", "item_tokens", F.explode("windows").alias("w"))
    places = places.select("row", "item", "w.shift", "covered", "item_tokens", F.explode(F.expr("sequence(w.at, w.at + w.width - 1)")).alias("at")).distinct()
    pairs = places.join(item, ["item", "at"]).withColumn("pos", F.col("at") + F.col("shift")).join(text, ["row", "pos"])
    slot = F.when(_slot(F.col("given")), F.struct("given", "value"))
    same = plain(F.col("given")) == plain(F.col("value"))
    checked = pairs.groupBy("row", "item", "shift", "covered", "item_tokens").agg(
        F.count_distinct(slot).alias("pairs"),
        F.count_distinct(slot["given"]).alias("givens"),
        F.count_distinct(slot["value"]).alias("values"),
        F.count_if(same).alias("same"),
        F.bool_and(same).alias("exact"),
    )
    good = checked.where("pairs = givens and pairs = values").where(F.col("same") >= SAME)
    good = good.groupBy("row", "item").agg(F.max("covered").alias("covered"), F.max("item_tokens").alias("item_tokens"), F.bool_or("exact").alias("exact"))
    good = materialise(good, "one-to-one")
    rest = spans.join(good, ["row", "item"], "left_anti").select("row", "item", "near", "item_tokens", F.inline("windows"))
    both = good.unionByName(_other_leaks(rest, item, text, covered)).join(items.select("item", "item_id"), "item")
    return both.groupBy("row", "item_id").agg(F.max("covered").alias("covered"), F.max("item_tokens").alias("item_tokens"), F.bool_or("exact").alias("exact"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that repeat an item of ``benchmark``."""
    own = free_name("_row", docs.columns)
    gone = materialise(leaks(docs, benchmark, **options).select(F.col("row").alias(own)).distinct(), "leaks")
    marked = docs.withColumn(own, F.monotonically_increasing_id())
    return marked.join(_few(gone, BROADCAST_WINDOWS), own, "left_anti").select(*docs.columns)
