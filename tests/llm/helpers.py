"""Tables with everything that operators must bear."""

LONG = "long words follow each other here " * 4000

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, idx string, shard string, slot string, size string, _row string, block string, gram string, score string, _first string, _words string, _size string, _key string, _tie string, _mid string, _part string, _start string, given string"


def nasty(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and names that clash."""
    extra = ("x",) * 18
    rows = [
        (1, "One two three four five six.", "en", "a", 28, *extra),
        (2, "one TWO three four five six.", "en", "a", 28, *extra),
        (2, "one TWO three four five six.", "en", "a", 28, *extra),
        (3, None, None, None, None, *(None,) * 18),
        (None, "One two three four five six.", "en", None, 28, *extra),
        (4, "", "en", "b", 0, *extra),
        (5, " \t\n ", "en", "b", 4, *extra),
        (6, LONG, "en", "c", len(LONG), *extra),
        (7, LONG + "end", "en", "c", len(LONG) + 3, *extra),
        (8, "eins zwei drei É é", "de", "", 18, *extra),
        (9, "eins zwei drei é é", "de", "", 18, *extra),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
