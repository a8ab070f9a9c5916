"""Tables of edge cases: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing about the coming rain".split()
LONG = " ".join(WORDS[k * 7 % len(WORDS)] + str(k) for k in range(30_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE + " twentyone", None, None, None), (4, None, "en", "a", None), (5, "", None, "b", 0),
    (6, "  \t\n ", "fr", None, 5), (7, LONG, "en", "b", len(LONG)), (8, LONG, "de", "b", 3), (9, "word", "en", "c", 4), (10, "Été à la plage, c'est l'été ÉTÉ", "fr", "c", 9),
    (None, BASE, "en", "a", 1), (None, None, None, None, None), (11, "😀 漢字 текст ａｂｃ", "de", "c", 3), (12, "1234 5678 -- !!", "en", "c", 3), (13, "one two", "en", "x", 7), (14, "ONE  TWO", "es", "x", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["doc", "ids", "n", "regs", "digest", "rep", "size", "hilbert", "pos", "kept", "component_id", "score", "lang_pred", "media", "c0", "c1", "key", "row", "item", "shard"]


def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def clashing(spark):
    """The same rows with columns whose names operators use themselves."""
    return docs(spark).withColumns({c: F.lit(7) for c in CLASH})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


PAGE_ROWS = [
    (1, "http://example.com/en/a?b#c", "<p>x</p>"), (2, "HTTPS://WWW.Example.COM/en/", "<p>x</p>"), (3, None, None), (4, "no scheme", ""), (5, "x://", "<p>ü</p>"), (5, "x://", "<p>ü</p>"), (6, "http://a.net/es/1", "y" * 300_000),
    (None, "http://net/fr/", "<p>x</p>"), (7, "http://notexample.com", "z"), (8, "a://b://net/es/", "z"), (9, "http://com?/en/", None), (10, "http://EXAMPLE.com/en/\nx", "é"),
]


def pages(spark):
    return spark.createDataFrame(PAGE_ROWS, "page_id long, url string, html string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
