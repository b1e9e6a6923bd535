"""Small tables with every odd case in them."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tid long, h string, _row long, key long, score double, drops string, _doc int"
SF = "/root/testdata/sf0.01"


def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""
    line = "the quick brown fox jumps over the lazy dog by the old river bank tonight"
    texts = [(1, None), (2, ""), (3, "  \n\n "), (4, line), (4, line), (5, line), (None, line), (6, "word " * 60_000), (7, line.replace("quick", "quack")),
             (8, "x" * 50_000), (9, "Ünïcode ﬁ 漢字 🎉 <s> <|endoftext|> \u0000   ▁"), (10, None), (None, None), (11, line + "\n" + line + "\nshort")]
    return spark.createDataFrame([(d, t, None if k % 3 else "en", None if k % 4 == 0 else "s", None, 1, "h", 7, 3, 0.5, "d", 2) for k, (d, t) in enumerate(texts)], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def small(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
