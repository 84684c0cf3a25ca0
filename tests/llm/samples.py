"""Small document tables with the odd cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, f string, size int, ids string, kept boolean"

ODD = [
    (1, None, None, None, None, "x", 1, "i", None),
    (2, "", "en", "a", 0, None, 2, None, True),
    (3, "   \n\t \n", "en", "a", 6, "y", None, "j", False),
    (4, "one", "en", None, 3, "y", 4, "j", None),
    (None, "no id at all but some words here", "en", "b", 32, "y", 4, "j", None),
    (5, "same same", "de", "b", 9, "y", 4, "j", None),
    (5, "same same", "de", "b", 9, "y", 4, "j", None),
    (5, "other text of one id", "de", "b", 9, "y", 4, "j", None),
    (6, "Ünï cödé  ß 日本語 テスト 🙂 x", "de", "é", 20, "y", 4, "j", None),
    (7, "word " * 3000, "en", "b", 15000, "y", 4, "j", None),
    (8, "<|endoftext|> is plain text\r\nfor some", "en", "c", 15000, "y", 4, "j", None),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
