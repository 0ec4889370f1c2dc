"""Small document tables with every awkward case, shared by the tests of this folder."""

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, "
        "spans string, score string, size string, node string, component_id string, ids string, part string")


def docs(spark, rows):
    """rows of (doc_id, text, lang, source); the columns after n_chars clash with results."""
    return spark.createDataFrame(
        [(i, t, lang, s, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x") for i, t, lang, s in rows],
        DOCS)


LONG = "word another third " * 20000
AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \t\n ", "en", "a"), (4, LONG, "en", "b"),
    (5, "mail me at ann.lee@mail.example.com or +1 (212) 555-0143", "en", "b"),
    (5, "mail me at ann.lee@mail.example.com or +1 (212) 555-0143", "en", "b"),
    (None, "no id, password=abcdef123 and 10.20.30.40", "en", None),
    (7, "é漢字 😀 ▁ \x00 ﷺ ſecret token: Ａ", "de", "b"), (8, "1234567890" * 3000, None, "c"),
    (9, "....!!!!", "fr", "c"), (10, "a b c d", "fr", "d"), (11, "a b c d", "fr", "d"),
]
