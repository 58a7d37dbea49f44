"""Small tables with the awkward rows that every operator must bear."""

CLASHING = ["_host", "_pattern", "_at", "_count", "_whole", "_words", "_bucket", "fp", "component_id", "block", "token", "hosts", "taken_", "p", "n", "place"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, score string, " + ", ".join(f"{c} int" for c in CLASHING)
LONG = " ".join(f"word{i}" for i in range(120))


def awkward(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows, clashing column names."""
    rows = [(1, LONG, "en", "a", 9, 7, "x"), (2, LONG, None, None, None, None, None), (2, LONG, None, None, None, None, None), (3, None, "en", "a", 0, 1, "y"), (4, "", "fr", "b", 0, 1, "z"), (5, " \n\t ", "fr", "b", 3, 1, "z"), (None, "one two", None, "a", 7, 1, None), (6, "short text " * 30_000, "en", "c", 1, 1, "l"), (7, "é😀 ß", "de", "c", 4, 1, "u")]
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def collected(df, *order):
    return sorted((tuple(r) for r in df.select(*order).collect()), key=repr)
