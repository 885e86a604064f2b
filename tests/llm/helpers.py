"""Rows that every operator must bear."""

LONG = ("Lorem ipsum dolor sit amet " * 4000).strip()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark, extra=True):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and a column of a clashing name."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "b", 65),
        (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "b", 65),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, LONG, "la", "a", len(LONG)),
        (None, "no id here at all", "en", "a", 17),
        (5, "12345 67890 !!! ???", "en", "\U0001f600", 19),
        (6, "Ünï cödé tëxt \U0001f600\U0001f601 end", "de", "a", 20),
        (7, "word", "en", "a", 4),
        (1, "same id, another text", "fr", "c", 21),
        (8, " \t\n ", "en", "a", 4),
    ]
    df = spark.createDataFrame(rows, DOC)
    return df.selectExpr("*", "doc_id AS fp", "text AS size", "1 AS score", "'x' AS key") if extra else df


def no_documents(spark):
    return spark.createDataFrame([], DOC)
