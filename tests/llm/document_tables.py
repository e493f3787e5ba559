"""A documents table with columns that clash with inner names; a module of its own, as conftests share one name."""

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, set long, row long, spans string, "
    "digest string, ids string, bucket int, first long, piece string, "
    "_row long, _doc long, _spans string, _kept long, _n int, _again int, _ROW2 int, block long"
)


def table(spark, rows):
    """(doc_id, text) rows as a documents table with clashing extra columns."""
    full = [(i, t, "en", None, None if t is None else len(t), 0.5, 1, 2, "s", "d", "i", 3, 4, "p", 5, 6, "s", 7, 8, 9, 10, 11) for i, t in rows]
    return spark.createDataFrame(full, DOCS)
