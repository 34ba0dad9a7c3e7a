"""Small frames for the operators' edge cases."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source) with the columns of documents."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC)
