"""Small inputs with the odd cases every operator must take."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, text_key string, h int, host string, label string, size long, weight string"


def docs(spark, rows):
    """Documents (id, text[, source]) with more columns whose names clash with inner ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 5, "k", 3, "x", None, 9, "w") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (None, None, None),
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (4, "one", "b"),
    (4, "one", "b"),
    (4, "two words", "b"),
    (None, "no id here at all", "b"),
    (5, "Ünïcode 漢字 🎉 text, and more words follow here. " * 3, ""),
    (6, "long " * 30000 + "end", "a"),
]
