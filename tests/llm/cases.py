"""Rows that every operator on texts has to take: nulls, empty and long texts, ties and repeats, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, component long, key int, score string, spans int, seq long"

ROWS = [
    (1, "The cat sat on the mat and looked at me", "en", "s", 3),
    (2, None, "en", "s", None),
    (3, "", None, None, 0),
    (4, "   \n\t", "en", "s", 5),
    (5, "one", "en", None, 3),
    (6, "The cat sat on the mat and looked at me", "en", "s", 3),
    (6, "The cat sat on the mat and looked at me", "en", "s", 3),
    (None, "The cat sat on the mat and looked at me", None, "s", 3),
    (None, "another text without an id, quite alone", None, "s", 3),
    (7, "long text " * 30000, "en", "s", 300000),
    (8, "é" * 50000, "fr", "s", 50000),
    (9, "mail a.b@c.example.com or +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111 🙂 end", "en", "s", 1),
    (10, "12345 678 !!! ???", "de", "s", 1),
]


def docs(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "z", 3, 4) for r in rows], DOCS)
