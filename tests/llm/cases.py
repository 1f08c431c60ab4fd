"""Small tables that every operator has to take."""

LONG = " ".join(f"word{i % 977} x{i}" for i in range(6000))

TEXTS = [
    (1, "", "en"),
    (2, None, "en"),
    (3, "one two three four five", None),
    (4, "one two three four five", "en"),
    (4, "one two three four five", "en"),
    (5, " \n\t \r\n", "de"),
    (6, LONG, "en"),
    (7, LONG + " tail", "en"),
    (8, "äöü ßé x y 漢字 \U0001f600", "xx"),
    (None, "a row without id", "en"),
]
SCHEMA = "doc_id long, text string, lang string, n_words long, r string, kept string"


def table(spark, rows=TEXTS):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, "r", "k") for r in rows], SCHEMA)
