"""Small document tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, part string, piece string"


def documents(spark, texts, extra=()):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), -1, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


TEXTS = [
    None,
    "",
    " ",
    "one two three",
    "one two three",
    "  led by spaces\n\n and lines \t ",
    "nothing but 漢字 and émigrés, it's ２ <|endoftext|> here",
    "word " * 9000,
    "a b c d e f g " * 30 + "\nline\nline\n\nline",
]
ODD_ROWS = [(None, "null id", None, None, None, None, None, None), (3, "one two three", "en", "s0", 13, -1, "x", None), (-5, "negative id", "fr", None, 0, 0, "", "")]
