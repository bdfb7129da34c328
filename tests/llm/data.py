"""Rows that every text operator has to stand: nulls, empty and long texts, ties, repeats, clashing names."""

LONG = "alpha beta gamma delta epsilon " * 4000

ODD = [
    (1, "The quick brown fox jumps over the lazy dog, isn't it?\nA second line here.\nA second line here.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog, isn't it?\nA second line here.\nA second line here.", "en", "a"),
    (2, "", "en", "a"),
    (3, None, None, None),
    (None, "Null id, with some words in it: under the MIT license.", "en", None),
    (4, " \t\n\x0b\x0c\r ", "de", "b"),
    (5, LONG, "en", "b"),
    (6, "École d'été à Zürich — ÎLE, İstanbul ΣΑΣ 数字 ١٢ e\u0301a\u0308 <|endoftext|>tail <|STARTOFTEXT|> 'S 're ''s", "fr", "b"),
    (7, "x" * 50000, "en", "a"),
    (8, "\x1c\x1d one\x85two\xa0three\u2003four\u3000five 12345 don't WE'LL #*$%&|<>", "en", "a"),
    (9, "emoji 😀😀 and \u200d zero \ufeff width", "en", "c"),
]


def odd_documents(spark, rows=None):
    """A table with the columns of documents and others whose names operators use themselves."""
    rows = ODD if rows is None else rows
    data = [(i, t, lang, s, None if t is None else len(t), "x", 7, "y", 1) for i, t, lang, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, n_words int, host string, _row int")
