"""Rows that operators must take as they are."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls, empty and repeated texts, ties, a long word, and signs beyond ASCII.
ODD = [
    (1, "It's a day.\n\nTwo  lines; 42 of them!", "en", "s", 1),
    (1, "It's a day.\n\nTwo  lines; 42 of them!", "en", "s", 1),
    (2, "", "en", None, 0),
    (3, None, None, "s", None),
    (None, "no key here at all", "en", "s", 1),
    (5, " \t\n ", "de", "s", 1),
    (6, "ünïcödé 中文 😀 'll we'll", "de", "s", 1),
    (7, "a" * 5000 + " end", "en", "s", 1),
    (-8, "12 34 !!", "fr", "s", 1),
]
