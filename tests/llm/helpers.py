"""Rows that every operator must take: nulls, blanks, repeats, a long text, clashing names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, size long, `key` string, target double,"
    " lang_pred string, label string, _id long, fp string, rid string, words string, kept string, n_words string, copies string"
)
EXTRA = ("r", 1, "k", 0.5, "p", "l", 7, "f", "i", "w", "x", "n", "c")

#: A vocabulary, so that languages and lines can be told apart.
WORDS = {
    "en": "the and of that with water house little people never under about other great small river mountain".split(),
    "de": "der und nicht mit wasser haus kleine leute niemals unter über andere große fluss gebirge schön straße".split(),
}


def prose(seed: int, lang: str, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def odd_rows():
    long = "\n".join(prose(k, "en", 40) for k in range(400))
    texts = [
        (None, "nobody has an id here and this line is long enough", "en", "a"),
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, " \t\n\x0b\x0c\r ", "en", "b"),
        (4, prose(1, "en", 120), "en", "a"),
        (5, prose(1, "en", 120), "en", "b"),
        (5, prose(1, "en", 120), "en", "b"),
        (6, prose(2, "de", 120), "de", None),
        (7, prose(2, "de", 119) + " anders", "de", "c"),
        (8, long, "en", "c"),
        (9, "12 34 !! ??", None, "a"),
        (10, "word", "en", "a"),
        (11, "😀 emoji ퟿ ü ß İ", "de", "b"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in texts]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
