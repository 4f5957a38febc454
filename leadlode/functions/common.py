"""Small string and array expressions shared by the jobs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]"

# --- Fixed values: every Unicode white-space character ----------------------
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def or_none(c: Column) -> Column:
    """NULL for an empty string, so that ``coalesce`` can skip it."""
    return F.nullif(c, F.lit(""))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def str_array(values) -> Column:
    """A literal array of strings (typed even when it is empty)."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def literal_alternation(words) -> str:
    """Regex that matches any of the given words literally."""
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + ")"


def contains_any(c: Column, words) -> Column:
    """True when ``c`` holds one of the words.

    A few words are looked up one by one, which beats a regex; a long list is one
    regex pass over the text.
    """
    words = list(words)
    if not words:
        return F.lit(False)
    if len(words) > 12:
        return c.rlike(literal_alternation(words))
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Spark evaluates a repeated sub-expression of a lambda function each time it
    occurs; a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _by_key(items: Column, key) -> Column:
    return F.sort_array(
        F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("p"), x.alias("v")))
    )


def _in_place(entries: Column) -> Column:
    return F.transform(F.sort_array(entries), lambda s: s["v"])


def distinct_by(items: Column, key) -> Column:
    """First element per key, original order kept.

    Sorts by key (n log n) rather than comparing all pairs.
    """
    first = let(
        _by_key(items, key),
        lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"])),
    )
    return _in_place(
        F.transform(first, lambda e: F.struct(e["p"].alias("p"), e["v"].alias("v")))
    )


def last_value_distinct_by(items: Column, key) -> Column:
    """Per key: the place of its first element with the value of its last."""

    def run_ends(s):
        n = F.size(s)
        opening = F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"]))
        closing = F.filter(s, lambda e, i: (i == n - 1) | (F.get(s, i + 1)["k"] != e["k"]))
        return F.zip_with(
            opening, closing, lambda a, b: F.struct(a["p"].alias("p"), b["v"].alias("v"))
        )

    return _in_place(let(_by_key(items, key), run_ends))
