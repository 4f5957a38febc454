"""HTML and free-text expressions."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlode import rules
from leadlode.functions.common import contains_any, or_none, squeeze, strip, text_or_empty


def html_text(html: Column, limit: int | None = None) -> Column:
    """Readable text of a page by pattern: no scripts, styles or tags."""
    t = F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>", "")
    t = F.regexp_replace(t, r"(?i)<style[\s\S]*?</style>", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = strip(F.regexp_replace(t, r"\s{2,}", " "))
    return t if limit is None else F.substring(t, 1, limit)


def html_title(html: Column) -> Column:
    return squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def _parser_udf():
    """Arrow UDF over the standard HTML parser.

    Everything it needs is local to this function, so it ships to the executors
    by value and they need no copy of this package.
    """

    class TextOnly(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts = []
            self.hidden = 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            if tag in ("script", "style") and self.hidden:
                self.hidden -= 1

        def handle_data(self, data):
            if not self.hidden:
                self.parts.append(data)

    def read(html):
        if html is None:
            return None
        reader = TextOnly()
        reader.feed(html)
        reader.close()
        return " ".join(" ".join(reader.parts).split())

    def texts(html: pd.Series) -> pd.Series:
        return html.map(read)

    return F.pandas_udf(texts, T.StringType())


def html_text_decoded(html: Column) -> Column:
    """As ``html_text``, with entities decoded and comments dropped.

    Only pages that hold an entity or a comment pay for the parser.
    """
    needs_parser = html.rlike(r"&[#a-zA-Z]|<!--")
    return F.when(needs_parser, _parser_udf()(F.when(needs_parser, html))).otherwise(
        squeeze(html_text(html))
    )


def source_context(text: Column, term: Column, reach: int = 50) -> Column:
    """Up to 100 characters around the first occurrence of a term."""
    at = F.position(F.lower(term), F.lower(text))
    start = F.greatest(at - reach, F.lit(1))
    stop = F.least(at + F.length(term) + reach, F.length(text) + 1)
    cut = F.substr(text, start, stop - start)
    return F.when(
        at > 0, F.substring(strip(F.translate(cut, "\n", " ")), 1, 100)
    ).otherwise(F.lit(rules.NO_CONTEXT))


# Where a heading with a text starts: <h1> to <h3>, or one to three # at the start of a line.
HEADING_START = (
    r"(?i)(?=<h[1-3](?:\s[^>]*)?>(?:\s|<(?!/h[1-3])[^>]*>)*[^<\s])"
    r"|(?m)(?=^#{1,3}[ \t]+(?!SOURCE_URL:)\S)"
)
_HEADING_TEXT = r"(?is)\A(?:<h[1-3](?:\s[^>]*)?>(.*?)(?:</h[1-3]\s*>|\z)|#{1,3}[ \t]+([^\n]+))"


def sections(html: Column) -> Column:
    """A page cut at its headings; all pieces but the first start with one."""
    return F.split(F.concat(F.lit("\n"), html), HEADING_START, -1)


def section_heading(piece: Column) -> Column:
    """Text of the heading that a piece starts with, else ''."""
    found = F.concat(F.regexp_extract(piece, _HEADING_TEXT, 1), F.regexp_extract(piece, _HEADING_TEXT, 2))
    return squeeze(F.regexp_replace(found, "<[^>]+>", " "))


def page_summary(text: Column, company: Column, limit: int = 200) -> Column:
    """Start of a page in plain words, or a neutral sentence when it is blank."""
    t = F.regexp_replace(text_or_empty(text), r"\[([^\]]+)\]\([^)]+\)", "$1")
    t = squeeze(F.regexp_replace(t, r"[#*`_\-]", " "))
    short = F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)
    return F.coalesce(
        or_none(short),
        F.concat(company, F.lit(rules.PLAIN_SUMMARY)),
    )


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text_or_empty(text), r"\s+"), lambda w: w != ""))


def has_contact_section(text: Column, words=rules.CONTACT_SECTION_WORDS) -> Column:
    return contains_any(F.lower(text_or_empty(text)), words)


def matched_phrase(text: Column, patterns) -> Column:
    """The text that the first matching place of a pattern covers, else NULL."""
    return or_none(F.regexp_extract(text, rules.any_of(patterns, "(?id)"), 1))


def matches(text: Column, patterns) -> Column:
    return text.rlike(rules.any_of(patterns, "(?id)"))


def strip_code_fence(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"^```(?:json)?\s*", ""), r"\s*```$", "")
