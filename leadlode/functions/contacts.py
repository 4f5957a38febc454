"""E-mail, phone and profile-link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlode import rules
from leadlode.functions import text as TX
from leadlode.functions.common import contains_any, distinct_by, let, strip, text_or_empty


# The same addresses as EMAIL_PATTERN finds: a match can only start where a run of
# local-part characters starts (or where the last match ended), so every other
# place of the text is skipped at once.
_RUN_START = r"(?:\G|(?<![a-zA-Z0-9._%+-]))"
_EMAIL_AT_RUN_START = _RUN_START + rules.EMAIL_PATTERN
# An address (group 2) with up to 50 characters before and after it.  What lies around is
# looked at only where an address was met, so a text is read once however many it holds.
_EMAIL_IN_PLACE = (
    f"(?s){_RUN_START}(?={rules.EMAIL_PATTERN})" + r"(?<=(\A.{0,49}|.{50}))" + f"({rules.EMAIL_PATTERN})" + r"(?=(.{0,50}))"
)


def _none() -> Column:
    return F.array().cast("array<string>")


def _found(text: Column, hint: Column, pattern: str, group: int) -> Column:
    """All matches, looked for only where the cheap hint holds."""
    return F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(_none())


def find_emails(text: Column) -> Column:
    return _found(text, text.contains("@"), _EMAIL_AT_RUN_START, 0)


def sighted_emails(text: Column) -> Column:
    """``array<struct(email, context)>``: every address as it occurs, with the text around it.

    One pass over the text, whatever the number of addresses.
    """

    def group(n):
        return _found(text, text.contains("@"), _EMAIL_IN_PLACE, n)

    around = F.arrays_zip(group(1).alias("before"), group(2).alias("email"), group(3).alias("after"))
    return F.transform(
        around,
        lambda m: F.struct(
            m["email"].alias("email"),
            F.substring(
                strip(F.translate(F.concat(m["before"], m["email"], m["after"]), "\n", " ")), 1, 100
            ).alias("context"),
        ),
    )


def is_valid_email(
    email: Column,
    blocked_words=rules.BLOCKED_EMAIL_WORDS,
    asset_extensions=rules.ASSET_EXTENSIONS,
) -> Column:
    """Shape, domain and placeholder checks of an address."""
    e = F.lower(strip(text_or_empty(email)))
    domain = F.element_at(F.split(e, "@"), -1)
    labels = F.split(domain, r"\.")
    return F.coalesce(
        e.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,10}\z")
        & ~F.exists(labels, lambda p: p.isin(list(asset_extensions)))
        & ~domain.rlike(r"^\d")
        & ~e.rlike(r"@\d+(\.\d+)?x")
        & ~contains_any(e, blocked_words),
        F.lit(False),
    )


def mailto_targets(html: Column) -> Column:
    found = _found(
        html, html.rlike("(?i)mailto:"), r"""(?i)href\s*=\s*["']\s*mailto:([^"'?]+)""", 1
    )
    return F.filter(F.transform(found, strip), lambda e: e.contains("@"))


def deobfuscated_emails(text: Column) -> Column:
    """``info [at] x [dot] org`` and its variants, written as addresses."""
    found = _found(text, text.rlike(rules.OBFUSCATED_DOT_HINT), rules.OBFUSCATED_EMAIL_PATTERN, 1)
    return F.transform(
        found,
        lambda s: F.regexp_replace(
            F.regexp_replace(s, rules.OBFUSCATED_AT, "@"), rules.OBFUSCATED_DOT, "."
        ),
    )


def decode_protected(hex_text: Column) -> Column:
    """Address hidden as hex bytes XOR-ed with the first byte."""

    def byte_at(i):
        return F.conv(F.substr(hex_text, i, F.lit(2)), 16, 10).cast("int")

    starts = F.filter(
        F.sequence(F.lit(3), F.greatest(F.length(hex_text) - 1, F.lit(3)), F.lit(2)),
        lambda i: i < F.length(hex_text),
    )
    key = byte_at(F.lit(1))
    chars = F.transform(starts, lambda i: F.char(byte_at(i).bitwiseXOR(key).cast("bigint")))
    return F.array_join(chars, "")


def protected_emails(html: Column) -> Column:
    found = _found(
        html, html.contains("data-cfemail"), r"""data-cfemail=["']([0-9a-fA-F]+)["']""", 1
    )
    return F.filter(F.transform(found, decode_protected), lambda e: e.contains("@"))


def page_emails(
    text: Column,
    html: Column,
    blocked_words=rules.BLOCKED_EMAIL_WORDS,
    asset_extensions=rules.ASSET_EXTENSIONS,
) -> Column:
    """``array<struct(email, context)>``: valid addresses of one page, first spelling of each, in order of sight."""
    html = text_or_empty(html)
    hidden = F.concat(
        protected_emails(html), mailto_targets(html), deobfuscated_emails(html), find_emails(html)
    )
    bare = F.transform(hidden, lambda e: F.struct(e.alias("email"), F.lit(rules.NO_CONTEXT).alias("context")))
    found = F.concat(sighted_emails(text_or_empty(text)), bare)
    valid = F.filter(found, lambda e: is_valid_email(e["email"], blocked_words, asset_extensions))
    return distinct_by(valid, lambda e: F.lower(e["email"]))


def headed_emails(
    html: Column,
    blocked_words=rules.BLOCKED_EMAIL_WORDS,
    asset_extensions=rules.ASSET_EXTENSIONS,
) -> Column:
    """``array<struct(email, heading)>`` of the addresses below a heading of a page, in order of sight.

    The page is cut at its headings once, and a piece knows its own heading: no address looks back
    over the page.  What follows the first heading only is looked at.
    """
    pieces = F.slice(TX.sections(text_or_empty(html)), 2, 1 << 30)

    def of_piece(piece):
        found = F.concat(
            find_emails(TX.html_text(piece)),
            protected_emails(piece),
            mailto_targets(piece),
            deobfuscated_emails(piece),
            find_emails(piece),
        )
        valid = F.filter(found, lambda e: is_valid_email(e, blocked_words, asset_extensions))
        return let(
            TX.section_heading(piece),
            lambda h: F.transform(valid, lambda e: F.struct(e.alias("email"), h.alias("heading"))),
        )

    return F.flatten(F.transform(pieces, of_piece))


def find_phones(text: Column) -> Column:
    """Plausible phone numbers of a text, distinct, in order of sight."""
    found = F.transform(
        F.regexp_extract_all(text_or_empty(text), F.lit(rules.PHONE_PATTERN), F.lit(1)), strip
    )
    return F.array_distinct(
        F.filter(
            found, lambda p: (F.length(p) >= 9) & ~contains_any(p, rules.PLACEHOLDER_DIGITS)
        )
    )


def find_profiles(text: Column) -> Column:
    """``struct(company, people, best)`` of the profile links in a text."""
    t = text_or_empty(text)
    found = _found(t, t.rlike(r"(?i)linkedin\.com/"), rules.PROFILE_PATTERN, 0)

    def split(links):
        company = F.get(F.filter(links, lambda l: F.lower(l).contains("/company/")), 0)
        people = F.filter(links, lambda l: ~F.lower(l).contains("/company/"))
        return F.struct(
            company.alias("company"),
            people.alias("people"),
            F.coalesce(company, F.get(people, 0)).alias("best"),
        )

    return let(F.array_distinct(found), split)


def mask_email(email: Column) -> Column:
    return F.regexp_replace(email, r"^(.).*(@.*)$", "$1***$2")


def mask_phone(phone: Column) -> Column:
    return F.regexp_replace(phone, r"\d(?=(?:\D*\d){2})", "*")
