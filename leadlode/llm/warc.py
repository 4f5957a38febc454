"""WARC revisits: a "not modified" answer resolved to the full response it refers to.

Captures have ``record_id, url, ts`` (seconds), ``status, headers`` (a block of ``Name: value`` lines),
``payload_digest, payload_length``.  A capture with status 304 is resolved to the latest earlier full
response (status 200) of the same canonical URL: an as-of join.  Its validators must agree with that
response's: the entity tag if it has one (weak and strong forms compare alike), else the date of last
change.  Then the answer's headers overlay the response's, but for those that describe a body or a
connection, which a 304 may not change.

No window runs over all captures of a URL.  Captures are cut into ranges of time by quantiles; a table of
the last response of each URL and range gives what is carried into a range, and the order is only made
inside one.

Defined results: captures at the same second are ordered by record id; a 304 without an earlier response
is ``no_original``, without any validator ``no_validator``, with another one ``changed`` (all keep their
own headers and have no payload); other captures are ``full`` or ``other``; a null URL or time is never
matched; a header that is named twice counts with its last value; an empty table gives no rows.  Other
columns are kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlode.functions.common import let
from leadlode.llm.common import shared_table

#: Fields that a 304 may not change in a stored response, fixed by the HTTP caching rules.
KEPT_HEADERS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
#: Query parameters that name a visit and not a page.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
RANGES = 64


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query: no scheme, ``www.``, default port, fragment, tracking parameter or last slash."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    told = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.sort_array(told), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def parsed_headers(block: Column) -> Column:
    """``array<struct<name, value>>`` sorted by name, names in lower case, the last value of each."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.btrim(F.substring_index(x, ":", 1))).alias("name"),
            F.btrim(F.substr(x, F.instr(x, ":") + 1)).alias("value"),
        ),
    )
    return let(pairs, _last_of_each)


def _last_of_each(pairs: Column) -> Column:
    names = F.transform(pairs, lambda p: p["name"])
    return let(
        names,
        lambda n: F.sort_array(
            F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(n, i + 2, F.greatest(F.size(n) - i - 1, F.lit(0))), p["name"]))
        ),
    )


def header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), 0)["value"]


def merged_headers(base: Column, answer: Column, kept: Iterable[str] = KEPT_HEADERS) -> Column:
    """The response's headers overlaid with those of the answer that may change it."""
    may = F.filter(answer, lambda h: ~h["name"].isin(*kept))
    return let(may, lambda m: F.sort_array(F.concat(F.filter(base, lambda b: ~F.exists(m, lambda x: x["name"] == b["name"])), m)))


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")


def _tag(value: Column) -> Column:
    return F.regexp_replace(value, r"^W/", "")


def resolve_revisits(captures: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``row, canonical, outcome, refers_to, payload_digest, payload_length, headers`` of every capture.

    Runs jobs when called: the quantiles of time and the captures without their other columns.
    """
    rows = captures.select(
        F.struct("*").alias("row"),
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("canonical"),
        F.col("ts").cast("long").alias("ts"),
        F.col("status").cast("int").alias("status"),
        parsed_headers(F.col("headers")).alias("headers"),
        F.col("payload_digest").alias("digest"),
        F.col("payload_length").cast("long").alias("length"),
    )
    shares = [i / ranges for i in range(1, ranges)]
    times = captures.select(F.col("ts").cast("long").alias("ts"))
    cuts = sorted(set(times.approxQuantile("ts", shares, 0.002))) if shares else []
    part = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]).cast("array<long>"), lambda c: c < F.col("ts")))
    ready = shared_table(rows.withColumn("part", part))

    full = F.when(F.col("status") == 200, F.struct("ts", "record_id", "headers", "digest", "length"))
    findable = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    asked = ready.where(findable & F.col("status").isin(200, 304)).withColumn("full", full)
    last = asked.groupBy("canonical", "part").agg(F.max("full").alias("last"))
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select(
        F.col("canonical").alias("_canonical"), F.col("part").alias("_part"), "carried"
    )
    inside = Window.partitionBy("canonical", "part").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    met = asked.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where(F.col("status") == 304)
    based = met.join(carried, (F.col("canonical") == F.col("_canonical")) & (F.col("part") == F.col("_part"))).withColumn(
        "base", F.coalesce("near", "carried")
    )

    own_tag, own_date = header(F.col("headers"), "etag"), header(F.col("headers"), "last-modified")
    same = F.when(own_tag.isNotNull(), F.coalesce(_tag(own_tag) == _tag(header(F.col("base.headers"), "etag")), F.lit(False))).otherwise(
        F.coalesce(own_date == header(F.col("base.headers"), "last-modified"), F.lit(False))
    )
    outcome = (
        F.when(F.col("base").isNull(), "no_original")
        .when(own_tag.isNull() & own_date.isNull(), "no_validator")
        .when(same, "resolved")
        .otherwise("changed")
    )
    judged = based.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    revisits = judged.select(
        "row",
        "canonical",
        "outcome",
        F.when(done, F.col("base.record_id")).alias("refers_to"),
        F.when(done, F.col("base.digest")).alias("payload_digest"),
        F.when(done, F.col("base.length")).alias("payload_length"),
        header_text(F.when(done, merged_headers(F.col("base.headers"), F.col("headers"))).otherwise(F.col("headers"))).alias("headers"),
    )
    is_304 = F.coalesce(F.col("status") == 304, F.lit(False))
    others = ready.where(~(is_304 & findable)).select(
        "row",
        "canonical",
        F.when(is_304, "no_original").when(F.col("status") == 200, "full").otherwise("other").alias("outcome"),
        F.lit(None).cast("long").alias("refers_to"),
        F.when(~is_304, F.col("digest")).alias("payload_digest"),
        F.when(~is_304, F.col("length")).alias("payload_length"),
        header_text(F.col("headers")).alias("headers"),
    )
    return revisits.union(others)
