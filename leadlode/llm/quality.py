"""Quality rules by distribution divergence, in DataFrame functions only.

A document is compared with references of its language: the histogram of its character classes
and that of the language's commonest words (and all others together), each by Jensen-Shannon
distance.  A document without any of the common words is at a distance that follows from their share alone
(0.34 for words that are a fifth of all); who comes within ``MAX_EMPTY_SHARE`` of it is not in the language, be it letter
salad, a list or a text under a wrong label.  The references are counted over all documents of the language.  Documents with fewer
words than ``MIN_WORDS`` or with a language without reference are not judged by distance, since
small histograms are far from everything.

Basic counts come with it: words, symbols, repeated lines and words in repeated five-word windows.

Defined results: null texts have no words; blank texts too; documents with a null language are
judged by the basic rules only; equal texts of one language get equal rows; words that tie for the
last place of a reference are taken in code-point order; an empty table gives no rows.  Other
columns are untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlode.functions.common import let
from leadlode.llm.common import BLANK_RUN, BLANKS, shared_table, words

WINDOW = 5
COMMON_WORDS = 16
MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.42
#: Of the distance that a document without any common word has: texts nearer to that than to the language go.
MAX_EMPTY_SHARE = 0.9
SYMBOLS = "#*$%&|<>"
#: Character classes, each counted in what the ones before have left over.
CLASSES = (
    ("lower", r"[a-z]+"),
    ("blank", BLANK_RUN),
    ("upper", r"[A-Z]+"),
    ("digit", r"[0-9]+"),
    ("point", r"[.,;:!?'\"()\-]+"),
    ("letter", r"\p{L}+"),
)


def repeated_window_words(found: Column, size: int = WINDOW) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more, from the array of words."""

    def windows(h: Column) -> Column:
        of = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))
        return F.slice(of, 1, F.greatest(F.size(h) - (size - 1), F.lit(0)))

    def places(in_order: Column) -> Column:
        def again(x, i):
            return (F.get(in_order, i - 1)["h"] == x["h"]) | (F.get(in_order, i + 1)["h"] == x["h"])

        return F.sort_array(F.transform(F.filter(in_order, lambda x, i: F.coalesce(again(x, i), F.lit(False))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        own = F.transform(at, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - x, F.lit(size))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(some, let(pairs, lambda s: let(places(s), covered))).otherwise(F.lit(0).cast("long"))

    return let(F.transform(found, lambda x: F.xxhash64(x)), lambda h: let(windows(h), count))


def profile(docs: DataFrame) -> DataFrame:
    """``row, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, lowered`` of each document."""
    rows = docs.select(F.struct("*").alias("row"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    found = rows.withColumn("w", words(F.col("t"))).withColumn("n_chars", F.length("t")).withColumn("left", F.col("t"))
    for name, pattern in CLASSES:
        found = found.withColumn("rest", F.regexp_replace("left", pattern, "")).select(
            *[c for c in found.columns if c != "left"],
            (F.length("left") - F.length("rest")).cast("long").alias(f"n_{name}"),
            F.col("rest").alias("left"),
        )
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return found.select(
        "row",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("n_blank")).cast("long").alias("word_chars"),
        (F.length("left") - F.length(F.translate("left", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).alias("n_repeat_words"),
        F.array(*[F.col(f"n_{name}") for name, _ in CLASSES], F.length("left").cast("long")).alias("classes"),
        words(F.lower("t")).alias("lowered"),
    )


def references(docs: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """``ref_lang, classes_q, ref_words, words_q``: one row per language, shares that sum to one."""
    told = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("left"))
    counts = told.withColumn("all", F.length("left"))
    for name, pattern in CLASSES:
        counts = counts.withColumn("rest", F.regexp_replace("left", pattern, "")).select(
            *[c for c in counts.columns if c != "left"],
            (F.length("left") - F.length("rest")).alias(f"n_{name}"),
            F.col("rest").alias("left"),
        )
    names = [f"n_{name}" for name, _ in CLASSES]
    sums = counts.groupBy("lang").agg(*[F.sum(n).alias(n) for n in names], F.sum(F.length("left")).alias("other"), F.sum("all").alias("all"))
    classes = sums.select("lang", F.array(*[F.col(n) / F.col("all") for n in [*names, "other"]]).alias("classes_q"))

    each = told.select("lang", F.explode(words(F.lower("left"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    each = shared_table(each)
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = each.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= common)
    total = each.groupBy("lang").agg(F.sum("n").alias("all"))
    lists = (
        top.groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "word", "n"))).alias("top"), F.sum("n").alias("topped"))
        .join(total, "lang")
        .select(
            F.col("lang").alias("_lang"),
            F.col("top.word").alias("ref_words"),
            F.concat(F.transform("top", lambda x: x["n"] / F.col("all")), F.array((F.col("all") - F.col("topped")) / F.col("all"))).alias("words_q"),
        )
    )
    return classes.join(lists, F.col("lang") == F.col("_lang")).select(F.col("lang").alias("ref_lang"), "classes_q", "ref_words", "words_q")


def jensen_shannon(counts: Column, shares: Column) -> Column:
    """Distance (0 to 1) of a histogram of counts from one of shares; null for an empty one."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def part(p, q):
        m = (p + q) / F.lit(2.0)
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    def distance(n):
        parts = F.zip_with(counts, shares, lambda c, q: part(c / n, q))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.lit(2.0)))

    return let(total, lambda n: F.when(n > 0, distance(n)))


def empty_distance(shares: Column) -> Column:
    """Distance of a document without common words, from shares whose last is that of all other words."""
    rest = F.element_at(shares, -1)
    return F.sqrt((1 - rest + F.log2(2 / (1 + rest)) + rest * F.log2(2 * rest / (1 + rest))) / 2)


def judge(
    docs: DataFrame,
    refs: DataFrame | None = None,
    min_words: int = MIN_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    max_empty_share: float = MAX_EMPTY_SHARE,
) -> DataFrame:
    """``row``, the counts, ``base_failed, class_distance, word_distance, kept`` of every document.

    ``refs`` are counted over the documents themselves, in jobs of their own, if not given.
    """
    refs = shared_table(references(docs)) if refs is None else refs
    found = profile(docs).join(refs, F.col("lang") == F.col("ref_lang"), "left")
    common = F.filter("lowered", lambda w: F.array_contains("ref_words", w))
    hits = let(common, lambda c: F.transform("ref_words", lambda r: (F.size(c) - F.size(F.array_remove(c, r))).cast("long")))
    counted = found.withColumn("hits", hits).withColumn(
        "spread", F.concat("hits", F.array(F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x)))
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = counted.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        jensen_shannon(F.col("classes"), F.col("classes_q")).alias("class_distance"),
        jensen_shannon(F.col("spread"), F.col("words_q")).alias("word_distance"),
        (empty_distance(F.col("words_q")) * max_empty_share).alias("empty"),
    )
    # A language of nothing but its common words has no rest, and 0 * log2(0) no value.
    words_near = (F.col("word_distance") <= max_word_distance) & F.coalesce(F.col("word_distance") <= F.col("empty"), F.lit(True))
    near = (F.col("class_distance") <= max_class_distance) & words_near
    good = (F.col("n_words") < min_words) | F.coalesce(near, F.lit(True))
    return measured.withColumn("kept", ~F.col("base_failed") & good).drop("empty")
