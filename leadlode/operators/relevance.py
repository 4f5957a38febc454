"""Two-document TF-IDF cosine between a profile and each text.

With a corpus of two, a token of both documents weighs 1 and a token of one
weighs ln(1.5) + 1, so every text is scored on its own row: no shuffle, and the
sums are integers until the last step.

``profile_matches`` scores the texts against a table of profiles.  A score of ``min_score`` needs a certain share of
a profile's squared counts among the shared tokens, so each profile is indexed by its rarest tokens only: those
whose tail, up to the commonest, still holds that share.  Pairs that meet in the index are bounded by what they
met in and the rest of the profile, and only pairs within reach are scored, exactly.  One join gives both: a shared
token adds to the bound, if it is indexed, and to the sums of the score, so no text is read again for each of its pairs.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadlode.functions.common import let, strip, text_or_empty
from leadlode.session import drop_shared, write_shared

TOKEN = r"[\p{L}\p{N}_]{2,}"
LONE_WEIGHT = math.log(1.5) + 1.0
NEUTRAL = 0.5
#: Rows at which texts and profiles meet that one task reads at most, about, and the most tasks made for that.
TASK_ROWS = 1 << 23
MOST_TASKS = 1 << 13


def spark_stop_words(spark: SparkSession, language: str = "english") -> list[str]:
    """Spark's own stop-word list."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords(language))


def profile_counts(profile: str, stop_words=()) -> dict[str, int]:
    """Token counts of the (single, short) profile text."""
    stop = set(stop_words)
    return dict(Counter(t for t in re.findall(r"\w{2,}", profile.lower()) if t not in stop))


def _tokens(text: Column, stop_words) -> Column:
    found = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(TOKEN), F.lit(0))
    stop_words = list(stop_words)
    return F.filter(found, lambda t: ~t.isin(stop_words)) if stop_words else found


def token_counts(text: Column, stop_words=()) -> Column:
    """``array<struct(token, n)>`` of a text: sort, then measure each run."""

    def runs(s):
        starts = F.filter(
            F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        n = F.size(s)
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda a, j: F.struct(
                    F.get(s, a).alias("token"),
                    (F.coalesce(F.get(at, j + 1), n) - a).cast("bigint").alias("n"),
                ),
            ),
        )

    return let(F.sort_array(_tokens(text, stop_words)), runs)


def relevance_score(
    docs: DataFrame,
    profile: str,
    stop_words=(),
    id_col: str = "doc_id",
    text_col: str = "text",
    digits: int | None = 3,
) -> DataFrame:
    """``id, score`` of every text against the profile."""
    wanted = profile_counts(profile, stop_words)
    text = F.col(text_col)
    d = docs.select(
        id_col,
        (strip(text_or_empty(text)) == "").alias("blank"),
        token_counts(text, stop_words).alias("counts"),
    )

    words = sorted(wanted)
    shared = F.filter("counts", lambda c: c["token"].isin(words)) if words else F.slice("counts", 1, 0)
    d = d.select(id_col, "blank", "counts", shared.alias("shared"))
    weights = [x for w in words for x in (F.lit(w), F.lit(wanted[w]).cast("bigint"))]
    weight = F.create_map(*weights) if words else F.lit(None).cast("map<string,bigint>")

    def total(entries, of):
        return F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, c: acc + of(c))

    def in_profile(c):
        return F.element_at(weight, c["token"])

    d = d.select(
        id_col,
        "blank",
        F.size("counts").alias("n_tokens"),
        total("counts", lambda c: c["n"] * c["n"]).alias("all_doc"),
        total("shared", lambda c: c["n"] * c["n"]).alias("both_doc"),
        total("shared", lambda c: c["n"] * in_profile(c)).alias("dot"),
        total("shared", lambda c: in_profile(c) * in_profile(c)).alias("both_profile"),
    )
    w2 = F.lit(LONE_WEIGHT * LONE_WEIGHT)
    all_profile = F.lit(sum(n * n for n in wanted.values())).cast("bigint")
    doc_norm = F.sqrt(F.col("both_doc") + (F.col("all_doc") - F.col("both_doc")) * w2)
    profile_norm = F.sqrt(F.col("both_profile") + (all_profile - F.col("both_profile")) * w2)
    score = (
        F.when(F.col("blank") | ((F.col("n_tokens") == 0) & F.lit(not wanted)), F.lit(NEUTRAL))
        .when((F.col("n_tokens") == 0) | F.lit(not wanted), F.lit(0.0))
        .otherwise(F.col("dot") / (doc_norm * profile_norm))
    )
    return d.select(id_col, (score if digits is None else F.round(score, digits)).alias("score"))


def _square_sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"] * c["n"])


def needed_share(min_score: float) -> float:
    """The least share of a profile's squared counts that a text of this score has in common with it."""
    t2, w2 = min_score * min_score, LONE_WEIGHT * LONE_WEIGHT
    return t2 * w2 / (1 - t2 + t2 * w2) * (1 - 1e-9)


def weighed_tokens(profile_tokens: DataFrame, frequencies: DataFrame, min_score: float) -> DataFrame:
    """The profiles' tokens that some text has, with ``indexed``, ``reach`` and ``least``.

    A match must have one of the indexed tokens; ``reach`` is the squared count of those left out, ``least`` what a
    match has of them all.
    """
    seen = profile_tokens.join(frequencies, "token")
    rarest = Window.partitionBy("_p").orderBy("df", "token")
    tail = F.sum(F.col("m") * F.col("m")).over(rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    told = seen.withColumn("tail", tail).withColumn("least", F.col("mass") * needed_share(min_score))
    told = told.withColumn("left_out", F.when(F.col("tail") < F.col("least"), F.col("tail")))
    told = told.withColumn("reach", F.coalesce(F.max("left_out").over(Window.partitionBy("_p")), F.lit(0)))
    return told.select("_p", "token", "m", "mass", "reach", "least", F.col("left_out").isNull().alias("indexed"))


def profile_index(profile_tokens: DataFrame, frequencies: DataFrame, min_score: float) -> DataFrame:
    """``_p, token, m, reach, least`` of the tokens a match must have one of."""
    return weighed_tokens(profile_tokens, frequencies, min_score).where("indexed").select("_p", "token", "m", "reach", "least")


def profile_matches(
    docs: DataFrame,
    profiles: DataFrame,
    min_score: float = 0.1,
    stop_words=(),
    id_col: str = "doc_id",
    text_col: str = "text",
    profile_col: str = "profile_id",
    profile_text_col: str = "profile",
    digits: int | None = 3,
) -> DataFrame:
    """``profile, id, score`` of every text and profile that score ``min_score`` or more.

    Scores equal ``relevance_score``'s.  A text or profile without tokens matches none: its score is one constant
    for all partners.  Ids are taken to be unique; rows with a null id or null profile id match none.  Runs jobs when called.
    """
    if not 0 < min_score <= 1:
        raise ValueError("min_score must be above 0 and at most 1")

    spark, folders = docs.sparkSession, []

    def written(rows: DataFrame) -> DataFrame:
        told, folder = write_shared(rows)
        folders.append(folder)
        return told

    def counted(rows: DataFrame, key: str, text: str, names: tuple[str, str, str]) -> DataFrame:
        """A row for each token.  The counts are written first: a filter or sum over them would cut the texts again."""
        told = written(rows.where(F.col(key).isNotNull()).select(F.col(key).alias(names[0]), token_counts(F.col(text), stop_words).alias("counts")))
        told = told.withColumn(names[1], _square_sum(F.col("counts"))).select(names[0], names[1], F.explode("counts").alias("c"))
        return told.select(names[0], names[1], F.col("c.token").alias("token"), F.col("c.n").alias(names[2]))

    of_profile = written(counted(profiles, profile_col, profile_text_col, ("_p", "mass", "m")))
    # Of a text only the tokens that some profile has go on; its squared counts are of them all.
    of_text = counted(docs, id_col, text_col, ("_d", "all_doc", "n"))
    of_text = written(of_text.join(of_profile.select("token").distinct(), "token", "left_semi"))
    frequencies = of_text.groupBy("token").agg(F.count("*").alias("df"))
    index = written(weighed_tokens(of_profile, frequencies, min_score))

    # A text's tokens stay in one task, so its sums per profile are not shuffled.  The number of tasks only bounds what one holds.
    meet = of_text.join(index.groupBy("token").agg(F.count("*").alias("with")), "token").agg(F.sum("with")).first()[0] or 0
    tasks = max(min(-(-meet // TASK_ROWS), MOST_TASKS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    n, m = F.col("n"), F.col("m")
    both = of_text.repartition(tasks, "_d").join(index, "token").groupBy("_d", "_p").agg(
        F.first("all_doc").alias("all_doc"), F.first("mass").alias("mass"), F.sum(n * m).alias("dot"),
        F.sum(n * n).alias("both_doc"), F.sum(m * m).alias("both_profile"),
        F.sum(F.when(F.col("indexed"), m * m)).alias("met"), F.first("reach").alias("reach"), F.first("least").alias("least"),
    )
    both = both.where(F.col("met") + F.col("reach") >= F.col("least"))
    w2 = F.lit(LONE_WEIGHT * LONE_WEIGHT)
    norms = [F.sqrt(F.col(b) + (F.col(a) - F.col(b)) * w2) for b, a in (("both_doc", "all_doc"), ("both_profile", "mass"))]
    score = F.col("dot") / (norms[0] * norms[1])
    done, _ = write_shared(
        both.select(F.col("_p").alias(profile_col), F.col("_d").alias(id_col), score.alias("score")).where(F.col("score") >= min_score)
    )
    for folder in folders:
        drop_shared(spark, folder)
    return done if digits is None else done.withColumn("score", F.round("score", digits))
