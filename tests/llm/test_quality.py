from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from leadlode.llm import quality
from tests.llm.helpers import WORDS, no_docs, odd_docs, prose


def repeated(words, size=5):
    wins = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    return len({i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(size)})


@pytest.mark.parametrize("seed", range(6))
def test_repeated_windows(spark, seed):
    rnd = random.Random(seed)
    rows = [([rnd.choice("abc"[: 1 + k % 3]) for _ in range(rnd.randrange(40))],) for k in range(30)]
    got = spark.createDataFrame(rows, "w array<string>").select("w", quality.repeated_window_words(F.col("w")).alias("n")).collect()
    assert all(r["n"] == repeated(r["w"]) for r in got)


def test_distance(spark):
    rows = [([3, 0, 1], [0.5, 0.25, 0.25]), ([1, 1, 2], [0.25, 0.25, 0.5]), ([4, 0, 0], [0.0, 0.0, 1.0]), ([0, 0, 0], [0.5, 0.5, 0.0])]
    df = spark.createDataFrame(rows, "n array<long>, q array<double>")

    def plain(n, q):
        if not sum(n):
            return None
        p = [x / sum(n) for x in n]
        return math.sqrt(sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True)) / 2)

    for r in df.select("*", quality.jensen_shannon(F.col("n"), F.col("q")).alias("d")).collect():
        want = plain(r["n"], r["q"])
        assert r["d"] is None if want is None else abs(r["d"] - want) < 1e-9


def test_junk_goes_and_clean_texts_stay(spark):
    rnd = random.Random(1)

    def sentence(lang, k):
        common = WORDS[lang][:4]
        return " ".join(rnd.choice(common) if rnd.random() < 0.5 else "".join(rnd.choices("abcdefghilmnorstu", k=6)) for _ in range(k))

    clean = [(k, sentence("en", 100), "en") for k in range(100)]
    symbols = [(200, " ".join(w + "%$#*" for w in sentence("en", 100).split()), "en")]
    listing = [(201, " | ".join("".join(rnd.choices("qxzjkv", k=7)) for _ in range(100)), "en")]
    short = [(202, "%% ## ** $$ || && <> %% ## aa bb", "en")]
    df = spark.createDataFrame(clean + symbols + listing + short, "doc_id long, text string, lang string")
    kept = {r["row"]["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert all(kept[k] for k in range(100)) and not kept[200] and not kept[201] and kept[202]


def test_texts_without_common_words_and_swapped_labels_go(spark):
    rnd = random.Random(5)

    def text(lang, k=200):
        common = WORDS[lang][:12]
        return " ".join(rnd.choice(common) if rnd.random() < 0.25 else "".join(rnd.choices("abcdefghilmnorstu", k=6)) for _ in range(k))

    others = [lang for lang in WORDS if lang != "en"][:1]
    rows = [(k, text("en"), "en") for k in range(80)] + [(100 + k, text(others[0]), others[0]) for k in range(80)]
    salad = [(300 + k, " ".join("".join(rnd.choices("abcdefghilmnorstu", k=6)) for _ in range(300)), "en") for k in range(3)]
    swapped = [(400 + k, text(others[0], 400), "en") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.references(docs)
    odd = spark.createDataFrame(salad + swapped, "doc_id long, text string, lang string")
    kept = {r["row"]["doc_id"]: r["kept"] for r in quality.judge(docs.union(odd), refs).collect()}
    assert all(kept[k] for k, *_ in rows) and not any(kept[k] for k, *_ in salad + swapped)


def test_empty_distance_is_that_of_no_common_word(spark):
    df = spark.createDataFrame([([0, 0, 9], [0.1, 0.3, 0.6])], "n array<long>, q array<double>")
    r = df.select(quality.jensen_shannon(F.col("n"), F.col("q")).alias("d"), quality.empty_distance(F.col("q")).alias("e")).first()
    assert abs(r["d"] - r["e"]) < 1e-12


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = {r["row"]["doc_id"]: r for r in quality.judge(docs).collect()}
    assert got[1]["n_words"] == got[3]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[4]["word_chars"] == len(re.sub(r"[\x20\x09-\x0D]", "", got[4]["row"]["text"])) and got[4]["row"]["size"] in (1, 7)
    assert got[8]["n_words"] == 16000 and got[9]["n_symbols"] == 0 and got[11]["n_words"] == 6
    assert quality.judge(no_docs(spark)).count() == 0


def test_plan_has_no_python(spark):
    plan = quality.judge(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
