from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from leadlode.llm import langid
from tests.llm.helpers import no_docs, odd_docs, prose


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, prose(k, lang, 60), lang) for k in range(60) for lang in ("en", "de")]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=40)


def test_several_centroids_of_length_one(model):
    assert sorted(set(model.languages)) == ["de", "en"] and len(model.languages) > 2
    assert abs((model.centroids**2).sum(axis=1) - 1).max() < 1e-5


def test_unseen_texts(model):
    for lang in ("en", "de"):
        for k in range(900, 940):
            assert model.judge([prose(k, lang, 30)])[0][0] == lang


def test_letterless_and_foreign_texts_are_rejected(model):
    out = model.judge([None, "", "12 !!", "Съешь ещё этих мягких французских булок", prose(1, "en", 5)])
    assert out[:3] == [("und", 0.0, True)] * 3
    assert out[3][2] and out[3][0] in ("en", "de") and not out[4][2]


def test_long_text_counts_do_not_depend_on_the_stretch(monkeypatch):
    text = prose(3, "de", 500)
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "STRETCH", 17)
    assert (langid.gram_counts(text) == whole).all()


def test_odd_rows(spark, model):
    docs = odd_docs(spark)
    got = docs.select("doc_id", "lang_pred", langid.language(model, F.col("text")).alias("found")).collect()
    assert len(got) == docs.count() and all(r["lang_pred"] == "p" for r in got)
    assert all(0 <= r["found"]["score"] <= 1 for r in got)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {4, 5, 6, 7, 8} <= ids and not {1, 2, 3, 9} & ids
    assert langid.keep_identified(no_docs(spark), model).count() == 0


def test_letters_of_all_planes(model):
    """Letters above U+20000 are letters; emoji are not."""
    out = model.judge(["\U00020000\U00020001\U0002a6d0", "\U0001f600 \U0001f680"])
    assert out[0][0] in ("en", "de") and out[1] == ("und", 0.0, True)


def test_scores_do_not_depend_on_the_batch(model):
    texts = [prose(k, "en" if k % 2 else "de", 5 + k) for k in range(74)]
    assert model.judge(texts) == [model.judge([t])[0] for t in texts]


def test_the_sample_reads_no_ids(spark):
    """Null and shared ids: every language is learned, from different texts, the same in each run."""
    rows = [(None if lang == "en" else 7, prose(k % 30, lang, 60), lang) for k in range(60) for lang in ("en", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = langid.train(docs, per_language=20), langid.train(docs.repartition(3), per_language=20)
    assert set(one.languages) == {"en", "de"} and (one.centroids == two.centroids).all()


def test_no_training_rows(spark):
    empty = langid.train(no_docs(spark))
    assert empty.judge(["some text"]) == [("und", 0.0, True)]


def test_held_out_is_a_third_by_id(spark):
    import zlib

    ids = spark.range(300).withColumnRenamed("id", "doc_id")
    got = {r[0]: r[1] for r in ids.select("doc_id", langid.held_out()).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in range(300)}


def test_long_salad_and_languages_not_learned_are_rejected(spark):
    """In Latin letters, against a model of running text with many words."""
    rnd, rows = random.Random(5), []
    for lang, parts in (("aa", "the ing er and on tion re st ly ou".split()), ("bb", "sch ein ung der ich ge en zu ver auf".split())):
        for k in range(120):
            text = " ".join("".join(rnd.choices(parts, k=rnd.randrange(1, 4))) for _ in range(rnd.choice([3, 10, 100, 400])))
            rows.append((2 * k + (lang == "bb"), text, lang))
    learned = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def salad(n):
        return " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(2, 9))) for _ in range(n))

    finnish = (
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
        "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    )
    out = learned.judge([salad(n) for n in (50, 300, 3000)] + [finnish])
    assert [r[2] for r in out] == [True] * 4, out
    assert [r[1] > langid.MIN_COSINE for r in out] == [True] * 4, "one cutoff for all lengths would keep them"
    assert not any(r[2] for r in learned.judge([t for _, t, _ in rows]))
