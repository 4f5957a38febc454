from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from leadlode.llm import lm_scoring
from tests.llm.helpers import no_docs, odd_docs, prose


def plain(docs, good, core, prior=50.0, word_prior=0.5):
    """Scores by the formula, every word in one table."""
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for k, t in docs}
    counts = Counter(w for t in words.values() for w in t)
    first = {w: i + 2 for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:core])}
    side, types = len(first) + 2, sum(1 for n in counts.values() if n > 1) + 1
    pairs = {k: Counter(zip([1, *(first.get(w, 0) for w in t)], [first.get(w, 0) for w in t], strict=False)) for k, t in words.items()}
    rare = {k: Counter(w for w in t if w not in first) for k, t in words.items()}
    size = {m: sum(len(words[k]) for k in ks) for m, ks in (("t", good), ("e", words))}
    out = {}
    for k in words:
        losses = []
        for ks, scale in ((good, 1.0), (list(words), size["t"] / size["e"] if size["t"] else 1.0)):
            c, r = (sum((x[j] for j in ks if j != k), Counter()) for x in (pairs, rare))
            total = c.total() * scale
            loss = 0.0
            for (v, w), n in pairs[k].items():
                of_w, of_v = (scale * sum(m for p, m in c.items() if p[at] == x) for at, x in ((1, w), (0, v)))
                loss -= n * math.log2((c[v, w] * scale + prior * (of_w + prior / side) / (total + prior)) / (of_v + prior))
            for w, n in rare[k].items():
                loss -= n * math.log2((r[w] * scale + word_prior) / (r.total() * scale + word_prior * types))
            losses.append(loss / len(words[k]))
        out[k] = losses
    return out


@pytest.mark.parametrize("share", [1, 30, 1 << 17])
def test_scores_equal_a_plain_version(spark, share):
    """Whichever words are sent to the tasks, the scores are the same."""
    long = "x" * 70
    docs = [(k, prose(k, "en" if k % 3 else "de", 50) + ("" if k % 2 else f" Rare{k % 8} only{k} {long}")) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    good = [(k,) for k in range(40) if k % 3]
    targets = spark.createDataFrame(good + good, "doc_id long")
    models = lm_scoring.train(df, targets, core=20, share=share)
    got = {r["row"]["doc_id"]: r for r in lm_scoring.score(df, targets, models).collect()}
    for k, (a, b) in plain(docs, [g[0] for g in good], 20).items():
        assert got[k]["n_tokens"] == len(docs[k][1].split())
        assert abs(got[k]["target_loss"] - a) < 1e-5 and abs(got[k]["background_loss"] - b) < 1e-5
        assert abs(got[k]["score"] - (a - b)) < 1e-5
    assert max(got[k]["score"] for k, in good) < min(got[k]["score"] for k in range(0, 40, 3))


def test_the_vocabulary_grows_with_the_corpus(spark):
    """Words outside the core tell documents apart, however rare: a text known elsewhere from one of new words."""
    docs = [(k, prose(k, "en", 30) + " " + " ".join(f"w{k if k != 9 else 8}x{i}" for i in range(20))) for k in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    targets = spark.createDataFrame([(1,), (8,)], "doc_id long")
    models = lm_scoring.train(df, targets, core=10, word_prior=0.01)
    got = {r["row"]["doc_id"]: r for r in lm_scoring.score(df, targets, models).collect()}
    assert models.types == 20 + 1 + len({w for _, t in docs for w in t.split() if not w.startswith("w") or "x" not in w})
    assert max(got[8]["background_loss"], got[9]["background_loss"]) + 1 < min(got[k]["background_loss"] for k in range(8))
    assert got[9]["target_loss"] + 1 < got[8]["target_loss"]  # document 8 is a target, and its own words are left out


def test_odd_rows(spark):
    docs = odd_docs(spark)
    targets = spark.createDataFrame([(4,), (None,), (99,)], "doc_id long")
    models = lm_scoring.train(docs, targets)
    got = lm_scoring.score(docs, targets, models, keep=tuple(docs.columns)).collect()
    assert len(got) == docs.count()
    by = {r["row"]["doc_id"]: r for r in got}
    assert by[8]["row"]["key"] == "k" and by[8]["row"]["row"] == "r"
    assert by[1]["n_tokens"] == by[3]["n_tokens"] == 0 and by[2]["score"] is None
    assert by[8]["n_tokens"] == 16000 and by[5]["score"] < by[6]["score"]


def test_no_targets_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    models = lm_scoring.train(odd_docs(spark), none)
    assert all(math.isfinite(r["score"]) for r in lm_scoring.score(odd_docs(spark), none, models).collect() if r["n_tokens"])
    empty = lm_scoring.train(no_docs(spark), none)
    assert lm_scoring.score(no_docs(spark), none, empty).count() == 0


def plain_pairs(docs, good, core, prior=50.0, word_prior=0.5):
    """Scores by the formula with a context for every word, every pair in one table."""
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for k, t in docs}
    counts = Counter(w for t in words.values() for w in t)
    first = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:core]}
    side, types = len(first) + 2, sum(1 for n in counts.values() if n > 1) + 1
    pairs = {k: Counter(zip([None, *t], t, strict=False)) for k, t in words.items()}
    size = {m: sum(len(words[k]) for k in ks) for m, ks in (("t", good), ("e", words))}
    out = {}
    for k in words:
        losses = []
        for ks, scale in ((good, 1.0), (list(words), size["t"] / size["e"] if size["t"] else 1.0)):
            c = sum((pairs[j] for j in ks if j != k), Counter())
            of_v, of_w = Counter(), Counter()
            for (v, w), n in c.items():
                of_v[v] += n * scale
                of_w[w] += n * scale
            total, others = of_w.total(), sum(n for w, n in of_w.items() if w not in first)

            def share(w, total=total, others=others, of_w=of_w):
                if w in first:
                    return (of_w[w] + prior / side) / (total + prior)
                return (others + prior / side) / (total + prior) * (of_w[w] + word_prior) / (others + word_prior * types)

            losses.append(-sum(n * math.log2((c[v, w] * scale + prior * share(w)) / (of_v[v] + prior)) for (v, w), n in pairs[k].items()) / len(words[k]))
        out[k] = losses
    return out


@pytest.mark.parametrize(("core", "bucket_pairs", "gathered"), [(20, 300, 200), (0, 1 << 20, 1 << 20), (20, 50, 1 << 20), (1024, 100, 1)])
def test_pair_scores_equal_a_plain_version(spark, core, bucket_pairs, gathered):
    """Every word is a context of its own, whichever are in the core and however the pairs are dealt."""
    long = "x" * 70
    docs = [(k, prose(k % 30, "en" if k % 3 else "de", 50) + ("" if k % 2 else f" Rare{k % 8} only{k} {long} Rare{k % 8} tail")) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    good = [(k,) for k in range(40) if k % 3]
    targets = spark.createDataFrame(good + good, "doc_id long")
    models = lm_scoring.train(df, targets, core=core)
    got = {r["row"]["doc_id"]: r for r in lm_scoring.score_pairs(df, targets, models, ("doc_id",), bucket_pairs, gathered).collect()}
    for k, (a, b) in plain_pairs(docs, [g[0] for g in good], core).items():
        assert got[k]["n_tokens"] == len(docs[k][1].split())
        assert abs(got[k]["target_loss"] - a) < 1e-5 and abs(got[k]["background_loss"] - b) < 1e-5
        assert abs(got[k]["score"] - (a - b)) < 1e-5


def test_pairs_of_rare_words_are_told_apart(spark):
    """The same rare words in another order: only their pairs tell which text is known."""
    known = [f"w{i}" for i in range(40)]
    filler = [(k, prose(k, "en", 30)) for k in range(2, 12)]
    docs = [(0, " ".join(known)), (1, " ".join(known)), (20, " ".join(known[::2] + known[1::2][::-1])), *filler]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    targets = spark.createDataFrame([(1,)], "doc_id long")
    models = lm_scoring.train(df, targets, core=5, prior=1.0)
    got = {r["row"]["doc_id"]: r["target_loss"] for r in lm_scoring.score_pairs(df, targets, models).collect()}
    shared = {r["row"]["doc_id"]: r["target_loss"] for r in lm_scoring.score(df, targets, models).collect()}
    assert got[0] + 1 < got[20] and abs(shared[0] - shared[20]) < 0.1


def test_pair_scores_of_odd_rows(spark):
    docs = odd_docs(spark)
    targets = spark.createDataFrame([(4,), (None,), (99,)], "doc_id long")
    got = lm_scoring.score_pairs(docs, targets, lm_scoring.train(docs, targets), keep=tuple(docs.columns)).collect()
    assert len(got) == docs.count()
    by = {r["row"]["doc_id"]: r for r in got}
    assert by[8]["row"]["key"] == "k" and by[8]["row"]["row"] == "r"
    assert by[1]["n_tokens"] == by[3]["n_tokens"] == 0 and by[2]["score"] is None and by[8]["n_tokens"] == 16000
    none = spark.createDataFrame([], "doc_id long")
    assert all(math.isfinite(r["score"]) for r in lm_scoring.score_pairs(docs, none, lm_scoring.train(docs, none)).collect() if r["n_tokens"])
    assert lm_scoring.score_pairs(no_docs(spark), none, lm_scoring.train(no_docs(spark), none)).count() == 0
