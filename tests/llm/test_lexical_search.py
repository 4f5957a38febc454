from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from leadlode.llm import lexical_search as LS
from tests.llm.helpers import no_docs, odd_docs, odd_rows

ITEMS = "item_id long, text string, rank string, terms string, score string"


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=10):
    told = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, n_words = len(told), sum(c.total() for _, c in told)
    df = Counter(t for _, c in told for t in c)
    out = []
    for item_id, wanted in {(i, tuple(sorted(set(terms(t))))) for i, t in items}:
        scores = []
        for doc_id, c in told:
            m = 10 + 90 * c.total() * n_docs // n_words
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in wanted if t in c
            )
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


@pytest.mark.parametrize("stretch,block", [(1 << 20, 1 << 22), (40, 60)])
def test_equals_brute_force(spark, monkeypatch, stretch, block):
    rnd = random.Random(3)
    weighted = [f"w{int(40 * rnd.random() ** 3)}" for _ in range(4000)]
    docs = [(k // 2, " ".join(rnd.choices(weighted, k=rnd.randrange(1, 30)))) for k in range(400)]
    docs += [(900 + k, docs[5][1]) for k in range(30)] + [(None, docs[7][1]), (None, docs[5][1]), (1000, "W1, w2;É w39")]
    items = [(k, " ".join(rnd.choices(weighted, k=9))) for k in range(12)]
    items += [(None, "w1 w1 É"), (50, None), (51, " .,"), (52, "nowhere"), (3, items[3][1]), (4, "w30 w2")]
    monkeypatch.setattr(LS, "POSTINGS", stretch)
    got = LS.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert rows(got) == brute(docs, items)


def test_odd_rows(spark):
    items = [(1, "The little river", *"abc"), (2, "straße und ß", *"abc"), (None, None, *"abc"), (3, "12 emoji", *"abc")]
    got = LS.search(odd_docs(spark), spark.createDataFrame(items, ITEMS))
    assert rows(got) == brute([r[:2] for r in odd_rows()], [i[:2] for i in items])


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "river", *"abc")], ITEMS)
    assert LS.search(no_docs(spark), some).count() == 0
    none = LS.search(odd_docs(spark), some.limit(0))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0


def test_long_texts_are_read_in_stretches(monkeypatch):
    text = ("Ab cd-ef " * 500).encode()
    want = [t.encode() for t in terms(text.decode())]
    monkeypatch.setattr(LS, "STRETCH", 7)
    assert [t for run in LS.term_runs(text) for t in run] == want


def test_accumulators_are_limited():
    """A common term gives no accumulators once ten documents of the rare one are ahead of its bound."""
    class Watched(LS.Best):
        def add(self, score, doc, none):
            self.seen = len(score)
            super().add(score, doc, none)

    n = 1000
    at = np.concatenate((np.arange(20), np.arange(n)))
    term = np.concatenate((np.zeros(20, np.int64), np.ones(n, np.int64)))
    share = np.where(term == 0, 1000 + at, 7)
    top = Watched(10)
    LS.score_stretch([np.array([0, 1])], [top], np.arange(n), np.zeros(n, bool), at, term, share, 2)
    assert top.seen == 10 and top.score.tolist() == [1026 - i for i in range(10)]
