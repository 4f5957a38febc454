from __future__ import annotations

import random
import re

import numpy as np
import pytest

from leadlode.llm import substring
from tests.llm.helpers import no_docs, odd_docs, prose


def expected(docs, window=20):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        stay = [True] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                stay[s : s + window] = [False] * window
            seen.add(k)
        out[i] = (len(w), stay.count(False), " ".join(x for x, y in zip(w, stay, strict=True) if y))
    return out


@pytest.mark.parametrize("hot", [1, 6, 1000])
def test_equals_brute_force(spark, hot):
    rnd = random.Random(hot)
    shared = [prose(k, "en", rnd.randrange(15, 60)) for k in range(6)]
    docs = [
        (k, " ".join(x for _ in range(3) for x in (prose(1000 + 7 * k, "de", rnd.randrange(30)), rnd.choice(shared)))) for k in range(50)
    ] + [(200 + k, " ".join(rnd.choice("ab") for _ in range(90))) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(df, hot=hot).collect()}
    assert got == expected(docs)


def test_automaton_matching_statistics():
    rnd = random.Random(2)
    known = substring.Automaton()
    texts = [[rnd.randrange(3) for _ in range(40)] for _ in range(5)]
    for t in texts:
        known.add(t)
    query = [rnd.randrange(4) for _ in range(60)]
    there = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    want = [max((n for n in range(e + 1) if n == 0 or tuple(query[e - n : e]) in there), default=0) for e in range(1, len(query) + 1)]
    assert list(known.statistics(query)) == want


def test_equal_windows_have_equal_minimizers(monkeypatch):
    a, b = prose(1, "en", 80).split(), prose(2, "en", 60).split()
    text = " ".join(b[:30] + a[10:50] + b[30:])
    x, y = substring.word_hashes(" ".join(a)), substring.word_hashes(text)
    assert (x[10:50] == y[30:70]).all()

    def shard(words):
        h, first, last = substring.pieces(words, 20, 8)
        return {s: int(m) for m, f, e in zip(h, first, last, strict=True) for s in range(f, e + 1)}

    one, two = shard(x), shard(y)
    assert len(one) == len(x) - 19 and all(one[10 + k] == two[30 + k] for k in range(21))
    monkeypatch.setattr(substring, "STRETCH", 11)
    assert (substring.word_hashes(text) == y).all()
    assert len(np.unique(substring.word_hashes(" ".join(map(str, range(5000)))))) == 5000


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = substring.remove_repeats(docs).collect()
    got = {(r["row"]["doc_id"], r["row"]["source"]): r for r in rows}
    assert len(rows) == docs.count()
    assert got[1, "a"]["kept"] == "" and got[3, "b"]["n_words"] == 0 and got[10, "a"]["kept"] == "word"
    assert got[4, "a"]["n_removed"] == 0 and got[5, "b"]["n_removed"] == 120 and got[7, "c"]["n_removed"] == 119
    assert got[8, "c"]["n_words"] == 16000 and got[None, "a"]["n_removed"] == 0
    assert substring.remove_repeats(no_docs(spark)).count() == 0
