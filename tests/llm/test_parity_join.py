from __future__ import annotations

import random

import numpy as np
import pytest

from leadlode.llm import parity_join as PJ
from tests.llm.helpers import no_docs, odd_docs, odd_rows

COLUMNS = ["doc_id", "n_shingles", "component_id", "n_links"]


def word_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def brute(docs):
    sets = [word_set(t) for _, t in docs]
    near = [
        [j for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 90 * len(a | b)] for i, a in enumerate(sets)
    ]
    out = []
    for i, (doc_id, _) in enumerate(docs):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [docs[j][0] for j in seen if docs[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None, len(near[i])))
    return sorted(out, key=str)


def rows(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


def families():
    """Texts of many sizes with variants on both sides of the limit, chains of them, and copies."""
    rnd, docs = random.Random(11), []
    for _ in range(60):
        base = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(rnd.choice([1, 2, 3, 9, 19, 20, 30, 60, 150, 400]))]
        docs.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            other = list(base) if rnd.random() < 0.5 else docs[-1].split()
            for _ in range(rnd.randrange(1 + len(other) // 40)):
                at = rnd.randrange(len(other))
                other[at : at + rnd.randrange(2)] = [rnd.choice(["new", "word"])]
            other += ["tail"] * rnd.randrange(1 + len(other) // 12)
            docs.append(" ".join(other).upper() if rnd.random() < 0.1 else " ".join(other))
    return [(k, t) for k, t in enumerate(docs)] + [(500, docs[3]), (None, docs[3]), (7, docs[9]), (501, None), (502, " "), (None, "")]


@pytest.mark.parametrize("chunk", [1 << 19, 300])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(PJ.verified, "__defaults__", (3, 90, chunk))
    monkeypatch.setattr(PJ.counted_links, "__defaults__", (3, 90, chunk, 7))
    docs = families()
    want = brute(docs)
    assert 40 < sum(n > 0 for *_, n in want) < len(want) - 20
    assert rows(PJ.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == want


def test_large_group_of_near_copies(spark):
    """300 texts of one stem, each with a word of its own: all pairs are links, but no pairs are emitted."""
    stem = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join([*stem[: k % 200], f"own{k}", *stem[k % 200 :]])) for k in range(300)]
    found = PJ.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(found) == brute(docs)
    told = PJ.told_sets(spark.createDataFrame(docs, "doc_id long, text string"))
    assert PJ.linked_classes(spark.createDataFrame(docs, "doc_id long, text string"), told)[1].count() < 40 * len(docs)


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(5)
    for size in (19, 40, 333, 5000):
        for _ in range(20):
            a = rnd.integers(0, 1 << 63, size, dtype=np.uint64)
            b = np.concatenate((a[rnd.integers(0, 6) :], rnd.integers(0, 1 << 63, rnd.integers(0, 1 + size // 10), dtype=np.uint64)))
            a, b = np.unique(a), np.unique(b)
            words = PJ.bands(size)[0][1]
            differing = int(np.bitwise_count(PJ.sketch(a, words) ^ PJ.sketch(b, words)).sum())
            assert differing <= len(np.setxor1d(a, b))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 90 * (len(a) + len(b) - common) and len(a) != common:
                assert np.isin(PJ.keys_of(a), PJ.keys_of(b)).any()


def test_linked_sizes_share_a_band():
    for a in range(1, 3000):
        for b in range(a, a * 100 // 90 + 1):
            if most := 10 * (a + b) // 190:
                met = dict(PJ.bands(a)).items() & dict(PJ.bands(b)).items()
                assert any(words > most for _, words in met), (a, b)


def test_odd_rows(spark):
    assert rows(PJ.jaccard_join(odd_docs(spark))) == brute([r[:2] for r in odd_rows()])


def test_empty_table(spark):
    found = PJ.jaccard_join(no_docs(spark))
    assert found.columns == COLUMNS and found.count() == 0
