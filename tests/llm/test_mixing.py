from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leadlode.llm import mixing
from leadlode.llm.common import word_count
from tests.llm.helpers import no_docs, odd_docs


def water(sizes: dict, weights: dict, most: int) -> dict:
    """Iterated: deal by weight, clamp, deal the rest again."""
    open_, target, left = dict(weights), {}, sum(sizes.values())
    while open_:
        over = [s for s, w in open_.items() if left * w / sum(open_.values()) > most * sizes[s]]
        if not over:
            return target | {s: left * w / sum(open_.values()) for s, w in open_.items()}
        s = min(over, key=lambda s: most * sizes[s] / weights[s])
        target[s] = float(most * sizes[s])
        left -= target[s]
        del open_[s]
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_iterated_clamping(spark, seed):
    rnd = random.Random(seed)
    names = [None, *(f"s{k:02d}" for k in range(9))]
    sizes = {n: rnd.choice([0, 3, 10, 100, 1000, 5000]) for n in names}
    order = sorted(names, key=lambda n: (n is None, n or ""))
    weights = {n: (1, 2, 3)[k % 3] for k, n in enumerate(order)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = water(sizes, weights, 3)
    assert got.keys() == want.keys()
    assert all(abs(got[n] - want[n]) < 1e-6 * max(1, want[n]) for n in names)


def test_taken_words_come_near_the_target(spark):
    rnd = random.Random(5)
    rows = [(k, "w " * min(3000, int(rnd.paretovariate(0.8))), rnd.choice("aaaaaabbc")) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix_sizes(docs).collect()
    assert sorted(first) == sorted(mixing.mix_sizes(docs.repartition(3)).collect())
    by = defaultdict(list)
    for r in first:
        by[r["source"]].append(r)
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 0.01 * rs[0]["source_size"] + 1
        assert max(r["copies"] for r in rs) - min(r["copies"] for r in rs) <= 1


def test_odd_rows_and_repeats(spark):
    docs = odd_docs(spark)
    sizes = mixing.mix_sizes(docs).collect()
    assert len(sizes) == docs.count()
    assert {r["doc_id"]: r["size"] for r in sizes if r["doc_id"] in (1, 2, 3, 4)} == {1: 0, 2: 0, 3: 0, 4: 120}
    twins = {r["copies"] for r in sizes if r["doc_id"] == 5}
    assert len(twins) == 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in sizes:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want
    assert mixing.mix(no_docs(spark)).count() == 0 and mixing.mix_sizes(no_docs(spark)).count() == 0


def test_word_count(evaluate):
    texts = [None, "", " \x0b", "a", " a  b\n", "a b", "é\tü"]
    assert evaluate(word_count(F.col("x")), texts) == [0, 0, 0, 1, 2, 1, 2]
