from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadlode.llm import simhash
from tests.llm.helpers import no_docs, odd_docs, prose


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two THREE", prose(1, "de", 40), "ÄÖ ü ẞ x y", "a b c d " * 9])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint(text) == plain(text)
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert simhash.fingerprint(text) == plain(text)


def test_every_value_has_one_home_and_reaches_its_neighbours():
    rnd = np.random.default_rng(1)
    for cover in simhash.covers():
        fps = rnd.integers(0, 1 << 64, 200, dtype=np.uint64)
        near = fps ^ (np.uint64(1) << np.uint64(cover.first_bit) << rnd.integers(0, cover.width, 200).astype(np.uint64))
        home, reached = {}, {}
        for rows, anchors in cover.reach(fps):
            part = fps[rows] >> np.uint64(cover.first_bit) & np.uint64((1 << cover.width) - 1)
            assert (np.bitwise_count(part ^ anchors[:, 0]) <= 1).all()
            home |= dict(zip(rows.tolist(), anchors[:, 0].tolist(), strict=True))
        for rows, anchors in cover.reach(near):
            reached |= {r: set(a.tolist()) for r, a in zip(rows.tolist(), anchors, strict=True)}
        assert len(home) == 200 and all(home[k] in reached[k] for k in range(200))


def components(fps, distance):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("chunk", [4, 4096])
def test_links_equal_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6))) for c in centres for _ in range(25)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    rows = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    want = components(list(fps), 4)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edges = simhash.link_edges(rows, chunk=chunk).collect()
    for e in edges:
        root[find(e["src"] % (1 << 64))] = find(e["dst"] % (1 << 64))
    pairs = [(a, b) for a in fps for b in fps]
    assert all((find(a) == find(b)) == (want[a] == want[b]) for a, b in pairs)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = simhash.groups(docs).collect()
    assert len(got) == docs.count()
    name = {(r["doc_id"]): r["component_id"] for r in got}
    assert name[1] == name[2] == name[3] == 1 and name[4] == name[5] == 4 and name[8] == 8
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert None in ids and ids.count(5) == 0 and ids.count(4) == 1 and 1 in ids and 2 not in ids
    assert simhash.groups(no_docs(spark)).count() == 0 and simhash.keep_one(no_docs(spark)).count() == 0


def test_large_group_of_copies_sends_few_edges(spark):
    base = random.Random(3).getrandbits(64)
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}
    rows = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    assert simhash.link_edges(rows).count() < 8 * len(fps)
    assert simhash.link_edges(rows).select(F.explode(F.array("src", "dst"))).distinct().count() == len(fps)
