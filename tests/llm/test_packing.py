from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlode.llm import packing
from tests.llm.helpers import no_docs, odd_docs, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    return packing.WordIds(PATH)


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=" \n\t\r\x1c\x85　ab'sé1.<|>", max_size=40))
def test_parts_give_the_ids_of_the_whole(encode, text):
    whole = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text), "<u4").tolist() == whole


def test_stretches(encode, monkeypatch):
    text = prose(1, "de", 300) + "  \n x   y"
    whole = encode.tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "STRETCH", 40)
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    assert np.frombuffer(encode(text), "<u4").tolist() == whole


@pytest.mark.parametrize("seed", range(5))
def test_bins_hold_all_and_never_too_much(seed):
    rnd = random.Random(seed)
    lengths = np.array([min(100, 1 + int(rnd.expovariate(0.05))) for _ in range(400)])
    bins, offsets = packing.best_two_fit(lengths, 100)
    for b in set(bins.tolist()):
        own = sorted((o, n) for o, n, k in zip(offsets, lengths, bins, strict=True) if k == b)
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at <= 100
    assert bins.max() + 1 <= -(-lengths.sum() // 100) + 2


def test_the_smallest_is_exchanged_for_two_that_fit_better():
    # 60 + 30 leaves 10; 30 is exchanged for 25 + 15.
    bins, _ = packing.best_two_fit(np.array([60, 30, 25, 15]), 100)
    assert bins.tolist() == [0, 1, 0, 0]


def test_pieces_and_places(spark, encode):
    docs = odd_docs(spark)
    got = packing.pack(docs, PATH, sequence=64, with_ids=True).collect()
    by = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by.setdefault(r["doc_id"], {}).setdefault(r["piece"], r)
    for row in docs.collect():
        ids = [*np.frombuffer(encode(row["text"] or ""), "<u4").tolist(), 0]
        own = [by[row["doc_id"]][k] for k in sorted(by[row["doc_id"]])]
        assert [i for p in own for i in p["ids"]] == ids
        assert [p["start"] for p in own] == [len(ids) - sum(q["length"] for q in own[k:]) for k in range(len(own))]
        assert all(p["length"] == 64 for p in own[1:])
    load = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == load.get(r["sequence_id"], 0)
        load[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(load.values()) <= 64
    assert len(got) == packing.token_pieces(docs, PATH, 64).count()
    assert packing.pack(no_docs(spark), PATH).count() == 0


def test_shards(spark):
    docs = spark.createDataFrame([(k, prose(k, "en", 50)) for k in range(200)], "doc_id long, text string")
    pieces = packing.shared_table(packing.token_pieces(docs, PATH))
    whole, parts = packing.pack_pieces(pieces).collect(), packing.pack_pieces(pieces, shard_tokens=4096).collect()
    assert len(whole) == len(parts) == 200
    assert len({r["sequence_id"] for r in parts}) <= len({r["sequence_id"] for r in whole}) + 3
