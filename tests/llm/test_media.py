from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlode.llm import media, webp
from tests.llm.helpers import no_docs, odd_docs, prose

P, X, G, C = webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PALETTE


def images():
    rnd = np.random.default_rng(3)
    for h, w in ((1, 1), (1, 9), (6, 1), (9, 13), (33, 70)):
        slope = (np.add.outer(np.arange(h) * 3, np.arange(w) * 2) & 255).astype(np.uint32)
        yield np.uint32(0xFF000000) | slope << np.uint32(16) | (slope * 2 & np.uint32(255)) << np.uint32(8) | slope
        yield rnd.integers(0, 1 << 32, (h, w), dtype=np.uint32)


@pytest.mark.parametrize("transforms", [(), (G,), (P,), (X,), (P, X, G), (X, P), (G, P)])
@pytest.mark.parametrize("how", [{}, {"copies": True}, {"cache_bits": 3}, {"copies": True, "cache_bits": 8}])
def test_round_trips(transforms, how):
    rnd = np.random.default_rng(4)
    for image in images():
        h, w = image.shape
        n = ((w + 3) >> 2) * ((h + 3) >> 2)
        blocks = {P: (np.arange(n, dtype=np.uint32) % 14) << np.uint32(8), X: rnd.integers(0, 1 << 32, n, dtype=np.uint32)}
        data = webp.encode(image, transforms, size_bits=2, blocks=blocks, **how)
        back, size = webp.decode(data + b"more")
        assert size == len(data) and (back == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    rnd = np.random.default_rng(colours)
    image = rnd.choice(rnd.integers(0, 1 << 32, colours, dtype=np.uint32), (11, 21))
    for copies in (False, True):
        assert (webp.decode(webp.encode(image, (C,), copies))[0] == image).all()


def test_a_file_of_another_encoder():
    one = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    pixels, size = webp.decode(one)
    assert pixels.shape == (1, 1) and size == len(one)


def test_several_code_groups():
    """A hand-written stream with a meta image: two groups that share the picture in 4 by 4 blocks."""
    w = webp.Writer()
    for value, n in ((0x2F, 8), (7, 14), (3, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        w.bits(value, n)
    w.image(np.array([0, 1 << 8], np.uint32))
    left, right = np.full(16, 5), np.full(16, 9)
    for samples in (left, right):
        for k in range(4):
            w.code(np.bincount([255 if k == 3 else int(samples[0]) if k == 0 else 0], minlength=280 if k == 0 else 256))
        w.code(np.zeros(40, np.int64))
    body = w.bytes() + b"\0" * 3
    body += b"\0" * (len(body) & 1)
    size = len(body).to_bytes(4, "little")
    data = b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + size + body
    green = webp.decode(data)[0] >> np.uint32(8) & np.uint32(255)
    assert green.tolist() == [[5] * 4 + [9] * 4] * 4


def test_long_payloads_are_several_files(monkeypatch):
    payload, _ = media.payload_of(prose(1, "de", 3000))
    monkeypatch.setattr(webp, "SIDE", 64)
    stored = media.to_media(payload)
    assert len(media.images_of(stored)) == -(-len(payload) // 4096) and media.samples_of(stored) == payload


@pytest.mark.parametrize("stretch", [1 << 19, 512])
def test_runs_do_not_depend_on_the_stretch(stretch, monkeypatch):
    monkeypatch.setattr(webp, "STRETCH", stretch)
    payload, _ = media.payload_of(prose(2, "en", 2000))
    assert media.samples_of(media.to_media(payload)) == payload


def test_odd_rows(spark):
    docs = odd_docs(spark)
    stored = docs.select("doc_id", "text", media.store(F.col("text")).alias("s"))
    rows = stored.select("*", media.examine(F.col("s.media")).alias("found")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        data = (r["text"] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert r["s"]["n_bytes"] == len(data) and r["s"]["payload_bytes"] == r["found"]["payload_bytes"] == len(payload)
        assert r["found"]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["found"]["tail_crc32"] == zlib.crc32(payload[-64:])
    twins = {(bytes(r["s"]["media"]), r["found"]["feature"]) for r in rows if r["doc_id"] == 5}
    assert len(twins) == 1
    pixels = stored.select(media.pixels(F.col("s.media"))[0].alias("p")).where("p.width = 64 and length(p.argb) = 256 * p.height")
    assert pixels.count() == docs.count()
    assert no_docs(spark).select(media.store(F.col("text"))).count() == 0
