"""Media columns: texts as lossless WebP images, and what is read back from them.

A text's bytes, with zeros up to a positive multiple of 64, are the samples of grey images 64 pixels
wide and at most 16384 high (longer payloads are several files one after another).  Grey pixels leave
only their green channel once green is subtracted; images of at most 16 shades get a palette, which
packs several pixels into one, and texts that repeat themselves are written with back-references.

Defined results: null is as empty (one row of zeros); equal texts give equal files and features; media
that is no lossless WebP file raises; an empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlode.llm import webp

WIDTH = 64
#: A payload that zlib's fastest level takes to less than this share is searched for copies.
REPETITIVE = 0.2


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded bytes of a text and how many were its own."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def to_media(payload: bytes) -> bytes:
    """WebP files whose samples are the payload (a multiple of 64 bytes)."""
    files = []
    for at in range(0, len(payload), WIDTH * webp.SIDE):
        part = payload[at : at + WIDTH * webp.SIDE]
        grey = np.frombuffer(part, np.uint8).astype(np.uint32) * np.uint32(0x010101) | np.uint32(webp.BLACK)
        shades = np.count_nonzero(np.bincount(np.frombuffer(part, np.uint8)))
        copies = len(zlib.compress(part, 1)) < REPETITIVE * len(part)
        files.append(webp.encode(grey.reshape(-1, WIDTH), (webp.PALETTE if shades <= 16 else webp.SUBTRACT_GREEN,), copies))
    return b"".join(files)


def images_of(media: bytes) -> list[np.ndarray]:
    """The pixel arrays of one or more files."""
    found, at = [], 0
    while at < len(media):
        pixels, size = webp.decode(media[at:])
        found.append(pixels)
        at += size
    return found


def samples_of(media: bytes) -> bytes:
    return b"".join((image & np.uint32(255)).astype(np.uint8).tobytes() for image in images_of(media))


def features_of(payload: bytes) -> str:
    """Size, mean, commonest sample and number of shades of a grey image, as text."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    mean = int((counts * np.arange(256)).sum()) * 1000 // len(samples)
    return f"{WIDTH}x{len(samples) // WIDTH} mean={mean // 1000}.{mean % 1000:03d} top={int(counts.argmax())} shades={np.count_nonzero(counts)}"


def _store(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        payload, own = payload_of(text if isinstance(text, str) else None)
        out.append((own, len(payload), to_media(payload)))
    return pd.DataFrame(out, columns=["n_bytes", "payload_bytes", "media"])


def _examine(media: pd.Series) -> pd.DataFrame:
    out = []
    for data in media:
        payload = samples_of(bytes(data))
        out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), features_of(payload)))
    return pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])


def _pixels(media: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None
            if data is None
            else [{"width": i.shape[1], "height": i.shape[0], "argb": i.astype(">u4").tobytes()} for i in images_of(bytes(data))]
            for data in media
        ]
    )


def store(text: Column) -> Column:
    """``struct<n_bytes, payload_bytes, media>`` of a text column."""
    return F.pandas_udf(_store, "n_bytes long, payload_bytes long, media binary")(text)


def examine(media: Column) -> Column:
    """``struct<payload_bytes, payload_sha256, tail_crc32, feature>`` of what the stored bytes hold."""
    return F.pandas_udf(_examine, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")(media)


def pixels(media: Column) -> Column:
    """The pixel arrays of any lossless WebP column: ``array<struct<width, height, argb>>``, null for null."""
    return F.pandas_udf(_pixels, "array<struct<width:int, height:int, argb:binary>>")(media)
