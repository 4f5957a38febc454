"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed letter n-grams (1 to 3 letters, lower case, everything that is no
letter counting as one blank), weighted by log term frequency times inverse document frequency
and scaled to length one.  Document frequencies are counted over all training texts.  For each
language a bounded sample (``per_language`` different texts, those with the smallest hashes)
is split into ``clusters`` groups by spherical k-means; their means, scaled to one, are the
centroids.  A text gets the language of the centroid with the largest cosine.

Rejection is by distance: a text is rejected if it has no letter, or if its cosine to the nearest
centroid is below a cutoff that grows with the number of its distinct n-grams, since chance hits do too:
``MIN_COSINE`` up to 16 n-grams (a word or two) and ``COSINE_STEP`` more for each doubling.  Measured on
sf0.1: median of random a-z words 0.03 (1 word), 0.05 (10), 0.08 (50), 0.12 (300), 0.15 (1 000); Finnish, Italian
and Turkish 0.05 to 0.12 (5 to 50 words); lowest 1 % of corpus texts 0.05 (1), 0.19 (10), 0.22 (50), 0.32 (300).
In texts of under ten words some salad stays.

Defined results: null, empty and letterless texts are ``und`` with score 0 and rejected; with no
training rows every text is ``und``; equal texts get equal answers, whatever rows they share a batch with; ids are
never read, so null and repeated ones change nothing; ties go to the language
first in code-point order.  Rows of other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlode.llm.common import shared_table

SLOTS = 1 << 13
PER_LANGUAGE = 400
CLUSTERS = 4
MIN_COSINE = 0.04
COSINE_STEP = 0.02
UNKNOWN = "und"
#: Characters of a text that are counted at a time.
STRETCH = 1 << 20

_SHIFT = np.uint32(32 - 13)
_A, _B, _C = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank; letters above 0xFFFF stay as they are."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        above = np.arange(0x10000, 0x110000, dtype=np.uint32)
        table[0x10000:] = np.where([chr(i).isalpha() for i in range(0x10000, 0x110000)], above, 32)
        _LETTERS = table
    return _LETTERS


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text; None if it has no letter."""
    table, counts, before, any_letter = _letters(), np.zeros(SLOTS, np.int64), np.full(1, 32, np.uint32), False
    for at in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[at : at + STRETCH].encode("utf-32-le", "surrogatepass"), "<u4")
        s = table[codes]
        letter = s != 32
        any_letter |= bool(letter.any())
        s = s[letter | np.concatenate(([before[-1] != 32], letter[:-1]))]
        s = np.concatenate((before, s, [np.uint32(32)])) if at + STRETCH >= len(text) else np.concatenate((before, s))
        new = len(before)
        two = s[:-1] * _A + s[1:] * _B
        three = two[:-1] * _A + s[2:] * _C
        hashes = (s[new:] * _C, two[max(0, new - 1) :] * _C, three[max(0, new - 2) :] * _B)
        for h in hashes:
            h ^= h >> np.uint32(15)
            h *= _A
            counts += np.bincount(h >> _SHIFT, minlength=SLOTS)
        before = s[-2:]
    return counts if any_letter else None


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    min_cosine: float = MIN_COSINE
    cosine_step: float = COSINE_STEP

    def cutoff(self, grams: int) -> float:
        """The least cosine of a text with so many distinct n-grams."""
        return self.min_cosine + self.cosine_step * math.log2(max(1.0, grams / 16))

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts.astype(np.float32)) * self.idf
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        vectors, place, grams = [], [], []
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        for i, text in enumerate(texts):
            counts = gram_counts(text) if text and self.languages else None
            if counts is not None:
                vectors.append(self.vector(counts))
                place.append(i)
                grams.append(int(np.count_nonzero(counts)))
        if vectors:
            # One product a text: a product of the whole batch rounds by its number of rows.
            cosines = [self.centroids @ v for v in vectors]
            for i, row, n in zip(place, cosines, grams, strict=True):
                b = int(row.argmax())
                near = min(1.0, max(0.0, float(row[b])))
                out[i] = (self.languages[b], near, near < self.cutoff(n))
        return out


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = gram_counts(text) if text else None
                if counts is not None:
                    seen += counts > 0
                    n += 1
        slots = np.append(np.flatnonzero(seen), -1)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.append(seen[slots[:-1]], n))], ["slot", "n"])

    rows = texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    found, n = np.zeros(SLOTS, np.int64), 0
    for slot, times in zip(rows["slot"], rows["n"], strict=True):
        if slot < 0:
            n = int(times)
        else:
            found[slot] = times
    return found, n


def _clusters(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Centroids by spherical k-means from far-apart starts."""
    starts = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(starts) < min(clusters, len(vectors)):
        nearest = (vectors @ vectors[starts].T).max(axis=1)
        starts.append(int(nearest.argmin()))
    centres = vectors[starts].copy()
    for _ in range(20):
        group = (vectors @ centres.T).argmax(axis=1)
        new = np.stack([vectors[group == k].sum(axis=0) if (group == k).any() else centres[k] for k in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> Model:
    """Centroids from ``text, lang``; rows without text or language are left out.

    ``per_language`` bounds the clustered sample of one language; the inverse document
    frequencies come from every row.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    seen, n = _document_frequencies(usable.select("text"))
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    blank = Model(idf, np.zeros((0, SLOTS), np.float32), [])

    keyed = usable.select("lang", "text", F.xxhash64("lang", "text").alias("key"))
    known = shared_table(keyed.groupBy(F.col("lang").alias("_lang")).agg(F.count_distinct("key").alias("n")))
    # A share of the texts that holds the smallest hashes several times over; only those are ranked.
    share = F.col("key") / F.lit(2.0**64) + 0.5 <= F.lit(4.0 * per_language) / F.col("n")
    first = Window.partitionBy("lang").orderBy("key")
    near = keyed.join(known, F.col("lang") == F.col("_lang")).where(share).select("lang", "key").distinct()
    chosen = near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language)
    chosen = shared_table(chosen.select(F.col("lang").alias("_lang"), F.col("key").alias("_key")))
    named = keyed.join(chosen, (F.col("key") == F.col("_key")) & (F.col("lang") == F.col("_lang")))
    sample = named.dropDuplicates(["key", "lang"]).select("lang", "text")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        counts = [c for c in map(gram_counts, sorted(rows["text"])) if c is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "centroid": []})
        centres = _clusters(np.stack([blank.vector(c) for c in counts]), clusters)
        return pd.DataFrame(
            {
                "lang": rows["lang"].iloc[0],
                "centroid": [c.astype("<f4").tobytes() for c in centres],
            }
        )

    fitted = sample.groupBy("lang").applyInPandas(fit, "lang string, centroid binary").collect()
    fitted.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    if not fitted:
        return blank
    return Model(
        idf,
        np.stack([np.frombuffer(bytes(r["centroid"]), "<f4") for r in fitted]),
        [r["lang"] for r in fitted],
    )


def language(model: Model, text: Column) -> Column:
    """``struct<lang_pred, score, rejected>`` of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.judge([t if isinstance(t, str) else None for t in texts]), columns=["lang_pred", "score", "rejected"])

    return judge(text)


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Is the row kept out of training? (crc32 of the id as text, modulo ``folds``)"""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is not rejected, columns unchanged."""
    judged = docs.select(F.struct("*").alias("row"), language(model, F.col("text")).alias("found"))
    return judged.where(~F.col("found.rejected")).select("row.*")
