"""Best-fit packing of tokenised documents into sequences: best-two-fit.

A document's ids are those of the tokenizer and one end id.  Only documents longer than a
sequence are cut: full pieces from the end, so that the first piece may be shorter.

Pieces are dealt by hash to shards of about ``SHARD_TOKENS`` tokens (a bound on what one task
holds, whatever the input), and each shard is packed by itself: a bin takes the largest piece
left and then, again and again, the largest that fits; when nothing fits any more, its smallest
piece is exchanged for the two unpacked pieces whose sum fills the widened gap best, if that
fills it better.  What a shard leaves open is its last bins, one in some hundreds.

Defined results: null and empty texts are one end id; equal rows are packed once each; a shard
of one piece is a bin; an empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlode.llm.common import shared_table

SEQUENCE = 2048
END_ID = 0
SHARD_TOKENS = 1 << 21
#: Words after which a worker begins a new list of those it knows; the last list stays at hand.
REMEMBERED = 250_000
#: Characters of which text is tokenised at a time.
STRETCH = 1 << 20

_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of texts, by words that are remembered.

    The tokenizer's pattern starts a new token at every space after a character that is not
    white space, so a text may be cut there and its parts tokenised one by one.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)  # a byte-level token has a character for a byte
        for name, i in names.items():
            self.bytes_of[i] = len(name)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, parts: set[str]) -> None:
        """Words not met lately are tokenised in one go: joined, they still part at their spaces."""
        new, joined = parts.difference(self.known), []
        for part in new:
            if part in self.older:
                self.known[part] = self.older[part]
            elif part.startswith(" ") and not part[-1].isspace():
                joined.append(part)
            else:
                self.known[part] = self._encode(part).tobytes()
        if joined:
            ids = self._encode("".join(joined))
            ends = np.cumsum([len(p.encode()) for p in joined])
            cuts = (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1) * 4
            told, at = ids.tobytes(), 0
            for part, end in zip(joined, cuts.tolist(), strict=True):
                self.known[part] = told[at:end]
                at = end

    def _forget(self) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known

    @staticmethod
    def _parts(text: str) -> list[str]:
        white = _WHITE[:6] if text.isascii() else _WHITE
        if any(c + " " in text for c in white):
            return _BEFORE_SPACE.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def __call__(self, text: str) -> bytes:
        out = []
        at = 0
        while at < len(text):
            end = min(len(text), at + STRETCH)
            if end < len(text):
                cut = _BEFORE_SPACE.search(text, end)
                end = cut.start() if cut else len(text)
            parts = self._parts(text[at:end])
            self._learn(set(parts))
            out.append(b"".join([self.known[p] for p in parts]))
            self._forget()
            at = end
        return b"".join(out)


def _cut(path: str, sequence: int, end_id: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(path)
        last = np.asarray([end_id], "<u4").tobytes()
        n = 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + last
                total = len(ids) // 4
                start, length = 0, total % sequence or sequence
                k = 0
                while start < total:
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(own), n, np.frombuffer(own, "<u4") if with_ids else None))
                    start, length, k, n = start + length, sequence, k + 1, n + 1
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
            if with_ids:
                arrays.append(pa.array(cols[6], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return pieces


def token_pieces(
    docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, nth`` (and ``ids``) of every piece; ``nth`` counts rows of a task."""
    schema = _PIECE + ", nth long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _cut(vocabulary, sequence, end_id, with_ids), schema
    )


def best_two_fit(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity)."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    there = sum(1 << n for n in stacks)  # bit n: a piece of length n is left
    mirror = sum(1 << (capacity - n) for n in stacks)

    def take(n: int) -> int:
        nonlocal there, mirror
        i = stacks[n].pop()
        if not stacks[n]:
            there &= ~(1 << n)
            mirror &= ~(1 << (capacity - n))
        return i

    def give_back(n: int, i: int) -> None:
        nonlocal there, mirror
        stacks[n].append(i)
        there |= 1 << n
        mirror |= 1 << (capacity - n)

    def pair(room: int, least: int) -> tuple[int, int] | None:
        """The two lengths left whose sum is nearest to room and above least."""
        for total in range(room, least, -1):
            both = there & (mirror >> (capacity - total))
            while both:
                n = both.bit_length() - 1
                if 2 * n < total:
                    break
                if 2 * n != total or len(stacks[n]) > 1:
                    return n, total - n
                both &= ~(1 << n)
        return None

    number = 0
    while there:
        n = there.bit_length() - 1
        held, gap = [(n, take(n))], capacity - n
        while gap:
            n = (there & ((1 << (gap + 1)) - 1)).bit_length() - 1
            if n < 1:
                break
            held.append((n, take(n)))
            gap -= n
        if gap and len(held) > 1:
            small = held[-1]
            if two := pair(gap + small[0], small[0]):
                held[-1:] = [(n, take(n)) for n in two]
                give_back(*small)
        at = 0
        for n, i in held:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces (a table that is read, not computed, each time) with ``sequence_id`` and ``offset``."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "nth"), F.lit(shards)).alias("shard")

    def pack(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["doc_id", "piece", "nth"], ignore_index=True)
        bins, offsets = best_two_fit(found["length"].to_numpy(), sequence)
        found["sequence_id"] = (found["shard"].to_numpy().astype("int64") << 32) + bins
        found["offset"] = offsets
        return found.drop(columns=["shard", "nth"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "nth")
    return pieces.select("*", shard).groupBy("shard").applyInPandas(pack, f"{kept}, sequence_id long, offset long")


def pack(
    docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Every piece of every document and its place; runs a job that tokenises and writes the pieces."""
    return pack_pieces(shared_table(token_pieces(docs, vocabulary, sequence, end_id, with_ids)), sequence)
