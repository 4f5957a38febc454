"""Repeated passages between and inside documents, found with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of a document.  It goes if the same words also start
earlier: in a document with a smaller id, or earlier in the same one.

Documents are not streamed against every shard of a corpus that is the reference itself; that would
cost the square of the input.  Instead each window belongs to the shard named by its minimizer, the
smallest hash among its ``GRAM``-word sequences.  Equal windows have equal minimizers, so a window's
shard holds every place where it can occur.  Consecutive windows with the same minimizer form one piece.

1. Minimizers of all documents are counted.  Those met once cannot be in a repeated window.  The others
   are marked in a bitmap of fixed size (16 MB), which is broadcast; a mark set by chance only lets an
   extra piece pass.
2. Pieces with a marked minimizer are dealt out by it.  A shard's pieces come in the order of their
   places.  Each is streamed through the automaton of the pieces before it; the matching statistics say
   how long a match with earlier text ends at each word, and matches of a window or more are spans to
   remove.  Then the piece is added to the automaton.
3. Minimizers with more than ``HOT`` pieces (a passage that thousands of documents share) are not put
   into one automaton.  Their windows are grouped by hash, with the earliest place taken before the
   shuffle, and every other place goes.
4. Spans are joined to the documents by id and text, and the words they cover are left out.

Defined results: null and blank texts have no words; texts shorter than a window stay whole; rows
with equal id and text are one document and get the same answer; a null id counts as smaller than all
others; an empty table gives no rows.  Other columns are untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlode.llm.common import BITMAP_BLOCK, BITMAP_SLOTS, bitmap_blocks, shared_table
from leadlode.llm.simhash import _BLANK

WINDOW = 20
GRAM = 8
HOT = 256
#: Rows of a window that one task compares with the earliest.
SALT_ROWS = 1 << 13
#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 20

_MIX, _BASE = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [
            np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))), dtype=np.uint64)
            for base in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(32))


def _hashed(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a stretch of text."""
    raw = np.frombuffer(data, np.uint8)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    return _mixed((sums[end] - sums[start]) * down[start])


def word_hashes(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + STRETCH)
        if end < len(data):
            blank = _BLANK.search(data, end)
            end = blank.start() if blank else len(data)
        found.append(_hashed(data[at:end]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _runs(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive values."""
    out = np.zeros(len(x) - size + 1, np.uint64)
    for j in range(size):
        out = out * np.uint64(_BASE) + x[j : len(x) - size + 1 + j]
    return _mixed(out)


def pieces(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and last window (inclusive) of every piece."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = _runs(words, gram)
    span, at, reach = window - gram + 1, np.arange(len(grams)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = at[:-step], at[step:]
        at = np.where(grams[left] <= grams[right], left, right)
        reach += step
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return grams[at[first]], first, np.append(first[1:], len(at)) - 1


class Automaton:
    """A suffix automaton of several sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        nxt, link, length = self.next, self.link, self.length
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                new = self._state({}, length[last] + 1)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p < 0:
                    link[new] = 0
                else:
                    link[new] = self._split(p, c)
                last = new
            else:
                last = self._split(last, c)

    def _state(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p reaches by c, with a length just above p's."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def statistics(self, sequence: list[int]) -> Iterator[int]:
        """For each position, the length of the longest match that ends there."""
        state = long = 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                long = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                long += 1
            yield long


def _spans(ends: list[int], window: int) -> Iterator[tuple[int, int]]:
    """Maximal spans of the windows that end at the given (rising) positions."""
    begin = stop = -1
    for e in ends:
        if e + 1 - window > stop:
            if stop >= 0:
                yield begin, stop
            begin = e + 1 - window
        stop = e + 1
    if stop >= 0:
        yield begin, stop


def shard_spans(shard: list[tuple[int, int, int, bytes]], window: int) -> Iterator[tuple[int, int, int]]:
    """``rid, begin, end`` to remove, from a shard's ``order, start, rid, ids`` in order."""
    seen: set[bytes] = set()
    known: Automaton | None = None
    waiting: list[bytes] = []
    at = 0
    while at < len(shard):
        stop = at
        while stop < len(shard) and shard[stop][:2] == shard[at][:2]:  # equal places are not earlier than each other
            stop += 1
        for _, start, rid, ids in shard[at:stop]:
            if ids in seen:
                yield rid, start, start + len(ids) // 4
            elif seen:
                if known is None:
                    known = Automaton()
                for w in waiting:
                    known.add(np.frombuffer(w, "<u4").tolist())
                waiting.clear()
                ends = [i for i, n in enumerate(known.statistics(np.frombuffer(ids, "<u4").tolist())) if n >= window]
                for a, b in _spans(ends, window):
                    yield rid, start + a, start + b
        for own in {x[3] for x in shard[at:stop]} - seen:
            seen.add(own)
            waiting.append(own)
        at = stop


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))


def _order() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def minimizers(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``h``: the minimizer of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces(word_hashes(t), window, gram)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "h long")


def _marked(docs: DataFrame, marks: bytes, window: int, gram: int) -> DataFrame:
    """``h, ord, rid, start, ids``: the pieces whose minimizer is marked."""
    told = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(told.value, np.uint8)
        for batch in batches:
            hs, orders, rids, starts, ids = [], [], [], [], []
            for order, rid, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = word_hashes(text)
                h, first, last = pieces(words, window, gram)
                slot = (h % np.uint64(BITMAP_SLOTS)).astype(np.int64)
                on = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                if not len(on):
                    continue
                raw = (words >> np.uint64(32)).astype("<u4").tobytes()
                hs.append(h[on].view(np.int64))
                orders.append(np.full(len(on), order))
                rids.append(np.full(len(on), rid))
                starts.append(first[on])
                ids.extend(raw[4 * a : 4 * (b + window)] for a, b in zip(first[on].tolist(), last[on].tolist(), strict=True))
            if ids:
                columns = [pa.array(np.concatenate(x), pa.int64()) for x in (hs, orders, rids, starts)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], ["h", "ord", "rid", "start", "ids"])

    return docs.select(_order().alias("ord"), _row_key().alias("rid"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "h long, ord long, rid long, start long, ids binary"
    )


def _cold(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, int, bytes]] = []
        name = None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for h, *piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if h != name:
                    if len(shard) > 1:
                        out.extend(shard_spans(shard, window))
                    shard, name = [], h
                shard.append(tuple(piece))
            yield _span_batch(out)
        yield _span_batch(list(shard_spans(shard, window)))

    return run


def _span_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    table = np.array(rows, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(3)], ["rid", "begin", "end"])


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            orders, starts, rids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            raw = batch.column(3).to_pylist()
            sizes = np.array([len(x) // 4 for x in raw], np.int64)
            counts = np.maximum(sizes - window + 1, 0)
            # All pieces are hashed as one run; windows that reach over the end of a piece are left out.
            h = _runs(np.frombuffer(b"".join(raw), "<u4").astype(np.uint64), window).view(np.int64)
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            own = h[np.repeat(np.cumsum(sizes) - sizes, counts) + within]
            columns = [own, np.repeat(orders, counts), np.repeat(rids, counts), np.repeat(starts, counts) + within]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["wh", "ord", "rid", "start"])

    return run


def _later(windows: DataFrame, window: int, rows: int = SALT_ROWS) -> DataFrame:
    """``rid, begin, end`` of every window that also starts earlier; a window with many rows is dealt to several tasks."""
    earliest = shared_table(windows.groupBy("wh").agg(F.min(F.struct("ord", "start")).alias("least"), F.count("*").alias("n")).where(F.col("n") > 1))
    salts = F.ceil(F.col("n") / rows).cast("int")
    many = shared_table(earliest.where(F.col("n") > rows).select(F.col("wh").alias("_many"), salts.alias("_salts")))
    dealt = windows.join(many, F.col("wh") == F.col("_many"), "left").withColumn(
        "salt", F.pmod(F.xxhash64("ord", "start"), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    first = earliest.select(F.col("wh").alias("_wh"), "least", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    return (
        dealt.join(first, (F.col("wh") == F.col("_wh")) & (F.col("salt") == F.col("_salt")))
        .where((F.col("ord") != F.col("least.ord")) | (F.col("start") != F.col("least.start")))
        .select("rid", F.col("start").alias("begin"), (F.col("start") + window).alias("end"))
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``_rid, spans``: what goes from each document, as word positions.  Runs jobs when called."""
    spark = docs.sparkSession
    counted = minimizers(docs, window, gram).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    blocks = bitmap_blocks(counted.select(F.col("h").alias("h")), "h").collect()
    marks = bytearray(BITMAP_SLOTS // 8)
    for row in blocks:
        marks[row["block"] * BITMAP_BLOCK // 8 : (row["block"] + 1) * BITMAP_BLOCK // 8] = row["bits"]
    found = shared_table(_marked(docs, bytes(marks), window, gram))

    busy = shared_table(found.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("h").alias("_h")))
    met = found.join(busy, F.col("h") == F.col("_h"), "left")
    cold = (
        met.where(F.col("_h").isNull())
        .select("h", "ord", "start", "rid", "ids")
        .repartition("h")
        .sortWithinPartitions("h", "ord", "start")
        .mapInArrow(_cold(window), "rid long, begin long, end long")
    )
    hot_windows = (
        met.where(F.col("_h").isNotNull())
        .select("ord", "start", "rid", "ids")
        .mapInArrow(_windows(window), "wh long, ord long, rid long, start long")
    )
    spans = shared_table(cold).union(_later(shared_table(hot_windows), window))
    return shared_table(spans.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("begin", "end")).alias("spans")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``row`` (the document as it came) and ``kept, n_words, n_removed``; kept words are joined by one space."""
    spans = repeated_spans(docs, window, gram, hot)

    @F.pandas_udf("kept string, n_words long, n_removed long")
    def strip(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for text, begin, end in zip(texts, begins, ends, strict=True):
            own = (text or "").encode("utf-8", "surrogatepass").split()
            n = len(own)
            if begin is not None and len(begin):
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, np.asarray(begin), 1)
                np.add.at(change, np.asarray(end), -1)
                own = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            out.append((b" ".join(own).decode("utf-8", "surrogatepass"), n, n - len(own)))
        return pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])

    rows = docs.select(F.struct("*").alias("row"), _row_key().alias("rid"), F.col("text").cast("string").alias("text"))
    met = rows.join(spans, F.col("rid") == F.col("_rid"), "left")
    done = met.select("row", strip(F.col("text"), F.col("spans.begin"), F.col("spans.end")).alias("done"))
    return done.select("row", "done.*")
