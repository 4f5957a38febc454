"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, each set if it is set in over half of the hashes of a document's
shingles (repeats counted).  Fingerprints of at most ``distance`` differing bits are linked and
documents reachable over links form a group.

Candidates come from a covering code.  The 64 bits are cut into ``blocks`` parts; two linked
fingerprints differ by at most ``distance // blocks`` bits in one of the parts.  In each part the
anchors are the words of a Hamming code (on as many bits as it has, the others free): every value
is within one bit (the covering radius) of exactly one anchor, its home.  A fingerprint is sent
home, and to every anchor within radius plus ``distance // blocks``; whoever is linked to it over
that part is then met at its home.  At an anchor those at home are compared with all that were
sent there, by the differing bits of the whole fingerprint.

Equal fingerprints travel once.  An anchor with more than ``CHUNK`` rows is cut into cells, so that
each chunk of those at home meets each chunk of the others in a task of its own.  A task sends on
a spanning forest of the links it found, at most one row per fingerprint it holds, never all pairs.

Defined results: null and blank texts have fingerprint zero and are linked like any other; a null
id is never the name of a group that has another; equal rows are in one group; an empty table
gives no rows.  Other columns are not looked at by ``fingerprints``; ``keep_one`` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlode.llm.common import shared_table
from leadlode.operators.components import connected_components

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 3
CHUNK = 4096
#: Bytes of a text that are cut into words at a time, rows and pairs that are compared at a time.
STRETCH = 1 << 21
ROWS = 1 << 18
PAIRS = 1 << 21

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_runs(data: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of a text in lists; each list begins with the last ``overlap`` words of the one before."""
    carry: list[bytes] = []
    at = 0
    while at < len(data):
        end = min(len(data), at + STRETCH)
        if end < len(data):
            blank = _BLANK.search(data, end)
            end = blank.start() if blank else len(data)
        found = carry + data[at:end].split()
        yield found
        carry = found[-overlap:] if overlap else []
        at = end


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_digest

    sums, n, short = np.zeros((8, 256), np.int64), 0, []
    column = np.arange(8) * 256
    for found in _word_runs((text or "").encode("utf-8", "surrogatepass").lower(), size - 1):
        short = found
        if len(found) < size:
            continue
        joined = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
        told = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in spans])
        rows = np.frombuffer(told, np.uint8).reshape(-1, 8)
        sums += np.bincount((rows + column).ravel(), minlength=2048).reshape(8, 256)
        n += len(rows)
    if not n and short:
        sums += np.bincount(np.frombuffer(xxh64_digest(b" ".join(short), SEED), np.uint8) + column, minlength=2048).reshape(8, 256)
        n = 1
    bits = sums @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    return int.from_bytes(np.packbits((2 * bits > n).ravel()).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of a text from its shingles' hashes, repeats included."""
    sums, column = np.zeros((8, 256), np.int64), np.arange(8) * 256
    for at in range(0, len(hashes), ROWS):
        rows = hashes[at : at + ROWS].astype(">u8").view(np.uint8).reshape(-1, 8)
        sums += np.bincount((rows + column).ravel(), minlength=2048).reshape(8, 256)
    bits = sums @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    return int.from_bytes(np.packbits((2 * bits > len(hashes)).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every document, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class Cover:
    """Anchors of one part of the fingerprint."""

    def __init__(self, first_bit: int, width: int, threshold: int):
        self.first_bit, self.width = first_bit, width
        r = 1
        while (2 << r) - 1 <= width:
            r += 1
        self.coded = (1 << r) - 1
        flips: dict[int, list[tuple[int, int]]] = {s: [] for s in range(1 << r)}

        def grow(start: int, mask: int, left: int) -> None:
            flips[self._syndrome_of(mask)].append((mask.bit_count(), mask))
            for bit in range(start, width) if left else ():
                grow(bit + 1, mask | 1 << bit, left - 1)

        grow(0, 0, 1 + threshold)
        # By syndrome: the flips that lead to an anchor; the first is the way home.
        self.flips = [np.array([m for _, m in sorted(flips[s])], np.uint64) for s in range(1 << r)]

    def _syndrome_of(self, value: int) -> int:
        s = 0
        for bit in range(self.coded):
            if value >> bit & 1:
                s ^= bit + 1
        return s

    def reach(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of (row numbers, anchors by row: home first)."""
        part = fps >> np.uint64(self.first_bit) & np.uint64((1 << self.width) - 1)
        syndrome = np.zeros(len(part), np.uint64)
        for bit in range(self.coded):
            syndrome ^= (part >> np.uint64(bit) & np.uint64(1)) * np.uint64(bit + 1)
        for s, flips in enumerate(self.flips):
            rows = np.flatnonzero(syndrome == s)
            if len(rows):
                yield rows, part[rows][:, None] ^ flips[None, :]


def covers(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[Cover]:
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return [Cover(sum(widths[:i]), w, distance // blocks) for i, w in enumerate(widths)]


def _replicas(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``anchor, home, fp``: a row for each anchor a fingerprint is sent to, and one more at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = covers(distance, blocks)
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for k, cover in enumerate(parts):
                for rows, anchors in cover.reach(fp):
                    named = anchors | np.uint64(k << 56)
                    anchor = np.concatenate((named[:, 0], named.ravel())).view(np.int64)
                    own = np.concatenate((fp[rows], np.repeat(fp[rows], named.shape[1]))).view(np.int64)
                    home = np.arange(len(anchor)) < len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(own)], ["anchor", "home", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, home boolean, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that connect what the links (a, b) connect: one for each node but the smallest."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _links(group: np.ndarray, home: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between those at home and all others of the same (sorted) group."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    which = np.cumsum(np.append(False, group[1:] != group[:-1]))
    start, end = first[which], np.append(first[1:], len(group))[which]
    left = np.flatnonzero(home)
    room = end[left] - start[left]
    found_a, found_b = [], []
    at = 0
    upto = np.cumsum(room)
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        own, n = left[at:stop], room[at:stop]
        x = np.repeat(own, n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[own], n)
        near = np.bitwise_count(fp[x] ^ fp[y]) <= distance
        near &= fp[x] != fp[y]
        if near.any():
            a, b = forest(fp[x[near]], fp[y[near]])
            found_a.append(a)
            found_b.append(b)
        at = stop
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def edges(group, home, fp):
            a, b = _links(group, home, fp, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

        def joined():
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for batch in batches:
            cell = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)).astype(np.int64)
            # Rows come sorted by anchor and cell; a group's name need only differ from its neighbours'.
            group = cell[0] * 1_000_003 + cell[1]
            size += len(group)
            held.append((group, batch.column(2).to_numpy(zero_copy_only=False), np.asarray(batch.column(3)).view(np.uint64)))
            if size >= ROWS:
                group, home, fp = joined()
                cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
                if cut:
                    yield edges(group[:cut], home[:cut], fp[:cut])
                held = [(group[cut:], home[cut:], fp[cut:])]
                size = len(group) - cut
        if held:
            yield edges(*joined())

    return run


def link_edges(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """``src, dst``: edges that connect whatever is linked, from a table of distinct ``fp``."""
    rows = _replicas(fps, distance, blocks)
    busy = shared_table(
        rows.groupBy("anchor")
        .agg(F.sum(F.col("home").cast("long")).alias("lefts"), F.sum((~F.col("home")).cast("long")).alias("rights"))
        .where((F.col("lefts") > chunk) | (F.col("rights") > chunk))
        .select(
            F.col("anchor").alias("_anchor"),
            F.ceil(F.col("lefts") / chunk).alias("_i"),
            F.ceil(F.col("rights") / chunk).alias("_j"),
        )
    )
    one = F.lit(1).cast("long")
    i, j = F.greatest(F.coalesce("_i", one), one), F.greatest(F.coalesce("_j", one), one)
    spot = F.xxhash64("fp")
    cells = F.when(F.col("home"), F.transform(F.sequence(F.lit(0).cast("long"), j - 1), lambda x: F.pmod(spot, i) * j + x)).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), i - 1), lambda x: x * j + F.pmod(spot, j))
    )
    dealt = rows.join(busy, F.col("anchor") == F.col("_anchor"), "left").select(
        "anchor", F.explode(cells).alias("cell"), "home", "fp"
    )
    return (
        dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(_compare(distance), "src long, dst long")
    )


def groups(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, fp, component_id`` of every document.  Runs jobs when called."""
    found = shared_table(fingerprints(docs, size))
    distinct = shared_table(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = shared_table(connected_components(shared_table(link_edges(distinct, distance, blocks))))
    named = distinct.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_fp = shared_table(named.join(least, "label").select(F.col("fp").alias("_fp"), "component_id"))
    return found.join(of_fp, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """The document with the smallest id of each group, columns unchanged; equal ids are kept once.

    Rows without an id cannot be named as copies and stay.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    ids = groups(known, size, distance, blocks).where(F.col("doc_id") == F.col("component_id"))
    ids = shared_table(ids.select(F.col("doc_id").alias("_id")).distinct())
    rows = known.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc"))
    met = rows.join(ids, F.col("_doc") == F.col("_id"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_doc").orderBy(F.xxhash64("row.text")))
    one = met.withColumn("_nth", nth).where(F.col("_nth") == 1).select("row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
