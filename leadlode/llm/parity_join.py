"""N-gram Jaccard join by parity sketches.

A document is the set of its three-word shingles (as 64-bit hashes; ASCII letters in lower case; a text of fewer
words is one shingle).  Two documents are linked if ``100 * |A and B| >= 90 * |A or B|``, so their sets differ by
at most ``d = 10 (|A| + |B|) / 190`` shingles.

Sketches.  Sizes are cut into bands.  In a band every set is hashed into ``d + 1`` words of 64 bits, ``d`` the
greatest difference of a linked pair that meets there: a shingle flips one bit, so a bit is the parity of the
shingles that fall on it, and sketches differ in at most as many bits as the sets differ in shingles.  By the
pigeonhole principle, linked sets agree in one word at least.  A set is sketched for its own band and for the one
below it if a set there can be linked to it.  ``band, number and value`` of a word are the key of the join.  A
second sketch of 256 bits in all rules pairs out by its Hamming distance before their sets are fetched.

Equal sets are one class from the start.  The sets of a key are compared with the smallest of the key first; then
only sets that are still in different components meet, so a large group of near copies costs rows, not pairs.
Each candidate is verified on the whole sets.  At last the links of every set are counted inside its component:
its sets are dealt to chunks of bounded size, every two chunks meet in a task of their own, and only counts leave
the task.

Sets are named by 64 bits of their sorted hashes.  Defined results: null, blank and word-less texts have an empty
set, are linked with nothing and are their own component, named by their id; equal texts are linked; a null id
names a component only where it has no other; rows that share an id are rows of their own; very long texts are cut
into words by stretches; an empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlode.llm.common import bitmap_split, shared_table
from leadlode.llm.simhash import SEED, _word_runs
from leadlode.operators.components import connected_components

SIZE = 3
PERCENT = 90
#: Ratio of the sizes of a band, and words of the second sketch.
BAND_RATIO = 1.25
SHORT = 4
#: Shingles and sets of a chunk that meets another in one task.
CHUNK = 1 << 21
CHUNK_SETS = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the splitmix finaliser: fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chained(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix((h ^ words[k : k + n]) + np.uint64(k + 1))
    return h


def shingles(data: bytes | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    from xxhash import xxh64_intdigest

    found, short = [], None
    for run in _word_runs((data or b"").lower(), size - 1):
        words = np.fromiter((xxh64_intdigest(w, SEED) for w in run), np.uint64, len(run))
        if len(words) >= size:
            found.append(_chained(words, size))
        short = words
    if not found and short is not None and len(short):
        found.append(_chained(short, len(short)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def most_differing(size: int, percent: int = PERCENT) -> int:
    """Shingles by which linked sets can differ if the smaller one has at most ``size``."""
    return (100 - percent) * (size + size * 100 // percent) // (100 + percent)


@cache
def band_tops(upto: int) -> tuple[int, ...]:
    """The greatest size of each band, from 1 up to the one that holds ``upto``."""
    tops, first = [], 1
    while not tops or tops[-1] < upto:
        tops.append(max(first, int(first * BAND_RATIO) - 1))
        first = tops[-1] + 1
    return tuple(tops)


def bands(size: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """``(band, words)`` of the sketches of a set: of its own band, and of the one below if it can be linked there."""
    tops = band_tops(1 << max(size - 1, 1).bit_length())
    own = next(i for i, top in enumerate(tops) if size <= top) if size else -1
    met = [k for k in (own, own - 1) if k >= 0 and percent * size <= 100 * tops[k]] if size else []
    # Where linked sets differ in nothing they are one class and need no sketch.
    return [(k, most_differing(tops[k], percent) + 1) for k in met if most_differing(tops[k], percent)]


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """Parities of a set: ``words`` words of 64 bits."""
    out = np.zeros(words, np.uint64)
    place = ((hashes >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)
    np.bitwise_xor.at(out, place.astype(np.int64), np.uint64(1) << (hashes & np.uint64(63)))
    return out


def keys_of(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The join keys of a set."""
    found = [np.zeros(0, np.uint64)]
    for band, words in bands(len(hashes), percent):
        number = np.arange(words, dtype=np.uint64) | np.uint64(band << 40)
        found.append(mix(mix(number + np.uint64(SEED)) ^ sketch(hashes, words)))
    return np.concatenate(found)


def set_name(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), len(hashes))


def told_sets(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, th, n, sid, short, keys`` of every document: hash of the text, size and name of the set, sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "n", "sid", "short", "keys"]
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([set_name(s) for s in sets], np.uint64).view(np.int64)),
                    pa.array([sketch(s, SHORT).view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([keys_of(s, percent).view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names,
            )

    text = F.col("text").cast("string")
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    return told.mapInArrow(run, "doc_id long, th long, n long, sid long, short array<long>, keys array<long>")


def fetched_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sid, n, copies, text`` of the wanted classes (``sid, th, n, copies``): one text of each, as bytes.

    Texts travel to where sets are compared: packed, they are half the size of their hashes.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(text).alias("_th"), text.cast("binary").alias("text"))
    perhaps, _ = bitmap_split(texts, "_th", wanted, "th")
    return perhaps.dropDuplicates(["_th"]).join(wanted, F.col("_th") == F.col("th")).select("sid", "n", "copies", "text")


def _linked(n_a, n_b, common, percent: int):
    return 100 * common >= percent * (n_a + n_b - common)


def _meet(left: list, right: list, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set on the left: its number and the numbers of the linked sets on the right."""
    sizes = np.array([len(h) for h in right], np.int64)
    held, where = np.unique(np.concatenate(right), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(held), np.int32)
    for i, hashes in enumerate(left):
        at = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
        at = at[held[at] == hashes]
        mark[at] = 1
        common = np.add.reduceat(mark[where], starts)
        mark[at] = 0
        yield i, np.flatnonzero(_linked(len(hashes), sizes, common, percent))


LEFT, RIGHT, BOTH = 0, 1, 2


def _compare(size: int, percent: int, counted: bool):
    """Of rows sorted by cell (``cell, chunk, side, sid, copies, text``): the links between its sides.

    Either ``src, dst`` of each link, or ``sid, links``: for every set the documents it is linked to.
    """
    names = ["sid", "links"] if counted else ["src", "dst"]

    def cell(rows: list) -> tuple[list, list]:
        side = np.array([r[0] for r in rows])
        a, b = [r for r in rows if r[0] != RIGHT], [r for r in rows if r[0] != LEFT]
        if not a or not b:
            return [], []
        sid_a, sid_b = (np.array([r[1] for r in x], np.int64) for x in (a, b))
        of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        copies_a, copies_b = (np.array([r[2] for r in x], np.int64) for x in (a, b))
        one, two = [], []
        for i, near in _meet([r[3] for r in a], [r[3] for r in b], percent):
            near = near[sid_b[near] != sid_a[i]]
            one.append(np.full(len(near), sid_a[i]))
            two.append(sid_b[near])
            of_a[i] = copies_b[near].sum()
            of_b[near] += copies_a[i]
        if not counted:
            return list(np.concatenate(one)), list(np.concatenate(two))
        if (side == BOTH).all():
            return list(sid_a), list(of_a)
        return [*sid_a, *sid_b], [*of_a, *of_b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        name, held = None, []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

        for batch in batches:
            cells = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            sides, sids, copies, texts = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            for i, own in enumerate(cells):
                if own != name:
                    for kept, more in zip(out, cell(held) if held else ((), ()), strict=True):
                        kept.extend(more)
                    name, held = own, []
                held.append((sides[i], sids[i], copies[i], shingles(texts[i], size)))
            if len(out[0]) > 1 << 16:
                yield batch_of()
                out = ([], [])
        for kept, more in zip(out, cell(held) if held else ((), ()), strict=True):
            kept.extend(more)
        yield batch_of()

    return run


def _compared(rows: DataFrame, size: int, percent: int, counted: bool) -> DataFrame:
    schema = "sid long, links long" if counted else "src long, dst long"
    dealt = rows.select("cell", "chunk", "side", "sid", "copies", "text").repartition("cell", "chunk")
    return dealt.sortWithinPartitions("cell", "chunk").mapInArrow(_compare(size, percent, counted), schema)


def verified(pairs: DataFrame, sets: DataFrame, size: int = SIZE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """``src, dst``: the pairs ``a, b`` whose sets are alike enough; ``a``'s text goes to each chunk of its partners once."""
    partners = shared_table(pairs.join(sets.select(F.col("sid").alias("b"), "n"), "b"))
    room = partners.groupBy("a").agg(F.ceil(F.sum("n") / chunk).alias("chunks"))
    dealt = shared_table(partners.join(room, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").alias("chunk")))
    right = dealt.join(sets, F.col("b") == F.col("sid")).select(F.col("a").alias("cell"), "chunk", F.lit(RIGHT).alias("side"), "sid", "copies", "text")
    left = dealt.select("a", "chunk").distinct().join(sets, F.col("a") == F.col("sid"))
    return _compared(left.select(F.col("a").alias("cell"), "chunk", F.lit(LEFT).alias("side"), "sid", "copies", "text").union(right), size, percent, False)


def counted_links(
    members: DataFrame, sets: DataFrame, size: int = SIZE, percent: int = PERCENT, chunk: int = CHUNK, many: int = CHUNK_SETS
) -> DataFrame:
    """``sid, links``: how many documents of other classes each class is linked to, from ``sid, label`` of the components."""
    held = members.join(sets.select("sid", "n"), "sid")
    room = held.groupBy("label").agg(F.ceil(F.greatest(F.sum("n") / chunk, F.count("*") / many)).alias("chunks"))
    own = F.pmod(F.xxhash64("sid"), "chunks")
    zero = F.lit(0).cast("long")
    # Chunk i meets chunk j in cell (i, j), i <= j: on the left for i, on the right for j.
    as_left = F.transform(F.sequence(own, F.col("chunks") - 1), lambda j: F.struct((own * F.col("chunks") + j).alias("chunk"), F.when(j == own, BOTH).otherwise(LEFT).alias("side")))
    as_right = F.transform(F.sequence(zero, own), lambda i: F.struct((i * F.col("chunks") + own).alias("chunk"), F.lit(RIGHT).alias("side")))
    cells = F.concat(as_left, F.filter(as_right, lambda c: c["chunk"] != own * F.col("chunks") + own))
    dealt = held.join(room, "label").select("sid", F.col("label").alias("cell"), F.inline(cells))
    rows = dealt.join(sets.select("sid", "copies", "text"), "sid")
    return _compared(rows, size, percent, True).groupBy("sid").agg(F.sum("links").alias("links"))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and short sketches of two sets allow a link."""
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    differing = sum((F.bit_count(F.get(f"{a}short", k).bitwiseXOR(F.get(f"{b}short", k))) for k in range(SHORT)), F.lit(0))
    fits = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return fits & (differing * (100 + percent) <= (100 - percent) * (n_a + n_b))


def linked_classes(docs: DataFrame, told: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``sid, first, copies, label, links`` of every class of equal sets, and ``src, dst`` of verified links that
    hold the components together."""
    full = told.where(F.col("n") > 0)
    classes = shared_table(
        full.groupBy("sid").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("th").alias("th"), F.min("short").alias("short"), F.min("n").alias("n"))
    )
    keyed = full.select("sid", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where(F.col("low") < F.col("high"))
    shared = shared_table(ends.select("key", "low"))
    perhaps, _ = bitmap_split(keyed, "key", shared, "key")
    met = shared_table(perhaps.distinct().join(shared, "key"))

    sketches = classes.select("sid", "n", "short")
    stars = met.where(F.col("sid") != F.col("low")).select("low", "sid").distinct()
    of = lambda side: sketches.select(F.col("sid").alias(f"{side}sid"), F.col("n").alias(f"{side}n"), F.col("short").alias(f"{side}short"))
    stars = stars.join(of("a_"), F.col("low") == F.col("a_sid")).join(of("b_"), F.col("sid") == F.col("b_sid"))
    stars = shared_table(stars.where(_may_link("a_", "b_", percent)).select(F.col("low").alias("a"), F.col("sid").alias("b")))

    # Only texts of pairs that may be linked are fetched.
    def of_pairs(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()

    def fetch(ids: DataFrame) -> DataFrame:
        return shared_table(fetched_texts(docs, shared_table(classes.join(ids, "sid", "left_semi").select("sid", "th", "n", "copies"))))

    sets = fetch(of_pairs(stars))
    edges = shared_table(verified(stars, sets, size, percent))
    labels = shared_table(connected_components(edges))

    # What is still apart: one side of such a pair at least is not of the key's first component.
    named = met.join(labels, F.col("sid") == F.col("node"), "left").select("key", "sid", F.coalesce("label", "sid").alias("label"))
    named = shared_table(named)
    spread = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where(F.col("least") < F.col("most"))
    apart = shared_table(named.join(spread.drop("most"), "key").join(sketches, "sid"))
    side = lambda p: apart.select("key", "least", *[F.col(c).alias(f"{p}{c}") for c in ("sid", "label", "n", "short")])
    others = side("a_").where(F.col("a_label") != F.col("least")).drop("least")
    pairs = others.join(side("b_"), "key").where(
        (F.col("a_label") != F.col("b_label"))
        & ((F.col("a_sid") < F.col("b_sid")) | (F.col("b_label") == F.col("least")))
        & _may_link("a_", "b_", percent)
    )
    pairs = pairs.select(F.least("a_sid", "b_sid").alias("a"), F.greatest("a_sid", "b_sid").alias("b")).distinct()
    pairs = shared_table(pairs.join(stars, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        sets = sets.union(fetch(of_pairs(pairs).join(sets.select("sid"), "sid", "left_anti")))
        edges = shared_table(edges.union(verified(pairs, sets, size, percent)))
        labels = shared_table(connected_components(edges))
    links = shared_table(counted_links(labels.withColumnRenamed("node", "sid"), sets, size, percent))
    out = classes.join(labels, F.col("sid") == F.col("node"), "left").join(links, "sid", "left")
    return out.select("sid", "first", "copies", F.coalesce("label", "sid").alias("label"), F.coalesce("links", F.lit(0).cast("long")).alias("links")), edges


def jaccard_join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every document; ``n_links`` is the number of documents it is
    linked to.  Runs jobs when called."""
    told = shared_table(told_sets(docs, size, percent))
    classes = shared_table(linked_classes(docs, told, size, percent)[0])
    least = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = classes.join(least, "label").select(
        F.col("sid").alias("_sid"), "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")
    )
    full = F.when(F.col("n") > 0, F.col("sid"))
    rows = told.select("doc_id", F.col("n").alias("n_shingles"), full.alias("sid")).join(shared_table(of_class), F.col("sid") == F.col("_sid"), "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
