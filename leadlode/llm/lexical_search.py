"""Ranked lexical search by accumulator-limited, term-at-a-time scoring.

Every item is scored against all documents.  A term weighs ``w = floor(1000 ln((2N+2)/(2df+1)))``; a document
adds ``w * ((10^9 tf) div (1000 tf + 8 m))`` for each distinct term of the item, ``m = 10 + (90 n N) div L``.

Items are taken in blocks of at most ``BLOCK_BYTES`` of terms, so that what travels to the tasks is bounded;
a block is one pass over the texts.  That pass keeps the postings of the block's terms, a row for each
document with its length; the second pass scores them where they lie.  A task holds the postings of a stretch
of documents by term and works an item's terms off rarest first.  A document gets an accumulator only while the
bounds of the terms still to come (each term's greatest share in the stretch) reach the k-th score known so
far: the k-th partial score of the stretch, or the k-th final score of the stretches before.  After that, only
documents that have an accumulator are updated, exactly and to the last term.  A document that is left out
scores less than the k-th, never as much, so ties are whole.  A task hands on at most k rows an item.

Defined results: null texts and texts without a term count neither in ``N`` nor in ``L`` and are found by no
item; an item without a term (or with null text) finds nothing; items of one id and the same terms are one,
items of one id with other terms are ranked each for itself; equal rows of documents are ranked one after the
other; of equal scores null ids come last; empty tables give no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlode.llm.common import shared_table

K = 10
#: Bytes of the terms of a block of items, which travel with the tasks (expected size: items are dealt by hash).
BLOCK_BYTES = 1 << 22
#: Bytes of a text that are cut into terms at a time, and postings that are scored at a time.
STRETCH = 1 << 21
POSTINGS = 1 << 20
SALTS = 16

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: By byte of UTF-8: letters in lower case, digits and all beyond ASCII as they are, a blank for the rest.
_KEPT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def term_runs(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded stretch at a time."""
    plain, at = data.translate(_KEPT), 0
    while at < len(plain):
        end = min(len(plain), at + STRETCH)
        if end < len(plain):
            end = plain.find(b" ", end)
            end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, terms``: the distinct terms of every item that has one."""
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))))
    return items.select(F.col("item_id").cast("long").alias("item_id"), terms.alias("terms")).where(F.size("terms") > 0).distinct()


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term: its length and its postings of the given terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {t.encode(): i for i, t in enumerate(terms)}.get
        for batch in batches:
            lengths, found, counts = [], [], []
            for data in batch.column(1).to_pylist():
                n, ids = 0, []
                for run in term_runs(data or b""):
                    n += len(run)
                    ids += [i for t in run if (i := get(t)) is not None]
                which, tfs = np.unique(np.array(ids, np.int32), return_counts=True)
                lengths.append(n)
                found.append(which)
                counts.append(tfs.astype(np.int32))
            arrays = [pa.array(x, pa.list_(pa.int32())) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *arrays], ["doc_id", "n", "terms", "tfs"])

    text = F.col("text").cast("string").cast("binary")
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return told.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>").where(F.col("n") > 0)


class Best:
    """The k best of an item so far: scores, ids and whether an id is missing."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """What a further document has to reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        score, doc, none = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score))[: self.k]
        self.score, self.doc, self.none = score[order], doc[order], none[order]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def score_stretch(items, best, doc, none, at, term, share, n_terms: int) -> None:
    """Term-at-a-time scores of one stretch of documents.

    ``items`` hold term numbers, rarest first; ``at, term, share`` are the postings: place of the document,
    number of the term, what it adds.
    """
    order = np.argsort(term, kind="stable")
    at, term, share = at[order], term[order], share[order]
    cuts = np.searchsorted(term, np.arange(n_terms + 1))
    held = np.flatnonzero(cuts[1:] > cuts[:-1])
    bound = np.zeros(n_terms, np.int64)
    if len(held):
        bound[held] = np.maximum.reduceat(share, cuts[held])
    for item, top in zip(items, best, strict=True):
        rest = np.cumsum(bound[item][::-1])[::-1]
        score = np.zeros(len(doc), np.int64)
        known, created, open_ = np.zeros(len(doc), bool), 0, True
        for t, left in zip(item, rest.tolist(), strict=True):
            a, b = cuts[t], cuts[t + 1]
            if a == b:
                continue
            if open_:
                # A partial score can pass the rest only if the best one does.
                least = top.floor()
                if left >= least and created >= top.k and int(score.max()) > left:
                    least = max(least, _kth(score[known], top.k))
                open_ = left >= least
            rows, adds = at[a:b], share[a:b]
            if not open_:
                if not created:
                    break
                live = known[rows]
                rows, adds = rows[live], adds[live]
            score[rows] += adds
            if open_:
                known[rows] = True
                created += len(rows)
        found = np.flatnonzero(score >= max(top.floor(), _kth(score, top.k), 1))
        if len(found):
            top.add(score[found], doc[found], none[found])


def ranked(table: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """``nr, doc_id, score``: at most k rows an item and task, from the postings of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        held: list[pa.RecordBatch] = []

        def score() -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            lists = whole.column("terms").combine_chunks()
            ends = np.asarray(lists.offsets)
            at = np.repeat(np.arange(len(whole)), np.diff(ends))
            term = np.asarray(lists.flatten()).astype(np.int64)
            tf = np.asarray(whole.column("tfs").combine_chunks().flatten()).astype(np.int64)
            length = whole.column("n").to_numpy().astype(np.int64)
            m = 10 + 90 * length * n_docs // n_words
            share = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[at]))
            ids = whole.column("doc_id").combine_chunks()
            none = np.asarray(ids.is_null())
            score_stretch(items, best, np.asarray(ids.fill_null(0)), none, at, term, share, len(weights))

        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= POSTINGS:
                score()
                held, size = [], 0
        if held:
            score()
        nr = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        if len(nr):
            doc = pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.none for b in best]))
            yield pa.RecordBatch.from_arrays([pa.array(nr), doc, pa.array(np.concatenate([b.score for b in best]))], ["nr", "doc_id", "score"])

    return table.mapInArrow(run, "nr long, doc_id long, score long")


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _best(rows: DataFrame, keys: list, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, block: list, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` of one block of items (id and terms).  Runs jobs when called."""
    spark = docs.sparkSession
    terms = sorted({t for _, ts in block for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    table = shared_table(postings(docs, terms))
    n_docs, n_words = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(terms), np.int64)
    df[np.asarray(held.column("term"))] = np.asarray(held.column("df"))
    weights = np.array([weight(int(d), n_docs) for d in df], np.int64)
    rarest_first = [np.array(sorted((number[t] for t in ts), key=lambda i: (df[i], i))) for _, ts in block]
    found = ranked(table, rarest_first, weights, n_docs, n_words, k)
    # Every task hands on its k best; a first round of ranks keeps their number small per item.
    few = _best(found, ["nr", F.pmod(F.spark_partition_id(), F.lit(SALTS))], k).drop("rank")
    ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "nr long, item_id long")
    return _best(few, ["nr"], k).join(ids, "nr").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of every item.  Runs jobs when called."""
    spark = docs.sparkSession
    asked = shared_table(item_terms(items))
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8)
    whole = asked.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(whole / block_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).collect()
        if rows:
            out = out.unionByName(search_block(docs, sorted(((r["item_id"], r["terms"]) for r in rows), key=str), k))
    return out
