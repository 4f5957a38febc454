"""Language-model scoring by cross-entropy difference.

Two word bigram models, one of a target (labelled documents) and one of the background (all documents),
share one vocabulary, order and smoothing.  The vocabulary is every word of the corpus, so it grows with it.
With ``score_pairs`` every word, however rare, is a context of its own, and every pair of words is counted:

    P(w | v) = (n(v, w) + prior * U(w)) / (n(v) + prior),   U(w) = the smoothed share of w in all words

With ``score``, the smaller model, the ``core`` commonest words have a context each; all others share one context, and such a
word's chance is that of the shared context times its own share of it:

    P(w | v) = P2(c(w) | v) * P1(w),   c(w) = w for core words (P1 = 1), OTHER for the rest

In both a word that no other document holds has the prior's share.

A document's own words are taken out of both models before it is scored, or rare words of targets would be
known to one model only by the text itself.  The background's counts are scaled to the target's number of words, so that
smoothing weighs alike in both.  The score is the mean loss per word under the target model less that under
the background model, in bits; the lower, the more target-like.

How the counts travel: core bigrams are (core + 2) squared cells and words with at least one in ``share`` of all
tokens are at most ``share`` many; both are sent to the tasks, whatever the input.  The rest of the vocabulary
is never collected: in ``score`` each document lists its rare words with their counts, these meet by word, and the sums go back to
the documents.  No rare word has more than one in ``share`` of the tokens, so no key is hot.  In ``score_pairs`` each pair
with a word outside the core goes to the bucket of that word's hash (of its second word, if neither is in the core), so a bucket has
all that is known of its words; buckets grow in number with the tokens, and no word outside the core has more than one
in ``core`` of these.

Defined results: null and blank texts have no words, loss and score null; without target documents the
target model is the prior alone; words that tie for the last core place are taken in code-point
order; documents with several labels are targets if any label makes them one; null ids are no targets; equal rows are scored
each, and each counts for the others; words are lower-cased; rare words meet by 64-bit hash, and so do
words of over 64 bytes; scores are rounded to nine decimals; an empty table gives no rows.  Other columns are
untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from leadlode.llm.common import bitmap_split, words
from leadlode.llm.simhash import _word_runs
from leadlode.session import drop_shared, write_shared

CORE = 1024
#: A word with one in so many of all tokens is sent to the tasks; there can be no more of them than this.
SHARE = 1 << 17
#: Words of the unigram model added to a context, and counts added to a word of the shared context.
PRIOR = 50.0
WORD_PRIOR = 0.5
OTHER, START = 0, 1
LONG_WORD = 64
#: Pairs of a bucket, and pairs and documents that a task gathers before it deals them to the buckets.
BUCKET_PAIRS = 1 << 20
GATHERED = 1 << 20
GATHERED_DOCS = 1 << 16
#: Set in hashes, so that codes differ from them; added to the code of a core word that follows; the mark of a document's end.
HASH, AFTER, END = -1 << 63, 1 << 40, 1 << 41


def _key(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\x00" + xxh64_digest(word)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


@dataclass
class Reading:
    """A text by the vocabulary: codes of its core bigrams, places of its frequent words, counts of the rest."""

    codes: np.ndarray
    frequent: np.ndarray
    rare: Counter


def _read(text: str, number: dict[bytes, int], core: int) -> Reading:
    side, before = core + 2, None
    codes, frequent, rare = [], [], Counter()
    for run in _word_runs(text.encode("utf-8", "surrogatepass"), 1):
        new = [_key(w) for w in (run if before is None else run[1:])]
        if not new:
            continue
        ids = np.fromiter((number.get(w, -1) for w in new), np.int64, len(new))
        rare.update(w for w, i in zip(new, ids.tolist(), strict=True) if i < 0)
        frequent.append(ids[ids >= side] - side)
        ids = np.where((ids < 0) | (ids >= side), OTHER, ids)
        codes.append((np.concatenate(([START if before is None else before], ids[:-1])) * side + ids).astype(np.int32))
        before = ids[-1]
    none = [np.zeros(0, np.int64)]
    return Reading(np.concatenate(codes or none), np.concatenate(frequent or none), rare)


@dataclass
class Models:
    """Counts of the target (row 0) and of all documents (row 1); rare words are not among them."""

    number: dict[bytes, int]
    core: int
    bigrams: np.ndarray
    frequent: np.ndarray
    types: int
    prior: float
    word_prior: float

    @property
    def scale(self) -> float:
        target, every = self.bigrams.sum(axis=1)
        return float(target / every) if every and target else 1.0


def _told(docs: DataFrame, targets: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """``row, text, is_target`` of every document, and the folder of the target ids."""
    ids = targets.select(F.col("doc_id").cast("long").alias("_target")).where(F.col("_target").isNotNull()).distinct()
    named, path = write_shared(ids)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    texts = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.lower(F.col("text").cast("string")).alias("text"))
    perhaps, others = bitmap_split(texts, "id", named, "_target")
    # Targets are no bounded set: they meet the texts by a merge at every size.
    told = perhaps.join(named.hint("merge"), F.col("id") == F.col("_target"), "left")
    if keep:  # in a fixed order: a task that is run again numbers its documents alike
        told = told.sortWithinPartitions("id", "text")
    told = told.select("row", "text", F.col("_target").isNotNull().alias("is_target"))
    return told.union(others.select("row", "text", F.lit(False))), path


def _vocabulary(docs: DataFrame, core: int, share: int) -> tuple[list[bytes], int]:
    """Words with a share of the tokens, commonest first (core words among them), and how many words occur twice or more."""
    each = docs.select(F.explode(words(F.lower(F.col("text").cast("string")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    each, path = write_shared(each)
    total, types = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    first = each.where(F.octet_length("word") <= LONG_WORD).orderBy(F.desc("n"), "word").limit(core)
    many = each.where(F.col("n") * share >= total)
    code = F.when(F.octet_length("word") <= LONG_WORD, F.encode("word", "utf-8"))
    long = many.where(F.octet_length("word") > LONG_WORD).select("word")
    found = [bytes(r[0]) for r in first.select(code).collect()]
    seen = set(found)
    rest = [bytes(r[0]) for r in many.where(code.isNotNull()).orderBy(F.desc("n"), "word").select(code).collect()]
    digest = F.udf(lambda w: _key(w.encode("utf-8", "surrogatepass")), "binary")
    rest += sorted(bytes(r[0]) for r in long.select(digest("word")).collect())
    drop_shared(docs.sparkSession, path)
    return found + [w for w in rest if w not in seen], types


def train(
    docs: DataFrame,
    targets: DataFrame,
    core: int = CORE,
    share: int = SHARE,
    prior: float = PRIOR,
    word_prior: float = WORD_PRIOR,
) -> Models:
    """Counts of both models; ``targets`` has the ``doc_id`` of target documents.  Runs jobs when called."""
    listed, types = _vocabulary(docs, core, share)
    core = min(core, len(listed))
    number = {w: i + 2 for i, w in enumerate(listed)}
    cells, size = (core + 2) ** 2, (core + 2) ** 2 + len(listed) - core
    told, path = _told(docs, targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, size), np.int64)
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for text, target in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                read = _read(text or "", number, core)
                found[bool(target)].extend((read.codes, read.frequent + cells))
            for k, codes in enumerate(found):
                if codes:
                    totals[k] += np.bincount(np.concatenate(codes), minlength=size)
        code = np.flatnonzero(totals.any(axis=0))
        columns = [code, totals[1, code], totals[:, code].sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["code", "target", "every"])

    rows = (
        told.select("text", "is_target")
        .mapInArrow(run, "code long, target long, every long")
        .groupBy("code")
        .agg(F.sum("target").alias("target"), F.sum("every").alias("every"))
        .toArrow()
    )
    drop_shared(docs.sparkSession, path)
    counts, code = np.zeros((2, size)), np.asarray(rows.column("code"))
    counts[0, code], counts[1, code] = np.asarray(rows.column("target")), np.asarray(rows.column("every"))
    return Models(number, core, counts[:, :cells], counts[:, cells:], types + 1, prior, word_prior)


class _Judge:
    """Losses of core bigrams and frequent words, with the text's own counts taken out."""

    def __init__(self, models: Models) -> None:
        self.m, self.side = models, models.core + 2
        square = models.bigrams.reshape(2, self.side, self.side)
        self.contexts, self.singles, self.totals = square.sum(axis=2), square.sum(axis=1), models.bigrams.sum(axis=1)
        self.scales = (1.0, models.scale)

    def losses(self, read: Reading, is_target: bool, pairs: bool = False) -> list[float]:
        """Under each model, all but what rare words, or with ``pairs`` their contexts too, gain by having been seen."""
        m, side, out = self.m, self.side, []
        code, own = np.unique(read.codes, return_counts=True)
        v, w = code // side, code % side
        own_v, own_w = np.bincount(v, own, minlength=side), np.bincount(w, own, minlength=side)
        place, times = np.unique(read.frequent, return_counts=True)
        for k, scale in enumerate(self.scales):
            mine = 1 if k or is_target else 0
            total = (self.totals[k] - mine * own.sum()) * scale
            single = ((self.singles[k][w] - mine * own_w[w]) * scale + m.prior / side) / (total + m.prior)
            pair = (m.bigrams[k][code] - mine * own) * scale * (not pairs or (v != OTHER) & (w != OTHER)) + m.prior * single
            context = (self.contexts[k][v] - mine * own_v[v]) * scale * (not pairs or v != OTHER) + m.prior
            loss = -(own * np.log2(pair / context)).sum()
            # Words of the shared context: its share of them, as if unseen, less what seen ones gain.
            others = (self.singles[k][OTHER] - mine * own_w[OTHER]) * scale + m.word_prior * m.types
            loss += own_w[OTHER] * np.log2(others / m.word_prior)
            loss -= (times * np.log2((m.frequent[k][place] - mine * times) * scale / m.word_prior + 1)).sum()
            out.append(float(loss))
        return out


def score(docs: DataFrame, targets: DataFrame, models: Models, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (the columns to keep), ``n_tokens, target_loss, background_loss, score``.  Runs jobs when called."""
    told, ids_path = _told(docs, targets, keep)
    kind = "n_tokens long, target double, background double, words array<long>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(models)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, is_target in zip(batch["text"].to_pylist(), batch["is_target"].to_pylist(), strict=True):
                read = _read(text or "", models.number, models.core)
                told = [len(read.codes), *(judge.losses(read, is_target) if len(read.codes) else (0.0, 0.0))]
                told += [[_signed(xxh64_intdigest(w)) for w in read.rare], list(read.rare.values())]
                for column, value in zip(out, told, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            made = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            names = ["row", "is_target", "n_tokens", "target", "background", "words", "times"]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["is_target"], *made], names)

    row_type = told.schema["row"].dataType.simpleString()
    read = told.mapInArrow(run, f"row {row_type}, is_target boolean, {kind}")
    base, base_path = write_shared(read.withColumn("rid", F.monotonically_increasing_id()))
    drop_shared(docs.sparkSession, ids_path)

    rare = base.select("rid", "is_target", F.explode(F.arrays_zip("words", "times")).alias("w"))
    rare = rare.select("rid", "is_target", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    mine = F.when(F.col("is_target"), F.col("n")).otherwise(0)
    by_word = Window.partitionBy("word")
    seen = rare.withColumn("every", F.sum("n").over(by_word) - F.col("n")).withColumn("target", F.sum(mine).over(by_word) - mine)
    gain = [F.col("n") * F.log2(F.col(c) * F.lit(s / models.word_prior) + 1) for c, s in (("target", 1.0), ("every", models.scale))]
    seen = seen.where(F.col("every") > 0).select("rid", *[g.cast("float").alias(c) for g, c in zip(gain, ("one", "two"), strict=True)])
    gains = seen.groupBy("rid").agg(F.sum("one").alias("one"), F.sum("two").alias("two"))

    done = base.drop("words", "times", "is_target").join(gains, "rid", "left")
    losses = [F.col(c) - F.coalesce(g, F.lit(0.0)) for c, g in (("target", F.col("one")), ("background", F.col("two")))]
    any_word = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    per_word = [F.round(x / any_word, 9) for x in (*losses, losses[0] - losses[1])]
    names = ("target_loss", "background_loss", "score")
    return done.select("row", "n_tokens", *[x.alias(c) for x, c in zip(per_word, names, strict=True)])


def _marks(text: str, number: dict[bytes, int], core: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its code (``OTHER`` outside the core), and its code or, outside the core, its hash."""
    codes, marks, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], True
    for run in _word_runs(text.encode("utf-8", "surrogatepass"), 1):
        new = [_key(w) for w in (run if first else run[1:])]
        ids = np.fromiter((number.get(w, OTHER) for w in new), np.int64, len(new))
        ids[ids >= core + 2] = OTHER
        rest, mark = np.flatnonzero(ids == OTHER), ids.copy()
        mark[rest] = np.fromiter((xxh64_intdigest(new[i]) for i in rest.tolist()), np.uint64, len(rest)).view(np.int64) | HASH
        codes.append(ids)
        marks.append(mark)
        first = False
    return np.concatenate(codes), np.concatenate(marks)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from zero in as few bytes each as the largest needs; the first byte tells how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


class _Gathered:
    """Pairs of some documents that hold a word outside the core, until they are dealt to the buckets of these words."""

    def __init__(self) -> None:
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.docs: list[tuple[int, int, bool]] = []
        self.n = 0

    def add(self, codes: np.ndarray, marks: np.ndarray, is_target: bool) -> None:
        """Word, the word before it or the core word after it, and how often the document has that core word."""
        rest = np.flatnonzero(codes == OTHER)
        before = marks[rest - 1]
        before[rest == 0] = START
        after = rest[rest + 1 < len(codes)]
        after = after[codes[after + 1] != OTHER]
        following = codes[after + 1]
        own = np.bincount(codes)[following]
        last = marks[-1:][codes[-1:] == OTHER]
        word = np.concatenate((marks[rest], marks[after], last))
        other = np.concatenate((before, following + AFTER, np.full(len(last), END)))
        times = np.concatenate((np.zeros(len(rest), np.int64), own, np.zeros(len(last), np.int64)))
        self.pairs.append((word, other, times, np.full(len(word), len(self.docs))))
        self.docs.append((len(codes), len(rest), is_target))
        self.n += len(word)

    def dealt(self, buckets: int) -> Iterator[tuple]:
        """``bucket`` and the columns of ``_CHUNK``."""
        if not self.n:
            return
        word, other, times, doc = (np.concatenate(c) for c in zip(*self.pairs, strict=True))
        order = np.argsort(word.view(np.uint64), kind="stable")
        word, other, times, doc = word[order], other[order], times[order], doc[order]
        bucket = (((word.view(np.uint64) << np.uint64(1)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
        facts = np.array(self.docs, np.int64)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            words, n = np.unique(word[i:j].view(np.uint64), return_counts=True)
            docs, place = np.unique(doc[i:j], return_inverse=True)
            yield int(bucket[i]), words.tobytes(), _pack(n), other[i:j].tobytes(), _pack(times[i:j]), _pack(place), _pack(docs), *map(_pack, facts[docs].T)


_CHUNK = ("words", "repeats", "others", "times", "places", "docs", "tokens", "outside", "targets")


@dataclass
class _Shares:
    """What the buckets know of both models: counts of core words and of all tokens, scales and priors."""

    singles: np.ndarray
    totals: np.ndarray
    scales: tuple[float, float]
    types: int
    prior: float
    word_prior: float

    def gains(self, word, other, times, doc, tokens, outside, target) -> list[np.ndarray]:
        """Bits that each document of a bucket gains under each model by what others have of its pairs."""
        side, n_docs = self.singles.shape[1], len(tokens)
        order = np.lexsort((doc, other, word))
        word, other, times, doc = word[order], other[order], times[order], doc[order]
        new_word = np.diff(word, prepend=word[0]) != 0
        new_pair = new_word | (np.diff(other, prepend=other[0]) != 0)
        first = new_pair | (np.diff(doc, prepend=doc[0]) != 0)
        first[0] = True
        at = np.flatnonzero(first)
        n = np.diff(at, append=len(word))
        word_id, pair_id = np.cumsum(new_word)[at], np.cumsum(new_pair)[at]
        other, times, doc = other[at], times[at], doc[at]
        as_word, ends = other < AFTER, other == END
        kinds = as_word.astype(np.int64), ends.astype(np.int64)
        # Each word in each document: how often it is there, and how often before another word.
        key, of = np.unique(word_id * n_docs + doc, return_inverse=True)
        own = np.bincount(of, n * kinds[0])
        own_before = own - np.bincount(of, n * kinds[1])
        its_word, its_doc = key // n_docs, key % n_docs
        out, core = [], np.clip(other - AFTER, 0, side - 1)
        core[as_word | ends] = OTHER
        for k, scale in enumerate(self.scales):
            counts = target if k == 0 else np.ones(n_docs, bool)
            mine = counts.astype(np.float64)
            every = np.bincount(its_word, own * counts[its_doc])[its_word] - own * mine[its_doc]
            before = np.bincount(its_word, own_before * counts[its_doc])[its_word] - own_before * mine[its_doc]
            gain = own * np.log2(every * scale / self.word_prior + 1) - own_before * np.log2(before * scale / self.prior + 1)
            total = (self.totals[k] - mine * tokens) * scale + self.prior
            others = (self.singles[k][OTHER] - mine * outside) * scale
            share = np.where(
                as_word,
                (others[doc] + self.prior / side) * (every[of] * scale + self.word_prior) / (others[doc] + self.word_prior * self.types),
                (self.singles[k][core] - mine[doc] * times) * scale + self.prior / side,
            ) / total[doc]
            seen = np.bincount(pair_id, n * counts[doc])[pair_id] - n * mine[doc]
            more = np.where(ends, 0.0, n * np.log2(seen * scale / (self.prior * share) + 1))
            out.append(np.bincount(its_doc, gain, n_docs) + np.bincount(doc, more, n_docs))
        return out


def score_pairs(
    docs: DataFrame,
    targets: DataFrame,
    models: Models,
    keep: tuple[str, ...] = ("doc_id",),
    bucket_pairs: int = BUCKET_PAIRS,
    gathered: int = GATHERED,
) -> DataFrame:
    """The columns of ``score``, with a context for every word.  Runs jobs when called."""
    told, _ = _told(docs, targets, keep)
    judge = _Judge(models)
    shares = _Shares(judge.singles, judge.totals, judge.scales, models.types, models.prior, models.word_prior)
    buckets = max(1, math.ceil(float(judge.totals[1]) / bucket_pairs))
    row_type = told.schema["row"].dataType.simpleString()
    of_docs = f"row {row_type}, place int, n_tokens long, target double, background double"
    names = ["bucket", "home", "row", "place", "n_tokens", "target", "background", *_CHUNK]
    made = [pa.int64(), pa.int64(), None, pa.int32(), pa.int64(), pa.float64(), pa.float64(), *[pa.binary()] * len(_CHUNK)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, held, flushed = _Judge(models), _Gathered(), 0
        part = TaskContext.get().partitionId()
        home = part << 32

        def dealt(row_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for bucket, *chunk in held.dealt(buckets):
                rows.append((bucket, home, None, None, None, None, None, *chunk))
                size += sum(map(len, chunk))
                if size > 4 << 20:
                    yield made_of(rows, row_kind)
                    rows, size = [], 0
            if rows:
                yield made_of(rows, row_kind)

        def made_of(rows: list[tuple], row_kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t or row_kind) for c, t in zip(zip(*rows, strict=True), made, strict=True)], names)

        kind = pa.null()
        for batch in batches:
            kind = batch["row"].type
            places: list[list] = [[] for _ in range(5)]
            for text, is_target in zip(batch["text"].to_pylist(), batch["is_target"].to_pylist(), strict=True):
                codes, marks = _marks(text or "", models.number, models.core)
                pairs = np.concatenate(([START], codes[:-1])) * judge.side + codes if len(codes) else codes
                told = judge.losses(Reading(pairs, np.zeros(0, np.int64), Counter()), is_target, True) if len(codes) else (0.0, 0.0)
                for column, value in zip(places, (home, len(held.docs), len(codes), *told), strict=True):
                    column.append(value)
                held.add(codes, marks, is_target)
                if held.n >= gathered or len(held.docs) >= GATHERED_DOCS:
                    yield from dealt(kind)
                    held, flushed = _Gathered(), flushed + 1
                    home = part << 32 | flushed
            # Documents pass through the shuffle beside their pairs, in groups of their own.
            aside = [pa.array([-1 - h for h in places[0]], pa.int64()), pa.array(places[0], pa.int64()), batch["row"]]
            aside += [pa.array(c, t) for c, t in zip(places[1:], made[3:7], strict=True)]
            none = [pa.nulls(len(batch), pa.binary())] * len(_CHUNK)
            yield pa.RecordBatch.from_arrays([*aside, *none], names)
        yield from dealt(kind)

    def met(group: pa.Table) -> pa.Table:
        """Documents as they are; of pairs the gains of each chunk's documents."""
        none = len(group)
        if group["bucket"][0].as_py() < 0:
            empty = pa.nulls(none, pa.binary())
            return group.select(names[1:7]).append_column("docs", empty).append_column("gains", empty)
        chunk = {c: group[c].to_pylist() for c in _CHUNK}
        word = np.concatenate([np.repeat(np.frombuffer(w, np.int64), _unpack(n)) for w, n in zip(chunk["words"], chunk["repeats"], strict=True)])
        other = np.concatenate([np.frombuffer(b, np.int64) for b in chunk["others"]])
        times, tokens, outside, target = (np.concatenate([_unpack(b) for b in chunk[c]]) for c in ("times", "tokens", "outside", "targets"))
        sizes = [len(_unpack(b)) for b in chunk["docs"]]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        doc = np.concatenate([_unpack(b) + s for b, s in zip(chunk["places"], starts[:-1].tolist(), strict=True)])
        both = np.stack(shares.gains(word, other, times, doc, tokens, outside, target.astype(bool))).astype(np.float32)
        gains = [both[:, i:j].tobytes() for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        columns = [group["home"], *[pa.nulls(none, group[c].type) for c in names[2:7]], pa.array(chunk["docs"], pa.binary()), pa.array(gains, pa.binary())]
        return pa.table(columns, [*names[1:7], "docs", "gains"])

    def summed(group: pa.Table) -> pa.Table:
        rows = group.filter(group["place"].is_valid())
        place = rows["place"].to_numpy()
        total = np.zeros((2, int(place.max(initial=0)) + 1))
        for docs, gains in zip(group["docs"].to_pylist(), group["gains"].to_pylist(), strict=True):
            if docs is not None:
                total[:, _unpack(docs)] += np.frombuffer(gains, np.float32).reshape(2, -1)
        losses = [pa.array(rows[c].to_numpy() - total[k][place]) for k, c in enumerate(("target", "background"))]
        return pa.table([rows["row"], rows["n_tokens"], *losses], ["row", "n_tokens", "target", "background"])

    chunks = told.mapInArrow(read, f"bucket long, home long, {of_docs}, " + ", ".join(f"{c} binary" for c in _CHUNK))
    gains = chunks.groupBy("bucket").applyInArrow(met, f"home long, {of_docs}, docs binary, gains binary")
    done = gains.groupBy("home").applyInArrow(summed, f"row {row_type}, n_tokens long, target double, background double")
    any_word = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    per_word = [F.round(x / any_word, 9) for x in (F.col("target"), F.col("background"), F.col("target") - F.col("background"))]
    return done.select("row", "n_tokens", *[x.alias(c) for x, c in zip(per_word, ("target_loss", "background_loss", "score"), strict=True)])
