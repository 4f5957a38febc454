"""Repair of the turn structure of conversations by an auction shortest-path algorithm.

A conversation is repaired if the initials of its roles read ``(s?(ua)+)?``.  Its rows are taken by turn (nulls
first, then by role and text hash).  Edits: keep a row (0), give it the role user or assistant (2), delete it (3;
blank rows and rows whose role and text were seen before must go), insert an empty row (2 each); a truncated row
that stays adds 1.  The cheapest edits form the audit, one letter each; of equally cheap ones the ASCII-least.

Lattice.  A node is a place among the rows and what has been said last (nothing, system, user, assistant); edits
are arcs with integer costs.  Prices start at the least cost of the rows still to come.  A path grows from the
origin: at its last node, the price rises to the least of arc plus price behind it and the path contracts by one
arc, or, if an arc is tight already, the path extends over it.  When it reaches the end, the prices are dual
optimal, so every cheapest path runs on tight arcs, and the ASCII-least of them is traced letter by letter.

Long conversations.  Rows are sorted by range, so that a conversation may lie in many partitions, and cut into
pieces of at most ``PIECE`` rows.  For a conversation of several pieces, each piece is priced from every state to
every state (a task of its own for any piece); a scan over these 4 x 4 tables, last piece first, gives the exact
prices behind each piece; then each piece is priced and traced from all its states, and a scan over the pieces
strings the fragments together.  Rows that must go and equal rows of a turn count as one step with a number.
The repaired text is streamed row by row in the order of the rows; a running hash is all that is held of it.

Defined results: a null role or text is one space (so a null text is blank), a null ``conv_id`` is a conversation
like any other; roles are judged by their first character, case-sensitive; rows of one turn are ordered by role
and text hash; a conversation without rows gives zeros, an empty audit and the hash of the empty string; empty
tables give no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlode.llm.common import BLANKS, shared_table

PIECE = 64

# States: what has been said last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Cost of the rows that have to be inserted at the end, by state, and of the edits.
CLOSING = (0, 4, 2, 0)
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 40

#: Kinds of steps: 0 to 3 the initials s, u, a and others; 4 more if the row is truncated; 8 if it must go.
INITIALS = "sua"
GONE = 8

#: State after each initial, from each state; None where the pattern forbids it.
SAID = {NOTHING: (SYSTEM, USER, None), SYSTEM: (None, USER, None), USER: (None, None, ASSISTANT), ASSISTANT: (None, USER, None)}


def _edits(kind: int, state: int) -> list[tuple[str, int, int]]:
    """``letter, cost, next state`` of the edits of a row, by letter."""
    out = [("D", DELETE, state)]
    if kind < GONE:
        initial, late = kind % 4, TRUNCATED * (kind // 4)
        kept = SAID[state][initial] if initial < 3 else None
        if kept is not None:
            out.append(("K", late, kept))
        out.append(("R", RENAME + late, USER if SAID[state][1] else ASSISTANT))
    return out


EDITS = [[_edits(kind, state) for state in range(4)] for kind in range(GONE + 1)]
INSERTS = [USER, USER, ASSISTANT, USER]


class Piece:
    """The lattice of some steps, with prices behind its last one."""

    def __init__(self, kinds: bytes, runs: list[int], behind: list[int]):
        self.kinds, self.runs, self.n = kinds, runs, len(kinds)
        # Costs and prices are told over what the steps and the end cost at least.
        self.base = [0] * (self.n + 1)
        least = [DELETE * r if k == GONE else TRUNCATED * (k // 4) for k, r in zip(kinds, runs, strict=True)]
        for i in range(self.n - 1, -1, -1):
            self.base[i] = self.base[i + 1] + least[i]
        self.floor = min(behind)
        self.behind = [b - self.floor for b in behind]
        self.least = least
        self.price = [0] * (4 * self.n + 5)
        self._close()

    def _close(self) -> None:
        """Price nodes from which no end can be reached out of the way."""
        price, n = self.price, self.n
        can = [b < FAR // 2 for b in self.behind]
        for i in range(n, -1, -1):
            if i < n:
                can = [any(can[t] for _, _, t in EDITS[self.kinds[i]][q]) for q in range(4)]
                talks = can[USER] or can[ASSISTANT]
                can = [can[NOTHING] or talks, can[SYSTEM] or talks, talks, talks]
            for q in range(4):
                if not can[q]:
                    price[4 * i + q] = FAR

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """``letters, cost, next node``, by letter; the last node is the end."""
        i, q = divmod(node, 4)
        if i == self.n:
            return [("", self.behind[q], 4 * self.n + 4)]
        kind, low, ahead = self.kinds[i], self.least[i], 4 * i + 4
        if kind == GONE:
            out = [("D" * self.runs[i], 0, ahead + q)]
        else:
            out = [(a, c - low, ahead + t) for a, c, t in EDITS[kind][q]]
        insert = ("I", INSERT, 4 * i + INSERTS[q])
        # The letters' order: D, I, K, R.
        return [out[0], insert, *out[1:]]

    def auction(self, origin: int) -> int:
        """Grow a path from the origin to the end; the origin's cost to it."""
        price, end, path = self.price, 4 * self.n + 4, [origin]
        if price[origin] >= FAR:
            return FAR
        while path[-1] != end:
            node = path[-1]
            best, to = FAR, end
            for _, cost, after in self.arcs(node):
                if cost + price[after] < best:
                    best, to = cost + price[after], after
            if price[node] < best:
                price[node] = best
                if node != origin:
                    path.pop()
            else:
                path.append(to)
        return price[origin] + self.base[origin // 4] + self.floor

    def trace(self, origin: int) -> tuple[str, int]:
        """Letters of the ASCII-least path on tight arcs, and the state it ends in."""
        price, end, dead = self.price, 4 * self.n + 4, set()
        path, said = [origin], [""]
        while path[-1] != end:
            node = path[-1]
            for letters, cost, after in self.arcs(node):
                if after not in dead and price[node] == cost + price[after] and price[after] < FAR:
                    path.append(after)
                    said.append(letters)
                    break
            else:
                dead.add(path.pop())
                said.pop()
        return "".join(said), path[-2] % 4


def priced(kinds: bytes, runs: list[int], behind: list[int], first: bool) -> tuple[list[int], list[str], list[int]]:
    """Cost, letters and last state from each state a piece can be entered in (the first piece: from nothing)."""
    piece = Piece(kinds, runs, behind)
    costs, letters, ends = [FAR] * 4, [""] * 4, [0] * 4
    for q in range(1 if first else 4):
        costs[q] = piece.auction(q)
        if costs[q] < FAR:
            letters[q], ends[q] = piece.trace(q)
    return costs, letters, ends


def table_of(kinds: bytes, runs: list[int]) -> list[int]:
    """The 4 x 4 costs of a piece from state to state."""
    out = [FAR] * 16
    for end in range(4):
        piece = Piece(kinds, runs, [0 if q == end else FAR for q in range(4)])
        for q in range(4):
            out[4 * q + end] = min(FAR, piece.auction(q))
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated and renamed by a checksum of their name."""
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(True), times)).alias("_there"),
    ).drop("_there")


def _rows(conversations: DataFrame) -> DataFrame:
    """Rows as they are judged: ids as integers, no nulls in role and text, and a hash of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    return rows.withColumn("th", F.md5("text"))


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, th, times, blank, seen, truncated``: one row for equal rows of a turn, without the text.

    ``seen``: role and text occur in an earlier turn, so that all ``times`` of them are duplicates, not all but one.
    """
    bare = F.btrim("text", F.lit(BLANKS))
    told = rows.select(
        "conv_id", "turn", "role", "th", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated")
    )
    counted = told.groupBy("conv_id", "turn", "role", "th").agg(F.count("*").alias("times"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    counted = shared_table(counted)
    at = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    first = counted.groupBy(F.struct("conv_id", "role", "th").alias("_what")).agg(F.min(at).alias("_first"))
    met = counted.withColumn("_what", F.struct("conv_id", "role", "th")).join(first, "_what")
    return met.select("conv_id", "turn", "role", "th", "times", "blank", (at > F.col("_first")).alias("seen"), "truncated")


def fault_counts(found: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated`` of every conversation that has rows."""
    many = F.when(F.col("blank"), 0).when(F.col("seen"), F.col("times")).otherwise(F.col("times") - 1)
    cut = (~F.col("blank") & ~F.col("seen") & F.col("truncated")).cast("long")
    per_turn = found.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"), F.sum(many).alias("duplicate"), F.sum(cut).alias("truncated")
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return per_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


PIECES = "conv_id long, part int, nr long, kinds binary, runs array<long>, illegal long, opens int, closes int"


def pieces(found: DataFrame, size: int = PIECE) -> DataFrame:
    """The steps of all conversations in order, ``size`` to a piece; ``part, nr`` order the pieces of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, nr = (), 0
        kinds, runs, illegal, opens, closes = bytearray(), [], 0, -1, -1
        done: list[tuple] = []

        def cut() -> None:
            nonlocal kinds, runs, illegal, opens, nr
            if kinds:
                done.append((own[0], part, nr, bytes(kinds), runs, illegal, opens, closes))
            kinds, runs, illegal, opens, nr = bytearray(), [], 0, -1, nr + 1

        def out() -> pa.RecordBatch:
            kinds_of = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32()]
            arrays = [pa.array([r[k] for r in done], t) for k, t in enumerate(kinds_of)]
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            for conv_id, initial, times, must_go, seen, truncated in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != (conv_id,) or len(kinds) >= size:
                    cut()
                    own = (conv_id,)
                if opens < 0:
                    opens = initial
                elif not _legal(closes, initial):
                    illegal += 1
                closes = initial
                illegal += times - 1
                stays = not (must_go or seen)
                if stays:
                    kinds.append(initial + 4 * truncated)
                    runs.append(1)
                if gone := times - stays:
                    kinds.append(GONE)
                    runs.append(gone)
            if len(done) > 4096:
                yield out()
                done = []
        cut()
        yield out()

    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    ordered = found.repartitionByRange("conv_id", "turn", "role", "th").sortWithinPartitions("conv_id", "turn", "role", "th")
    return ordered.select("conv_id", initial, "times", "blank", "seen", F.col("truncated").cast("int")).mapInArrow(run, PIECES)


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _by_batch(fn, kinds: list, names: list):
    """Run a generator of rows over the rows of all batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names)

        for row in fn(rows):
            held.append(row)
            if len(held) >= 4096:
                yield out()
                held = []
        yield out()

    return run


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[bool, tuple]]:
    """Each row of a sorted run and whether its first value differs from the one before."""
    own: tuple = ()
    for row in rows:
        yield own != (row[0],), row
        own = (row[0],)


def prices_behind(cut: DataFrame) -> DataFrame:
    """``conv_id, part, nr, behind``: the exact prices behind every piece of the conversations that have several."""
    many = cut.groupBy("conv_id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(F.struct("conv_id").alias("_key"))
    long = cut.withColumn("_key", F.struct("conv_id")).join(many, "_key", "left_semi").select("conv_id", "part", "nr", "kinds", "runs")

    def tables(rows):
        for conv_id, part, nr, kinds, runs in rows:
            yield conv_id, part, nr, table_of(kinds, runs)

    def scan(rows):
        behind: list[int] = []
        for new, (conv_id, part, nr, table) in _grouped(rows):
            if new:
                behind = list(CLOSING)
            yield conv_id, part, nr, behind
            behind = [min(FAR, *(table[4 * q + t] + behind[t] for t in range(4))) for q in range(4)]

    lists = pa.list_(pa.int64())
    ids, names = [pa.int64(), pa.int32(), pa.int64()], ["conv_id", "part", "nr"]
    costs = long.mapInArrow(_by_batch(tables, [*ids, lists], [*names, "costs"]), "conv_id long, part int, nr long, costs array<long>")
    last_first = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("nr"))
    return last_first.mapInArrow(_by_batch(scan, [*ids, lists], [*names, "behind"]), "conv_id long, part int, nr long, behind array<long>")


def audits(cut: DataFrame) -> DataFrame:
    """``conv_id, cost, illegal, audit`` of every conversation that has rows."""
    key = F.struct("conv_id", "part", "nr")
    behind = prices_behind(cut).select(key.alias("_key"), "behind")
    first = cut.groupBy("conv_id").agg(F.min(F.struct("part", "nr")).alias("_first")).select(F.struct("conv_id").alias("_conv"), "_first")
    told = (
        cut.withColumn("_key", key)
        .withColumn("_conv", F.struct("conv_id"))
        .join(behind, "_key", "left")
        .join(first, "_conv")
        .select(
            "conv_id", "part", "nr", "kinds", "runs", "illegal", "opens", "closes",
            F.coalesce("behind", F.array(*[F.lit(c).cast("long") for c in CLOSING])).alias("behind"),
            (F.struct("part", "nr") == F.col("_first")).alias("first"),
        )
    )

    def solve(rows):
        for conv_id, part, nr, kinds, runs, illegal, opens, closes, behind, first in rows:
            costs, letters, ends = priced(kinds, runs, behind, first)
            yield conv_id, part, nr, illegal, opens, closes, costs[NOTHING], letters, ends

    def string(rows):
        conv_id, cost, illegal, said, state, last = None, 0, 0, [], -1, -1
        for new, (own, _, _, inner, opens, closes, price, letters, ends) in _grouped(rows):
            if new:
                if state >= 0:
                    yield conv_id, cost, illegal, "".join(said) + "I" * (CLOSING[state] // INSERT)
                conv_id, cost, illegal, said, state, last = own, price, 0, [], NOTHING, -1
            illegal += inner + (last >= 0 and not _legal(last, opens))
            said.append(letters[state])
            state, last = ends[state], closes
        if state >= 0:
            yield conv_id, cost, illegal, "".join(said) + "I" * (CLOSING[state] // INSERT)

    whole, small, texts, lists = pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())
    solved = told.mapInArrow(
        _by_batch(
            solve,
            [whole, small, whole, whole, small, small, whole, texts, lists],
            ["conv_id", "part", "nr", "illegal", "opens", "closes", "cost", "letters", "ends"],
        ),
        "conv_id long, part int, nr long, illegal long, opens int, closes int, cost long, letters array<string>, ends array<int>",
    )
    ordered = solved.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nr")
    return ordered.mapInArrow(
        _by_batch(string, [whole, whole, whole, pa.string()], ["conv_id", "cost", "illegal", "audit"]),
        "conv_id long, cost long, illegal long, audit string",
    )


def _applied(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``conv_id, edit, role, text, head`` of rows in order, each conversation's audit before its rows."""
    names = {USER: "user", ASSISTANT: "assistant"}
    audit, at, state, head, own = "", 0, NOTHING, None, None

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, INSERTS[state]
            yield own, "I", names[state], "", head

    for new, (conv_id, is_row, role, text, cost, illegal) in _grouped(rows):
        if new:
            yield from inserted()
        if not is_row:
            audit, at, state, head, own = text, 0, NOTHING, (cost, illegal, text), conv_id
            yield own, "", None, None, head
            continue
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "K":
            state = SAID[state][INITIALS.index(role[0])]
            yield own, "K", role, text, head
        elif edit == "R":
            state = USER if SAID[state][1] else ASSISTANT
            yield own, "R", names[state], text, head
    yield from inserted()


def _merged(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of every conversation in order, its audit before them."""
    none = F.lit(None)
    heads = told.select(
        "conv_id", F.lit(False).alias("is_row"), none.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("th"),
        F.col("audit").alias("text"), "cost", "illegal",
    )
    body = rows.select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "th", "text", none.cast("long").alias("cost"), none.cast("long").alias("illegal"))
    dealt = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "th")
    return dealt.select("conv_id", "is_row", "role", "text", "cost", "illegal")


def repaired_messages(conversations: DataFrame, size: int = PIECE) -> DataFrame:
    """``conv_id, pos, edit, role, text``: the messages of the repaired conversations.  Runs jobs when called."""
    rows = _rows(conversations)
    told = shared_table(audits(shared_table(pieces(faults(rows), size))))

    def messages(merged):
        pos = 0
        for conv_id, edit, role, text, _ in _applied(merged):
            if not edit:
                pos = 0
                continue
            yield conv_id, pos, edit, role, text
            pos += 1

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    run = _by_batch(messages, kinds, ["conv_id", "pos", "edit", "role", "text"])
    return _merged(rows, told).mapInArrow(run, "conv_id long, pos long, edit string, role string, text string")


def repair(conversations: DataFrame, ids: DataFrame | None = None, size: int = PIECE) -> DataFrame:
    """Faults, cheapest edits and hash of the repaired text of every conversation.  Runs jobs when called.

    ``ids`` names conversations (``conv_id``) that may have lost all their rows.
    """
    rows = _rows(conversations)
    found = shared_table(faults(rows))
    told = audits(shared_table(pieces(found, size)))

    def digests(merged):
        head, hashed, said = None, None, False
        for conv_id, edit, role, text, of in _applied(merged):
            if not edit:
                if head is not None:
                    yield *head, hashed.hexdigest()
                head, hashed, said = (conv_id, *of), hashlib.sha256(), False
                continue
            hashed.update(f"{chr(10) if said else ''}{role}:{text}".encode())
            said = True
        if head is not None:
            yield *head, hashed.hexdigest()

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    run = _by_batch(digests, kinds, ["_conv", "cost", "illegal", "audit", "repaired_sha256"])
    digested = _merged(rows, told).mapInArrow(run, "_conv long, cost long, illegal long, audit string, repaired_sha256 string")
    counts = fault_counts(found).withColumnRenamed("conv_id", "_counted")
    whole = (conversations if ids is None else ids).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    both = whole.join(counts, F.col("conv_id").eqNullSafe(F.col("_counted")), "left").join(digested, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.select(
        "conv_id",
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
