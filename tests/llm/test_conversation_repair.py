from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from leadlode.llm import conversation_repair as CR

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string, th string, blank string, nr string"
BLANK = re.compile("[\x20\x09-\x0d]*")
LEGAL = re.compile("(s?(ua)+)?")


def brute_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv_id, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows, faults):
    """Best of all edits by a table over rows and last said; strings compared whole."""
    best = {"": (0, "", ())}
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    def better(table, state, option):
        if state not in table or option[:2] < table[state][:2]:
            table[state] = option

    def with_inserts(table):
        for _ in range(4):
            for state, (cost, audit, said) in list(table.items()):
                for role in step[state].replace("s", ""):
                    better(table, role, (cost + 2, audit + "I", (*said, ({"u": "user", "a": "assistant"}[role], ""))))
        return table

    best = with_inserts(best)
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, said) in best.items():
            better(after, state, (cost + 3, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            if role[:1] and role[:1] in step[state]:
                better(after, role[:1], (cost + late, audit + "K", (*said, (role, text))))
            for to in step[state].replace("s", ""):
                better(after, to, (cost + 2 + late, audit + "R", (*said, ({"u": "user", "a": "assistant"}[to], text))))
        best = with_inserts(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def brute(rows, ids):
    out = []
    for conv in ids:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            last = text.strip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, said = cheapest(own, faults) if own else (0, "", ())
        assert LEGAL.fullmatch("".join(r[:1] for r, _ in said))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA).repartition(3)


def sample(seed, n, longest):
    rnd, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rnd.randrange(longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", None, ""])
            if rnd.random() < 0.5:
                role = ("user", "assistant")[turn % 2]
            text = rnd.choice(["Yes.", "No", "  ", None, "Why? ", f"t{rnd.randrange(5)}.", f"t{rnd.randrange(9)}", "a\x0bb!\n"])
            rows.append((conv if conv != 5 else None, None if rnd.random() < 0.05 else turn * rnd.choice([1, 1, 2]) - 3, role, text))
    return rows


@pytest.mark.parametrize("size", [64, 3, 1])
def test_equals_brute_force(spark, size):
    rows = sample(4, 90, 14) + [(500, 0, None, None), (501, None, "user", "a."), (501, None, "assistant", "b.")]
    ids = {r[0] for r in rows}
    whole = frame(spark, rows)
    got = CR.repair(CR.damage(whole), whole, size)
    assert got.columns[0] == "conv_id"
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(brute_damage(rows), ids)


def test_messages_are_legal_and_match_the_hash(spark):
    whole = frame(spark, sample(9, 40, 12))
    by_conv = {}
    for r in CR.repaired_messages(whole, 4).collect():
        by_conv.setdefault(r["conv_id"], []).append((r["pos"], r["role"], r["text"]))
    for r in CR.repair(whole).collect():
        said = sorted(by_conv.get(r["conv_id"], []))
        assert LEGAL.fullmatch("".join(m[1][0] for m in said))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in said).encode()).hexdigest() == r["repaired_sha256"]


def test_one_conversation_over_many_partitions(spark):
    rows = [(1, t, ("user", "assistant")[(t // 3) % 2], f"text {t % 700}.") for t in range(1500)] + [(2, 0, "user", "x.")]
    got = CR.repair(frame(spark, rows).repartition(8), None, 16)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, {1, 2})


def test_lattice_paths_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        kinds = [rnd.choice([0, 1, 2, 3, 4, 5, 6, 8]) for _ in range(rnd.randrange(9))]
        costs, letters, ends = CR.priced(bytes(kinds), [1] * len(kinds), list(CR.CLOSING), True)
        rows = [(1, i, ("system", "user", "assistant", "tool")[k % 4] if k < 8 else "user", "") for i, k in enumerate(kinds)]
        cost, audit, _ = cheapest(rows, ["blank" if k == 8 else "truncated" if k > 3 else "" for k in kinds])
        assert (costs[0], letters[0] + "I" * (CR.CLOSING[ends[0]] // 2)) == (cost, audit)


def test_empty_and_lost_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert CR.repair(CR.damage(none)).count() == 0 and CR.repaired_messages(none).count() == 0
    ids = spark.createDataFrame([(7,), (None,)], "conv_id long")
    lost = sorted([tuple(r) for r in CR.repair(none, ids).collect()], key=str)
    assert lost == brute([], {7, None})
