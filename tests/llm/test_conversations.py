"""Conversation repair against a brute-force version."""

import hashlib
import random
import re
import zlib

import pytest

from trajecta.llm import conversations
from trajecta.llm.queries import op11_repair

SCHEMA = "conv_id long, turn long, role string, text string"
NONE = [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def line(rows):
    """The line of one conversation's rows ``(turn, role, text)``."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # Grammar (s?(ua)+)?: what may follow each state.
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def relaxed(best):
        """With rows inserted first; the least (cost, audit), and the texts it gives."""
        for _ in range(5):
            for s, follow in moves.items():
                for r, to in follow.items():
                    if r in names and to in best:
                        cost, audit, said = best[to]
                        option = (cost + 2, "I" + audit, [names[r] + ":", *said])
                        best[s] = min(best.get(s, option), option)
        return best

    best = relaxed({"": (0, "", []), "a": (0, "", [])})
    for (_, role, text), fault in reversed(list(zip(rows, faults))):
        before = {}
        for s in moves:
            cost, audit, said = best[s]
            options = [(cost + 3, "D" + audit, said)]
            if fault not in ("b", "d"):
                for r, to in moves[s].items():
                    cost, audit, said = best[to]
                    cost += fault == "t"
                    if role[:1] == r:
                        options.append((cost, "K" + audit, [f"{role}:{text}", *said]))
                    if r in names:
                        options.append((cost + 2, "R" + audit, [f"{names[r]}:{text}", *said]))
            before[s] = min(options)
        best = relaxed(before)
    cost, audit, said = best[""]
    counts = [sum(f == x for f in faults) for x in "bdt"]
    return [gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()]


def lines(rows):
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    return {conv: line([(t, *(" " if x is None else x for x in r)) for t, *r in own]) for conv, own in by.items()}


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.select("conv_id", *names).collect()
    out = {r[0]: list(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def expected(rows):
    known = lines(damaged(rows))
    return {conv: known.get(conv, NONE) for conv, *_ in rows}


def test_all_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_repair(spark, sf_dir)) == expected(rows)


def some_rows(seed, count, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usurper"]
    texts = ["Hello.", "Yes!", "no", "What? ", "", " \t", None, "a.\x0b", "x\xa0", ".", "end.\n  ", "é"]
    out = []
    for conv in range(count):
        kind, role = rng.randrange(4), rng.choice(roles)
        for turn in range(rng.randrange(1, most)):
            text = rng.choice(texts) if kind else rng.choice(texts[:3]) + str(turn) + rng.choice([".", ""])
            own = role if kind == 1 else rng.choice(roles[:2]) if kind == 2 else roles[turn % 2]
            out.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), rng.choice([own, own, own, rng.choice(roles)]), text))
    return out


@pytest.mark.parametrize("chunk_rows", [1, 2, 7, 8192])
def test_chunks_of_any_size_give_the_same_repair(spark, chunk_rows):
    rows = some_rows(chunk_rows, 120, 18)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(conversations.audits(df, chunk_rows)) == lines(rows)
    assert found(conversations.audited(df, conversations.damage(df), chunk_rows)) == expected(rows)


@pytest.mark.parametrize("role", ["user", "tool", "system"])
def test_a_conversation_of_one_role_does_not_converge_but_settles(spark, role):
    """Costs then swing between the states for ever, and no chunk's vectors meet."""
    rows = [(5, t, role, f"row {t % 37}.") for t in range(150)] + [(6, 0, "user", "Hi."), (6, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(conversations.audits(df, 4)) == lines(rows)


def test_awkward_conversations(spark):
    rows = [
        (None, None, None, None),
        (None, 3, "user", "In a conversation without a name."),
        (1, None, "user", "a."),
        (1, None, "user", "a."),
        (1, -5, "assistant", "b" * 200_000 + "."),
        (1, 2**40, "assistant", "b" * 200_000 + "."),
        (2, 0, "assistant", ""),
        *[(3, 7, "user", "the same row.")] * 5000,
        *[(4, t, "user", "the same text.") for t in range(3000)],
        (8, -(2**63), "user", "x."),
        (8, 2**63 - 1, "assistant", "x."),
    ]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA + ", code string, copies int")
    known = lines(rows)
    known[8][0] = 2**63 - 1  # beyond the type
    assert found(conversations.audits(df, 64)) == known
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.audits(empty).collect() == []
    assert conversations.audited(empty, conversations.damage(empty)).collect() == []


def test_repaired_rows_are_what_the_hash_covers(spark):
    df = spark.createDataFrame(some_rows(3, 60, 14), SCHEMA)
    said = {}
    for r in sorted(conversations.repaired_rows(df, 5).collect(), key=lambda r: (r.chunk, r.place)):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, row in found(conversations.audits(df, 5)).items():
        assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == row[-1]
