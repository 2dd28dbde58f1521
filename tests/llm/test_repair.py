import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from tessera.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, n long, first string"


def faults(rows):
    """Damaged rows (turn, role, text) of one conversation in order, each with whether it has to go and whether it is truncated."""
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, bare == "" or (role, text) in seen, bool(bare) and bare[-1] not in ".!?"))
        seen.add((role, text))
    return out


def damage(conversation, conv_id):
    out = []
    for turn, role, text in conversation:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def cheapest(rows):
    """All edits of a few rows, tried one after the other: (cost, audit, repaired)."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    ways = [["D"] if must else ["D", "K", "Ru", "Ra"] for _, _, must, _ in rows]
    for edits in itertools.product(*ways):
        for new in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                for r in new[k]:
                    cost, audit = cost + 2, audit + "I"
                    lines.append(("user" if r == "u" else "assistant", ""))
                if k < len(rows):
                    role, text, _, cut = rows[k]
                    cost += {"D": 3, "K": 0, "Ru": 2, "Ra": 2}[edits[k]] + (cut and edits[k] != "D")
                    audit += edits[k][0]
                    if edits[k] != "D":
                        lines.append(({"K": role, "Ru": "user", "Ra": "assistant"}[edits[k]], text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    return best


def brute(conversation, conv_id):
    rows = damage(conversation, conv_id)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    found = faults(rows)
    blank = [not t.strip(" \t\n\x0b\x0c\r") for _, t, _, _ in found]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
    cost, audit, text = cheapest(found)
    return (gaps, sum(blank), sum(must and not b for (*_, must, _), b in zip(found, blank, strict=True)), sum(cut and not must for *_, must, cut in found), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversations(n, most=4):
    """Conversations of few rows with all kinds of roles, texts, gaps and nulls; every (conv_id, turn) in one."""
    r = random.Random(7)
    out = {}
    for k in [*range(n), None]:
        turns = r.sample([None, 0, 1, 2, 3, 5, 9], r.randint(1, most))
        out[k] = [(t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "Yes.", "No", "what?", " \n", None, "done! \t", "ünd 日本"])) for t in turns]
    return out


def frame(spark, found):
    return spark.createDataFrame([(k, *row, 7, "x") for k, rows in found.items() for row in rows], SCHEMA)


def test_against_all_edits(spark):
    found = {k: rows for k, rows in conversations(120).items() if len(damage(rows, k)) <= 4}
    got = {r[0]: tuple(r[1:]) for r in repair.repaired(frame(spark, found)).collect()}
    assert len(found) > 90 and got == {k: brute(rows, k) for k, rows in found.items()}


def test_long_conversations_against_sql(spark):
    r = random.Random(3)
    found = {k: [(t, r.choice(["user", "assistant", "system", "user", "assistant"]), r.choice(["One.", "Two!", "three", "four?", "", f"own {k} {t}."])) for t in range(r.randint(5, 40))] for k in range(60)}
    got = sorted(map(tuple, repair.repaired(frame(spark, found)).collect()))
    conversations = pd.DataFrame([(k, *row) for k, rows in found.items() for row in rows], columns=["conv_id", "turn", "role", "text"])  # noqa: F841  (the SQL reads it)
    assert sorted(duckdb.sql(repair.ORACLE_SQL).fetchall()) == got


def test_one_conversation_and_one_row_hold_most(spark):
    rows = [(t, "user" if t % 2 == 0 else "assistant", "again." if t % 3 else f"text {t}.") for t in range(3000)]
    found = {1: rows, 2: [(0, "user", "the same.")] * 2500, 3: [(0, "user", "hi."), (1, "assistant", "oh.")]}
    got = {r.conv_id: r for r in repair.repaired(frame(spark, found)).collect()}
    assert got[2].duplicate == 2499 + (2500 if zlib.crc32(b"2:0") % 20 == 3 else 0) and len(got[2].audit) >= 2500
    walked = faults(damage(rows, 1))
    assert got[1].duplicate == sum(must and bool(t.strip()) for _, t, must, _ in walked) and len(got[1].audit) - got[1].audit.count("I") == len(walked)


def test_no_rows_after_damage(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = repair.repaired(frame(spark, {gone: [(0, "user", "Hi.")]})).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_long_and_exact_ids(spark):
    assert repair.repaired(frame(spark, {1: [(0, "user", "x")]}).where("false")).count() == 0
    ids = [(1 << 60) + 1, (1 << 60) + 3, None]
    found = {k: [(0, "user", "long " * 100_000 + "."), (2, "assistant", None)] for k in ids}
    got = {r[0]: tuple(r[1:]) for r in repair.repaired(frame(spark, found).repartition(1)).collect()}
    assert got == {k: brute(rows, k) for k, rows in found.items()}


def test_ids_of_strings_and_any_partitions(spark):
    found = conversations(30)
    df = frame(spark, found).selectExpr("cast(conv_id as string) as conv_id", "turn", "role", "text")
    one, many = (sorted(map(str, repair.repaired(df.repartition(n)).collect())) for n in (1, 7))
    assert one == many and len(one) == 31


@pytest.mark.parametrize("roles", ["ua", "sua", "u", "a", "s", "uua", "uau", "auau", "sau", "ssua", "xua", ""])
def test_readings_without_spark(roles):
    back, kept, names = repair.Backward(), [], {"u": "user", "a": "assistant", "s": "system", "x": "xylophone"}
    for r in reversed(roles):
        kept.append(back.row(r, False))
    ahead = repair.Forward()
    for k, (r, c) in enumerate(zip(roles, reversed(kept), strict=True)):
        ahead.rows(k, names[r], f"{k}.", 1, False, True, False, c)
    assert ahead.closed()[5:7] == cheapest([(names[r], f"{k}.", False, False) for k, r in enumerate(roles)])[:2]
