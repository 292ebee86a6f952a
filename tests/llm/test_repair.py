import hashlib
import heapq
import random
import re
import zlib

import pytest

from corpusloom.llm import conversation_repair
from tests.oracle import connect

SPACE = " \t\n\x0b\x0c\r"
ROLE = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        if not text.strip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("ok" if text.rstrip(SPACE)[-1] in ".!?" else "truncated")
            seen.add((role, text))
    return out


def cheapest(rows, found):
    """Uniform-cost search over whole edit sequences; what comes out is matched with the pattern itself."""
    heap, n = [(0, "", 0, ())], 0
    while True:
        cost, audit, at, out = heapq.heappop(heap)
        said = "".join(r[:1] for r, _ in out)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return cost, audit, out
        if not re.fullmatch("s?(ua)*u?", said):
            continue
        n += 1
        assert n < 3_000_000
        for r in ROLE.values():
            heapq.heappush(heap, (cost + 5, audit + "I", at, (*out, (r, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            late = 5 * (found[at] == "truncated")
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, out))
            if found[at] not in ("blank", "duplicate"):
                if role:
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, (*out, (role, text))))
                for r in ROLE.values():
                    heapq.heappush(heap, (cost + 1 + late, audit + "R", at + 1, (*out, (r, text))))


def audit_of(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    found = faults(rows)
    turns = {t for t, *_ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, out = cheapest(rows, found)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)


def random_rows(seed, conversations=60, most=7):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randrange(most + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!\n", "why?", "cut", " ", None, "", "More. ", "é.\x85", f"n{turn}."])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn * 2, None, 0]), role, text))
    return rows


def brute(rows):
    return {conv: audit_of([r[1:] for r in damaged(rows) if r[0] == conv]) for conv in {r[0] for r in rows}}


SCHEMA = "conv_id long, turn long, role string, text string, segment int, whole string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)


def digest(df):
    return {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_digest(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_search(spark, seed):
    rows = random_rows(seed)
    assert digest(table(spark, rows)) == brute(rows)


@pytest.mark.parametrize("segment", [1, 3])
def test_segments_make_no_difference(spark, monkeypatch, segment):
    rows = random_rows(3)
    want = brute(rows)
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    assert digest(table(spark, rows)) == want


def test_turns_of_a_long_conversation(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"{t}.", ""])) for t in range(400)]
    monkeypatch.setattr(conversation_repair, "SEGMENT", 50)
    turns, audits = conversation_repair.repair(table(spark, rows))
    parts = turns.orderBy("segment").collect()
    got = [(t.role, t.text) for r in parts for t in r.repaired]
    row = audits.first()
    assert len(parts) == 8
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in got).encode()).hexdigest() == row.repaired_sha256
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in got))
    monkeypatch.setattr(conversation_repair, "SEGMENT", 1000)
    assert tuple(conversation_repair.repair(table(spark, rows))[1].first()) == tuple(row)


def test_nothing_left(spark):
    assert digest(table(spark, []).limit(0)) == {}
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert digest(table(spark, [(gone, 0, "user", "Hi.")])) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_the_table_s_own(spark):
    """Counts of sf0.01 by plain Python, and the search on its short conversations."""
    d = "/root/testdata/sf0.01"
    rows = connect(d).execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = digest(spark.read.parquet(f"{d}/conversations.parquet"))
    assert set(got) == {r[0] for r in rows}
    short = {c for c in got if sum(r[0] == c for r in rows) <= 6}
    assert len(short) > 20
    for conv in short:
        assert got[conv] == audit_of([r[1:] for r in damaged(rows) if r[0] == conv])
