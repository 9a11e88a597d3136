"""Conversation repair against a search over all edits, whole and in parts."""

import functools
import hashlib
import random
import zlib

import pytest

from tablelens.llm import conversation_repair as repair
from tablelens.llm.conversation_repair import AFTER_S, AFTER_U, CUT_OFF, MUST_GO, NEXT, NEVER

WHITE = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """Least (cost, audit) by trying every edit at every turn."""
    @functools.lru_cache(None)
    def go(i, state, inserted):
        best = [(0, "")] if i == len(turns) and state in (0, 2) else []
        if inserted < 3:
            best.append(after("I", 2, go(i, NEXT[state], inserted + 1)))
        if i < len(turns):
            t, wanted = turns[i], 2 if state == AFTER_U else 1
            best.append(after("D", 3, go(i + 1, state, 0)))
            if not t & MUST_GO:
                stays = 1 if t & CUT_OFF else 0
                if state == 0 and t & 3 == 0:
                    best.append(after("K", stays, go(i + 1, AFTER_S, 0)))
                fits = t & 3 == wanted
                best.append(after("K" if fits else "R", stays + 2 * (not fits), go(i + 1, NEXT[state], 0)))
        return min(best, default=(NEVER, ""))

    def after(edit, cost, rest):
        return cost + rest[0], edit + rest[1]
    return go(0, 0, 0)


def some_turns(pick, n):
    return bytes((pick.choice([0, 1, 2, 3]) if pick.random() < 0.4 else [1, 2][k % 2])
                 | (MUST_GO if pick.random() < 0.15 else CUT_OFF * (pick.random() < 0.2)) for k in range(n))


def in_parts(turns, cuts):
    parts = [p for p in (turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])) if p]
    beyond, costs = [], repair.ENDED
    for part in reversed(parts):
        beyond.append(costs)
        table = [repair._costs(part, [0 if s == e else NEVER for s in range(4)])[0] for e in range(4)]
        costs = [min(NEVER, *(table[e][s] + costs[e] for e in range(4))) for s in range(4)]
    state, audit = 0, ""
    for i, (part, ends) in enumerate(zip(parts, reversed(beyond))):
        own, state = repair._trace_part(part, ends, state, i + 1 == len(parts))
        audit += own
    return costs[0], audit


@pytest.mark.parametrize("seed", range(4))
def test_alignment_whole_and_in_parts(seed):
    pick = random.Random(seed)
    for _ in range(600):
        turns = some_turns(pick, pick.randint(0, 14))
        want = cheapest(turns)
        assert repair.align(turns) == want
        if turns:
            assert in_parts(turns, sorted(pick.sample(range(len(turns) + 1), min(len(turns), pick.randint(0, 3))))) == want


def test_long_alignment_equals_its_parts():
    pick = random.Random(9)
    for n in (200, 700):
        turns = some_turns(pick, n)
        assert repair.align(turns) == in_parts(turns, list(range(64, n, 64)))


def expected(rows):
    """{conv: summary} of (conv, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            bare = text.rstrip(WHITE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            turns.append(({"s": 0, "u": 1, "a": 2}.get(role[:1], 3)) | (MUST_GO if fault in (0, 1) else CUT_OFF * (fault == 2)))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = repair.align(bytes(turns)) if len(turns) > 14 else cheapest(bytes(turns))
        lines, i = [], 0
        body = 0
        for edit in audit:
            named = ("user", "assistant")[body % 2]
            if edit == "I":
                lines.append(named + ":")
            elif edit != "D":
                lines.append((own[i][1] if edit == "K" else named) + ":" + own[i][2])
            if edit != "D" and not (edit == "K" and not lines[:-1] and turns[i] & 3 == 0):
                body += 1
            i += edit != "I"
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed=4):
    pick = random.Random(seed)
    texts = ["Hello there.", "ok", "What now?", "", " \t", "Fine!", "no end", "Hello there. ", "é日本.", None]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "unknown"]
    rows = []
    for conv in [*range(30), None]:
        for turn in range(pick.randint(1, 9)):
            rows.append((conv, turn if pick.random() < 0.9 else None, pick.choice(roles[:2 + 7 * (pick.random() < 0.4)]), pick.choice(texts)))
    rows += [(99, turn, ("user", "assistant")[turn % 2 ^ (turn % 11 == 5)], f"turn {turn}" + ".!? "[turn % 4]) for turn in range(150)]
    return rows + [(99, 7, "user", "the same.")] * 60 + [r for r in rows if r[0] == 3]


@pytest.mark.parametrize("part,partitions", [(512, 1), (4, 7), (16, 40)])
def test_tables(spark, monkeypatch, part, partitions):
    monkeypatch.setattr(repair, "PART", part)
    rows = conversations()
    docs = spark.createDataFrame([(*r, "?", "?", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, conv string, seq string, times int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        parts = repair.repaired_parts(docs)
        got = repair.summaries(parts).collect()
        assert parts.where("size(roles) <> size(texts)").count() == 0
        assert repair.summaries(repair.repaired_parts(docs.limit(0))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.conv: tuple(r)[1:] for r in got} == expected(rows) and len(got) == len({r[0] for r in rows})


def test_query_against_brute_force(spark, sf_small):
    from tablelens.llm.queries import QUERIES
    turns = spark.read.parquet(f"{sf_small}/conversations.parquet").collect()
    rows = []
    for r in turns:
        c = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if c == 1 else "".join(x for x in r.text if x not in ".!?") if c == 2 else r.text
        rows += [(r.conv_id, r.turn, "user" if c == 4 else r.role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    want = expected(rows)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = QUERIES["op13_conversation_repair"](spark, sf_small).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {r.conv_id: want.get(r.conv_id, empty) for r in turns}
