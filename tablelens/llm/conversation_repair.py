"""Conversation structure repair by Wagner-Fischer alignment to an alternating grammar.

A conversation is mended to role initials ``(s?(ua)+)?`` by the cheapest edits: Keep 0, Rerole to
user or assistant 2, Delete 3 (blank turns and duplicates must go), Insert an empty user or assistant turn 2, and 1 for
each truncated turn that stays.  Of equally cheap audits (the edits' initials in order) the ASCII-least counts.

1. *Alignment* (:func:`align`).  All targets ``(ua)^k`` end alike, so one table over (turns left, letters left) holds
   the cost of every feasible length, and a second layer those with an ``s`` in front.  A greedy repair is the incumbent;
   cells further from the diagonal than its cost allows are never filled (Ukkonen's band).  The cheapest lengths
   are traced back, the least letter first, and their audits compared.
2. *Order.*  Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any size is spread over
   tasks; equal rows are counted before, and the first turn of each (role, text) comes from an aggregate whose
   rows meet theirs by order.  A conversation that begins and ends inside a task is aligned there.
3. *Long conversations.*  Others are parts of at most ``PART`` turns.  What a part does to the four states of the grammar is a
   4 x 4 table of costs; passing over these tables from the last part to the first gives the cost beyond each part, with which every
   part is traced alone from each state, and a pass in order picks the traces that fit.  The answer is that of :func:`align`.

Defined cases: null roles and texts count as one space; rows without a turn come first; rows of one turn come by role,
then by a hash of the text; rows without a conversation are one conversation; equal rows repeat each other; texts of any length
are handled one part at a time; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import WHITE, materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 60
#: Turns of a part, and bytes of text after which it is closed.
PART, PART_BYTES = 512, 1 << 23
#: A turn as a number: the letter of its role, and whether it must go, or stays truncated.
LETTERS, MUST_GO, CUT_OFF = "sua", 4, 8
#: States of the grammar: nothing yet, after s, after a, after u; the next letter's state; and the cost of ending there.
EMPTY, AFTER_S, AFTER_A, AFTER_U = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_U, AFTER_A)
ENDED = [0, 2 * INSERT, 0, INSERT]


def letter(role: str) -> int:
    at = LETTERS.find(role[:1]) if role else -1
    return at if at >= 0 else 3


def greedy_cost(turns: bytes) -> int:
    """The cost of a plain repair: turns in order, an insertion where the turn after fits that better."""
    live = [t for t in turns if not t & MUST_GO]
    cost, state = DELETE * (len(turns) - len(live)), EMPTY
    for i, t in enumerate(live):
        cost += TRUNCATED * bool(t & CUT_OFF)
        if state == EMPTY and t & 3 == 0:
            state = AFTER_S
            continue
        wanted = 2 if state == AFTER_U else 1
        if t & 3 != wanted:
            after = live[i + 1] & 3 if i + 1 < len(live) else wanted
            if t & 3 == 3 - wanted and after == wanted:  # insert what is missing, then keep
                cost, state = cost + INSERT, NEXT[state]
            else:
                cost += REROLE
        state = NEXT[state]
    return min(cost + ENDED[state], DELETE * len(turns))


def align(turns: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair over all lengths of the target."""
    n = len(turns)
    left = [0] * (n + 1)  # turns that need not go, from each place on
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (not turns[i] & MUST_GO)
    sure = DELETE * (n - left[0]) + sum(TRUNCATED for t in turns if t & (MUST_GO | CUT_OFF) == CUT_OFF)
    reach = (greedy_cost(turns) - sure) // 2 + 1  # no cheapest path is further from the diagonal
    low = [max(0, r - reach) for r in left]
    plain: list[list[int]] = [[]] * (n + 1)  # cost of the turns from i on against the last j letters, j from low[i]
    headed: list[list[int]] = [[]] * (n + 1)  # the same with an s in front of them

    def at(table, i, j):
        k = j - low[i]
        return table[i][k] if 0 <= k < len(table[i]) else NEVER

    for i in range(n, -1, -1):
        row, head = [], []
        for j in range(low[i], left[i] + reach + 1):
            best = row[-1] + INSERT if row else 0 if i == n and not j else NEVER
            top = NEVER
            if i == n and low[i] == 0:
                best = INSERT * j
            elif i < n:
                t = turns[i]
                best = min(best, at(plain, i + 1, j) + DELETE)
                top = at(headed, i + 1, j) + DELETE
                if not t & MUST_GO:
                    stays = TRUNCATED * bool(t & CUT_OFF)
                    if j:
                        best = min(best, at(plain, i + 1, j - 1) + stays + REROLE * (t & 3 != (1 if j % 2 == 0 else 2)))
                    if t & 3 == 0 and j >= 2 and j % 2 == 0:
                        top = min(top, at(plain, i + 1, j) + stays)
            row.append(best)
            head.append(top)
        plain[i], headed[i] = row, head

    lengths = [(at(table, 0, m), m, table) for table in (plain, headed)
               for m in range(low[0], left[0] + reach + 1) if m % 2 == 0 and (m or table is plain)]
    cost = min(c for c, _, _ in lengths)
    return cost, min(_traced(turns, plain, headed, at, m, table is headed) for c, m, table in lengths if c == cost)


def _traced(turns: bytes, plain, headed, at, j: int, top: bool) -> str:
    """The ASCII-least of the cheapest paths to a target of j letters."""
    i, out = 0, []
    while i < len(turns) or j:
        cost = at(headed if top else plain, i, j)
        t = turns[i] if i < len(turns) else MUST_GO
        stays = TRUNCATED * bool(t & CUT_OFF)
        if i < len(turns) and cost == at(headed if top else plain, i + 1, j) + DELETE:
            out.append("D")
            i += 1
        elif top:
            out.append("K")
            i, top = i + 1, False
        elif j and cost == at(plain, i, j - 1) + INSERT:
            out.append("I")
            j -= 1
        else:
            keep = cost == at(plain, i + 1, j - 1) + stays and t & 3 == (1 if j % 2 == 0 else 2)
            out.append("K" if keep else "R")
            i, j = i + 1, j - 1
    return "".join(out)


def _costs(turns: bytes, beyond: list[int]) -> list[list[int]]:
    """Cost from each place and state to the end of the part, and ``beyond`` it by the state it ends in."""
    out = [[]] * len(turns) + [beyond]
    for i in range(len(turns) - 1, -1, -1):
        t, then = turns[i], out[i + 1]
        now = [min(NEVER, c + DELETE) for c in then]
        if not t & MUST_GO:
            stays = TRUNCATED * bool(t & CUT_OFF)
            for state in range(4):
                emit = then[NEXT[state]] + stays + REROLE * (t & 3 != (2 if state == AFTER_U else 1))
                now[state] = min(now[state], emit)
            if t & 3 == 0:
                now[EMPTY] = min(now[EMPTY], then[AFTER_S] + stays)
        for state in (AFTER_A, AFTER_U, AFTER_A, EMPTY, AFTER_S):  # insertions in front of the turn
            now[state] = min(now[state], now[NEXT[state]] + INSERT)
        out[i] = now
    return out


def _trace_part(turns: bytes, beyond: list[int], state: int, last: bool) -> tuple[str, int]:
    """(audit, state at the end) of a part from a state on, by the costs beyond it."""
    costs, i, out = _costs(turns, beyond), 0, []
    while i < len(turns):
        t, cost, then = turns[i], costs[i][state], costs[i + 1]
        stays = TRUNCATED * bool(t & CUT_OFF)
        fits = t & 3 == (2 if state == AFTER_U else 1)
        if cost == then[state] + DELETE:
            out.append("D")
            i += 1
        elif cost == costs[i][NEXT[state]] + INSERT:
            out.append("I")
            state = NEXT[state]
        elif t & 3 == 0 and state == EMPTY and cost == then[AFTER_S] + stays:
            out.append("K")
            i, state = i + 1, AFTER_S
        else:
            out.append("K" if fits else "R")
            i, state = i + 1, NEXT[state]
    while last and ENDED[state]:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def edited(audit: str, turns: bytes, roles: list[str], texts: list[str], state: int = EMPTY):
    """(cost, roles, texts, state): the turns that an audit leaves, from a state of the grammar on."""
    i, cost, out_roles, out_texts = 0, 0, [], []
    for edit in audit:
        if edit == "D":
            cost, i = cost + DELETE, i + 1
            continue
        named = "assistant" if state == AFTER_U else "user"
        if edit == "I":
            cost += INSERT
            out_roles.append(named)
            out_texts.append("")
        else:
            cost += REROLE * (edit == "R") + TRUNCATED * bool(turns[i] & CUT_OFF)
            out_roles.append(roles[i] if edit == "K" else named)
            out_texts.append(texts[i])
            i += 1
        state = AFTER_S if state == EMPTY and edit == "K" and turns[i - 1] & 3 == 0 else NEXT[state]
    return cost, out_roles, out_texts, state


_PART = [("seq", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64()),
         ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
         ("first", pa.string()), ("last", pa.string()), ("turns", pa.binary()), ("roles", pa.list_(pa.string())),
         ("texts", pa.list_(pa.string())), ("cost", pa.int64()), ("audit", pa.string())]
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.string()): "array<string>"}
PARTS = ", ".join(f"{name} {_SQL[kind]}" for name, kind in _PART)


def _part_batch(keys: list, kind: pa.DataType, parts: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array([p.get(n) for p in parts], t) for n, t in _PART)],
                                      names=["conv", *(n for n, _ in _PART)])


class _Part:
    """Turns of one conversation in order, up to the size of a part."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.bytes = bytearray(), [], [], 0
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.first_turn = self.last_turn = self.first = self.last = None
        self.n_turns = 0

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        bare = text.rstrip(WHITE)
        fault = 0 if not bare else 1 if seen else 2 if bare[-1] not in ".!?" else None
        if fault is not None:
            self.counts[fault] += 1
        if self.last is None:
            self.first = role[:1]
        else:
            self.counts[3] += self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.turns.append(letter(role) | MUST_GO * (fault in (0, 1)) | CUT_OFF * (fault == 2))
        gone = fault in (0, 1)
        self.roles.append(role)
        self.texts.append("" if gone else text)
        self.bytes += len(role) if gone else len(role) + len(text)

    @property
    def full(self) -> bool:
        return len(self.turns) >= PART or self.bytes >= PART_BYTES

    def row(self) -> dict:
        blank, duplicate, truncated, illegal = self.counts
        return {"first_turn": self.first_turn, "last_turn": self.last_turn, "n_turns": self.n_turns, "blank": blank,
                "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "first": self.first, "last": self.last,
                "turns": bytes(self.turns), "roles": self.roles, "texts": self.texts}

    def whole(self) -> dict:
        row = self.row()
        cost, audit = align(row["turns"])
        _, roles, texts, _ = edited(audit, row["turns"], self.roles, self.texts)
        return row | {"cost": cost, "audit": audit, "roles": roles, "texts": texts}


def _count_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one row with their number."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        found = table.group_by(table.column_names[:-1]).aggregate([("times", "sum")]).rename_columns(table.column_names)
        yield from found.to_batches()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to parts; conversations that lie inside the task in one part are mended."""
    seq = TaskContext.get().partitionId() << 33
    begun, open_, key, kind, starts, continued = False, None, None, pa.null(), True, False
    row, times, first = None, 0, False  # equal rows and the mark of the first follow one another
    keys, rows = [], []

    def give(whole: bool) -> None:
        nonlocal seq
        if open_ is not None and open_.turns:
            keys.append(key)
            rows.append(open_.whole() if whole else open_.row() | {"seq": seq})
            seq += 1

    def put() -> None:
        """Add the row that is now complete."""
        nonlocal open_, continued
        for i in range(times):
            if open_.full:
                give(False)
                open_, continued = _Part(), True
            open_.add(row[1], row[2], row[4], not first or i > 0)

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, turn, role, digest, text, n in zip(*(c.to_pylist() for c in batch.columns)):
            now = (conv, turn, role, digest, text)
            if row is None or now[:4] != row[:4]:
                if row is not None:
                    put()
                if not begun or conv != key:
                    give(begun and not starts and not continued)
                    starts, begun, continued = not begun, True, False
                    key, open_ = conv, _Part()
                row, times, first = now, 0, False
            if n:
                row, times = now, times + n
            else:
                first = True
        if len(rows) >= 4096:
            yield _part_batch(keys, kind, rows)
            keys, rows = [], []
    if row is not None:
        put()
        give(False)  # it may go on in the next task
    if rows:
        yield _part_batch(keys, kind, rows)


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a part costs from each state to each."""
    for batch in batches:
        tables = []
        for turns in batch.column(2).to_pylist():
            ends = [_costs(turns, [0 if s == end else NEVER for s in range(4)])[0] for end in range(4)]
            tables.append([ends[end][state] for state in range(4) for end in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tables, pa.list_(pa.int64()))],
                                         names=["conv", "seq", "costs"])


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs beyond each part, over parts sorted from each conversation's last to its first."""
    key, begun, costs = None, False, ENDED
    for batch in batches:
        seqs, out, lasts = [], [], []
        for conv, seq, table in zip(*(c.to_pylist() for c in batch.columns)):
            last = not begun or conv != key
            if last:
                key, begun, costs = conv, True, ENDED
            seqs.append(seq)
            out.append(costs)
            lasts.append(last)
            costs = [min(NEVER, *(table[4 * s + end] + costs[end] for end in range(4))) for s in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(out, pa.list_(pa.int64())), pa.array(lasts, pa.bool_())],
                                         names=["seq", "beyond", "ends"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of each part from each state."""
    for batch in batches:
        found = [[_trace_part(turns, beyond, state, last) for state in range(4)]
                 for turns, beyond, last in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([[a for a, _ in f] for f in found], pa.list_(pa.string())),
             pa.array([[s for _, s in f] for f in found], pa.list_(pa.int32()))], names=["seq", "audits", "ends_in"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the parts of each conversation in order: the traces that fit, and what lies between two parts."""
    key, begun, state, last, last_turn = None, False, EMPTY, None, None
    for batch in batches:
        names = batch.schema.names
        keys, rows = [], []
        for at in range(batch.num_rows):
            part = {n: batch.column(i)[at].as_py() for i, n in enumerate(names)}
            if not begun or part["conv"] != key:
                key, begun, state, last, last_turn = part["conv"], True, EMPTY, None, None
            if last is not None:
                part["illegal"] += last + part["first"] not in ("su", "ua", "au")
            if last_turn is not None and last_turn == part["first_turn"]:
                part["n_turns"] -= 1
            last, last_turn = part["last"], part["last_turn"] if part["last_turn"] is not None else last_turn
            part["audit"] = part["audits"][state]
            part["cost"], part["roles"], part["texts"], state = edited(
                part["audit"], part["turns"], part["roles"], part["texts"], state)
            keys.append(part["conv"])
            rows.append(part)
        yield _part_batch(keys, batch.schema.field(names.index("conv")).type, rows)


def repaired_parts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """The repaired conversations in parts of bounded size: conv, seq (null for a conversation in one part; parts come in its
    order), counts of faults, cost, audit, and roles and texts of the turns that the repair leaves."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                        F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"), F.lit(1).cast("long").alias("times"))
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, turn long, role string, digest string, text string, times long"
    counted = rows.mapInArrow(_count_equal, schema)
    firsts = (rows.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("at"))
              .select("conv", F.col("at.turn").alias("turn"), "role", "digest", F.lit("").alias("text"), F.lit(0).cast("long").alias("times")))
    order = ["conv", "turn", "role", "digest"]
    found = materialise(counted.unionByName(firsts).repartitionByRange(*order).sortWithinPartitions(*order)
                        .mapInArrow(_parts, f"conv {kind}, {PARTS}"), "conversations")
    parts = found.where("seq is not null")
    beyond = (parts.select("conv", "seq", "turns").mapInArrow(_transfers, f"conv {kind}, seq long, costs array<long>")
              .repartition("conv").sortWithinPartitions("conv", F.desc("seq"))
              .mapInArrow(_beyond, "seq long, beyond array<long>, ends boolean"))
    traces = (parts.select("seq", "turns").join(beyond, "seq").select("seq", "turns", "beyond", "ends")
              .mapInArrow(_traces, "seq long, audits array<string>, ends_in array<int>"))
    fitted = (parts.drop("cost", "audit").join(traces.drop("ends_in"), "seq").repartition("conv")
              .sortWithinPartitions("conv", "seq").mapInArrow(_fitted, f"conv {kind}, {PARTS}"))
    return found.where("seq is null").unionByName(fitted)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, over its parts in order; its text passes by a part at a time."""
    key, kind, digest, written, sums, audit, ends = None, pa.null(), None, False, [0] * 6, [], [None, None]
    out: list[list] = [[] for _ in range(9)]

    def close() -> None:
        gaps = ends[1] - ends[0] + 1 - sums[5] if ends[0] is not None else 0
        for column, value in zip(out, (key, gaps, *sums[:5], "".join(audit), digest.hexdigest())):
            column.append(value)

    def batch_of() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=_SUMMARY)

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, seq, first_turn, last_turn, n_turns, *counts, own, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is None or conv != key:
                if digest is not None:
                    close()
                key, digest, written, sums, audit, ends = conv, hashlib.sha256(), False, [0] * 6, [], [None, None]
            sums = [a + b for a, b in zip(sums, [*counts, n_turns])]
            if first_turn is not None:
                ends = [first_turn if ends[0] is None else ends[0], last_turn]
            audit.append(own)
            for role, text in zip(roles, texts):
                digest.update(("\n" * written + role + ":" + text).encode())
                written = True
        if out[0]:
            yield batch_of()
            out = [[] for _ in range(9)]
    if digest is not None:
        close()
        yield batch_of()


_SUMMARY = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]


def summaries(parts: DataFrame) -> DataFrame:
    """One row per conversation: gaps, counts of faults, cost, audit, and the SHA-256 of the repaired turns as
    ``role:text`` lines.  A conversation in one part is summed up where it lies; the parts of others pass by in order."""
    whole = parts.where("seq is null")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    lines = F.zip_with("roles", "texts", lambda role, text: F.concat(role, F.lit(":"), text))
    single = whole.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                          F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("digest"))
    kind = parts.schema["conv"].dataType.simpleString()
    several = parts.where("seq is not null").select(
        "conv", "seq", "first_turn", "last_turn", "n_turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles", "texts")
    return single.unionByName(several.repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(
        _digests, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, digest string"))
