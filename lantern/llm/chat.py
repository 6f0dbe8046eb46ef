"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in
turn.  The automaton's states are what stands last: nothing, system, user or
assistant.  Each input turn is kept, merged into the turn before, relabelled,
or preceded by an empty turn; dynamic programming over the states finds the
cheapest repair, and the repaired sequence is rendered turn by turn.

A turn's costs form a 4 x 4 matrix, and the costs of a run of turns are the
(min, +) product of theirs.  Turns are range-partitioned in order, so a
conversation may span tasks: each task first gives the products of its first
and last conversation (two rows a task), from which the states at the borders
follow; then each task repairs its own turns between known states.  No task or
driver gathers a whole long conversation.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: What may follow each state.
NEXT = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT = 1, 2
#: Cost of a relabelling, by the role that a turn has (0: unknown) and gets.
RELABEL = {(0, SYSTEM): 5, (0, USER): 2, (0, ASSISTANT): 3, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 5, (USER, SYSTEM): 5, (USER, ASSISTANT): 4,
    (ASSISTANT, SYSTEM): 5, (ASSISTANT, USER): 4}
_FAR = 1 << 40
#: Cost of ending in each state; after a lone system turn an empty user turn is put in.
END = (0, INSERT, 0, 0)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def role_of(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else 0


def _moves(role: int) -> list[tuple[int, int, int, str, int | None]]:
    """(state, next state, cost, action, role put in before), the preferred ones first."""
    out = []
    for q in range(4):
        for put in (None, *NEXT[q]):
            s, paid = (q, 0) if put is None else (put, INSERT)
            for to in NEXT[s]:
                out.append((q, to, paid + (0 if to == role else RELABEL[role, to]), "keep" if to == role else "relabel", put))
        if q != NONE:
            out.append((q, q, MERGE + (0 if q == role else RELABEL[role, q]), "merge", None))
    return sorted(out, key=lambda m: (m[2], ("keep", "merge", "relabel").index(m[3]), m[4] is not None))


_MOVES = {}
for _r in range(4):
    _best: dict = {}
    for _m in _moves(_r):
        _best.setdefault((_m[0], _m[1]), _m)
    _MOVES[_r] = list(_best.values())


def advance(costs: list[int], role: int) -> tuple[list[int], list]:
    """Costs of each state after a turn, and the move that leads there."""
    out, how = [_FAR] * 4, [None] * 4
    for move in _MOVES[role]:
        c = costs[move[0]] + move[2]
        if c < out[move[1]]:
            out[move[1]], how[move[1]] = c, move
    return out, how


def matrix(roles: list[int]) -> list[list[int]]:
    rows = []
    for q in range(4):
        costs = [_FAR] * 4
        costs[q] = 0
        for r in roles:
            costs, _ = advance(costs, r)
        rows.append(costs)
    return rows


def repair(roles: list[int], start: int = NONE, end: int | None = None) -> list[tuple]:
    """The cheapest moves from state start, to state end or to the best one to end in."""
    costs = [_FAR] * 4
    costs[start] = 0
    back = []
    for r in roles:
        costs, how = advance(costs, r)
        back.append(how)
    q = min(range(4), key=lambda s: (costs[s] + END[s], s)) if end is None else end
    out = []
    for how in reversed(back):
        out.append(how[q])
        q = how[q][0]
    return out[::-1]


def borders(pieces: list[tuple[int, list[list[int]]]]) -> dict[int, tuple[int, int]]:
    """Of one conversation's pieces (task, matrix) in order: the states each begins and ends in."""
    costs, back = [_FAR] * 4, []
    costs[NONE] = 0
    for _, m in pieces:
        new = [min((costs[q] + m[q][t], q) for q in range(4)) for t in range(4)]
        costs = [min(c, _FAR) for c, _ in new]
        back.append([q for _, q in new])
    q, out = min(range(4), key=lambda s: (costs[s] + END[s], s)), {}
    for (task, _), b in zip(reversed(pieces), reversed(back), strict=True):
        out[task] = (b[q], q)
        q = b[q]
    return out


def _escaped(text: str | None) -> str:
    return (text or "").replace(OPEN, "< |im_start|>").replace(CLOSE, "< |im_end|>")


def _groups(batches):
    """(conv_id, rows) of consecutive rows with one conv_id."""
    key, held = None, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held is not None and row[0] == key:
                held.append(row)
                continue
            if held is not None:
                yield key, held
            key, held = row[0], [row]
    if held is not None:
        yield key, held


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) in order over range partitions, checkpointed so that the partitions stay."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    tie = rows.withColumn("_tie", F.xxhash64("role", "text"))
    keys = ["conv_id", "turn", "_tie"]
    return cut(tie.repartitionByRange(*keys).sortWithinPartitions(*keys, "role", "text").drop("_tie"))


def repaired(turns: DataFrame) -> DataFrame:
    """A row per turn: conv_id, turn, role, new_role, action, inserted, appended, cost, piece.

    action: keep, merge (into the turn before) or relabel; inserted: the role of
    the empty turn put in before, or null; appended: of one put in at the end;
    cost: of this turn's repair; piece: its part of the rendered conversation,
    which is the pieces of the conversation in order of turn.  Turns go in order
    of turn (null first; equal ones by role and text).  A null or unknown role
    is relabelled, a null text is empty, a null conv_id is a conversation.  Turns
    that repeat are turns of their own.  A long conversation may span tasks, a
    long text is one row.  An empty table gives no rows; other columns are left
    out.
    """
    prepare(turns.sparkSession)
    rows = ordered(turns)

    def edges(batches):
        first = last = None
        for key, held in _groups(batches):
            own = (key, matrix([role_of(r[2]) for r in held]))
            first = first or own
            last = own
        task = TaskContext.get().partitionId()
        found = [] if first is None else [(0, *first)] + ([(1, *last)] if last is not first else [])
        yield pa.RecordBatch.from_pydict({"task": [task] * len(found), "last": [f[0] for f in found], "conv_id": [f[1] for f in found],
            "m": [[x for r in f[2] for x in r] for f in found]}, schema=pa.schema([("task", pa.int32()), ("last", pa.int32()),
            ("conv_id", pa.int64()), ("m", pa.list_(pa.int64()))]))

    spans: dict = {}
    for r in rows.mapInArrow(edges, "task int, last int, conv_id long, m array<long>").orderBy("task", "last").collect():  # two rows a task
        spans.setdefault(r.conv_id, []).append((r.task, [r.m[i : i + 4] for i in range(0, 16, 4)]))
    known = {key: borders(p) | {"last": p[-1][0]} for key, p in spans.items() if len(p) > 1}

    def run(batches):
        task, out, names = TaskContext.get().partitionId(), [], ["conv_id", "turn", "role", "new_role", "action", "inserted", "appended", "cost", "piece"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))

        def sent():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)
            out.clear()
            return batch

        for key, held in _groups(batches):
            span = known.get(key)
            start, end = span[task] if span else (NONE, None)
            moves = repair([role_of(r[2]) for r in held], start, end)
            for k, ((_, turn, role, text), (q, to, cost, action, put)) in enumerate(zip(held, moves, strict=True)):
                piece = "\n" if action == "merge" else ""
                if action != "merge":
                    piece = f"{CLOSE}\n" if q != NONE else ""
                    piece += f"{OPEN}{ROLES[put]}\n{CLOSE}\n" if put is not None else ""
                    piece += f"{OPEN}{ROLES[to]}\n"
                piece += _escaped(text)
                appended = None
                if k == len(held) - 1 and (not span or span["last"] == task):
                    piece += f"{CLOSE}\n"
                    if END[to]:
                        appended, cost = "user", cost + END[to]
                        piece += f"{OPEN}user\n{CLOSE}\n"
                out.append((key, turn, role, ROLES[to], action, ROLES[put] if put is not None else None, appended, cost, piece))
            if len(out) >= 2000:
                yield sent()
        if out:
            yield sent()

    return rows.mapInArrow(run, "conv_id long, turn long, role string, new_role string, action string, inserted string, appended string, cost long, piece string")
