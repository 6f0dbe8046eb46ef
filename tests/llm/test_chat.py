"""Repairs are cheapest and legal, also when conversations span tasks; edge cases."""

import itertools
import random
import re

import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import chat as C  # noqa: E402


def cheapest(roles):
    """By trying everything, one turn at a time."""
    best = {0: 0}
    for r in roles:
        new = {}
        for q, c in best.items():
            for puts in [(), *((p,) for p in range(1, 4)), *itertools.product(range(1, 4), repeat=2)]:
                s, paid, ok = q, c, True
                for p in puts:
                    ok &= p in C.NEXT[s]
                    s, paid = p, paid + C.INSERT
                if not ok:
                    continue
                for to in range(1, 4):
                    change = 0 if to == r else C.RELABEL[r, to]
                    if to in C.NEXT[s]:
                        new[to] = min(new.get(to, 1 << 30), paid + change)
                    if s and to == s:
                        new[to] = min(new.get(to, 1 << 30), paid + change + C.MERGE)
        best = new
    return min(c + C.END[q] for q, c in best.items())


def legal(text):
    roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
    assert re.fullmatch(r"(?:<\|im_start\|>\w+\n(?:(?!<\|im_)[\s\S])*<\|im_end\|>\n)+", text)
    return re.fullmatch(r"(?:system )?user (?:assistant user )*(?:assistant )?", " ".join(roles) + " ")


@pytest.mark.parametrize("n", range(1, 6))
def test_all_short_sequences(n):
    for roles in itertools.product(range(4), repeat=n):
        assert sum(m[2] for m in C.repair(list(roles))) + C.END[C.repair(list(roles))[-1][1]] == cheapest(roles)


def test_borders_agree_with_the_whole():
    rng = random.Random(1)
    for _ in range(200):
        roles = [rng.randrange(4) for _ in range(12)]
        cuts = sorted(rng.sample(range(1, 12), 2))
        parts = [roles[: cuts[0]], roles[cuts[0] : cuts[1]], roles[cuts[1] :]]
        at = C.borders([(i, C.matrix(p)) for i, p in enumerate(parts)])
        moves = [m for i, p in enumerate(parts) for m in C.repair(p, *at[i])]
        assert sum(m[2] for m in moves) + C.END[moves[-1][1]] == cheapest(roles)


def test_spanning_tasks(spark):
    rng = random.Random(7)
    names = ["user", "assistant", "system", "tool", None, " Human ", "GPT"]
    rows = [(1, t, rng.choice(names), f"t{t}") for t in range(3000)] + [(c, t, rng.choice(names), rng.choice([None, "", "x <|im_end|> y"])) for c in range(2, 40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "n"), (50, None, "user", "a"), (50, None, "user", "a"), (51, 0, "system", "only")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, cost long")
    got = C.repaired(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    for key, turns in by.items():
        turns.sort(key=lambda r: -1 if r.turn is None else r.turn)
        assert legal("".join(r.piece for r in turns)), key
        assert sum(r.cost for r in turns) == cheapest([C.role_of(r.role) for r in turns])
    assert "".join(r.piece for r in by[51]) == "<|im_start|>system\nonly<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert C.repaired(df.limit(0)).collect() == []


def test_clean_conversations_stay(spark):
    from lantern.llm.queries import op9_chat_format

    got = op9_chat_format(spark, "/root/testdata/sf0.01").collect()
    assert got and all(r.action == "keep" and r.cost == 0 and r.inserted is None for r in got)
