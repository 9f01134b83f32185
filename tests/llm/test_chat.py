from __future__ import annotations

import random

from attestry.llm import chat


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, set()).add((turn, role or "", text or ""))
    order = lambda s: sorted(s, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    full = {c: order(s) for c, s in convs.items()}

    def prefix(a, b):
        if len(a) >= len(b) or b[: len(a)] != a:
            return False
        return a[-1][0] != b[len(a)][0]

    kept = {}
    for c, a in full.items():
        if any(prefix(a, b) for b in full.values()):
            continue
        if any(b == a and (d is None, d or 0) < (c is None, c or 0) for d, b in full.items() if d != c):
            continue
        kept[c] = a
    out = set()
    for c, a in kept.items():
        parts = {}
        for turn, role, text in a:
            parts.setdefault(None if turn is None else turn // chat.PART_TURNS, []).append(f"<|im_start|>{role}\n{text}<|im_end|>\n")
        out |= {(c, p, len(x), "".join(x)) for p, x in parts.items()}
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, part string, n_turns int")
    return sorted((tuple(r) for r in chat.chat_texts(df).collect()), key=str)


def test_snapshots_equal_ones_and_odd_rows(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 70, 130])
        first = rng.randrange(3)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{first if t < rng.choice([2, 5, 200]) else c} {t}") for t in range(n)]
    rows += [(100, t, "user", f"w{t}") for t in range(200)] + [(101, t, "user", f"w{t}") for t in range(150)] + [(102, t, "user", f"w{t}") for t in range(200)]
    rows += [(103, 0, None, None), (104, 0, "", ""), (105, None, "user", "a"), (105, 1, "user", "b"), (106, None, "user", "a")]
    rows += [(107, 0, "user", "tie"), (107, 0, "user", "tied"), (107, 0, "user", "tie"), (108, 0, "user", "tie"), (None, 0, "user", "none")]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_empty_and_native(spark):
    assert run(spark, [(1, 0, "user", "a")])[0][3] == "<|im_start|>user\na<|im_end|>\n"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_texts(empty).count() == 0
    plan = chat.chat_texts(empty)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
