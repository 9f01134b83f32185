from __future__ import annotations

import re

from attestry.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    ws = WORD.findall(t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup, n_lines = set(), 0, 0
    for line in t.split("\n"):
        if WORD.search(line):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    n, chars = len(ws), sum(map(len, ws))
    symbols = sum(c in "#*$%&|<>" for c in t)
    failed = n < 50 or 100 * len(hit) > 50 * n
    up = len(re.findall("[A-Z]", t))
    bad = 100 * symbols > 10 * n or 100 * dup > 60 * n_lines or chars < 2 * n or chars > 15 * n or 100 * up > 30 * len(re.findall("[A-Za-z]", t)) or 100 * t.count("!") > 20 * n
    return n, chars, symbols, dup, len(hit), failed, not failed and not bad


def cases():
    some = [f"w{i}é東 " * 1 for i in range(80)]
    text = "".join(some)
    return [
        None, "", " \t\r\x0b", "a", "a b c a b c", "x\n\nx\n x\nx\r\n", text, text.upper(), text + "!" * 40, text.replace(" ", "# "), text + "\n" + text,
        "\n".join([text] + ["same line here"] * 9), "a b " * 200, "word" * 50_000 + " " + text, text, " ".join("abcdefghijklmnopqrstu"[i % 20 :] + str(i) * 9 for i in range(90)),
        "\x85 \xa0 " + text, "  lead " + text + "\n",
    ]


def test_same_as_plain_python_in_any_order(spark):
    rows = [(i, t, "n") for i, t in enumerate(cases())] + [(None, "a b", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    for rules in (q.RULES, q.RULES[::-1]):
        got = sorted((tuple(r) for r in q.cascade(docs, rules).collect()), key=str)
        assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)


def test_order_is_by_rejections_per_cost(spark):
    order = q.ordered(q.RULES, [(r.name, 1.0, 0.0) if r.name != "capital letters" else (r.name, 2.0, 0.5) for r in q.RULES])
    assert order[0].name == "capital letters"
    docs = spark.createDataFrame([(1, t) for t in cases()], "doc_id long, text string")
    assert [x[0] for x in q.estimate(docs)] == [r.name for r in q.RULES]


def test_lines_and_words_built_to_collide(spark):
    rows = []
    for n in range(7, 13):
        a = "".join("ab"[k.bit_count() & 1] for k in range(1 << n))
        b = a.translate(str.maketrans("ab", "ba"))
        rows += [(n, f"{a}\n{b}\n{a}"), (-n, f"x {a} y x {b} y"), (n, f"{a} " * 3 + f"{b} " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in q.cascade(docs).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_empty_table(spark):
    assert q.cascade(spark.createDataFrame([], "doc_id long, text string")).count() == 0
