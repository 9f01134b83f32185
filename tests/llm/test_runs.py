from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from attestry.llm import runs
from attestry.llm.batches import utf8
from attestry.llm.queries import op11, tenth_rearranged

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, m, q) for (s, m), q in found.items())


def slow_collapsed(words):
    gone = {i for s, m, q in slow_runs(words) for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def slow_row(doc, text):
    words = WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc, len(found), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(slow_collapsed(words).encode()).hexdigest())


def texts_of(rng, n):
    out = []
    for _ in range(n):
        m, kinds = rng.choice([0, 1, 11, 12, 13, 24, 60, 150, 400]), rng.choice([1, 2, 3, 5, 50])
        words = [str(rng.randrange(kinds)) for _ in range(m)]
        for _ in range(rng.randrange(3) if m > 1 else 0):
            p, at = rng.randrange(1, max(2, m // 3)), rng.randrange(m)
            for i in range(at + p, min(m, at + rng.randrange(1, m))):
                words[i] = words[i - p]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    return out


def found(texts, least=12):
    t = runs.Texts(*utf8(pa.array(texts, pa.string())), least)
    return [list(zip(*[x.tolist() for x in t.runs(i)], strict=True)) for i in range(t.n)], [x.decode() for x in t.collapsed()]


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for size in (8, 64, 1024):
        a, b = rng.integers(0, runs.PRIME, size), rng.integers(0, 1000, size)
        got = runs.inverse(runs._reduced(runs.transform(a[None]) * runs.transform(b[None])))[0]
        want = [sum(int(a[i]) * int(b[(k - i) % size]) for i in range(size)) % runs.PRIME for k in range(min(size, 20))]
        assert got[: len(want)].tolist() == want


@pytest.mark.parametrize("least", [12, 5, 30])
def test_runs_are_those_of_brute_force(least):
    texts = texts_of(random.Random(least), 400)
    got, _ = found(texts, least)
    assert got == [slow_runs(WORDS.findall(t), least) for t in texts]


def test_too_short_runs_are_refused():
    with pytest.raises(ValueError, match="fewer than 5"):
        found(["a a"], 4)


def test_collapsed_texts():
    texts = texts_of(random.Random(7), 200)
    assert found(texts)[1] == [slow_collapsed(WORDS.findall(t)) for t in texts]


def test_very_long_and_highly_periodic_texts():
    short, long = ["a"], ["a", "b"]
    while len(long) < 1500:
        short, long = long, short + long
    assert found([" ".join(long)])[0][0] == slow_runs(long)
    one = "a " * 300_000
    assert found([one, one + "b " + one])[0] == [[(0, 300_000, 1)], [(0, 300_000, 1), (300_001, 300_000, 1)]]
    many = [str(i) for i in range(40_000)]
    assert found([" ".join(many * 2)])[0] == [[(0, 80_000, 40_000)]]


def test_words_whose_sums_leave_the_prime_are_compared():
    many = [str(i) for i in range(60_000)]
    assert found([" ".join(many + many[:59_999] + ["x"])])[0] == [[]]


def test_query_and_odd_rows(spark, tmp_path):
    rng = random.Random(11)
    texts = texts_of(rng, 150) + [None, "", " \t\n", "é é é é é é é é é é é é", "a " * 5000]
    rows = [(i * 37, t) for i, t in enumerate(texts)] + [(None, "a " * 20), (None, None), (5, "x y " * 9), (5, "x y " * 9)]
    schema = "doc_id long, text string"
    spark.createDataFrame(rows, schema).withColumnsRenamed({}).selectExpr("*", "1 AS n_runs", "2 AS start").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op11(spark, str(tmp_path)).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted([slow_row(*r) for r in rows], key=key)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op11(spark, f"{tmp_path}/none").count() == 0


def test_rearranging_needs_a_known_id():
    assert tenth_rearranged(None, 5) is None
    assert sum(tenth_rearranged(i, 9) is not None for i in range(1000)) in range(60, 150)


def test_general_outputs(spark):
    docs = spark.createDataFrame([("a", "x y " * 8 + "z"), ("b", None), ("c", "1 2 3")], "name string, body string")
    assert [tuple(r) for r in runs.runs(docs, "name", "body").collect()] == [("a", 0, 16, 2)]
    assert {r["name"]: r["body"] for r in runs.collapsed(docs, "name", "body").collect()} == {"a": "x y z", "b": None, "c": "1 2 3"}
