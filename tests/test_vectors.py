"""Word vectors of texts: pairs against brute force, and how much of the texts moves."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from attestry.operators import linkage as L
from attestry.operators import vectors


def texts(n=90):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(600)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            body = rows[-1][2].split() if i % 9 else rows[i // 2][2].split()
            body[rnd.randrange(len(body))] = rnd.choice(words)
        else:
            body = [rnd.choice(words[:20] if i % 2 else words) for _ in range(240)]
        rows.append((i, "de" if i % 5 == 0 else "en", ", ".join(body) + f" x{i}"))
    return [*rows, (n, "en", ""), (n + 1, "en", None), (n + 2, None, "w1 w2"), (n + 3, "de", "...")]


def brute(rows, threshold=0.97):
    tf = {i: (c, Counter(re.findall("[A-Za-z0-9]+", t or ""))) for i, c, t in rows if c and re.findall("[A-Za-z0-9]+", t or "")}
    n, df = Counter(c for c, _ in tf.values()), Counter((c, w) for c, v in tf.values() for w in v)
    vec = {i: (c, {w: k * (math.log((1 + n[c]) / (1 + df[c, w])) + 1) for w, k in v.items()}) for i, (c, v) in tf.items()}
    size = {i: math.sqrt(sum(x * x for x in v.values())) for i, (_, v) in vec.items()}
    out = {}
    for a, (ca, va) in vec.items():
        for b, (cb, vb) in vec.items():
            if a < b and ca == cb:
                cosine = sum(x * vb.get(w, 0) for w, x in va.items()) / size[a] / size[b]
                if cosine >= threshold:
                    out[a, b] = round(cosine, 9)
    return out


@pytest.mark.parametrize(("common", "block"), [(1 << 16, 128), (8, 1)])
def test_close_texts_are_complete(spark, monkeypatch, common, block):
    monkeypatch.setattr(vectors, "COMMON", common)  # with few known words most meet the table of words
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = texts()
    known = vectors.of_texts(spark.createDataFrame(rows, "id int, lang string, text string"), "lang", "id", "text")
    want = brute(rows)
    assert len(want) > 10
    assert {(r["a"], r["b"]): round(r["cosine"], 9) for r in L.near_pairs(known).collect()} == want
    root = {i: i for i, c, t in rows if c and re.findall("[A-Za-z0-9]+", t or "")}
    for _ in rows:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["n"]: r["root"] for r in L.near_components(known).collect()} == root


def test_no_word_of_a_text_becomes_a_row(spark):
    """Texts of frequent words alone: their words are known to every task, so only the few that may be heavy are rows."""
    from attestry.plans import linking

    rnd = random.Random(4)
    rows = [(i, "en", " ".join(f"w{rnd.randrange(200)}" for _ in range(400))) for i in range(60)]
    known = linking.word_vectors(spark.createDataFrame([*rows, (None, "en", "w1 w2")], "doc_id long, lang string, text string"))
    distinct = sum(len(set(t.split())) for _, _, t in rows)
    assert known.heavy.count() < distinct / 5
    assert known.of(known.names).count() == 60


def test_class_scores_take_the_three_best_of_every_class(spark, monkeypatch):
    """Blocks of signatures against pairs one by one, with packs of few references, a class of one member and a class left out."""
    rnd = random.Random(9)
    data = [(i, None if i == 7 else 5 if i == 0 else rnd.randrange(3), rnd.getrandbits(64) - (1 << 63)) for i in range(150)]
    monkeypatch.setattr(L, "PACK", 20)
    df = spark.createDataFrame(data, "id long, cls long, sig long")
    want = {}
    for i, _, s in data:
        for c in {c for _, c, _ in data if c is not None}:
            best = sorted((1 - bin((s ^ t) & (2**64 - 1)).count("1") / 64 for j, k, t in data if k == c and j != i), reverse=True)[:3]
            if best:
                want[i, c] = round(0.7 * best[0] + 0.3 * sum(best) / len(best), 9)
    assert (0, 5) not in want
    df = df.unionByName(spark.createDataFrame([(None, 1, 5), (None, 2, 0)], df.schema))  # without an id: neither target nor reference
    got = L.class_scores(df.select("id", "sig"), df, "id", "cls").collect()
    assert {(r["id"], r["cls"]): round(r["score"], 9) for r in got} == want and len(got) == len(want)


def test_token_overlap_calls_no_function_per_token(spark, tmp_path):
    from attestry.operators import metrics
    from attestry.plans import aggregates

    rows = [(1, "Ab ab c 77 x1 Straße ı9 AB. last one. end."), (2, ""), (3, None), (3, "a7 b7 a7. x. y.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = aggregates.near_copy_tokens(spark, str(tmp_path))
    out = metrics.multiset_overlap(tokens, "doc_id", "expected", "observed")
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert tokens.filter("doc_id = 1").head()["expected"] == ["AB", "AB", "77", "X1", "STRA", "AB", "LAST", "ONE", "END"]
    got = {r["doc_id"]: (r["expected_n"], r["observed_n"], r["matched_n"], r["number_recall"]) for r in out.collect()}
    assert got == {1: (9, 8, 7, 0.5), 3: (3, 3, 0, 0.0)}
