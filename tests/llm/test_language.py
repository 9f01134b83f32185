from __future__ import annotations

from collections import Counter

import numpy as np

from attestry.llm import language


def grams(text):
    padded = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    padded = f" {padded} "
    out = Counter()
    for i in range(1, len(padded) - 1):
        a, b, c = padded[i - 1], padded[i], padded[i + 1]
        if b == " ":
            continue
        out[(1, b)] += 1
        out[(2, b + c)] += 1
        if a == " ":
            out[(2, a + b)] += 1
        out[(3, a + b + c)] += 1
    return out


def ranked(counter, size):
    key = lambda g: (g[0], [0 if x == " " else ord(x) for x in g[1]])
    return [g for g, _ in sorted(counter.items(), key=lambda x: (-x[1], key(x[0])))][:size]


def brute(train, texts, size):
    profiles = {}
    for lang, text in train:
        profiles.setdefault(lang, Counter()).update(grams(text))
    profiles = {k: {g: i for i, g in enumerate(ranked(v, size))} for k, v in profiles.items()}
    out = []
    for t in texts:
        own = ranked(grams(t), size)
        if not own:
            out.append(("und", 0.0))
            continue
        best = min((sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)), k) for k, p in profiles.items())
        out.append((best[1], round(1 - best[0] / (len(own) * size), 9)))
    return out


TRAIN = [("en", "the cat and the dog went to the house of the king"), ("en", None), ("fr", "le chat et le chien sont dans la maison du été"), ("de", "der hund und die katze über das große haus"), ("zz", "東京 東京都 日本")]
TEXTS = ["the king and the cat", "le chien été", "und die große katze", None, "", "123 !!", "日本 東京", "a", "the\0cat İstanbul", "x" * 5000, "the king and the cat"]


def test_same_as_plain_python(spark):
    train = spark.createDataFrame([(k, t, 1) for k, t in [*TRAIN, (None, "zzz zzz")]], "lang string, text string, n int")
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang_pred string")
    for size in (5, 400):
        got = language.predict(docs, language.learn(train, size=size), size=size).orderBy("doc_id").collect()
        assert [(r.lang_pred, round(r.score, 9)) for r in got] == brute([x for x in TRAIN if x[1]], TEXTS, size)


def test_predictions_do_not_depend_on_the_batch(spark):
    profiles = language.Profiles({"a": [1, 2]}, 5)
    assert profiles.predict([])[0] == []
    alone = [language.gram_counts([t])[1].tolist() for t in ("the cat", "日本", "été")]
    number, gram, _ = language.gram_counts(["the cat", "日本", "été"])
    assert [gram[number == k].tolist() for k in range(3)] == alone


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs, "doc_id").filter("held_out and lang is not null").select("lang", "lang_pred").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", None), (None, "c", None)], "doc_id long, text string, lang string")
    assert {tuple(r) for r in language.identify(docs).collect()} == {(1, False, "und", 0.0), (None, False, "und", 0.0)}
    assert language.identify(docs.limit(0)).count() == 0
