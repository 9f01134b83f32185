from __future__ import annotations

import random
import re

import numpy as np
import pytest

from attestry.llm import jaccard
from attestry.llm.batches import utf8
from attestry.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, rule):
    sets = [shingles(t, rule.words) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rule.den * both >= rule.num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted(((key, len(s), least.get(root(i))) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    out = []
    for _ in range(n):
        size = rng.choice([1, 3, 4, 5, 8, 9, 12, 20, 60, 200, 700])
        text = [rng.choice(words) for _ in range(size)]
        if rng.random() < 0.4:
            text = passage + text
        out.append(text)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(rng.choice([text, out[-1]]))
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [rng.choice(words).upper()]
            out.append(copy)
    return [" ".join(t) if rng.random() < 0.8 else "\n".join(t) + "\t" for t in out]


@pytest.mark.parametrize(("seed", "rule"), [(1, jaccard.Similar(4, 85, 100)), (2, jaccard.Similar())])
def test_components_like_brute_force(spark, seed, rule):
    texts = corpus(seed, 60)
    rows = [(k, t) for k, t in enumerate(texts)] + [(-1, None), (-2, ""), (-3, " \n"), (None, texts[5]), (None, "none like it at all here"), (7, texts[7]), (7, "a b")]
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(5)
    got = sorted((tuple(r) for r in jaccard.link(docs, rule).collect()), key=str)
    assert got == brute(rows, rule)


@pytest.mark.parametrize("rule", [jaccard.Similar(4, 85, 100), jaccard.Similar(), jaccard.Similar(1, 95, 100)])
def test_linked_sets_share_a_key(rule):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts, pairs = [], []
    for n in [*range(1, 90), 150, 333, 900, 2000] * 3:
        a = rng.choice(10**9, n, replace=False)
        away = int(rng.integers(0, rule.differ(2 * n) + 1))
        b = np.concatenate([a[away // 2 :], rng.choice(10**9, away - away // 2) + 10**9])
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(f"{x}" for x in a), " ".join(f"{x}" for x in b)]
    one = jaccard.Similar(1, rule.num, rule.den)
    sets = jaccard.Sets(*utf8(pa.array(texts)), 1)
    key, owner, need = jaccard.block_keys(sets, np.arange(len(texts)), one)
    keys = [set(key[owner == i].tolist()) for i in range(len(texts))]
    needs = [{int(k) & 255: int(n) for k, n in zip(key[owner == i], need[owner == i], strict=True)} for i in range(len(texts))]
    tested = 0
    for i, j in pairs:
        if one.linked(sets.of(i), sets.of(j)) and sets.node[i] != sets.node[j]:
            tested += 1
            shared = [k & 255 for k in keys[i] & keys[j]]
            assert any(shared.count(x) >= max(needs[i][x], needs[j][x]) for x in set(shared))
    assert tested > 100


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    random.Random(1).shuffle(links)
    got = dict((r.node, r.component) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}


def test_one_document_of_each_component_stays(spark):
    rule = jaccard.Similar()
    texts = corpus(9, 25)
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(-1, None, 0), (-2, "", 0), (None, texts[5], 1), (None, "not like any at all here", 2), (7, texts[7], 3), (7, "a b c d e f g", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _c0 int")
    out = jaccard.one_of_each(docs, rule)
    assert out.schema == docs.schema
    got = out.collect()
    ours = [(r.doc_id, r.text) for r in got]
    want = brute([(i, t) for i, (_, t, _) in enumerate(rows)], rule)
    components = {c for _, n, c in want if n}
    assert len(ours) == len(components) + 2 and {(-1, None), (-2, ""), (None, "not like any at all here"), (7, "a b c d e f g")} <= set(ours)
    at = {c: {(rows[i][0], rows[i][1]) for i, n, d in want if n and d == c} for c in components}
    for members in at.values():
        (stays,) = members & set(ours)
        assert stays[0] == min((k for k, _ in members if k is not None), default=None)
    assert jaccard.one_of_each(docs.limit(0), rule).count() == 0


def test_empty_table(spark):
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_rows_without_an_id_do_not_meet(spark):
    shared = [f"{w} " * 3 + " ".join(f"s{k}" for k in range(40)) for w in ("a", "b", "c")]
    rows = [(None, shared[k % 3] + f" t{k % 50}") for k in range(2000)] + [(5, shared[0]), (5, shared[1] + " t1"), (5, "alone in all of the table")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rule = jaccard.Similar()
    known = docs.select(jaccard._row_hash("doc_id", "text").alias("_ref"), "doc_id", "text")
    marked = known.select(jaccard.F.struct("_ref").alias("who"), "text")
    plain = jaccard.nodes(marked, rule, "who", "text").select(jaccard.F.col("who._ref").alias("_ref"), "n_shingles", "node")
    wanted = plain.select("node").distinct().selectExpr("node", "node AS leader", "0 AS salts", "0 AS lead_salts")
    assert jaccard.candidate_sets(docs, plain, wanted, rule, "doc_id", "text").count() == wanted.count()
    assert sorted((tuple(r) for r in jaccard.link(docs, rule).collect()), key=str) == brute(rows, rule)


def test_words_built_to_collide_are_different():
    import pyarrow as pa

    for n in (10, 11, 12):
        a = "".join("ab"[k.bit_count() & 1] for k in range(1 << n))
        b = a.translate(str.maketrans("ab", "ba"))
        sets = jaccard.Sets(*utf8(pa.array([f"x {a} y z", f"x {b} y z", f"x {a} y z"])), 4)
        assert sets.node[0] == sets.node[2] != sets.node[1]
