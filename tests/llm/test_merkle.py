from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from attestry.llm import merkle
from attestry.llm.queries import op13

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, text, lang, source, n):
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(framed, (doc, source, lang, n, text)))


def slow_paths(leaves):
    """Root, and each leaf's steps: None, (left sibling, None) or (None, right sibling)."""
    paths, spots, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for path, at in zip(paths, spots, strict=True):
            other = at ^ 1
            path.append(None if other >= len(level) else (level[other], None) if at % 2 else (None, level[other]))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        spots = [at // 2 for at in spots]
    return (level[0] if level else None), paths


def fold(leaf, path):
    for step in path:
        leaf = h(leaf) if step is None else h(step[0], leaf) if step[0] else h(leaf, step[1])
    return leaf


def slow(rows):
    none_first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for row in rows:
        doc, text, lang, source, n = row
        bad = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        groups.setdefault(lang, []).append((none_first(doc), leaf_of(*row), leaf_of(doc, text, lang, source, n + 1) if bad else None, doc))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = []
    for g in order:
        groups[g].sort(key=lambda x: (x[0], x[1]))
        subs.append(slow_paths([x[1] for x in groups[g]]))
    root, tops = slow_paths([s for s, _ in subs])
    out = []
    for g, (sub, paths), top in zip(order, subs, tops, strict=True):
        for (_, leaf, changed, doc), path in zip(groups[g], paths, strict=True):
            steps = path + top
            proof = h(*[s[0] or s[1] for s in steps if s])
            end = fold(changed or leaf, steps)
            out.append((doc, leaf, sub, root, proof, end, end == root))
    return out


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def documents(rng, n):
    langs = ["en"] * 6 + ["de", "é", None, "E"]
    return [(i * 2, rng.choice([None, "", "text é " * rng.randrange(30)]), rng.choice(langs), rng.choice([None, "", "web"]), rng.choice([None, 0, 12345])) for i in range(n)]


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_trees_by_hand(spark, bits):
    rng = random.Random(bits)
    rows = documents(rng, 90)
    rows += [(4, "again", "en", "web", 1), (4, "and again", "en", "web", 1), (None, "x", "en", None, 3), (None, "y", None, None, 4), (901, "only one", "zz", "s", 5)]
    rows += [(4, "again", "en", "web", 1), (903, "very long " * 50_000, "de", "s", 6)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tree", "2 AS pos", "3 AS h")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    assert by_value(merkle.verified(docs, {"n_chars": tampered}, bits=bits).collect()) == by_value(slow(rows))


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1), (2, "a", "de", "s", 1)]])
def test_few_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert by_value(op13(spark, str(tmp_path)).collect()) == by_value(slow(rows))


def test_any_size_of_tree_in_a_block():
    for n in range(1, 40):
        leaves = [h(str(i)) for i in range(n)]
        nodes = merkle.forward([x.encode() for x in leaves], merkle.height(n, n, 12))
        root, paths = slow_paths(leaves)
        assert nodes[-1][1].decode() == root
        got = [[None if w == merkle.ALONE else (s.decode(), None) if w == merkle.LEFT else (None, s.decode()) for w, s in merkle.steps(p)] for p in merkle.backward(nodes, None)]
        assert got == paths
        assert all(list(merkle.steps(merkle.unpacked(merkle.packed(p)))) == list(merkle.steps(p)) for p in merkle.backward(nodes, None))


def test_other_tables_and_keys(spark):
    docs = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, None)], "name string, v int, kind string")
    clean = merkle.verified(docs, None, ("name", "v"), "name", "kind").collect()
    assert all(r["verified"] for r in clean) and len({r["root"] for r in clean}) == 1
    now = {"v": F.when(F.col("name") == "b", 9).otherwise(F.col("v"))}
    assert {r["name"]: r["verified"] for r in merkle.verified(docs, now, ("name", "v"), "name", "kind").collect()} == {"a": True, "b": False, "c": True}
