from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

from attestry.llm import golay
from attestry.llm.batches import utf8
from attestry.llm.queries import op12

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_hash(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """The smallest place reachable by links, per fingerprint."""
    kinds = sorted(set(prints))
    to = {p: p for p in kinds}

    def top(p):
        while to[p] != p:
            p = to[p]
        return p

    for a, b in combinations(kinds, 2):
        if (a ^ b).bit_count() <= 2:
            to[top(a)] = top(b)
    return [top(p) for p in prints]


def slow_link(rows):
    prints = [slow_hash(t) for _, t in rows]
    part = slow_components(prints)
    least = {}
    for (doc, _), c in zip(rows, part, strict=True):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    return [(doc, f"{p:016x}", least.get(c)) for (doc, _), p, c in zip(rows, prints, part, strict=True)]


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_codewords_are_near_and_shared():
    rng = np.random.default_rng(2)
    word = rng.integers(0, 1 << 23, 3000)
    keys = golay.codewords(word)
    assert ((keys >= 0).sum(1) != 1).any() and (np.isin((keys >= 0).sum(1), [1, 6])).all()
    whole = np.array([(h << 11) | golay._remainder(h << 11) for h in range(4096)])
    assert all(golay._remainder(int(w)) == 0 for w in whole[:200])
    for w, k in zip(word[:100].tolist(), keys[:100], strict=True):
        away = [(w ^ int(whole[i])).bit_count() for i in k if i >= 0]
        assert max(away) <= 4 and away[0] == min(away) == min((w ^ int(c)).bit_count() for c in whole)
    for bit in range(23):
        nearest = golay.codewords(word ^ (1 << bit))[:, 0]
        assert (keys == nearest[:, None]).any(1).all()


def test_fingerprints():
    rng = random.Random(3)
    texts = [None, "", " \t", "A", "a b", "É x\ty Z", "q " * 700] + [" ".join(rng.choice(["ab", "Cd", "é", "x" * rng.randrange(1, 40)]) for _ in range(rng.choice([3, 60, 600]))) for _ in range(60)]
    assert golay.simhashes(*utf8(pa.array(texts, pa.string()))).tolist() == [slow_hash(t) for t in texts]


def test_links_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    prints = {0, 1, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            for _ in range(rng.randrange(4)):
                base ^= 1 << rng.randrange(64)
            prints.add(base)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    found = golay.candidates(nodes)
    linked = {p for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2 for p in (a, b)}
    assert linked <= {r["fp"] % (1 << 64) for r in found.collect()}
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in golay.near_links(found).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    to = {p: p for p in prints}

    def top(p):
        while to[p] != p:
            p = to[p]
        return p

    for a, b in links:
        to[top(a)] = top(b)
    groups = lambda names: {frozenset(p for p, n in zip(prints, names, strict=True) if n == m) for m in names}
    assert groups([top(p) for p in prints]) == groups(slow_components(prints))


def test_a_large_cluster_of_near_copies_makes_no_pairs(spark):
    rng = random.Random(5)
    base, prints = rng.getrandbits(63), set()
    while len(prints) < 3000:
        p = base
        for _ in range(rng.randrange(5)):
            p ^= 1 << rng.randrange(63)
        prints.add(p)
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    assert golay.near_links(golay.candidates(nodes)).count() < 70 * len(prints)


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i * 3, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 40, 400])))) for i in range(60)]
    for _, text in rows[:20]:
        words = text.split()
        words[rng.randrange(len(words))] = "changed"
        rows += [(len(rows) * 3 + 1, " ".join(words)), (len(rows) * 3 + 2, text.upper())]
    rows += [(5000, None), (5001, ""), (5001, " "), (None, rows[0][1]), (None, "nobody else has this"), (7, "one two three"), (7, "four five six"), (9, "long " * 60_000)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component").write.parquet(f"{tmp_path}/documents.parquet")
    assert by_value(op12(spark, str(tmp_path)).collect()) == by_value(slow_link(rows))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12(spark, f"{tmp_path}/none").count() == 0
