from __future__ import annotations

import random
from collections import defaultdict

import pytest

from attestry.operators import search as S


def brute(hits, queries, k):
    terms = defaultdict(set)
    for h, t in hits:
        terms[h].add(t)
    weights = defaultdict(lambda: defaultdict(int))
    for q, t, w in queries:
        if t is not None:
            weights[q][t] += w
    best, totals = [], {}
    for q, of in weights.items():
        scored = sorted((-sum(w for t, w in of.items() if t in own), h) for h, own in terms.items() if own & set(of))
        best += [(q, h, -s, i + 1) for i, (s, h) in enumerate(scored[:k])]
        if scored:
            totals[q] = len(scored)
    return sorted(best), totals


@pytest.mark.parametrize("most_terms", [10, 2])
def test_best_texts_are_those_of_all_pairs(spark, most_terms):
    rng = random.Random(most_terms)
    words = [f"w{i}" for i in range(25)]
    hits = sorted({(h, t) for h in range(80) for t in rng.sample(words, rng.randrange(6)) + ["hot"] * (rng.random() < 0.9)})
    queries = [(f"q{q}", t, rng.choice([5, 8, 8, 20])) for q in range(30) for t in rng.choices([*words, "hot", "absent", None], k=rng.randrange(1, 6))] + [("none", "absent", 3)]
    h, q = spark.createDataFrame(hits, "holder int, term string"), spark.createDataFrame(queries, "query string, term string, weight int")
    best, totals = brute(hits, queries, 3)
    got = S.top_holders(h, "holder", q, "query", k=3, most_terms=most_terms).select("query", "holder", "score", "rank_no")
    assert sorted(map(tuple, got.collect())) == best
    assert dict(map(tuple, S.holder_counts(h, "holder", q, "query", most_terms=most_terms).collect())) == totals


def test_a_term_in_every_text_and_every_query_stays_linear(spark):
    n, m = 3000, 2000
    hits = spark.range(n).selectExpr("id AS holder", "explode(array('hot', concat('t', id % 500))) AS term")
    queries = spark.range(m).selectExpr("id AS query", "explode(array('hot', concat('t', id % 700), 'also')) AS term", "1 AS weight")
    sets = queries.select("query").distinct().selectExpr("query", "explode(array(array('hot'), array(concat('t', query % 700)), array('hot', concat('t', query % 700)))) AS key").select("key").distinct()
    assert S.held_sets(hits, "holder", "term", sets).count() <= 4 * n  # not n * m
    top = S.top_holders(hits, "holder", queries, "query", k=2).filter("query = 3").orderBy("rank_no").collect()
    assert [(r.holder, r.score) for r in top] == [(3, 2), (503, 2)]
    assert S.holder_counts(hits, "holder", queries, "query").filter("query = 3").head()["total"] == n
