from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from attestry.llm import syncmers
from attestry.llm.batches import SpanHashes


def test_closed_syncmers_by_hand():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé ") for _ in range(n)) for n in (0, 5, 19, 20, 21, 300)]
    data, off = syncmers._joined(texts)
    number, at, kmer = syncmers.closed_syncmers(data, off)
    got = sorted(zip(number.tolist(), at.tolist(), kmer.tolist(), strict=True))
    hashes, want = SpanHashes(data), []
    one = lambda a, b: int(hashes(np.array([a]), np.array([b]))[0])
    for d in range(len(texts)):
        for i in range(off[d], off[d + 1] - 19):
            inner = [one(j, j + 8) for j in range(i, i + 13)]
            if min(inner) in (inner[0], inner[-1]):
                want.append((d, i - off[d], one(i, i + 20)))
    assert got == want


def test_anchors_move_with_the_passage():
    passage = "".join(random.Random(4).choice("abcdefgh ") for _ in range(200))
    found = []
    for text in (passage, "some other words before " + passage + " and after"):
        _, at, kmer = syncmers.closed_syncmers(*syncmers._joined([text]))
        found.append({(int(a) - text.index(passage), int(h)) for a, h in zip(at, kmer, strict=True)})
    assert found[0] <= found[1]


def test_likeness_is_jaccard_for_small_sets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint32) for _ in range(2))
        assert syncmers.likeness(a, b) == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        u = np.union1d(a, b)[:7]
        assert syncmers.likeness(a[:7], b[:7], 7) == pytest.approx(np.isin(u, np.intersect1d(a, b)).mean())


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = text or "", after or ""
        out.append((key, t, t[: len(t) - len(t) // 2] + n[: len(t) // 2], n))
    return out


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_rows(spark, ranges):
    rng = random.Random(ranges)
    texts = ["".join(rng.choice("abcdefgh é東") for _ in range(rng.choice([0, 1, 30, 700]))) for _ in range(60)]
    rows = [(rng.randrange(-20, 90), t) for t in texts] + [(5, None), (None, "null id"), (7, "same"), (7, "same")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = sorted(tuple(r) for r in syncmers.edit_probe(docs, ranges=ranges).select("edited_sha256", "n_chars", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect())
    want = []
    for _, t, e, n in edited(rows):
        a, b, c = syncmers.fingerprints(*syncmers._joined([t, e, n]))
        want.append((hashlib.sha256(e.encode()).hexdigest(), len(t), syncmers.as_text(a), syncmers.as_text(b), syncmers.likeness(a, b), syncmers.likeness(a, c)))
    assert got == sorted(want)


def test_likeness_of_halves_and_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in syncmers.edit_probe(docs).collect() if r.n_chars > 2000]
    assert 0.2 < np.mean([r.near_edited for r in rows]) < 0.5 and np.median([r.near_next for r in rows]) < 0.05


def test_one_and_no_document(spark):
    one = spark.createDataFrame([(3, "abcd")], "doc_id long, text string")
    (row,) = syncmers.edit_probe(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
    assert syncmers.edit_probe(one.limit(0)).count() == 0
    assert syncmers.anchors(one).count() == 0
