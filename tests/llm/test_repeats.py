from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import repeats
from attestry.llm.batches import utf8


def brute(texts, width):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if count[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        left = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), len(r) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


def test_interleaving_is_the_order_of_all_suffixes():
    rng = np.random.default_rng(1)
    strings = [rng.integers(1, 4, rng.integers(1, 12)) for _ in range(30)]
    cuts = [0, 7, 8, 20, 30]
    transforms, suffixes = [], []
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = sorted(((tuple(s[i : i + 5]), k, i) for k, s in enumerate(strings[low:high], low) for i in range(len(s) + 1)), key=lambda x: x[0])
        suffixes.append(own)
        transforms.append(np.array([strings[k][i - 1] if i else 0 for _, k, i in own]))
    shard, lcp = repeats.merge_transforms(transforms, 5)
    following = [iter(s) for s in suffixes]
    merged = [next(following[s])[0] for s in shard]
    assert [m for m in merged if m] == sorted(m for m in merged if m)
    for a, b, n in zip(merged, merged[1:], lcp[1:], strict=False):
        if b:
            shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared == n or min(len(a), len(b)) < 5 and n >= shared


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=16, max_size=40), min_size=1, max_size=8), st.integers(1, 5))
def test_repeated_windows(texts, shards):
    width = 16
    raws = [t.encode() for t in texts]
    windows = [len(r) - width + 1 for r in raws]
    count = Counter(r[i : i + width] for r, n in zip(raws, windows, strict=True) for i in range(n))
    got = repeats.repeated_windows([np.frombuffer(r, np.uint8) for r in raws], windows, [1] * len(raws), width, shards)
    assert [g.tolist() for g in got] == [[count[r[i : i + width]] > 1 for i in range(n)] for r, n in zip(raws, windows, strict=True)]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(7)
    core = "".join(rng.choice("abcd é") for _ in range(300))
    texts = ["xyz" + core + "q", core, "p" * 9 + core + "r" * 300]
    data, off = utf8(pa.array(texts))
    found = repeats.find_anchors(data, off, 64)
    seen = {}
    for k, p, a, b in zip(found.number, found.place, found.first, found.last, strict=True):
        for i in range(a, b + 1):
            assert seen.setdefault(data[i : i + 64].tobytes(), p - i) == p - i and off[k] <= i and b + 64 <= off[k + 1]
    assert sum(b - a + 1 for a, b in zip(found.first, found.last, strict=True)) == sum(max(0, n - 63) for n in np.diff(off))


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefgh é東\n") for _ in range(n))
    passages = [make(n) for n in (300, 405, 450, 900)]
    texts = [None, "", make(10), "ab" * 900, "abab" * 300, "x" * 399, "x" * 400, "x" * 401, make(395)]
    for _ in range(40):
        t = make(rng.choice([50, 400, 1500]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(passages) + t[at:]
        texts.append(t)
        if rng.random() < 0.3:
            c = list(t)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = "Z"
            texts.append("".join(c))
    return texts


@pytest.mark.parametrize(("seed", "width"), [(1, 400), (2, 400), (3, 64)])
def test_like_brute_force(spark, seed, width):
    texts = corpus(seed)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[12], "x"), (20, "other text of the same id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(4)
    found = repeats.find(docs, width)
    got = sorted((tuple(r) for r in repeats.digests(found).collect()), key=str)
    assert got == sorted(((r[0], *b) for r, b in zip(rows, brute([t for _, t, _ in rows], width), strict=True)), key=str)
    left = {(r.doc_id, len((r.text or "").encode())) for r in repeats.cleaned(docs, found).collect()}
    for key, n_bytes, n_removed, _, _ in got:
        assert any(k == key and n_bytes - n_removed - 3 * 9 <= n <= n_bytes - n_removed for k, n in left)
    assert repeats.cleaned(docs, found).schema == docs.schema


@pytest.mark.parametrize(("seed", "width"), [(4, 400), (5, 64)])
def test_hot_contexts_like_brute_force(spark, seed, width, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)
    texts = corpus(seed)
    rows = [*enumerate(texts), (3, texts[3]), (12, texts[12])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in repeats.digests(repeats.find(docs, width)).collect()), key=str)
    assert got == sorted(((r[0], *b) for r, b in zip(rows, brute([t for _, t in rows], width), strict=True)), key=str)


def test_no_task_gets_all_segments_of_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 20)
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, dealt = make(900), []
    texts = [make(rng.randrange(300)) + passage + make(rng.randrange(300)) for _ in range(80)]
    ranges_of = repeats.ranges_of
    monkeypatch.setattr(repeats, "ranges_of", lambda segments, width: (dealt.append(segments), ranges_of(segments, width))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in repeats.digests(repeats.find(docs)).collect())
    assert got == [(i, *b) for i, b in enumerate(brute(texts, 400))]
    assert max([n for _, n in dealt[0].groupBy(dealt[0].columns[0]).count().collect()], default=0) <= 20


def test_a_common_passage_is_cut_into_blocks_once(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 20)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, cut = make(3000), []
    texts = [make(rng.randrange(50)) + passage + make(rng.randrange(50)) for _ in range(60)]
    hot_blocks = repeats.hot_blocks
    monkeypatch.setattr(repeats, "hot_blocks", lambda *args: (cut.append(hot_blocks(*args)), cut[-1])[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in repeats.digests(repeats.find(docs)).collect())
    assert got == [(i, *b) for i, b in enumerate(brute(texts, 400))]
    # the passage has 163 blocks; only the sides at a text's two ends differ from text to text
    assert cut[0].count() < 60 * 100


def test_empty_table(spark):
    found = repeats.find(spark.createDataFrame([], "doc_id long, text string"))
    assert repeats.digests(found).count() == 0


def test_short_repeats_may_stay_and_columns_may_clash(spark):
    words = [f"w{i}" for i in range(60)]
    long, short = " ".join(words), " ".join("abcdefghijklmnopqrst" + str(i) for i in range(10))
    rows = [(1, f"first {long} end", 5), (2, f"other {long} stop", 6), (3, f"has {short} in it", 7), (4, f"and {short} too", 8), (5, None, 9)]
    docs = spark.createDataFrame(rows, "_key long, text string, _copied long").selectExpr("*", "_key AS _ranges")
    left = repeats.cleaned(docs, repeats.find(docs, 152, "_key"), least_words=50).collect()
    assert {r["_key"]: (r["text"], r["_copied"], r["_ranges"]) for r in left} == {
        1: ("firstend", 5, 1), 2: ("otherstop", 6, 2), 3: (rows[2][1], 7, 3), 4: (rows[3][1], 8, 4), 5: (None, 9, 5)
    }
