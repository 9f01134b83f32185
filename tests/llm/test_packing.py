from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestry.llm import packing

PATH = P.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 12))
def test_each_id_once_and_no_padding(sizes, max_open):
    done = []
    packer = packing.SumOfSquares(32, done.append, max_open)
    for k, n in enumerate(sizes):
        packer.add((k, 0, np.arange(n), n))
        assert packer.n_open == packer.level.sum() <= max_open and packer.n_open == sum(map(len, packer._open))
    packer.close()
    seen = defaultdict(list)
    for window in done:
        fill = sum(len(p[2]) for p in window)
        assert fill == 32 or fill & (fill - 1) == 0 and fill < 32
        for doc, start, ids, total in window:
            assert ids.tolist() == list(range(start, start + len(ids))) and total == sizes[doc]
            seen[doc] += ids.tolist()
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in enumerate(sizes)}


def test_least_sum_of_squares_at_each_step():
    rng = random.Random(5)
    done = []
    packer = packing.SumOfSquares(16, done.append)
    for k in range(400):
        before, size = packer.level.copy(), rng.choice([3, 4, 5, 7, 11])
        options = []
        for h in range(0, 16 - size + 1):
            if h == 0 or before[h]:
                after = before.copy()
                if h:
                    after[h] -= 1
                if h + size < 16:
                    after[h + size] += 1
                options.append(int((after[1:] ** 2).sum()))
        packer.add((k, 0, np.arange(size), size))
        assert int((packer.level[1:] ** 2).sum()) == min(options)


def test_rows(spark):
    rng = random.Random(1)
    texts = [None, "", "Hello  World", "it's\tÉTÉ\x1cq", "naïve 東京\n\nx 12", "a" * 9000, "the house. " * 3000, "same text", "same text"]
    texts += [" ".join(rng.choice(["the", "Cat", "dog,", "été", "x1"]) for _ in range(rng.randrange(400))) for _ in range(120)]
    rows = [(i, t, "q") for i, t in enumerate(texts)] + [(None, "a b", "q"), (2, "again", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    out = packing.digests(packing.pack(docs, PATH)).collect()
    want = defaultdict(list)
    for key, text, _ in rows:
        want[key].append([*PLAIN.encode(text or "", add_special_tokens=False).ids, 1])
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in want[r.doc_id])
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    covered = defaultdict(list)
    for r in out:
        covered[r.doc_id] += range(r.start, r.start + r.length)
    assert {k: sorted(v) for k, v in covered.items()} == {k: sorted(i for x in v for i in range(len(x))) for k, v in want.items()}
    assert packing.pack(docs.limit(0), PATH).count() == 0
