from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
CASES = [
    "", " ", "\n", "a", "Hello  world\n\n x", "foo\t \nbar", "it's we'll 'S", "é ñ ß 東京 \U0001f600‍", "a" * 3000, "x y\nz w", " lead", "trail ",
    "\x00 \x1c\x1f\x85\xa0 　q", "<|endoftext|> a", "1234567 12", "don't\nwon't", "á ́", "-- ## !!\n!!", "ab\r\ncd",
]


def test_same_ids_as_library_and_round_trip():
    model = bpe.loaded(RANKS, P.PATTERN)
    for text, ids in zip(CASES, model.encode(CASES), strict=True):
        assert ids.tolist() == PLAIN.encode_ordinary(text)
        assert model.decode(ids) == text.encode()


def test_every_entry_alone():
    model = bpe.loaded(RANKS, P.PATTERN)
    for raw, rank in list(bpe.read_ranks(RANKS).items())[::97]:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        assert model.encode([text])[0].tolist() == PLAIN.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'sA1é \n\t\r\x1f　!東"), max_size=40))
def test_any_text(text):
    assert bpe.loaded(RANKS, P.PATTERN).encode([text])[0].tolist() == PLAIN.encode_ordinary(text)


def test_query_rows(spark):
    rows = [(1, "a b\nc", 1), (2, None, 2), (3, "", 3), (3, "", 3), (None, "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    want = set()
    for key, text, _ in rows:
        ids = PLAIN.encode_ordinary(text or "")
        want.add((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    assert bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0
