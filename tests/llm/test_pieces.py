"""Ids by pieces are the ids of the whole text, for each kind of tokenizer file."""

from __future__ import annotations

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestry.llm import pieces

FILES = {"byte_bpe_50k.json": False, "word_bpe_49k.json": True}
PLAIN = {n: Tokenizer.from_file(P.path(n)) for n in FILES}
OURS = {n: pieces.library_encoder(P.path(n), bare) for n, bare in FILES.items()}


@pytest.mark.parametrize("name", FILES)
def test_corpus(name):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    for ids, text in zip(OURS[name](texts), texts, strict=True):
        assert ids.tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé'sß÷ΣİŒ½²_1.,! \n\t\x01\x05\x1f　-́東"), max_size=30), max_size=3))
def test_any_text(name, texts):
    for ids, text in zip(OURS[name](texts), texts, strict=True):
        assert ids.tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_letters_that_become_a_letter_and_a_mark(name):
    texts = ["İ. a", "xİ, b", "\u0958. \ufb1d, \u01f0. \u0149,", "ŉ. é. É, ǰ. ß."]
    for ids, text in zip(OURS[name](texts), texts, strict=True):
        assert ids.tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_capitals_that_compose_in_lower_case_only(name):
    texts = ["H\u0331", "a J\u030c. T\u0308 b", "W\u030a, Y\u030a", "xJ\u0323\u030c", "h\u0331 \u00dcber J\u0301"]
    for ids, text in zip(OURS[name](texts), texts, strict=True):
        assert ids.tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "Ab", "don't", "x_", "12", "÷", "é", "...", "b.", "c,", ".", ",", "d.,", "²", "東", "3.5."]), min_size=1, max_size=8).flatmap(
    lambda w: st.lists(st.sampled_from([" ", "\n"]), min_size=len(w), max_size=len(w)).map(lambda g: "".join(x + y for x, y in zip(w, g))[:-1])), max_size=3))
def test_words_with_stops_between_single_gaps(name, texts):
    for ids, text in zip(OURS[name](texts), texts, strict=True):
        assert ids.tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_added_tokens_in_a_text(name):
    texts = ["a <|endoftext|> b", "x<|endoftext|>y.", "<|startoftext|>", "<|ENDOFTEXT|> c", "a <|endoftext| > b"]
    for ids, text in zip(OURS[name](texts), texts, strict=True):
        assert ids.tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_forgetting_changes_nothing(name):
    encode = pieces.library_encoder(P.path(name), FILES[name], kept=6)
    for k in range(6):
        texts = [f"some words, {k} and\nmore. The {'x' * 90}", "some words."]
        assert [x.tolist() for x in encode(texts)] == [PLAIN[name].encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encode._known) + len(encode._older) <= 6 + 2 * 8
