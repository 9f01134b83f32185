"""Token ids of whole texts, each distinct piece of text encoded once per task as long as it is remembered.

A text whose white space is single blanks and line feeds between other characters is cut at them: a word goes with the
blank before it, a line feed stands alone, and so does the full stop or comma that ends a word. The pre-token patterns
used here never match across those places, so the ids of the pieces, one after the other, are the ids of the text. A
text with stops behind other characters than letters and digits is cut by a pattern that leaves those in one piece. Any
other text is encoded whole.

A piece is held as a key: the word alone stands for the word behind a blank, ``BARE`` before it says that no blank is there."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np

BARE = "\x05"
_PIECE = re.compile(r" ?[^\W\d_]+(?=[.,]?(?:[ \n]|\Z))|[.,](?=[ \n]|\Z)|\n| ?[^ \n]+")
# White space but blanks and line feeds, and the characters that mark places here.
_OTHER_SPACE = re.compile(r"[\x01\x05\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_EDGES = (" ", "\n")
_DOUBLE = ("  ", "\n\n", " \n", "\n ")
# A stop that may belong to the characters before it.
_ODD_STOP = re.compile(r"[.,](?<=[\W_].)(?=[ \n])")
# The same where white space only separates, and is never part of a piece.
_BARE_ODD = re.compile(r"[\x01\x1c-\x1f]")
# Capitals that a mark may follow: normalisation composes before it lowers, and some pairs compose in lower case only.
_BARE_CAPITAL = re.compile(r"[A-Z][^\x00-\x7f]")
# A stop is cut off only behind letters that no normalisation turns into a letter and a mark.
_LATIN = "a-z\u00e0-\u00f6\u00f8-\u012f\u0131-\u024f"
_BARE_PIECE = re.compile(rf"[^\W\d_]*[{_LATIN}](?=[.,]?(?:\s|\Z))|(?<=[{_LATIN}])[.,](?=\s|\Z)|\S+")
_BARE_ODD_STOP = re.compile(rf"[.,](?<=[^{_LATIN}].)(?=[ \n])")
LONG_PIECE = 64
KEPT_PIECES = 800_000
MARKED = 100


def pieces(text: str) -> list[str] | None:
    """Keys of pieces that may be encoded alone, or None."""
    if not text:
        return []
    if text.startswith(_EDGES) or text.endswith(_EDGES) or any(x in text for x in _DOUBLE) or _OTHER_SPACE.search(text):
        return None
    marked = f"{BARE}{text} "
    if _ODD_STOP.search(marked):
        return [x[1:] if x[0] == " " else x if x == "\n" else BARE + x for x in _PIECE.findall(text)]
    keys = marked.replace("\n", f" \n {BARE}").replace(". ", f" {BARE}. ").replace(", ", f" {BARE}, ").split(" ")
    keys.pop()
    return keys


def spelled(key: str) -> str:
    """The piece that a key stands for."""
    return key[1:] if key[0] == BARE else key if key == "\n" else " " + key


def bare_pieces(text: str) -> list[str] | None:
    """Pieces for tokenizers that drop white space and lower-case: Latin capitals are lowered here, so that fewer differ."""
    raw = text.encode().lower()
    # 0xCC and 0xCD begin the marks that compose with Latin letters.
    if _BARE_ODD.search(text) or (b"\xcc" in raw or b"\xcd" in raw) and _BARE_CAPITAL.search(text):
        return None
    low = raw.decode() + " "
    if _BARE_ODD_STOP.search(low):
        return _BARE_PIECE.findall(low)
    return low.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n").replace(",\n", " ,\n").split()


def around(added: Sequence[str], cut: Callable[[str], list[str] | None]) -> Callable[[str], list[str] | None]:
    """``cut`` but for texts that hold one of the ``added`` tokens, in any case: they are encoded whole."""
    low = [x.encode().lower() for x in added]

    def run(text: str) -> list[str] | None:
        raw = text.encode().lower()
        return None if any(x in raw for x in low) else cut(text)

    return run


class Encoder:
    """``encode_batch`` takes texts and gives their ids; it must treat pieces as the module text says."""

    def __init__(self, encode_batch: Callable[[list[str]], Iterable[Sequence[int]]], cut: Callable[[str], list[str] | None] = pieces, spell: Callable[[str], str] = spelled, mark: str | None = None, kept: int = KEPT_PIECES):
        """``spell`` gives the piece for a key that ``cut`` made. ``kept``: pieces to remember, some 200 bytes each. ``mark``: a string that keeps apart what stands before and behind it, so that many pieces are encoded in one call."""
        self._encode, self._cut, self._spell = encode_batch, cut, spell
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._mark, self._kept = mark, kept
        if mark is not None:
            ids = next(iter(encode_batch([mark])))
            self._sign, self._around = ids[len(ids) // 2], len(ids) // 2

    def _each(self, new: list[str]) -> Iterable[bytes]:
        if self._mark is None:
            yield from (np.asarray(ids, "<u4").tobytes() for ids in self._encode(new))
            return
        groups = [new[k : k + MARKED] for k in range(0, len(new), MARKED)]
        for group, ids in zip(groups, self._encode([self._mark + self._mark.join(g) + self._mark for g in groups]), strict=True):
            ids = np.asarray(ids, "<u4")
            at = np.flatnonzero(ids == self._sign)
            if len(at) != len(group) + 1:
                raise ValueError("a piece holds the mark")
            raw = ids.tobytes()
            for low, high in zip((4 * (at[:-1] + 1 + self._around)).tolist(), (4 * (at[1:] - self._around)).tolist(), strict=True):
                yield raw[low:high]

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        # Two generations: a piece that is met again moves into the younger one, the rest is forgotten with the older one.
        if 2 * len(self._known) > self._kept:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        keys = list(chain.from_iterable(x for x in cut if x))
        raw = list(map(known.get, keys))
        missing = [k for k, x in enumerate(raw) if x is None]
        new = []
        for x in {keys[k] for k in missing}:
            if x in older:
                known[x] = older[x]
            else:
                new.append(x)
        if "\n" in new and self._mark is not None:
            known["\n"] = np.asarray(next(iter(self._encode(["\n"]))), "<u4").tobytes()
            new.remove("\n")
        known.update(zip(new, self._each([self._spell(x) for x in new]), strict=True))
        for k in missing:
            raw[k] = known[keys[k]]
        whole = iter(self._encode([t for t, c in zip(texts, cut, strict=True) if c is None]) if None in cut else [])
        out, at = [], 0
        for c in cut:
            if c is None:
                out.append(np.asarray(next(whole), "<u4"))
                continue
            out.append(np.frombuffer(b"".join(raw[at : at + len(c)]), "<u4"))
            at += len(c)
        for x in new:
            if len(x) > LONG_PIECE:
                del known[x]
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str, bare: bool = False, kept: int = KEPT_PIECES) -> Encoder:
    """Encoder for a file of the tokenizers library; strings of added tokens in a text get their ids, as the library does by default.

    A Python worker keeps it, with the pieces it knows, for the tasks that follow.

    ``bare``: the tokenizer drops white space and lower-cases; otherwise it is a byte-level one whose words hold their blank."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    encode = lambda texts: (x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False))
    added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    # No piece holds white space, so a line feed is a pre-token of its own between any two.
    if bare:
        return Encoder(encode, around(added, bare_pieces), str, " \x01 ", kept)
    return Encoder(encode, around(added, pieces), spelled, "\n", kept)
