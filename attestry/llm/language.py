"""Language identification by rank-order profiles.

A text is lower-cased, every character that is no letter becomes a blank, and its 1- to 3-grams within a word and its
edges are ranked by frequency (ties: by the gram). A language's profile is the ranked list of its most frequent grams
over all its training texts. A document's distance to a profile is the sum, over its own most frequent grams, of how
far out of place each is; a gram that the profile lacks counts as ``PROFILE`` places. The nearest profile wins, ties go
to the first language by name. The score is 1 - distance / largest possible distance.

Null texts and texts without a letter are ``und`` with score 0; so is everything when there is no training text.
Repeated rows are judged each on its own; only the named columns are read. Profiles come to the driver: ``PROFILE``
rows per language, however large the corpus."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.llm.batches import slices, strings

PROFILE = 400
NONE = "und"
_KEPT_KEYS = 2_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, gram, count), sorted by text and gram. A gram holds three code points, blanks as 0, left-aligned."""
    joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.cumsum(points == 0)
    letter = _letters()[points]
    used = np.unique(points[letter])
    place = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
    place[used] = np.arange(1, len(used) + 1)
    code = np.zeros(len(points) + 2, np.int64)
    code[1:-1][letter] = place[points[letter]]
    owner = np.concatenate([[0], number, number[-1:] if len(number) else [0]])
    bits = max(1, int(len(used)).bit_length())
    a, b, c = code[:-2], code[1:-1], code[2:]
    mid = b > 0
    # For each letter: itself, it with the next, and it with both neighbours; and a blank with the letter after it.
    start = (a == 0) & mid
    grams = np.concatenate([b[mid] << 2 * bits, (b[mid] << 2 * bits) | (c[mid] << bits), (b[start] << bits), (a[mid] << 2 * bits) | (b[mid] << bits) | c[mid]])
    sizes = (int(mid.sum()), int(mid.sum()), int(start.sum()), int(mid.sum()))
    kinds = np.repeat(np.array([0, 1, 1, 2], np.int64), sizes)
    where = owner[1:-1]
    texts_of = np.concatenate([where[mid], where[mid], where[start], where[mid]])
    key = (((texts_of << 2) | kinds) << 3 * bits) | grams
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([new, [len(key)]]))
    key = key[new]
    low = (1 << bits) - 1
    back = np.concatenate([[0], used]).astype(np.uint64)
    gram = key & ((1 << 3 * bits) - 1)
    kind = ((key >> 3 * bits) & 3).astype(np.uint64)
    parts = [back[(gram >> (k * bits)) & low] for k in (2, 1, 0)]
    # Letters lie below 2**20; the kind above them keeps a letter alone, a pair and a triple apart.
    wide = (kind << np.uint64(60)) | (parts[0] << np.uint64(40)) | (parts[1] << np.uint64(20)) | parts[2]
    return key >> (3 * bits + 2), wide.view(np.int64), count


def _gram_rows(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n) of the given texts, summed per task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[np.ndarray] = []

        def summed() -> np.ndarray:
            rows = np.concatenate(held, axis=1)
            order = np.lexsort((rows[1], rows[0]))
            rows = rows[:, order]
            new = np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]))
            return np.stack([rows[0, new], rows[1, new], np.add.reduceat(rows[2], new)])

        def out(rows: np.ndarray) -> pa.RecordBatch:
            known = list(names)
            return pa.RecordBatch.from_arrays([pa.array([known[k] for k in rows[0]]), pa.array(rows[1]), pa.array(rows[2])], names=["lang", "gram", "n"])

        for part in slices(batches, text):
            texts, langs = strings(part.column(text)), part.column(lang).to_pylist()
            number, gram, count = gram_counts(texts)
            if not len(gram):
                continue
            code = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
            held.append(np.stack([code[number], gram, count]))
            if sum(x.shape[1] for x in held) > _KEPT_KEYS:
                held = [summed()]
                if held[0].shape[1] > _KEPT_KEYS // 2:
                    yield out(held.pop())
        if held:
            yield out(summed())

    return docs.select(lang, text).mapInArrow(run, "lang string, gram long, n long")


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent grams of each non-null language, most frequent first, counted over all rows."""
    counts = _gram_rows(labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()), lang, text).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    rows = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).collect()
    found: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        found.setdefault(r.lang, []).append(r.gram)
    return found


class Profiles:
    def __init__(self, learned: dict[str, list[int]], size: int = PROFILE):
        self.names = sorted(learned)
        self.size = size
        self._grams = np.unique(np.array([g for x in learned.values() for g in x], np.int64))
        self._rank = np.full((len(self._grams) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self._rank[np.searchsorted(self._grams, np.array(learned[name], np.int64)), k] = np.arange(len(learned[name]))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        number, gram, count = gram_counts(texts)
        order = np.lexsort((gram, -count, number))
        number, gram = number[order], gram[order]
        first = np.searchsorted(number, np.arange(n))
        rank = np.arange(len(number)) - first[number] if len(number) else np.zeros(0, np.int64)
        top = rank < self.size
        number, gram, rank = number[top], gram[top], rank[top]
        used = np.bincount(number, minlength=n)
        if not self.names:
            return [NONE] * n, np.zeros(n)
        at = np.searchsorted(self._grams, gram)
        at = np.where((at < len(self._grams)) & (self._grams[np.minimum(at, len(self._grams) - 1)] == gram), at, len(self._grams))
        places = self._rank[at]
        off = np.where(places < 0, self.size, np.abs(places - rank[:, None]))
        distance = np.stack([np.bincount(number, off[:, k], minlength=n) for k in range(len(self.names))], axis=1)
        best = distance.argmin(axis=1)
        score = np.where(used > 0, 1 - distance[np.arange(n), best] / np.maximum(used * self.size, 1), 0.0)
        return [self.names[b] if u else NONE for b, u in zip(best, used, strict=True)], score


def predict(docs: DataFrame, learned: dict[str, list[int]], ident: str = "doc_id", text: str = "text", size: int = PROFILE) -> DataFrame:
    """``lang_pred`` and ``score`` of each text, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(learned, size)
        for part in slices(batches, text):
            names, score = profiles.predict(strings(part.column(text)))
            yield pa.RecordBatch.from_arrays([part.column(ident), pa.array(names, pa.string()), pa.array(score)], names=[ident, "lang_pred", "score"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, lang_pred string, score double")


def held_out(ident: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Profiles learned from the documents that are not held out, and a prediction for every document."""
    learned = learn(docs.filter(~held_out()))
    return predict(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
