"""Quality rules as a short-circuit cascade.

The base statistics are computed for every document. Documents that the base test leaves are judged by rules, one
after the other; a document that a rule rejects is not given to the next. The order comes from a sample: each rule's
cost (seconds per byte) and rejection rate are measured alone, and rules run by rejections per second, best first.
Rules are pure and a document is kept when none rejects it, so the order changes the work and never the verdict.

Null and empty texts have no words and fail the base test. Repeated rows are judged each on its own, an empty table
gives an empty result, and columns other than the two named are not read."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.batches import SPACES, U64, SpanHashes, mix, slices, utf8, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 2000


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


SYMBOLS = _bytes("#*$%&|<>")
UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS = UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
SHOUTS = _bytes("!")


class Texts:
    """Some documents' bytes and what the rules need of them."""

    def __init__(self, data: np.ndarray, off: np.ndarray, n_words: np.ndarray, word_chars: np.ndarray, n_symbols: np.ndarray, n_dup_lines: np.ndarray, n_lines: np.ndarray):
        self.data, self.off = data, off
        self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_lines = n_words, word_chars, n_symbols, n_dup_lines, n_lines

    def __len__(self) -> int:
        return len(self.off) - 1

    def count(self, table: np.ndarray) -> np.ndarray:
        return spans(table[self.data], self.off[:-1], self.off[1:])

    def only(self, keep: np.ndarray) -> Texts:
        size = np.diff(self.off)
        data = self.data[np.repeat(keep, size)]
        off = np.concatenate([[0], np.cumsum(size[keep])])
        return Texts(data, off, *(x[keep] for x in (self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_lines)))


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a flag per document; it depends on that document alone."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def _too_many(count: Callable[[Texts], np.ndarray], of: Callable[[Texts], np.ndarray], percent: int) -> Callable[[Texts], np.ndarray]:
    return lambda t: 100 * count(t) > percent * of(t)


RULES = (
    Rule("symbols per word", _too_many(lambda t: t.n_symbols, lambda t: t.n_words, 10)),
    Rule("repeated lines", _too_many(lambda t: t.n_dup_lines, lambda t: t.n_lines, 60)),
    Rule("short words", lambda t: t.word_chars < 2 * t.n_words),
    Rule("long words", lambda t: t.word_chars > 15 * t.n_words),
    Rule("capital letters", _too_many(lambda t: t.count(UPPER), lambda t: t.count(LETTERS), 30)),
    Rule("exclamation marks per word", _too_many(lambda t: t.count(SHOUTS), lambda t: t.n_words, 20)),
)


def spans(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of flags in each span."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each piece between line feeds; a text has one more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    at = np.searchsorted(off, feeds, "right") - 1
    number = np.concatenate([np.arange(len(off) - 1), at])
    start, end = np.concatenate([off[:-1], feeds + 1]), np.concatenate([off[1:], feeds])
    return start[np.lexsort((start, number))], end[np.lexsort((end, number))], np.sort(number, kind="stable")


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def base(data: np.ndarray, off: np.ndarray) -> tuple[Texts, np.ndarray]:
    """The base statistics, and n_repeat_words, of each text."""
    n = len(off) - 1
    hashes = SpanHashes(data)
    start, end, doc = words(data, off)
    n_words = np.bincount(doc, minlength=n)
    inside = ~SPACES[data]
    word_chars = spans(inside & ((data & 0xC0) != 0x80), off[:-1], off[1:])
    n_symbols = spans(SYMBOLS[data], off[:-1], off[1:])

    ls, le, ld = lines(data, off)
    full = spans(inside, ls, le) > 0
    ls, le, ld = ls[full], le[full], ld[full]
    n_lines = np.bincount(ld, minlength=n)
    key = mix(hashes.digests(ls, le) + ld.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    n_dup_lines = n_lines - np.bincount(ld[first], minlength=n)

    covered = np.zeros(len(start), bool)
    if len(start) > 2:
        h = hashes.digests(start, end)
        whole = doc[2:] == doc[:-2]
        gram = h[:-2] * U64(3) + mix(h[1:-1]) * U64(5) + mix(h[2:] ^ U64(0x5851F42D4C957F2D))
        at = np.flatnonzero(whole)
        hit = at[repeated(mix(gram[at] + doc[at].astype(U64) * U64(0x9E3779B97F4A7C15)))]
        for k in range(3):
            covered[hit + k] = True
    return Texts(data, off, n_words, word_chars, n_symbols, n_dup_lines, n_lines), np.bincount(doc[covered], minlength=n)


def judge(texts: Texts, alive: np.ndarray, rules: Sequence[Rule]) -> np.ndarray:
    """Which of the ``alive`` documents no rule rejects; each rule sees what the ones before it left."""
    kept = np.flatnonzero(alive)
    left = texts.only(alive)
    for rule in rules:
        if not len(kept):
            break
        good = ~rule.rejects(left)
        if not good.all():
            kept, left = kept[good], left.only(good)
    out = np.zeros(len(texts), bool)
    out[kept] = True
    return out


def base_failed(texts: Texts, n_repeat: np.ndarray) -> np.ndarray:
    return (texts.n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * texts.n_words)


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds per byte, rejected share) of each rule alone, on a random sample of about ``sample_rows`` rows.

    The sample decides the order of the rules only. It is taken inside the scan; one row per rule and task leaves it."""
    names = [r.name for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, size, seen = np.zeros(len(names)), np.zeros(len(names)), 0, 0
        for part in slices(batches, text):
            texts, n_repeat = base(*utf8(part.column(text)))
            left = texts.only(~base_failed(texts, n_repeat))
            size, seen = size + len(left.data), seen + len(left)
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                rejected[k] += rule.rejects(left).sum()
                spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(names)), pa.int32()), pa.array(spent), pa.array(rejected), pa.array([float(size)] * len(names)), pa.array([float(seen)] * len(names))],
            names=["rule", "spent", "rejected", "size", "seen"],
        )

    share = min(1.0, sample_rows / max(1, docs.count()))
    measured = docs.select(text).sample(share, seed=1).mapInArrow(run, "rule int, spent double, rejected double, size double, seen double")
    rows = measured.groupBy("rule").agg(*[F.sum(x).alias(x) for x in ("spent", "rejected", "size", "seen")]).collect()
    found = {r.rule: (r.spent / max(r["size"], 1.0), r.rejected / max(r.seen, 1.0)) for r in rows}
    return [(name, *found.get(k, (0.0, 0.0))) for k, name in enumerate(names)]


def ordered(rules: Sequence[Rule], estimates: Sequence[tuple[str, float, float]]) -> list[Rule]:
    """Rules by rejections per cost, best first; equal ones by name."""
    rate = {name: share / max(cost, 1e-15) for name, cost, share in estimates}
    return sorted(rules, key=lambda r: (-rate[r.name], r.name))


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, ident: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base statistics of each document, whether the base test failed, and whether it is kept. No shuffle."""
    order = ordered(rules, estimate(docs, rules, text, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            t, n_repeat = base(*utf8(part.column(text)))
            failed = base_failed(t, n_repeat)
            counts = (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, n_repeat)
            yield pa.RecordBatch.from_arrays(
                [part.column(ident), *(pa.array(x, pa.int64()) for x in counts), pa.array(failed), pa.array(judge(t, ~failed, order))],
                names=[ident, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(
        run, f"`{ident}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    )


def kept_rows(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns. No shuffle."""
    order = ordered(rules, estimate(docs, rules, text, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            t, n_repeat = base(*utf8(part.column(text)))
            yield part.filter(pa.array(judge(t, ~base_failed(t, n_repeat), order)))

    return docs.mapInArrow(run, docs.schema)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, a || ' ' || lead(a) OVER p || ' ' || lead(a, 2) OVER p AS g FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c >= 2),
n AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
    length(regexp_replace(t, '[^!]', '', 'g')) AS shouts
  FROM w LEFT JOIN n USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 60 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * capitals > 30 * letters OR 100 * shouts > 20 * n_words) AS kept
FROM f
"""
