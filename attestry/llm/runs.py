"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a stretch of words with a smallest period q (words q apart are identical) and a length of at least
``max(least, 2 * q)`` that no neighbouring word extends. The n words of a text are numbered by first use of their
spelling, so equal numbers are equal words, and the numbers are cut into blocks of L = 2, 4, 8, ... Scale L is in charge
of the periods from 2 * L - 1 to 4 * L - 2 (L = 2: from 1): a run of such a period q has more than 2 * L - 2 words whose
partner q words on lies in the run too, so one whole aligned block is among them.

1. A number theoretic transform of a block and of the window behind it gives all sums of squared differences between the
   block and the window's positions, as integers modulo a prime. A zero sum is an occurrence without a mismatch. The sums
   are exact while L * (number of different words) ** 2 stays below the prime; beyond that each zero is compared with the words.
2. Occurrences of neighbouring blocks at one distance are one chain. A chain is a seed: it is extended to both sides, word by
   word, to the first mismatch.
3. A stretch that was found at several distances keeps the smallest: the others are its multiples.

Blocks are passed over where they cannot have an occurrence (some word does not come again within reach) or inside a
known run of a period of at most L / 2 that covers the whole window (all their occurrences belong to that run). Where block and
occurrence lie in known runs of one period, the ends of those runs tell where the seed's extension ends. So a text of one
word, or of two such passages, costs no more than another.

A null or empty text, or one without a word, has no run. Texts are taken whole; a very long one is a slice of its own. Nothing
is shuffled, a row depends on its own text alone, and repeated rows and ids give repeated rows. An empty table gives an empty one.
Only the two named columns are read, so other columns may have any name."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from attestry.llm.batches import slices, utf8, words

LEAST = 12
PRIME = 2013265921  # 15 * 2**27 + 1, so there are transforms of up to 2**27 values
GENERATOR = 31
CELLS = 1 << 19  # values of blocks in one transform

_roots: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    return x - (x // PRIME) * PRIME


def roots(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first size / 2 powers of a root of unity of this order, and of its inverse."""
    if size > 1 << 27:
        raise ValueError("a text of more than 2**27 words needs another prime")
    if size not in _roots:
        both = []
        for base in (pow(GENERATOR, (PRIME - 1) // size, PRIME), pow(GENERATOR, PRIME - 1 - (PRIME - 1) // size, PRIME)):
            out = np.ones(1, np.int64)
            while len(out) < size // 2:
                out = np.concatenate([out, _reduced(out * pow(base, len(out), PRIME))])
            both.append(out)
        _roots[size] = tuple(both)
    return _roots[size]


def transform(rows: np.ndarray) -> np.ndarray:
    """Number theoretic transform of each row, in bit-reversed order."""
    k, n = rows.shape
    half = n // 2
    while half:
        pair = rows.reshape(k, n // (2 * half), 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1]
        out = np.empty_like(pair)
        total = a + b
        out[:, :, 0] = np.where(total >= PRIME, total - PRIME, total)
        out[:, :, 1] = _reduced((a - b + PRIME) * roots(2 * half)[0])
        rows, half = out.reshape(k, n), half // 2
    return rows


def inverse(rows: np.ndarray) -> np.ndarray:
    """Rows from their transforms in bit-reversed order."""
    k, n = rows.shape
    half = 1
    while half < n:
        pair = rows.reshape(k, n // (2 * half), 2, half)
        a, b = pair[:, :, 0], _reduced(pair[:, :, 1] * roots(2 * half)[1])
        out = np.empty_like(pair)
        total, rest = a + b, a - b
        out[:, :, 0] = np.where(total >= PRIME, total - PRIME, total)
        out[:, :, 1] = np.where(rest < 0, rest + PRIME, rest)
        rows, half = out.reshape(k, n), half * 2
    return _reduced(rows * pow(n, PRIME - 2, PRIME))


def occurrences(rank: np.ndarray, blocks: np.ndarray, length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) where the block of ``length`` from that start comes again ``low`` to ``high`` words on.

    ``rank`` has at least ``high + length`` values behind each block start. The sums are taken modulo ``PRIME``."""
    size = 4 * length
    window = high - low + length
    squares = np.zeros(len(rank) + 1, np.int64)
    np.cumsum(_reduced(rank * rank), out=squares[1:])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for first in range(0, len(blocks), max(1, CELLS // size)):
        part = blocks[first : first + max(1, CELLS // size)]
        mask = np.zeros((len(part), size), np.int64)
        mask[:, :length] = rank[part[:, None] + np.arange(length - 1, -1, -1)]
        text = np.zeros((len(part), size), np.int64)
        text[:, :window] = rank[part[:, None] + np.arange(low, low + window)]
        cross = inverse(_reduced(transform(mask) * transform(text)))[:, length - 1 : window]
        at = part[:, None] + np.arange(low, high + 1)
        sums = (squares[part + length] - squares[part])[:, None] + squares[at + length] - squares[at]
        block, step = np.nonzero(_reduced(sums + 2 * (PRIME - cross)) == 0)
        found.append((part[block], step + low))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([b for b, _ in found]), np.concatenate([d for _, d in found])


def _extent(code: np.ndarray, at: np.ndarray, gap: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, in direction ``step``, equal the word ``gap`` further."""
    out = np.zeros(len(at), np.int64)
    going, width = np.arange(len(at)), 4
    while len(going):
        width = max(4, min(width, (1 << 20) // len(going)))
        where = (at[going] + step * out[going])[:, None] + step * np.arange(width)
        there = where + gap[going][:, None]
        inside = (where >= 0) & (there < len(code))
        same = inside & (code[np.where(inside, where, 0)] == code[np.where(inside, there, 0)])
        stop = np.where(same.all(1), width, np.argmin(same, 1))
        out[going] += stop
        going, width = going[stop == width], width * 4
    return out


class Known:
    """Runs found so far, and those among them of a short period that cover a block."""

    def __init__(self) -> None:
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """One period, the smallest, for each stretch."""
        start, end, period = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        self.start, self.end, self.period = start[first], end[first], period[first]

    def covering(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and period of the run of a period of at most half the length that holds so many words from ``at``;
        period 0 where there is none. There is at most one: two such runs would share a smaller period."""
        short = self.period <= length // 2
        start, end, period = self.start[short], self.end[short], self.period[short]
        if not len(start):
            return np.zeros_like(at), np.zeros_like(at), np.zeros_like(at)
        far = np.maximum.accumulate(end)
        best = np.maximum.accumulate(np.where(end == far, np.arange(len(end)), 0))
        place = np.searchsorted(start, at, "right") - 1
        run = best[np.maximum(place, 0)]
        good = (place >= 0) & (end[run] >= at + length)
        return start[run], end[run], np.where(good, period[run], 0)


def find(rank: np.ndarray, code: np.ndarray, number: np.ndarray, gap: np.ndarray, different: np.ndarray, counts: np.ndarray, least: int = LEAST) -> Known:
    """All runs of the words of several texts, as positions in the joined sequence.

    Per word: its number within its text, the same over all texts, its text, and how far the same word comes again in that
    text. Per text: number of different words, of words. ``least`` is 5 or more, so that every run holds a block of two."""
    if least < 5:
        raise ValueError("runs of fewer than 5 words may hold no block")
    known = Known()
    n, longest = len(rank), int(counts.max(initial=0))
    length = 2
    while n and (2 * length - 1 if length > 2 else 1) * 2 <= longest and longest >= least:
        low, high = (2 * length - 1 if length > 2 else 1), 4 * length - 2
        whole = n // length
        reach = gap[: whole * length].reshape(whole, length).max(1)
        blocks = np.flatnonzero(reach <= high) * length
        text = number[blocks]
        blocks = blocks[(text == number[blocks + length - 1]) & (counts[text] >= max(least, 2 * low))]
        _, run_end, period = known.covering(blocks, length)
        blocks = blocks[(period == 0) | (run_end < blocks + high + length)]
        padded = np.concatenate([rank, np.zeros(high + length + 1, np.int64)])
        block, away = occurrences(padded, blocks, length, low, high)
        last = block + away + length - 1
        inside = (last < n) & (number[block] == number[np.minimum(last, n - 1)])
        block, away = block[inside], away[inside]
        in_start, in_end, in_period = known.covering(block, length)
        fresh = (in_period == 0) | (away % np.maximum(in_period, 1) != 0) | (block + away + length > in_end)
        block, away = block[fresh], away[fresh]
        unsure = np.flatnonzero(length * different[number[block]].astype(np.float64) ** 2 >= PRIME)
        wrong = _extent(code, block[unsure], away[unsure], 1) < length
        block, away = np.delete(block, unsure[wrong]), np.delete(away, unsure[wrong])
        order = np.lexsort((block, away))
        block, away = block[order], away[order]
        head = np.ones(len(block), bool)
        head[1:] = (away[1:] != away[:-1]) | (block[1:] != block[:-1] + length)
        tail = np.append(head[1:], True)[: len(block)]
        step, left, right = away[head], block[head], block[tail] + length
        ends = []
        for at, edge, towards in ((left, left, -1), (right - length, right, 1)):
            here, there = known.covering(at, length), known.covering(at + step, length)
            both = (here[2] > 0) & (here[2] == there[2])
            mine, other = (here[0], there[0] - step) if towards < 0 else (here[1], there[1] - step)
            edge = np.where(both, np.maximum(mine, other) if towards < 0 else np.minimum(mine, other), edge)
            going = np.flatnonzero(~both | (mine == other))
            more = _extent(code, edge[going] - (towards < 0), step[going], towards)
            edge[going] += towards * more
            ends.append(edge)
        start, stop = ends
        good = stop - start >= np.maximum(step, least - step)
        known.add(start[good], stop[good] + step[good], step[good])
        length *= 2
    return known


class Texts:
    """Words of several texts, optionally rearranged, and their runs."""

    def __init__(self, data: np.ndarray, off: np.ndarray, least: int = LEAST, rearranged: Callable[[int, int], np.ndarray | None] | None = None):
        start, end, number = words(data, off)
        self.n = len(off) - 1
        self.counts = np.bincount(number, minlength=self.n).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        size = end - start
        shift = np.concatenate([[0], np.cumsum(size)])
        joined = data[np.arange(shift[-1]) - np.repeat(shift[:-1] - start, size)]
        spelled = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(shift.astype(np.int64)), pa.py_buffer(joined)])
        coded = spelled.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(size) else np.zeros(0, np.int64)
        self.order = np.arange(len(size))
        self.moved = np.zeros(self.n, bool)
        if rearranged is not None:
            for i in np.flatnonzero(self.counts):
                order = rearranged(int(i), int(self.counts[i]))
                if order is not None:
                    self.order[self.bounds[i] : self.bounds[i + 1]] = self.bounds[i] + order
                    self.moved[i] = True
        self._spelled, coded = spelled, coded[self.order]
        by_word = np.lexsort((coded, number))
        word, text = coded[by_word], number[by_word]
        fresh = np.ones(len(word), bool)
        fresh[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
        code, rank = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
        kind = np.cumsum(fresh)
        code[by_word] = kind
        self.different = np.bincount(text[fresh], minlength=self.n).astype(np.int64)
        rank[by_word] = kind - np.repeat(np.cumsum(self.different) - self.different, self.counts)
        gap = np.full(len(word), np.iinfo(np.int64).max)
        gap[by_word[:-1]] = np.where(fresh[1:], gap[by_word[:-1]], by_word[1:] - by_word[:-1])
        self.number = number
        runs = find(rank, code, number, gap, self.different, self.counts, least)
        order = np.lexsort((runs.period, runs.start))
        self.start, self.end, self.period = runs.start[order], runs.end[order], runs.period[order]
        self.owner = number[self.start] if len(self.start) else np.zeros(0, np.int64)
        self.spans = np.searchsorted(self.owner, np.arange(self.n + 1))

    def runs(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and period of the runs of a text, by start and period."""
        own = slice(self.spans[i], self.spans[i + 1])
        return self.start[own] - self.bounds[i], self.end[own] - self.start[own], self.period[own]

    def collapsed(self) -> list[bytes]:
        """Every text's words, one space apart, without those that a run has after its first period."""
        covered = np.zeros(len(self.order) + 1, np.int64)
        np.add.at(covered, self.start + self.period, 1)
        np.add.at(covered, self.end, -1)
        kept = np.cumsum(covered[:-1]) == 0
        index = self.order[kept]
        chosen = self._spelled.take(pa.array(index)) if len(index) else self._spelled
        bounds = np.concatenate([[0], np.cumsum(np.bincount(self.number[kept], minlength=self.n))])
        if not len(index):
            return [b""] * self.n
        _, offsets, raw = chosen.buffers()
        off = np.frombuffer(offsets, np.int64)[chosen.offset : chosen.offset + len(chosen) + 1]
        size = np.diff(off)
        put = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(put[-1], 32, np.uint8)
        source = np.frombuffer(raw, np.uint8)[off[0] : off[-1]]
        out[np.arange(len(source)) + np.repeat(np.arange(len(size)), size)] = source
        whole = out.tobytes()
        return [whole[put[a] : max(put[a], put[b] - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def runs(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, start, length, period), a row per run; start is a word number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            t = Texts(*utf8(part.column(text)), least)
            ids = part.column(ident).take(pa.array(t.owner))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(t.start - t.bounds[t.owner]), pa.array(t.end - t.start), pa.array(t.period)], names=[ident, "start", "length", "period"]
            )

    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {docs.schema[ident].dataType.simpleString()}, start long, length long, period long")


def collapsed(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, text): the words of each text one space apart, each run cut to its first period; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            bodies = pa.array(Texts(*utf8(part.column(text)), least).collapsed(), pa.binary()).cast(pa.string())
            bodies = pc.if_else(pc.is_null(part.column(text)), pa.scalar(None, pa.string()), bodies)
            yield pa.RecordBatch.from_arrays([part.column(ident), bodies], names=[ident, text])

    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {docs.schema[ident].dataType.simpleString()}, `{text}` string")


def digests(docs: DataFrame, rearranged: Callable[[int | None, int], np.ndarray | None] | None = None, ident: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: number of runs, the longest (ties: smallest start, then period), hashes of all runs and of the collapsed text.

    ``rearranged(id, n)`` may name, for a text of n words, the word to put at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            ids = part.column(ident).to_pylist()
            moved = None if rearranged is None else (lambda i, n, ids=ids: rearranged(ids[i], n))
            t = Texts(*utf8(part.column(text)), least, moved)
            best: list[tuple[int, int, int] | None] = []
            listed = []
            for i in range(t.n):
                start, length, period = t.runs(i)
                k = int(np.argmax(length)) if len(length) else None  # the first of equals: by start, then period
                best.append(None if k is None else (int(start[k]), int(length[k]), int(period[k])))
                rows = "".join(f"{s},{m},{q}\n" for s, m, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
                listed.append(hashlib.sha256(rows.encode()).hexdigest())
            columns = [pa.array([None if b is None else b[k] for b in best], pa.int64()) for k in range(3)]
            columns.append(pa.array([None if b is None else 1000 * b[1] // b[2] for b in best], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(ident), pa.array(np.diff(t.spans)), *columns, pa.array(listed), pa.array([hashlib.sha256(x).hexdigest() for x in t.collapsed()])],
                names=[ident, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(
        run, f"`{ident}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    )
