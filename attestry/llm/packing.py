"""Sum-of-squares online packing of token ids into windows.

Each task reads its documents once, in order. What fills whole windows is cut off first; the rest of a document, less
than a window, goes to the fill level that makes the sum of the squared numbers of partly filled windows smallest
(Csirik et al., Sum-of-Squares bin packing): from level h to h + s it changes by 2 (n[h+s] - n[h]) + 2, into a new window by
2 n[s] + 1, and by 1 - 2 n[h] when the window becomes full. ``n`` is the level array. Equal changes take the fuller window.

Open windows hold their ids, so their number is bounded: at ``MAX_OPEN``, and at the end of a task, they are poured
together and cut into full windows. What remains at the end of a task, less than one window, is cut into windows
of powers of two, which need no padding. So no sequence is padded, and memory is bounded by ``MAX_OPEN`` windows.

Nothing is shuffled; a lost task is packed again from the same input split with the same sequence ids. A null or
empty text has its end id only. Repeated rows are packed each on its own; only the named columns are read."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.batches import slices, strings
from attestry.llm.pieces import KEPT_PIECES, library_encoder

MAX_OPEN = 1024
_TASK_BITS = 40

Piece = tuple[object, int, np.ndarray, int]  # document, start in it, ids, its length


class SumOfSquares:
    """Packs pieces online. ``full`` receives the list of pieces of each finished window."""

    def __init__(self, window: int, full: Callable[[list[Piece]], None], max_open: int = MAX_OPEN):
        self.window, self._full, self._max_open = window, full, max_open
        self._open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.level = np.zeros(window + 1, np.int64)  # of partly filled windows; the last is always 0
        self.n_open = 0

    def add(self, piece: Piece) -> None:
        doc, start, ids, total = piece
        whole = len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            self._full([(doc, start + at, ids[at : at + self.window], total)])
        if whole < len(ids):
            self._place((doc, start + whole, ids[whole:], total))

    def _place(self, piece: Piece) -> None:
        size = len(piece[2])
        n = self.level
        fits = np.flatnonzero(n[1 : self.window - size + 1]) + 1
        best, where = 2 * int(n[size]) + 1, 0
        if len(fits):
            to = fits + size
            change = np.where(to == self.window, 1, 2 * n[to] + 2) - 2 * n[fits]
            low = len(change) - 1 - int(change[::-1].argmin())
            if change[low] <= best:
                where = int(fits[low])
        pieces = self._open[where].pop(0) if where else []
        if where:
            n[where] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if where + size == self.window:
            self._full(pieces)
            return
        self._open[where + size].append(pieces)
        n[where + size] += 1
        self.n_open += 1
        if self.n_open > self._max_open:
            self._pour(last=False)

    def _pour(self, last: bool) -> None:
        """All open windows into full ones; the rest stays open, or at the end becomes windows of powers of two."""
        pieces = list(chain.from_iterable(chain.from_iterable(self._open)))
        self._open = [[] for _ in range(self.window)]
        self.level[:] = 0
        self.n_open = 0
        rest, filled = _cut(pieces, self.window, self._full)
        if not rest:
            return
        if not last:
            self._open[filled].append(rest)
            self.level[filled] = self.n_open = 1
            return
        for bit in range(filled.bit_length() - 1, -1, -1):
            if filled >> bit & 1:
                done: list[list[Piece]] = []
                rest = _cut(rest, 1 << bit, done.append, 1)[0]
                self._full(done[0])

    def close(self) -> None:
        self._pour(last=True)


def _cut(pieces: list[Piece], size: int, full: Callable[[list[Piece]], None], most: int | None = None) -> tuple[list[Piece], int]:
    """Calls ``full`` for each ``size`` ids, ``most`` times; the remaining pieces and how many ids they hold."""
    held: list[Piece] = []
    filled, made = 0, 0
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            take = len(ids) - at if made == most else min(size - filled, len(ids) - at)
            held.append((doc, start + at, ids[at : at + take], total))
            at, filled = at + take, filled + take
            if filled == size and made != most:
                full(held)
                held, filled, made = [], 0, made + 1
    return held, filled


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048, ident: str = "doc_id", text: str = "text", max_open: int = MAX_OPEN, kept: int = KEPT_PIECES
) -> DataFrame:
    """One row per piece: document, start in it, length, ids (little-endian unsigned 32-bit), the document's number of ids,
    sequence id and offset there. Sequence ids are the task's number * 2**40 + a running number. A worker remembers the ids
    of up to ``kept`` pieces of text, at some 200 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer_path, bare=True, kept=kept)
        task = TaskContext.get()
        following = (task.partitionId() if task else 0) << _TASK_BITS
        rows: list[tuple] = []
        kind = None

        def full(pieces: Sequence[Piece]) -> None:
            nonlocal following
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), ids.tobytes(), total, following, at))
                at += len(ids)
            following += 1

        def out() -> pa.RecordBatch:
            fields = list(zip(*rows, strict=True))
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(fields, kinds, strict=True)], names=columns(ident))

        packer = SumOfSquares(window, full, max_open)
        end = np.array([end_id], "<u4")
        for part in slices(batches, text):
            kind = part.column(ident).type
            for doc, ids in zip(part.column(ident).to_pylist(), encode(strings(part.column(text))), strict=True):
                ids = np.concatenate([ids, end])
                packer.add((doc, 0, ids, len(ids)))
            if rows:
                yield out()
        packer.close()
        if rows:
            yield out()

    key = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def columns(ident: str) -> list[str]:
    return [ident, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def digests(pieces: DataFrame, ident: str = "doc_id") -> DataFrame:
    return pieces.select(ident, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
