"""Document fingerprints from closed syncmers.

A k-mer (k bytes of UTF-8) is a closed syncmer when the smallest hash among its inner s-mers lies at its first or last
place. Whether it is one depends on its k bytes alone, so the same passage gives the same anchors in any document, at
places that move with it (``anchors`` returns them for positional matching). The fingerprint keeps the ``SKETCH`` smallest
distinct hashes of a text's anchors, so two fingerprints give an unbiased estimate of the Jaccard likeness of the
anchor sets, exact for texts with fewer anchors.

A text without an anchor (shorter than k bytes, or a gap everywhere) is one anchor by itself; an empty or null text has
the empty fingerprint, which is like another empty one (1) and unlike any other (0). Equal texts have equal fingerprints.

The edited text needs the next document by ascending id (nulls first, equal ids by text; after the last comes the
first). Documents are dealt by ranges of the id, and each range gets the first document of the next range as well, so
texts are shuffled once; range bounds and first ids, one per range, pass through the driver. Only the two named columns
are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.batches import SLICE_BYTES, U64, SpanHashes, slices, strings, utf8

K, S, SKETCH = 20, 8, 64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, in log2(width) passes."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def closed_syncmers(data: np.ndarray, off: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, byte position, k-mer hash) of each closed syncmer, in order; k-mers never cross texts."""
    if len(data) < k:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64)
    hashes = SpanHashes(data)
    inner = hashes.windows(s)
    least = sliding_min(inner, k - s + 1)
    n = len(least)
    at = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
    number = np.searchsorted(off, at, "right") - 1
    whole = at + k <= off[number + 1]
    at, number = at[whole], number[whole]
    return number, at - off[number], hashes(at, at + k)


def fingerprints(data: np.ndarray, off: np.ndarray, k: int = K, s: int = S, size: int = SKETCH) -> list[np.ndarray]:
    """The ``size`` smallest distinct 32-bit anchor hashes of each text, ascending."""
    n = len(off) - 1
    number, _, kmer = closed_syncmers(data, off, k, s)
    bare = np.setdiff1d(np.flatnonzero(np.diff(off)), number)
    if len(bare):
        number = np.concatenate([number, bare])
        kmer = np.concatenate([kmer, SpanHashes(data)(off[bare], off[bare + 1])])
    key = np.unique((number.astype(U64) << U64(32)) | (kmer >> U64(32)))
    owner = (key >> U64(32)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    low = (key & U64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a : min(b, a + size)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Jaccard likeness of two fingerprints, from the smallest hashes of their union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    shared = both[1:][twice]
    union = np.delete(both, np.flatnonzero(twice) + 1)[:size]
    return float(np.searchsorted(shared, union[-1], "right")) / len(union)


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.large_string()))


def anchors(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """One row per anchor: document, byte position, 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            number, at, kmer = closed_syncmers(*utf8(part.column(text)), k, s)
            yield pa.RecordBatch.from_arrays([part.column(ident).take(pa.array(number)), pa.array(at), pa.array(kmer.view(np.int64))], names=[ident, "position", "hash"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, position long, hash long")


def with_next(docs: DataFrame, ranges: int, ident: str, text: str) -> DataFrame:
    """(range, guard, ident, text) sorted by range, guard, id and text within each task; a range's guard row is the first document of the next one."""
    known = docs.select(F.col(ident).cast("bigint").alias(ident), text)
    steps = [k / ranges for k in range(1, ranges)]
    bounds = known.agg(F.percentile_approx(ident, steps, 10_000)).head()[0] if steps else []
    splits = [float("-inf"), *sorted({float(b) for b in bounds or []}), float("inf")]
    number = F.col(ident).cast("double").alias("_at")
    if len(splits) > 2:
        dealt = Bucketizer(splits=splits, inputCol="_at", outputCol="_range", handleInvalid="keep").transform(known.select("*", number))
    else:
        dealt = known.select("*", number, F.lit(0.0).alias("_range"))
    dealt = dealt.select(F.when(F.col("_at").isNull(), 0).otherwise(F.col("_range") + 1).cast("int").alias("_range"), ident, text)
    heads = {r["_range"]: r["first"] for r in dealt.groupBy("_range").agg(F.min(ident).alias("first")).collect()}
    order = sorted(heads)
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True)) if order else {}
    first = [h for h in heads.values() if h is not None]
    is_head = F.col(ident).isNull() | F.col(ident).isin(first) if first else F.col(ident).isNull()
    place = F.array(*[F.lit(before.get(k, 0)) for k in range(max(order, default=0) + 1)])
    guards = dealt.filter(is_head).select(F.get(place, F.col("_range")).alias("_range"), F.lit(1).alias("_guard"), ident, text)
    rows = dealt.select("_range", F.lit(0).alias("_guard"), ident, text).unionAll(guards)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "_range").sortWithinPartitions("_range", "_guard", F.asc_nulls_first(ident), F.asc_nulls_first(text))


def edit_probe(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = K, s: int = S, size: int = SKETCH, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text (second half replaced by the head of the next document), and likenesses."""
    if ranges is None:
        ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        pairs: list[tuple[int | None, int, int]] = []
        pending: tuple[int | None, int, int] | None = None  # range, id, place in texts

        def out() -> pa.RecordBatch:
            own = [texts[i] for _, i, _ in pairs]
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for _, i, j in pairs]
            marks, edited_marks = fingerprints(*_joined(texts), k, s, size), fingerprints(*_joined(edited), k, s, size)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _, _ in pairs], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([as_text(marks[i]) for _, i, _ in pairs]), pa.array([as_text(x) for x in edited_marks]),
                    pa.array([likeness(marks[i], x, size) for (_, i, _), x in zip(pairs, edited_marks, strict=True)]),
                    pa.array([likeness(marks[i], marks[j], size) for _, i, j in pairs]),
                ],
                names=[ident, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for part in slices(batches, text, SLICE_BYTES // 2):
            rows = zip(part.column("_range").to_pylist(), part.column("_guard").to_pylist(), part.column(ident).to_pylist(), strings(part.column(text)), strict=True)
            for where, guard, doc, body in rows:
                if guard and (pending is None or pending[0] != where):
                    continue
                texts.append(body)
                if pending is not None:
                    pairs.append((pending[1], pending[2], len(texts) - 1))
                pending = None if guard else (where, doc, len(texts) - 1)
            if pairs:
                yield out()
            last = texts[pending[2]] if pending else None
            texts.clear()
            pairs.clear()
            if pending:
                texts.append(last)
                pending = (*pending[:2], 0)

    return with_next(docs, ranges, ident, text).mapInArrow(
        run, f"`{ident}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
