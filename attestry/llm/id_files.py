"""Token ids as binary segments with Elias-Fano document boundaries.

Format: a table of segments in Parquet, written and read by Spark, so any store that Spark reaches will do. A segment
is one byte string that can be read alone:

    magic "EFSEG1", id width in bytes (2 or 4), bits of a low part (boundaries, documents), then four counts as
    unsigned 64-bit integers (documents, documents without an id, ids, smallest document id as signed), the two
    Elias-Fano parts, and the ids of all documents one after the other.

Boundaries (where each document's ids end) and document ids ascend, so both are Elias-Fano coded: the low bits of each
value packed, the high parts in unary, and for every ``BLOCK`` bits of the unary part the number of ones before it. A
boundary costs about 2 + log2(ids / documents) bits, and ``select`` finds one by a search in the block counts and
one block of bits. There is no table of 64-bit offsets.

Documents ascend by id across segments: they are dealt by ranges of the id, and each task writes segments of about
``SEGMENT_IDS`` ids, whole documents each. Ids before a segment come from the totals per task: one row per range, whose
number is the number of shuffle partitions, whatever the corpus holds.

A null or empty text has its end id only. Null document ids come first; repeated ids are ordered by text. Only the two
named columns are read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.batches import slices, strings
from attestry.llm.pieces import library_encoder

BLOCK = 512
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<6sBBBxQQQq")
_MAGIC = b"EFSEG1"


class EliasFano:
    """Ascending unsigned integers below ``2**63``; equal neighbours are allowed."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, counts: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self._low, self._counts, self._high = n, low_bits, low, counts, high

    @staticmethod
    def width(n: int, top: int) -> int:
        return max(0, (top // n).bit_length() - 1) if n else 0

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes]:
        """Bits of a low part, and the coded values."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = EliasFano.width(n, int(values[-1]) if n else 0)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = -(-(int(high[-1]) + 1 if n else 0) // BLOCK) * BLOCK
        unary = np.zeros(length, np.uint8)
        unary[high] = 1
        counts = np.concatenate([[0], np.cumsum(unary.reshape(-1, BLOCK).sum(axis=1))])[:-1].astype("<u4") if length else np.zeros(0, "<u4")
        return bits, struct.pack("<Q", length // BLOCK) + np.packbits(low.astype(np.uint8)).tobytes() + counts.tobytes() + np.packbits(unary).tobytes()

    @staticmethod
    def decode(n: int, bits: int, raw: bytes, at: int) -> tuple[EliasFano, int]:
        """The values at a place in ``raw``, and where they end."""
        (blocks,) = struct.unpack_from("<Q", raw, at)
        at += 8
        size = -(-n * bits // 8)
        low = np.frombuffer(raw, np.uint8, size, at)
        counts = np.frombuffer(raw, "<u4", blocks, at + size)
        at += size + 4 * blocks
        return EliasFano(n, bits, low, counts, np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at)), at + blocks * BLOCK // 8

    def select(self, i: int) -> int:
        """The i-th value, from one block of the unary part."""
        block = int(np.searchsorted(self._counts, i, "right")) - 1
        ones = np.flatnonzero(np.unpackbits(self._high[block * BLOCK // 8 : (block + 1) * BLOCK // 8]))
        high = block * BLOCK + int(ones[i - int(self._counts[block])]) - i
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        bits = np.unpackbits(self._low[first // 8 : -(-last // 8)])[first % 8 : first % 8 + self.low_bits]
        return (high << self.low_bits) | sum(int(b) << k for k, b in enumerate(bits))

    def all(self) -> np.ndarray:
        """Every value, as one pass of selects."""
        high = np.flatnonzero(np.unpackbits(self._high)) - np.arange(self.n)
        low = np.unpackbits(self._low)[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | (low * weights).sum(axis=1, dtype=np.uint64)


def segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One segment of documents in ascending order of id, null ids first."""
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    bits_ends, coded_ends = EliasFano.encode(ends)
    bits_docs, coded_docs = EliasFano.encode(np.array([d - base for d in known], np.uint64))
    head = _HEAD.pack(_MAGIC, width, bits_ends, bits_docs, len(doc_ids), len(doc_ids) - len(known), len(flat), base)
    return head + coded_ends + coded_docs + flat.astype(f"<u{width}").tobytes()


class Segment:
    """A segment as read back: any document's ids by its place."""

    def __init__(self, raw: bytes):
        magic, width, bits_ends, bits_docs, self.n_docs, nulls, self.n_ids, self._base = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a segment")
        self.ends, at = EliasFano.decode(self.n_docs, bits_ends, raw, _HEAD.size)
        self._docs, at = EliasFano.decode(self.n_docs - nulls, bits_docs, raw, at)
        self._nulls = nulls
        self.ids = np.frombuffer(raw, f"<u{width}", self.n_ids, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self._nulls + [int(x) + self._base for x in self._docs.all().tolist()]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)].astype("<u4")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, ident: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Writes the segments of all documents below ``folder``, which every executor and reader must reach."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer_path)
        end = np.array([end_id], "<u4")
        part_no = TaskContext.get().partitionId()
        held_docs: list[int | None] = []
        held_ids: list[np.ndarray] = []
        before = number = size = 0

        def out() -> pa.RecordBatch:
            nonlocal before, number, size
            raw = segment(held_docs, held_ids)
            row = [[part_no], [number], [before], [size], [len(held_docs)], [raw]]
            before, number, size = before + size, number + 1, 0
            held_docs.clear()
            held_ids.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["part", "segment", "ids_before", "n_ids", "n_docs", "data"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in slices(batches, text):
            for doc, ids in zip(batch.column(ident).to_pylist(), encode(strings(batch.column(text))), strict=True):
                held_docs.append(doc)
                held_ids.append(np.concatenate([ids, end]))
                size += len(ids) + 1
                if size >= SEGMENT_IDS:
                    yield out()
        if held_docs:
            yield out()

    known = docs.select(F.col(ident).cast("bigint").alias(ident), text)
    order = [F.asc_nulls_first(ident), F.asc_nulls_first(text)]
    dealt = known.repartitionByRange(n, order[0]).sortWithinPartitions(*order)
    rows = dealt.mapInArrow(run, "part int, segment int, ids_before long, n_ids long, n_docs long, data binary")
    rows.write.option("compression", "none").parquet(folder)


def read(spark, folder: str, ident: str = "doc_id") -> DataFrame:
    """(document, start, ids) of every document in the segments; start counts the ids of all documents before it."""
    files = spark.read.parquet(folder)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, before = {}, 0
    for r in totals:
        starts[r.part], before = before, before + r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = zip(batch.column("part").to_pylist(), batch.column("ids_before").to_pylist(), batch.column("data"), strict=True)
            for part, ahead, raw in places:
                one = Segment(raw.as_py())
                ends = one.ends.all().astype(np.int64)
                begin = np.concatenate([[0], ends[:-1]])
                flat = one.ids.astype("<u4")
                data = pa.Array.from_buffers(pa.large_binary(), one.n_docs, [None, pa.py_buffer(np.concatenate([[0], ends]) * 4), pa.py_buffer(flat)])
                fields = [pa.array(one.doc_ids(), pa.int64()), pa.array(begin + ahead + starts[part]), pa.array(ends - begin), data.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(fields, names=[ident, "start", "n_tokens", "ids"])

    return files.select("part", "ids_before", "data").mapInArrow(run, f"`{ident}` long, start long, n_tokens long, ids binary")


def digests(read_back: DataFrame, ident: str = "doc_id") -> DataFrame:
    return read_back.select(ident, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
