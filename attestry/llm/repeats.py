"""Removal of long repeated byte strings, by merging Burrows-Wheeler transforms of shards.

A byte goes when it lies in a string of ``width`` bytes that starts anywhere else as well. Strings never cross texts.

1. Anchors. Of the 32-byte grams in a window of ``width`` bytes, the one with the smallest hash (leftmost of equals) is its
   anchor. Equal windows have the same anchor at the same place, so suffixes can be dealt by anchor.
2. Only windows that can repeat go on: a window holds the 216 bytes (at the default width) before or behind its anchor's far end, so
   that context must occur twice among the distinct texts. Contexts are counted, with map-side sums, over all texts.
3. The surviving windows on one side of an anchor, with their bytes, are a segment; segments meet by that side's context,
   which equal windows share. A task splits the
   segments it gets into shards and sorts each shard's suffixes (prefix doubling over symbols of ``width / DEPTH`` bytes, so
   that ``DEPTH`` symbols are the width). It takes each shard's transform (the symbol before each suffix) and finds the
   interleaving of all shards by refinement (Holt and McMillan): starting from the shards one after the other, each
   round reads the transforms in the present order and deals the suffixes stably by the symbol read. After h rounds they
   are in order of their first h symbols, and the places where a new block of equal prefixes begins give the common prefix
   lengths. Blocks after ``DEPTH`` rounds are the repeated intervals. No suffix is sorted again.
4. A context at more than ``HOT`` places would be one large group, so its windows are counted by their hashes instead: equal
   sides are merged with a count before the shuffle, what differs is cut into blocks of ``BLOCK`` starts, equal blocks merged
   again, and only blocks whose common core occurs twice go on as single windows.
5. Repeated windows become byte ranges per text.

Texts are handled once each, with 64-bit hashes as their keys; a text that occurs twice is a repeat from end to end if it is
long enough. Null and empty texts have no bytes and no spans. Repeated rows are copies of each other. Only the two named
columns are read. Memory: a task holds about ``CHUNK_BYTES`` of segments and those of one context, at most ``HOT``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.batches import U64, SpanHashes, slices, utf8
from attestry.session import cut_lineage

WIDTH = 400
GRAM = 32
DEPTH = 8
SHARDS = 4
CHUNK_BYTES = 1 << 19
HOT = 1000
BLOCK = 16
WHITE = b" \t\n\v\f\r"


@dataclass
class Anchors:
    """Per anchor: text number, place, first and last window start (all within the joined bytes), and hashes."""

    number: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    before: np.ndarray  # hash of the context that the windows starting early hold; 0 where there is none
    behind: np.ndarray


def _half(width: int) -> int:
    return (width - GRAM + 1) // 2


def find_anchors(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> Anchors:
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return Anchors(none, none, none, none, none.view(U64), none.view(U64), none.view(U64))
    hashes = SpanHashes(data)
    grams = hashes.windows(GRAM)
    # High half: hash; low half: place, so the smallest is the leftmost of equals.
    packed = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    have, span = 1, width - GRAM + 1
    while have < span:
        step = min(have, span - have)
        packed = np.minimum(packed[:-step], packed[step:])
        have += step
    size = np.diff(off)
    count = np.maximum(size - width + 1, 0)
    number = np.repeat(np.arange(len(size)), count)
    start = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    if not len(start):
        return Anchors(none, none, none, none, none.view(U64), none.view(U64), none.view(U64))
    place = (packed[start] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (number[1:] != number[:-1])]))
    number, place, first = number[new], place[new], start[new]
    last = start[np.append(new[1:], len(start)) - 1]
    half = _half(width)
    gram = hashes(place, place + GRAM)
    early, late = first <= place - half, last > place - half
    before, behind = np.zeros(len(place), U64), np.zeros(len(place), U64)
    at = place[early]
    before[early] = hashes(at - half, at + GRAM) | U64(1)
    at = place[late]
    behind[late] = hashes(at, at + width - half) & ~U64(1)
    return Anchors(number, place, first, last, gram, before, behind)


def shard_order(symbols: np.ndarray, following: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of one shard in order of their first ``depth`` symbols; ``following`` is the place ``k`` symbols of one later."""
    rank, have = symbols.astype(np.int64), 1
    jump = following
    while have < depth:
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        jump, have = jump[jump], 2 * have
    return np.argsort(rank, kind="stable")


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each suffix in merged order, common prefix with the suffix before it in symbols, at most ``depth``)."""
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    lcp = np.full(len(shard), depth, np.int64)
    starts = np.zeros(len(shard), bool)
    starts[:1] = True
    read = np.empty(len(shard), np.int64)
    for round_no in range(depth):
        for s, transform in enumerate(transforms):
            read[shard == s] = transform
        order = np.argsort(read, kind="stable")
        block = np.cumsum(starts)[order]
        symbol = read[order]
        new = np.ones(len(shard), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        lcp[new & ~starts] = round_no
        starts, shard = new, shard[order]
    lcp[:1] = 0
    return shard, lcp


def repeated_windows(segments: list[np.ndarray], windows: list[int], times: list[int], width: int = WIDTH, shards: int = SHARDS) -> list[np.ndarray]:
    """For each segment, which of its first ``windows`` starts begin a string of ``width`` bytes that another one begins too.

    ``times``: how often the segment stands for a place in some text."""
    step = width // DEPTH
    size = np.array([len(s) for s in segments])
    begin = np.concatenate([[0], np.cumsum(size + 1)])  # every segment has one place more, its end
    joined = np.zeros(begin[-1], np.uint8)
    for s, b in zip(segments, begin, strict=False):
        joined[b : b + len(s)] = s
    owner = np.repeat(np.arange(len(segments)), size + 1)
    offset = np.arange(len(joined)) - begin[owner]
    full = offset + step <= size[owner]
    symbols = np.zeros(len(joined), np.int64)
    at = np.flatnonzero(full)
    symbols[at] = np.unique(SpanHashes(joined).windows(step)[at], return_inverse=True)[1] + 1  # 0 is the end of a string
    own = offset < np.array(windows)[owner]
    weight = np.where(own, np.array(times)[owner], 0)

    # The end symbol may follow itself: a suffix beyond its end is all ends.
    after = np.where(full, np.arange(len(joined)) + step, np.arange(len(joined)))
    preceding = np.where(offset >= step, symbols[np.maximum(np.arange(len(joined)) - step, 0)], 0)
    cut = begin[np.unique(np.linspace(0, len(segments), min(shards, len(segments)) + 1).astype(int))]
    orders, transforms = [], []
    for low, high in zip(cut[:-1], cut[1:], strict=True):
        order = shard_order(symbols[low:high], after[low:high] - low, DEPTH) + low
        orders.append(order)
        transforms.append(preceding[order])
    shard, lcp = merge_transforms(transforms, DEPTH)
    merged = np.empty(len(shard), np.int64)
    for s, order in enumerate(orders):
        merged[shard == s] = order
    interval = np.cumsum(lcp < DEPTH) - 1
    twice = np.bincount(interval, weight[merged]) > 1
    hit = np.zeros(len(joined), bool)
    hit[merged] = twice[interval]
    hit &= own
    return [hit[b : b + w] for b, w in zip(begin, windows, strict=False)]


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def repeated_contexts(texts: DataFrame, width: int) -> DataFrame:
    """(key, places, hot): anchors of each distinct text with a context that occurs twice; 2 * place, + 1 for the one behind.

    ``hot``: those of them whose context is at more than ``HOT`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            fresh = []
            for i, key in enumerate(part.column("key").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            part = part.take(pa.array(fresh, pa.int64()))
            data, off = utf8(part.column("text"))
            found = find_anchors(data, off, width)
            place = found.place - off[found.number]
            early, late = np.flatnonzero(found.before), np.flatnonzero(found.behind)
            context = np.concatenate([found.before[early], found.behind[late]]).view(np.int64)
            which = np.concatenate([2 * place[early], 2 * place[late] + 1])
            key = part.column("key").take(pa.array(found.number[np.concatenate([early, late])]))
            yield pa.RecordBatch.from_arrays([pa.array(context), key, pa.array(which)], names=["context", "key", "place"])

    rows = cut_lineage(texts.mapInArrow(run, "context long, key long, place long"))
    # A text that several tasks have read counts once: its places are equal, so two different ones are what is asked.
    spread = F.struct("key", "place")
    twice = rows.groupBy("context").agg(F.min(spread).alias("low"), F.max(spread).alias("high"), (F.count(F.lit(1)) > HOT).alias("often")).filter("low <> high").select("context", "often")
    twice = cut_lineage(twice)  # as a table, so that a context that very many anchors have is split in the join
    return rows.join(twice, "context").groupBy("key").agg(F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("often"), F.col("place"))).alias("hot"))


@dataclass
class Sides:
    """Sides of anchors whose context repeats: text number, anchor's place, first and last window start, context."""

    number: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    context: np.ndarray


def _sides(part: pa.RecordBatch, data: np.ndarray, off: np.ndarray, width: int, hot: bool) -> Sides:
    half, found = _half(width), find_anchors(data, off, width)

    def listed(name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(np.asarray(p, np.int64) + 2 * o for p, o in zip(part.column(name).to_pylist(), off, strict=False))])

    often = listed("hot")
    wanted = often if hot else np.setdiff1d(listed("places"), often)
    sides = [
        (np.flatnonzero(np.isin(2 * found.place, wanted)), found.first, np.minimum(found.last, found.place - half), found.before),
        (np.flatnonzero(np.isin(2 * found.place + 1, wanted)), np.maximum(found.first, found.place - half + 1), found.last, found.behind),
    ]
    join = lambda k: np.concatenate([x[k][x[0]] for x in sides])
    at = np.concatenate([x[0] for x in sides])
    return Sides(found.number[at], found.place[at], join(1), join(2), join(3).view(np.int64))


def cut_segments(candidates: DataFrame, width: int) -> DataFrame:
    """(context, key, first, windows, bytes): windows of the sides that repeat and are not hot, one row per distinct text and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, off = utf8(part.column("text"))
            x = _sides(part, data, off, width, hot=False)
            raw = [data[a : b + width].tobytes() for a, b in zip(x.first, x.last, strict=True)]
            fields = [pa.array(x.context), part.column("key").take(pa.array(x.number)), pa.array(x.first - off[x.number]), pa.array(x.last - x.first + 1), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(fields, names=["context", "key", "first", "windows", "bytes"])

    return candidates.mapInArrow(run, "context long, key long, first long, windows long, bytes binary")


def hot_sides(candidates: DataFrame, width: int, with_bytes: bool) -> DataFrame:
    """(side, key, first): the hot sides; equal bytes at an equal distance from the anchor have an equal hash ``side``.

    On demand also lead, the first window's distance from the place ``width`` before the anchor, and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, off = utf8(part.column("text"))
            x = _sides(part, data, off, width, hot=True)
            lead = x.first - (x.place - width)  # windows start less than width before their anchor, so this is not negative
            whole = SpanHashes(data)(x.first, x.last + width).view(np.int64)
            fields = [pa.array(whole), pa.array(lead), part.column("key").take(pa.array(x.number)), pa.array(x.first - off[x.number])]
            if with_bytes:
                fields.append(pa.array([data[a : b + width].tobytes() for a, b in zip(x.first, x.last, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(fields, names=["whole", "lead", "key", "first", "bytes"][: len(fields)])

    rows = candidates.filter(F.size("hot") > 0).mapInArrow(run, "whole long, lead long, key long, first long" + ", bytes binary" * with_bytes)
    return rows.withColumn("side", F.xxhash64("whole", "lead")).drop("whole")


def hot_blocks(sides: DataFrame, width: int, block: int) -> DataFrame:
    """(core, whole, side, n, begin, starts): windows of the sides (side, n, lead, bytes) by blocks of starts, as distances from the anchor.

    ``core``: hash of the bytes that every window of the block holds; ``whole``: of all bytes of those windows of it that
    the side has; ``begin``: the first of these windows, counted from the side's first; ``starts``: of each of these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("bytes").to_pylist()
            data, off = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
            side_first, side_last = off[:-1], off[1:] - width
            zero = side_first - np.asarray(batch.column("lead"))
            low = (side_first - zero) // block
            count = (side_last - zero) // block - low + 1
            side = np.repeat(np.arange(len(count)), count)
            begin = zero[side] + block * (np.arange(len(side)) - np.repeat(np.cumsum(count) - count, count) + low[side])
            first, last = np.maximum(side_first[side], begin), np.minimum(side_last[side], begin + block - 1)
            hashes = SpanHashes(data)
            core, whole = hashes(begin + block - 1, begin + width), hashes(first, last + width)
            ends = np.concatenate([[0], np.cumsum(last - first + 1)])
            start = np.arange(ends[-1]) + np.repeat(first - ends[:-1], last - first + 1)
            starts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes(start, start + width).view(np.int64)))
            fields = [pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), batch.column("side").take(pa.array(side)), batch.column("n").take(pa.array(side)), pa.array(first - side_first[side]), starts]
            yield pa.RecordBatch.from_arrays(fields, names=["core", "whole", "side", "n", "begin", "starts"])

    return sides.mapInArrow(run, "core long, whole long, side long, n int, begin long, starts array<long>")


def hot_ranges(candidates: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """(key, begin, end) of the bytes that repeated windows of hot contexts cover."""
    spread = F.struct("key", "first")
    # Rows that occur twice have equal places; different sides are at different places.
    sides = hot_sides(candidates, width, with_bytes=True).groupBy("side").agg(F.min(spread).alias("low"), F.max(spread).alias("high"), F.first("lead").alias("lead"), F.first("bytes").alias("bytes"))
    sides = cut_lineage(sides.select("side", "lead", "bytes", F.when(F.col("low") != F.col("high"), 2).otherwise(1).alias("n")))
    blocks = cut_lineage(hot_blocks(sides, width, block))
    merged = blocks.groupBy("whole").agg(F.first("core").alias("core"), F.sum("n").alias("n"), F.first("starts").alias("starts"))
    merged = cut_lineage(merged)
    alive = cut_lineage(merged.groupBy("core").agg(F.sum("n").alias("n")).filter("n > 1").select("core"))
    windows = merged.join(alive, "core").select("whole", "n", F.posexplode("starts").alias("at", "window"))
    twice = cut_lineage(windows.groupBy("window").agg(F.sum("n").alias("n")).filter("n > 1").select("window"))
    hits = windows.join(twice, "window").groupBy("whole").agg(F.sort_array(F.collect_set("at")).alias("hits"))
    edge = lambda step: F.filter("hits", lambda x: ~F.array_contains("hits", x + step))
    runs = cut_lineage(hits.select("whole", F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b")).alias("runs")))
    placed = F.transform("runs", lambda r: F.struct((F.col("begin") + r["a"]).alias("a"), (F.col("begin") + r["b"]).alias("b")))
    per_side = blocks.select("side", "whole", "begin").join(runs, "whole").groupBy("side").agg(F.flatten(F.collect_list(placed)).alias("runs"))
    # Blocks follow each other, so runs that meet are one: a text has a row per side and run, not per block.
    begins = F.array_sort(F.filter(F.col("runs.a"), lambda x: ~F.array_contains(F.col("runs.b"), x - 1)))
    ends = F.array_sort(F.filter(F.col("runs.b"), lambda x: ~F.array_contains(F.col("runs.a"), x + 1)))
    per_side = cut_lineage(per_side.select("side", F.arrays_zip(begins.alias("a"), ends.alias("b")).alias("runs")))
    found = hot_sides(candidates, width, with_bytes=False).join(per_side, "side").select("key", "first", F.explode("runs").alias("run"))
    return found.select("key", (F.col("first") + F.col("run.a")).alias("begin"), (F.col("first") + F.col("run.b") + width).alias("end"))


def ranges_of(segments: DataFrame, width: int) -> DataFrame:
    """(key, begin, end) of the bytes that repeated windows of segments cover."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        order: dict[tuple[bytes, int], int] = {}
        times: list[int] = []
        which = []
        for _, _, n, raw in rows:
            i = order.setdefault((raw, n), len(order))
            times[i : i + 1] = [times[i] + 1] if i < len(times) else [1]
            which.append(i)
        hits = repeated_windows([np.frombuffer(raw, np.uint8) for raw, _ in order], [n for _, n in order], times, width)
        out: list[tuple[int, int, int]] = []
        spans = []
        for hit in hits:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            spans.append([(int(a), int(b) - 1 + width) for a, b in zip(edge[::2], edge[1::2], strict=True)])
        for (key, first, _, _), i in zip(rows, which, strict=True):
            out += [(key, first + a, first + b) for a, b in spans[i]]
        fields = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in fields], names=["key", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        held, current, last = 0, None, None
        for batch in batches:
            raws = batch.column("bytes")
            for i, (context, key, first, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("context", "key", "first", "windows")), strict=True)):
                if context != current and held >= CHUNK_BYTES:
                    yield solve(rows)
                    rows, held = [], 0
                current = context
                if (context, key, first) == last:
                    continue  # the same place of a row that occurs twice
                last = (context, key, first)
                rows.append((key, first, n, raws[i].as_py()))
                held += len(rows[-1][3])
        if rows:
            yield solve(rows)

    partitions = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.repartition(partitions, "context").sortWithinPartitions("context", "key", "first")
    return dealt.mapInArrow(run, "key long, begin long, end long")


@dataclass
class Repeats:
    """``rows``: id, key, n_bytes, digest of the whole text, and whether the text occurs twice and goes as a whole.
    ``texts``: key and text of each text with a repeated context. ``ranges``: key and the sorted byte ranges to remove."""

    rows: DataFrame
    texts: DataFrame
    ranges: DataFrame


def find(docs: DataFrame, width: int = WIDTH, ident: str = "doc_id", text: str = "text") -> Repeats:
    if width % DEPTH or width < 2 * GRAM:
        raise ValueError(f"width must be a multiple of {DEPTH} and at least {2 * GRAM}")
    body = F.coalesce(F.col(text), F.lit(""))
    known = docs.select(F.col(ident), text_key(text).alias("key"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("digest"))
    known = cut_lineage(known)
    copies = known.groupBy("digest").agg((F.count(F.lit(1)) > 1).alias("copied"))
    rows = known.join(copies, "digest").withColumn("copied", F.col("copied") & (F.col("n_bytes") >= width))

    texts = docs.filter(F.octet_length(F.col(text)) >= width).select(text_key(text).alias("key"), F.col(text).alias("text"))
    places = repeated_contexts(texts, width)
    first = known.groupBy("key").agg(F.min(F.struct(F.col(ident).isNotNull().alias("known"), F.col(ident).alias("id"))).alias("first"))
    chosen = places.join(first, "key").select(F.col("key").alias("_key"), F.col("first.id").alias("_id"), "places", "hot")
    source = docs.filter(F.octet_length(F.col(text)) >= width).select(F.col(ident).alias("_doc"), text_key(text).alias("key"), F.col(text).alias("text"))
    candidates = cut_lineage(source.join(chosen, (F.col("key") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id"))).select("key", "text", "places", "hot"))
    ranges = ranges_of(cut_segments(candidates, width), width).union(hot_ranges(candidates, width))
    ranges = cut_lineage(ranges.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("ranges")))
    return Repeats(rows, candidates.select("key", "text").dropDuplicates(["key"]), ranges)


def _remove(raw: bytes, ranges: list[dict] | None) -> tuple[bytes, int]:
    """What is left, and the number of maximal removed runs; ranges ascend by their begin."""
    kept, at, spans = [], 0, 0
    reached = -1
    for r in ranges or []:
        if r["begin"] > reached:
            kept.append(raw[at : r["begin"]])
            spans += 1
        reached = max(reached, r["end"])
        at = reached
    kept.append(raw[at:])
    return b"".join(kept), spans


def digests(repeats: Repeats, ident: str = "doc_id") -> DataFrame:
    """n_bytes, n_removed, n_spans and the digest of what is left, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            left = [_remove(t.encode(), r) for t, r in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True)]
            fields = [part.column("key"), pa.array([len(x) for x, _ in left], pa.int64()), pa.array([n for _, n in left], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in left])]
            yield pa.RecordBatch.from_arrays(fields, names=["key", "n_left", "spans", "left_digest"])

    changed = repeats.texts.join(repeats.ranges, "key").mapInArrow(run, "key long, n_left long, spans long, left_digest string")
    rows = repeats.rows.join(changed, "key", "left")
    gone = F.col("copied")
    return rows.select(
        ident, "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("n_left"), F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_digest", "digest")).alias("kept_sha256"),
    )


def _of_words(raw: bytes, ranges: list[dict], least: int) -> list[dict]:
    """The maximal runs of the ranges, which ascend, that hold ``least`` whole words."""
    runs: list[dict] = []
    for r in ranges:
        if runs and r["begin"] <= runs[-1]["end"]:
            runs[-1]["end"] = max(runs[-1]["end"], r["end"])
        else:
            runs.append({"begin": r["begin"], "end": r["end"]})
    kept = []
    for r in runs:
        inside = raw[r["begin"] : r["end"]]
        torn = sum(0 < at < len(raw) and raw[at - 1] not in WHITE and raw[at] not in WHITE for at in (r["begin"], r["end"]))
        if len(inside.split()) - torn >= least:
            kept.append(r)
    return kept


def cleaned(docs: DataFrame, repeats: Repeats, text: str = "text", least_words: int = 0) -> DataFrame:
    """The documents with the repeated bytes removed; a character that is cut goes as a whole. Null texts stay null.

    Repeated runs with fewer than ``least_words`` whole words stay. Other columns may have any name."""
    kind = docs.schema
    names = docs.columns
    plain = {c: f"_c{i}" for i, c in enumerate(names)}  # so that no column is named like one made here
    at = plain[text]
    copied = repeats.rows.groupBy("key").agg(F.bool_or("copied").alias("copied"))
    per_text = copied.join(repeats.ranges, "key", "left").select(F.col("key").alias("_key"), F.col("copied").alias("_copied"), F.col("ranges").alias("_ranges")).filter("_copied or _ranges is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            texts = []
            for t, gone, ranges in zip(*(part.column(c).to_pylist() for c in (at, "_copied", "_ranges")), strict=True):
                if t is not None and (gone or ranges):
                    raw = t.encode()
                    spans = [{"begin": 0, "end": len(raw)}] if gone else ranges
                    t = _remove(raw, _of_words(raw, spans, least_words))[0].decode("utf-8", "ignore")
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, part.column(at).type) if c == text else part.column(plain[c]) for c in names], names=names)

    rows = docs.toDF(*plain.values()).withColumn("_key", text_key(at)).join(per_text, "_key", "left")
    return rows.select(*plain.values(), "_copied", "_ranges").mapInArrow(run, kind)
