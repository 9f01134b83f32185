"""SimHash near duplicates by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: a bit is 1 if it is set in more than half of the XXH64 hashes (seed 42) of the
document's 3-word shingles, repeats included. Words are runs of other characters than 0x20 and 0x09-0x0D, A-Z lower-cased,
joined by one space; with fewer words the whole sequence is the shingle, and without a word the fingerprint is zero. Two fingerprints
link when at most two bits differ.

1. Nodes. Equal fingerprints are one node, which knows its smallest document id: thousands of copies are one row from here on.
2. Keys. The bits are cut into three segments of 22, 21 and 21. Of two differing bits, no more than one lies in some second
   segment while some first one has none (pigeonhole). So each ordered pair (first, second) of segments gives keys of the
   first as it is and the second by the binary Golay code of 23 bits: the second, filled up with zeros, is decoded to the
   index of its nearest codeword and, where that is three bits off, of the five that are four bits off. The nearest codeword
   of a neighbour is at most four bits away, so two nodes that link share a key under which one of them is *nearest*.
   That is 6 nodes' own keys and about 32 in all, each of 33 or 34 bits.
3. Join. Nodes that meet another one under a key (at least one of them nearest) are candidates; a key is one aggregate row
   with its smallest and largest node, whatever number of nodes it has.
4. Verify. Two fingerprints differ in at most two bits exactly if some word is at most one bit away from both. The 65 words
   around each candidate are joined on equality. No more than 65 fingerprints are so near to one word, whatever the
   data, and all of these link with each other, so a link of each with the smallest is enough: near copies of one text, of which
   thousands link, never become pairs.
5. Components of these links, and of each component the smallest document id.

Only links through candidates of step 3 are verified; step 2 is complete for two bits, so none is lost and none is added.

Null texts count as empty. Null ids link like others but name no component; a component without a known id has a null
name. Rows with equal ids stay separate rows. An empty table gives an empty one. Very long texts are a slice of their own. Only
the two named columns are read, so other columns may have any name."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.batches import slices, utf8, words
from attestry.llm.components import components
from attestry.session import cut_lineage

SHINGLE, SEED = 3, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(word: int) -> int:
    """The 11 check bits that a word of 23 bits misses to be a codeword."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _error_table() -> np.ndarray:
    """For each remainder the errors of at most four bits with it: the nearest codeword's first, -1 where there are no more."""
    of_bit = [_remainder(1 << b) for b in range(23)]
    table = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= of_bit[b]
            table[s, used[s]] = sum(1 << b for b in bits)
            used[s] += 1
    return table


_CHECKS = np.array([_remainder(high << 11) for high in range(4096)], np.int64)
_ERRORS = _error_table()


def codewords(word: np.ndarray) -> np.ndarray:
    """Per word of 23 bits the indices of the codewords within four bits: the nearest, then up to five more, else -1."""
    errors = _ERRORS[(word & 2047) ^ _CHECKS[word >> 11]]
    return np.where(errors < 0, -1, (word[:, None] ^ errors) >> 11)


def simhashes(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text."""
    n = len(off) - 1
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, number = words(lower, off)
    out = np.zeros(n, np.uint64)
    if not len(start):
        return out
    size = end - start
    put = np.concatenate([[0], np.cumsum(size + 1)])
    spaced = np.full(put[-1], 32, np.uint8)
    place = np.arange(size.sum())
    before = np.concatenate([[0], np.cumsum(size)[:-1]])
    spaced[place + np.repeat(np.arange(len(size)), size)] = lower[place + np.repeat(start - before, size)]
    counts = np.bincount(number, minlength=n)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    last = first + np.repeat(counts, counts) - 1
    at = np.arange(len(start))
    begins = (at + shingle - 1 <= last) | (at == first)
    at = at[begins]
    stop = np.minimum(at + shingle - 1, last[at])
    raw = spaced.tobytes()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], seed) for a, b in zip(put[at].tolist(), (put[stop + 1] - 1).tolist(), strict=True)], np.uint64)
    owner = number[at]
    # One bit of every byte at a time: 255 hashes are added in one word before a byte can overflow.
    fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
    heads = np.flatnonzero(fresh)
    place = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
    groups = np.flatnonzero(place % 255 == 0)
    texts = np.flatnonzero(fresh[groups])
    votes = np.zeros((len(texts), 64), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101), groups)
        votes[:, bit::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), texts, axis=0)
    most = 2 * votes > np.diff(np.append(heads, len(owner)))[:, None]
    out[owner[heads]] = np.packbits(most, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint's bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([part.column(ident), pa.array(simhashes(*utf8(part.column(text)), shingle, seed).view(np.int64))], names=[ident, "fp"])

    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {docs.schema[ident].dataType.simpleString()}, fp long")


def fuzzy_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp, nearest) for each fingerprint: its keys, and under which its own codeword is the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            parts = [((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
            near = [codewords(p) for p in parts]
            for i in range(len(SEGMENTS)):
                for j in range(len(SEGMENTS)):
                    if i != j:
                        row, choice = np.nonzero(near[j] >= 0)
                        key = (near[j][row, choice] << 26) | (parts[i][row] << 4) | (i * len(SEGMENTS) + j)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(choice == 0)], names=["key", "fp", "nearest"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long, nearest boolean")


def candidates(nodes: DataFrame) -> DataFrame:
    """(fp): nodes that share a key with another node, of which one is nearest there."""
    keys = fuzzy_keys(nodes)
    met = keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.bool_or("nearest").alias("some")).filter("low < high and some")
    return keys.join(met.select("key"), "key", "left_semi").select("fp").distinct()


def near_links(found: DataFrame) -> DataFrame:
    """(a, b): links that give the components of all pairs of fingerprints with at most two differing bits."""
    flips = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
    around = found.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    balls = around.groupBy("word").agg(F.array_sort(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    return balls.select(F.explode(F.slice("fps", 2, 64)).alias("a"), F.col("fps")[0].alias("b")).distinct()


def link(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fingerprint, component_id): the fingerprint as 16 hex digits, the smallest id that links reach."""
    known = cut_lineage(fingerprints(docs, ident, text, shingle, seed))
    nodes = cut_lineage(known.groupBy("fp").agg(F.min(ident).alias("least")))
    label = components(cut_lineage(near_links(candidates(nodes)))).select(F.col("node").alias("fp"), "component")
    placed = nodes.join(label, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    out = known.join(cut_lineage(placed.join(named, "component").select("fp", "component_id")), "fp")
    return out.select(ident, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
