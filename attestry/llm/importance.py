"""Quality by importance resampling (hashed n-gram models, Gumbel top-k).

A text is the set of its features: words, runs of signs, pairs of neighbours, and whether one or two of these repeat over
eight places in a row. The raw model counts, for each hashed feature, the documents that have it; the target model counts those among them
that are labelled as good. A feature's log ratio compares the target count with what the raw count lets expect,
``PRIOR`` documents added to both; it counts where the target lacks the feature clearly (``SIGNIFICANT`` deviations, and fewer
than one in e of the expected documents), else it is 0. A document's log weight is the sum of its features' log ratios.
Each feature is counted in two tables under two hashes and takes the milder ratio, so a chance meeting of two
features in one bucket damns neither.

Documents are then drawn without replacement in proportion to exp(weight / ``TEMPERATURE``): each adds Gumbel noise, from a
hash of its id and text, and the ``k`` largest keys stay. ``k`` is the number of documents whose weight reaches the floor that
best parts good from other labelled texts, where a good text is weighed without its own share of the target model. The k-th
largest key is found by counting, in rounds of ``BINS`` bins; nothing is sorted.

Counts cover every document; the models are fixed tables, whatever the corpus holds. Labels are read from at most
``LABELLED`` rows, the ones with the smallest hashes of the id; that bounds what is broadcast.

Null, empty and blank texts have no feature and weight 0, like any text that nothing speaks against. A document without
a label is raw text only; labels with a null mark count as not good; of repeated labels the worse counts. Rows with equal
keys at the edge all stay. An empty table gives an empty result; without a good label every document stays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from attestry.llm.batches import SPACES, U64, SpanHashes, mix, slices, utf8
from attestry.session import cut_lineage

WORD_BITS, PAIR_BITS = 19, 18
SIZE = 2 * (1 << WORD_BITS) + 2 * (1 << PAIR_BITS)
BLOCK = 1 << 13
LABELLED = 20_000
PRIOR = 1.0
SIGNIFICANT = 2.5
TEMPERATURE = 0.05
BINS = 4096

_CLASS = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits, 2 signs
_CLASS[SPACES] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39, 95]] = 1
_RUN = U64(0x5851F42D4C957F2D)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket in the first table, bucket in the second) of each distinct feature of each text."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    cuts = off[:-1]
    new[cuts[cuts < len(data)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))
    full = kind[start] > 0
    start, end = start[full], end[full]
    owner = np.searchsorted(off, start, "right") - 1
    word = SpanHashes(data).digests(start, end)
    same = owner[1:] == owner[:-1]
    pair = mix(word[:-1] * U64(3) + word[1:])[same]
    again = (word[2:] == word[:-2]) & (owner[2:] == owner[:-2])
    for step in (1, 2, 3):  # seven in a row; 1 + 2 + 3 places are lost
        again = again[:-step] & again[step:] if len(again) > step else again[:0]
    run = owner[np.flatnonzero(again)]
    out = []
    at = 0
    words = (np.concatenate([owner, run]), np.concatenate([word, np.full(len(run), _RUN)]))
    for (number, value), bits in ((words, WORD_BITS), ((owner[1:][same], pair), PAIR_BITS)):
        order = np.lexsort((value, number))
        number, value = number[order], value[order]
        first = np.ones(len(value), bool)
        first[1:] = (number[1:] != number[:-1]) | (value[1:] != value[:-1])
        number, value = number[first], value[first]
        one = (value >> U64(64 - bits)).astype(np.int64) + at
        two = ((value & U64(0xFFFFFFFF)) >> U64(32 - bits)).astype(np.int64) + at + (1 << bits)
        out.append((number, one, two))
        at += 2 << bits
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Model:
    """Documents with each feature, raw and target, and how many documents there are of each."""

    raw: np.ndarray
    target: np.ndarray
    n_raw: int
    n_target: int

    def ratios(self, left_out: bool = False) -> np.ndarray:
        """Log ratio of each bucket; ``left_out``: as for a text of the target that is not to speak for itself."""
        if not self.n_target:
            return np.zeros(SIZE, np.float32)
        one = 1 if left_out else 0
        expected = self.raw * (self.n_target / self.n_raw)
        target = np.maximum(self.target - one, 0)
        ratio = np.log((target + PRIOR) / (expected + PRIOR))
        clear = (target - expected) / np.sqrt(expected + 1) < -SIGNIFICANT
        return np.where(clear & (ratio < -1), ratio, 0).astype(np.float32)


def weigh(data: np.ndarray, off: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    owner, one, two = features(data, off)
    return np.bincount(owner, np.maximum(ratios[one], ratios[two]), minlength=len(off) - 1).astype(float)


def labelled_sample(labels: DataFrame, ident: str = "doc_id", rows: int = LABELLED) -> DataFrame:
    """(id, _good) of at most ``rows`` labelled documents, by hash of the id."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    chosen = labels.filter(F.col(ident).isNotNull()).groupBy(ident).agg(F.min(good).alias("_good"))
    return chosen.orderBy(F.xxhash64(ident), ident).limit(rows)


def counted(docs: DataFrame, good: str = "_good", text: str = "text") -> Model:
    """The model of documents some of which are marked good. Tasks send blocks of counts, which are summed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        n_raw = n_target = 0
        for part in slices(batches, text):
            owner, one, two = features(*utf8(part.column(text)))
            mark = np.array([x is True for x in part.column(good).to_pylist()], bool)
            n_raw, n_target = n_raw + len(mark), n_target + int(mark.sum())
            chosen = mark[owner]
            for bucket in (one, two):
                np.add.at(raw, bucket, 1)
                np.add.at(target, bucket[chosen], 1)
        if n_raw:
            blocks = [b for b in range(SIZE // BLOCK) if raw[b * BLOCK : (b + 1) * BLOCK].any()]
            fields = [[x[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes() for b in blocks] for x in (raw, target)]
            sizes = np.array([n_raw, n_target], "<u4").tobytes()
            columns = [pa.array([*blocks, -1], pa.int32()), *(pa.array([*f, sizes], pa.binary()) for f in fields)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "raw", "target"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, *values in zip(*(batch.column(c).to_pylist() for c in ("block", "raw", "target")), strict=True):
                arrays = [np.frombuffer(v, "<u4").astype(np.int64) for v in values]
                sums[b] = [x + y for x, y in zip(sums[b], arrays, strict=True)] if b in sums else arrays
        if sums:
            fields = [pa.array([v[k].astype("<i8").tobytes() for v in sums.values()], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *fields], names=["block", "raw", "target"])

    schema = "block int, raw binary, target binary"
    parts = docs.select(text, good).mapInArrow(run, schema)
    partitions = min(SIZE // BLOCK, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    raw, target, n = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64), np.zeros(2, np.int64)
    for r in parts.repartition(partitions, "block").mapInArrow(total, schema).collect():
        if r.block < 0:
            n += np.frombuffer(r.raw, "<i8")
            continue
        for out, part in ((raw, r.raw), (target, r.target)):
            out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(part, "<i8")
    return Model(raw, target, int(n[0]), int(n[1]))


def floor_of(good: np.ndarray, other: np.ndarray) -> float:
    """The weight that parts good from other texts with the fewest mistakes per class; the lowest of equals. None are other: no floor."""
    if not len(good) or not len(other):
        return -np.inf
    at = np.unique(np.concatenate([good, other]))
    kept = 1 - np.searchsorted(np.sort(good), at) / len(good)
    gone = np.searchsorted(np.sort(other), at) / len(other)
    return float(at[int(np.argmax(kept + gone))])


def _weights(docs: DataFrame, ratios: np.ndarray, extra: str, text: str) -> DataFrame:
    schema = StructType([*(f for f in docs.schema if f.name != text), StructField(extra, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            names = [c for c in part.schema.names if c != text]
            weight = pa.array(weigh(*utf8(part.column(text)), ratios))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), weight], names=[*names, extra])

    return docs.mapInArrow(run, schema)


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by counts in ever narrower bins."""
    left, most = keys.agg(F.min(column), F.max(column)).head()
    while left < most:
        width = (most - left) / BINS
        if width <= 0 or left + width == left:
            break
        bin_no = F.least(F.floor((F.col(column) - left) / width), F.lit(BINS - 1))
        rows = keys.filter(F.col(column).between(left, most)).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r.bin):
            if k <= r.n:
                left, most = r.low, r.high
                break
            k -= r.n
    return left


@dataclass
class Draw:
    """The fitted model, and the smallest key that is drawn (None: no document is)."""

    model: Model
    least: float | None
    temperature: float
    seed: int

    def keys(self, docs: DataFrame, ident: str, text: str) -> DataFrame:
        """The documents without their text, with ``log_weight`` and ``key``."""
        noise = (F.xxhash64(F.lit(self.seed), ident, text).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
        drawn = docs.withColumn("_noise", -F.log(-F.log(noise)))
        weighed = _weights(drawn, self.model.ratios(), "log_weight", text)
        return weighed.withColumn("key", F.col("log_weight") / self.temperature + F.col("_noise")).drop("_noise")

    def keep(self) -> Column:
        return F.lit(False) if self.least is None else F.col("key") >= self.least


def fit(
    docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", seed: int = 11, temperature: float = TEMPERATURE, labelled: int = LABELLED
) -> tuple[Draw, DataFrame]:
    """The draw, and (id, log_weight, key) of each document as a written table."""
    sample = cut_lineage(labelled_sample(labels, ident, labelled))
    marked = docs.select(ident, text).join(F.broadcast(sample), ident, "left")
    model = counted(marked, "_good", text)
    known = docs.select(ident, text).join(F.broadcast(sample), ident)
    own = _weights(known.filter("_good").select(text), model.ratios(left_out=True), "weight", text).collect()
    other = _weights(known.filter(~F.col("_good")).select(text), model.ratios(), "weight", text).collect()
    floor = floor_of(np.array([r.weight for r in own]), np.array([r.weight for r in other]))
    draw = Draw(model, None, temperature, seed)
    scored = cut_lineage(draw.keys(docs.select(ident, text), ident, text))
    k = scored.filter(F.col("log_weight") >= floor).count()
    draw.least = kth_largest(scored, "key", k) if k else None
    return draw, scored


def resample(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(id, log_weight, key, kept) of each document."""
    draw, scored = fit(docs, labels, ident, text, **settings)
    return scored.withColumn("kept", draw.keep())


def kept_rows(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents that are drawn, with all their columns. They are weighed again where they lie, so no text is shuffled."""
    draw, _ = fit(docs, labels, ident, text, **settings)
    names = docs.columns
    plain = {c: f"_c{i}" for i, c in enumerate(names)}  # so that no column is named like one made here
    again = docs.toDF(*plain.values()).withColumn("_body", F.col(plain[text]))
    keyed = draw.keys(again, plain[ident], "_body").filter(draw.keep())
    return keyed.select(*[F.col(v).alias(c) for c, v in plain.items()])
