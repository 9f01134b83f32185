"""Exact n-gram Jaccard linking of documents with a token-group matrix.

Documents are sets of hashed word n-grams; equal sets are one node. Similar nodes are put into groups, each group keeps
the union of its members' tokens, and a node is compared with a group's members only where the union holds enough of
the node's tokens. Every link between different components is found; no pair inside a component is made.

1. Candidates. The token space is cut into more blocks than two linked sets can differ in tokens, so two linked sets
   agree on several whole blocks (pigeonhole). Sets that share enough (size class, block, content) keys may link;
   nothing else can. A key holds several tokens, so a passage that many documents share does not make a key by itself.
2. Components by leaders. Every node is compared with a leader, the node that is first in most of its keys, and, if it
   does not link with it, with the nodes of the same leader that did not either. For keys that several components
   still share this is done again with leaders under another order, ``ROUNDS`` times. Links join components, so near copies
   of one text, of which most link with each other, become one component without their pairs.
3. Matrix. Nodes with one leader form groups of about ``GROUP`` (fewer of large sets), and each group has the union of its
   members' tokens and, for each member, where its tokens lie in it.
   For keys that more than one component still shares, a cell (node, group) must share enough keys; then the number of the
   node's tokens in the group's union bounds it, and only a qualifying group is opened: its members' places, marked where
   the node has the token, sum to all intersections at once.
4. Components of all links.

Keys travel as packed arrays, one row per task and bucket of keys; sets of candidate nodes are built from the texts
once. Leaders with many nodes are salted. Node ids are 64-bit hashes of the sets.

Empty sets (null, empty or blank texts) link with nothing. Repeated rows are copies. A null document id is a document
like any other and is passed over when the smallest id is taken. Only the two named columns are read."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.batches import U64, SpanHashes, mix, slices, utf8, words
from attestry.llm.components import components
from attestry.session import cut_lineage

GROUP = 512
GROUP_TOKENS = 2_000_000
ROUNDS = 2
LEADER_SALT = 100
SPARE = 8  # one block more for so many differing tokens: more keys to send, more that a link must share
_STEP = U64(0x9E3779B97F4A7C15)
_NO_BYTE = U64(0xFFFFFFFFFFFFFF00)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Similar:
    """Jaccard likeness of at least ``num / den`` between sets of ``words``-word n-grams."""

    words: int = 5
    num: int = 80
    den: int = 100

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = sorted((len(a), len(b)))
        if self.den * small < self.num * large:
            return False
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * shared >= self.num * (len(a) + len(b) - shared)

    def differ(self, total: int) -> int:
        """Most tokens that two linked sets of ``total`` tokens together do not share."""
        return (self.den - self.num) * total // (self.den + self.num)

    def needed(self, n: int) -> int:
        """Tokens of a set of size n that any linked set must hold."""
        return -(-self.num * n // self.den)

    @cached_property
    def bounds(self) -> np.ndarray:
        """Size classes; linked sets lie in one class or at two sides of one bound."""
        out = [1]
        while self.differ(2 * out[-1]) == 0:
            out[-1] += 1
        ratio = (self.den / self.num) ** 2
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, math.floor(out[-1] * ratio)))
        return np.array(out, np.int64)

    def schemes(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which sets, scheme number, most differing tokens) for the class of each size and for the bounds it is near."""
        at = np.searchsorted(self.bounds, n, "right")  # bounds[at - 1] <= n < bounds[at]
        out = [(np.flatnonzero(at > 0), 2 * at, (self.den - self.num) * 2 * (self.bounds[at] - 1) // (self.den + self.num))]
        for shift in (0, -1):
            edge = self.bounds[np.maximum(at + shift, 0)]
            near = (at + shift >= 0) & (n * self.den >= self.num * edge) & (n * self.num <= self.den * (edge - 1))
            most = edge - 1 + self.den * (edge - 1) // self.num
            out.append((np.flatnonzero(near), 2 * (at + shift) + 1, (self.den - self.num) * most // (self.den + self.num)))
        return [(w, s[w], d[w]) for w, s, d in out]


class Sets:
    """Distinct hashed n-grams of some texts, ascending within each text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, width: int):
        n = len(off) - 1
        data = _LOWER[data]
        start, end, doc = words(data, off)
        h = SpanHashes(data).digests(start, end)
        count = np.bincount(doc, minlength=n)
        gram = h.copy()
        for k in range(1, width):
            gram = mix(gram[: len(h) - k] * _STEP + h[k:]) if len(h) > k else gram[:0]
        first = np.flatnonzero(doc[: len(gram)] == doc[width - 1 :]) if len(gram) else np.zeros(0, np.int64)
        owner, token = doc[first], gram[first]
        begins = np.concatenate([[0], np.cumsum(count)])
        short = np.flatnonzero((count > 0) & (count < width))
        alone = []
        for d in short:
            acc = np.array([count[d]], U64)
            for x in h[begins[d] : begins[d + 1]]:
                acc = mix(acc * _STEP + x)
            alone.append(acc)
        if alone:
            owner, token = np.concatenate([owner, short]), np.concatenate([token, *alone])
        order = np.lexsort((token, owner))
        owner, token = owner[order], token[order]
        new = np.ones(len(token), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
        self.owner, self.token = owner[new], token[new]
        self.size = np.bincount(self.owner, minlength=n)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.node = mix(_sums(mix(self.token), self.begin) + self.size.astype(U64)).view(np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.token[self.begin[i] : self.begin[i + 1]]


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]


def block_keys(sets: Sets, which: np.ndarray, rule: Similar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, need): of any two linked sets each shares at least ``need`` keys of some scheme with the other.

    The scheme's lowest byte is the key's. With so many blocks more than a linked set can differ in, that many are equal;
    a set's own empty blocks are not counted."""
    keys, owners, needs = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for chosen, scheme, most in rule.schemes(sets.size[which]):
        live = most > 0
        text, scheme, most = which[chosen][live], scheme[live], most[live]
        if not len(text):
            continue
        spare = np.ceil(most / SPARE).astype(np.int64) + 4
        blocks = most + 1 + spare
        size = sets.size[text]
        at = np.repeat(sets.begin[text] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        local = np.repeat(np.arange(len(text)), size)
        token = sets.token[at]
        block = ((token >> U64(32)) * blocks[local].astype(U64)) >> U64(32)
        new = np.ones(len(token), bool)
        new[1:] = (local[1:] != local[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        content = _sums(mix(token ^ _STEP), np.append(first, len(token)))
        mark = scheme.astype(U64)
        empty = blocks - np.bincount(local[first], minlength=len(text))
        need = np.maximum(1 + spare - empty, 1)
        keys.append((mix(content + mix((mark[local[first]] << U64(32)) + block[first])) & _NO_BYTE) | (mark[local[first]] & ~_NO_BYTE))
        owners.append(text[local[first]])
        needs.append(need[local[first]])
        for i in np.flatnonzero(empty > spare):  # its equal blocks may all be empty ones
            full = set(block[first[local[first] == i]].tolist())
            bare = np.array([b for b in range(int(blocks[i])) if b not in full], U64)
            keys.append((mix(mix((mark[i] << U64(32)) + bare)) & _NO_BYTE) | (mark[i] & ~_NO_BYTE))
            owners.append(np.full(len(bare), text[i]))
            needs.append(np.ones(len(bare), np.int64))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(needs)


def nodes(docs: DataFrame, rule: Similar, ident: str, text: str) -> DataFrame:
    """(id, n_shingles, node) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            sets = Sets(*utf8(part.column(text)), rule.words)
            yield pa.RecordBatch.from_arrays([part.column(ident), pa.array(sets.size, pa.int64()), pa.array(sets.node)], names=[ident, "n_shingles", "node"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, n_shingles long, node long")


def shared_keys(docs: DataFrame, rule: Similar, text: str, buckets: int) -> DataFrame:
    """(key, node, need, leader) for every key that more than one node has; the leader is the key's smallest node.

    A key is sent as its bucket and 32 more bits. Two keys that meet by chance only cost a comparison."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        amount = 0

        def out() -> pa.RecordBatch:
            key, node, need = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = ((key >> U64(32)) * U64(buckets)) >> U64(32)
            order = np.lexsort((node, bucket))
            key, node, need, bucket = key[order], node[order], need[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1).astype(U64))
            rows: list[tuple] = []
            for b in np.flatnonzero(np.diff(cut)):
                part = slice(cut[b], cut[b + 1])
                own, places = np.unique(node[part], return_inverse=True)
                short = ((key[part] >> U64(8)) & U64(0xFFFFFFFF)).astype("<u4"), (key[part] & U64(0xFF)).astype("u1"), np.minimum(need[part], 255).astype("u1")
                counts = np.bincount(places).astype("<u4")
                rows.append((int(b), *(x.tobytes() for x in short), own.tobytes(), counts.tobytes()))
            fields = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(fields[0], pa.int32()), *(pa.array(f, pa.binary()) for f in fields[1:])], names=["bucket", "keys", "schemes", "needs", "nodes", "counts"])

        for part in slices(batches, text):
            sets = Sets(*utf8(part.column(text)), rule.words)
            fresh = []
            for i, node in enumerate(sets.node.tolist()):
                if sets.size[i] and node not in seen:
                    seen.add(node)
                    fresh.append(i)
            key, owner, need = block_keys(sets, np.array(fresh, np.int64), rule)
            held.append((key, sets.node[owner], need))
            amount += len(key)
            if amount > 4_000_000:
                yield out()
                amount = 0
        if amount:
            yield out()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def out() -> pa.RecordBatch:
            key, node, need = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((node, key))
            key, node, need = key[order], node[order], need[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, need = key[new], node[new], need[new]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(start, len(key)))
            keep = np.repeat(count > 1, count)
            fields = (key, node, need, np.repeat(node[start], count))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(f[keep])) for f in fields], names=["key", "node", "need", "leader"])

        for batch in batches:
            columns = [batch.column(c) for c in ("keys", "schemes", "needs", "nodes", "counts")]
            for row, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != current and held:
                    yield out()
                current = bucket
                raw = [c[row].as_buffer() for c in columns]
                short, scheme, need, own, counts = (np.frombuffer(r, t) for r, t in zip(raw, ("<u4", "u1", "u1", "<i8", "<u4"), strict=True))
                key = (np.int64(bucket) << 40) | (short.astype(np.int64) << 8) | scheme
                held.append((key, np.repeat(own, counts), need.astype(np.int64)))
        if held:
            yield out()

    packed = docs.select(text).mapInArrow(pack, "bucket int, keys binary, schemes binary, needs binary, nodes binary, counts binary")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(find, "key long, node long, need long, leader long")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _row_hash(ident: str, text: str) -> Column:
    return F.xxhash64(F.col(ident), _text_hash(text))


def candidate_sets(docs: DataFrame, known: DataFrame, wanted: DataFrame, rule: Similar, ident: str, text: str) -> DataFrame:
    """``wanted`` with (size, tokens) of its nodes, each from one document that has the set."""
    # A row is found by its id and text together, so rows of one id, or of none, do not meet.
    first = known.groupBy("node").agg(F.min("_ref").alias("_ref"))
    carried = ["node", "leader", "salts", "lead_salts"]
    reps = first.join(wanted, "node").select("_ref", *carried)
    met = docs.select(_row_hash(ident, text).alias("_ref"), F.col(text)).join(reps, "_ref")
    found = met.dropDuplicates(["_ref", "node", "leader"]).select(text, *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            sets = Sets(*utf8(part.column(text)), rule.words)
            right = np.flatnonzero(sets.node == part.column("node").to_numpy(zero_copy_only=False))  # hashes may collide
            at = pa.array(right)
            tokens = pa.array([sets.of(i).tobytes() for i in right], pa.binary())
            kept = [part.column(c).take(at) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sets.size[right], pa.int64()), tokens], names=[*carried, "size", "tokens"])

    return found.mapInArrow(run, "node long, leader long, salts int, lead_salts int, size long, tokens binary")


_Row = tuple[int, int, np.ndarray]  # node, component, tokens


def _grouped(rows: DataFrame, keys: list[str], found: Callable[[list[_Row], list[_Row]], list[tuple[int, int]]], most: int) -> DataFrame:
    """Links (a, b) that ``found`` makes of each group's members (kind 0) and up to ``most`` of its queries (kind 1) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = None
        members: list[_Row] = []
        queries: list[_Row] = []
        links: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            a, b = zip(*links, strict=True)
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            group = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            tokens = batch.column("tokens")
            rest = zip(*(batch.column(c).to_pylist() for c in ("kind", "node", "component")), strict=True)
            for i, (key, (kind, node, component)) in enumerate(zip(group, rest, strict=True)):
                if key != current or len(queries) >= most:
                    links.extend(found(members, queries))
                    queries = []
                if key != current:
                    current, members = key, []
                (queries if kind else members).append((node, component, np.frombuffer(tokens[i].as_py(), "<u8")))
            if links:
                yield out()
        links.extend(found(members, queries))
        if links:
            yield out()

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*keys, "kind", "node", "component", "tokens").repartition(partitions, *keys).sortWithinPartitions(*keys, "kind")
    return dealt.mapInArrow(run, "a long, b long")


def leader_links(sets: DataFrame, rule: Similar) -> DataFrame:
    """Links of nodes with their leaders; the nodes of one leader are dealt in ``salts`` parts.

    In a part, a node that links with no leader so far is a leader for those that come after it."""
    copies = F.explode(F.sequence(F.lit(0), F.col("lead_salts") - 1)).alias("salt")
    lead = sets.filter("lead_salts is not null").select(F.col("node").alias("leader"), copies, F.lit(0).alias("kind"), "node", "tokens")
    queries = sets.filter("leader is not null").select("leader", F.pmod(F.hash("node"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "node", "tokens")

    def found(members: list[_Row], queries: list[_Row]) -> list[tuple[int, int]]:
        leaders = [(node, own) for node, _, own in members[:1]]
        links = []
        for q, _, tokens in queries:
            to = next((node for node, own in leaders if rule.linked(tokens, own)), None)
            if to is None:
                leaders.append((q, tokens))
            else:
                links.append((q, to))
        return links

    return _grouped(lead.unionAll(queries).withColumn("component", F.lit(0).cast("bigint")), ["leader", "salt"], found, 2 * LEADER_SALT)


def _salted(pairs: DataFrame) -> DataFrame:
    """(node, leader, salts, lead_salts), a row per node: whom it follows in how many tasks, and in how many it is followed."""
    size = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / LEADER_SALT).cast("int").alias("salts"))
    follows = pairs.join(size, "leader").select("node", "leader", "salts")
    return follows.join(size.select(F.col("leader").alias("node"), F.col("salts").alias("lead_salts")), "node", "full")


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links between nodes have joined their components."""
    a = links.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a")
    both = a.join(label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").select("ca", "cb")
    joined = components(both, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("_new"))
    return cut_lineage(label.join(joined, "component", "left").select("node", F.coalesce("_new", "component").alias("component")))


def _mixed(shared: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of keys that more than one component shares, with the component of each."""
    at = shared.join(label, "node")
    mixed = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    return cut_lineage(at.join(mixed, "key"))


def _next_leaders(mixed: DataFrame, order: int) -> DataFrame:
    """(node, leader): of the first nodes, in this order, of a node's keys that lie in another component, the one with most keys."""
    rank = F.struct(F.xxhash64(F.lit(order), "node").alias("h"), F.col("node").alias("leader"), F.col("component").alias("other"))
    first = mixed.groupBy("key").agg(F.min(rank).alias("first"))
    away = mixed.join(first, "key").filter(F.col("component") != F.col("first.other"))
    return _most_shared(away.select("node", F.col("first.leader").alias("leader")), 2)


def _most_shared(pairs: DataFrame, least: int) -> DataFrame:
    """(node, leader): the leader that shares most keys with the node, the smallest of equals; none with fewer than ``least``."""
    counts = pairs.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    best = counts.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("fewer"), "leader")).alias("b"))
    return best.select("node", F.col("b.leader").alias("leader"))


def _linkable(shared: DataFrame) -> DataFrame:
    """The rows of nodes that share as many keys of a scheme as a link needs; with any other node they cannot link."""
    scheme = F.col("key").bitwiseAND(F.lit(0xFF)).alias("scheme")
    rows = shared.select("key", "node", "need", scheme)
    enough = rows.groupBy("node", "scheme").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("most")).filter("n >= most").select("node", "scheme")
    kept = rows.join(enough, ["node", "scheme"])
    first = kept.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last")
    return kept.join(first.select("key", "leader"), "key").select("key", "node", "need", "leader")


def matrix_links(mixed: DataFrame, sets: DataFrame, rule: Similar) -> DataFrame:
    """Links between components that still share a key: cells bounded by keys and group unions, qualifying groups opened."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("size") / GROUP_TOKENS)).cast("int")
    groups = sets.groupBy("leader").agg(parts.alias("groups"))
    placed = sets.select("node", "leader", "size").join(groups, "leader").select("node", "leader", "size", F.pmod(F.hash("node"), F.col("groups")).alias("part"))
    at = cut_lineage(mixed.drop("leader").join(placed, "node"))
    rows = at.groupBy("key", "leader", "part").agg(F.min("component").alias("low"), F.min("size").alias("least"), F.max("size").alias("most"))
    asking = at.select("key", F.col("node").alias("q"), "need", F.col("size").alias("q_size"), F.col("component").alias("own"))
    cells = asking.join(rows, "key").filter(F.col("low") < F.col("own"))
    cells = cells.filter((rule.den * F.col("most") >= rule.num * F.col("q_size")) & (rule.den * F.col("q_size") >= rule.num * F.col("least")))
    scheme = F.col("key").bitwiseAND(F.lit(0xFF))
    counted = cells.groupBy("q", "own", "leader", "part", scheme.alias("scheme")).agg(F.count(F.lit(1)).alias("hits"), F.max("need").alias("need"))
    cells = cut_lineage(counted.filter("hits >= need").select("q", "own", "leader", "part").distinct())
    wanted = cells.select("leader", "part").distinct()
    inside = at.select("node", "leader", "part", "component").distinct().join(wanted, ["leader", "part"], "left_semi")
    body = sets.select("node", "tokens")
    members = inside.join(body, "node").select("leader", "part", F.lit(0).alias("kind"), "node", "component", "tokens")
    queries = cells.select(F.col("q").alias("node"), F.col("own").alias("component"), "leader", "part").join(body, "node")
    queries = queries.select("leader", "part", F.lit(1).alias("kind"), "node", "component", "tokens")

    def found(members: list[_Row], queries: list[_Row]) -> list[tuple[int, int]]:
        if not members or not queries:
            return []
        union, places = np.unique(np.concatenate([t for _, _, t in members]), return_inverse=True)
        sizes = np.array([len(t) for _, _, t in members])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        components_of = np.array([c for _, c, _ in members])
        links = []
        for q, own, tokens in queries:
            place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            place = place[union[place] == tokens]
            if len(place) < rule.needed(len(tokens)):
                continue
            has = np.zeros(len(union), np.int64)
            has[place] = 1
            shared = np.add.reduceat(has[places], starts)
            hit = np.flatnonzero((components_of < own) & (rule.den * shared >= rule.num * (len(tokens) + sizes - shared)))
            # One link with a component is enough.
            links += [(q, members[hit[i]][0]) for i in np.unique(components_of[hit], return_index=True)[1]]
        return links

    return _grouped(members.unionAll(queries), ["leader", "part"], found, 256)


def _linked(docs: DataFrame, known: DataFrame, rule: Similar, ident: str, text: str) -> DataFrame:
    """``known``, which has the node of every document, with the component ``_c`` of each."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = cut_lineage(_linkable(cut_lineage(shared_keys(docs, rule, text, max(1, partitions // 2)))))
    followers = _most_shared(shared.filter("node <> leader").select("node", "leader"), 1)
    sets = cut_lineage(candidate_sets(docs, known.filter("n_shingles > 0"), _salted(followers), rule, ident, text))
    label = sets.select("node").distinct().withColumn("component", F.col("node"))
    label = _relabelled(label, cut_lineage(leader_links(sets, rule)))
    mixed = _mixed(shared, label)
    body = sets.select("node", "size", "tokens")
    for order in range(ROUNDS):
        if mixed.isEmpty():
            break
        pairs = cut_lineage(_salted(_next_leaders(mixed, order)))
        label = _relabelled(label, cut_lineage(leader_links(pairs.join(body, "node"), rule)))
        mixed = _mixed(mixed.drop("component"), label)
    grouped = sets.select("node", F.coalesce("leader", "node").alias("leader"), "size", "tokens")
    label = _relabelled(label, cut_lineage(matrix_links(mixed, grouped, rule)))
    return known.join(label, "node", "left").withColumn("_c", F.coalesce("component", "node"))


def link(docs: DataFrame, rule: Similar = Similar(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the smallest document id reachable by links; null ids stay unless linked to a known one."""
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    marked = rows.select(F.struct("id", _row_hash("id", "text").alias("ref")).alias("who"), "text")
    known = cut_lineage(nodes(marked, rule, "who", "text")).select(F.col("who.id").alias(ident), F.col("who.ref").alias("_ref"), "n_shingles", "node")
    named = _linked(rows, known, rule, "id", "text")
    smallest = named.filter("n_shingles > 0").groupBy("_c").agg(F.min(ident).alias("_least"))
    out = named.join(smallest, "_c", "left")
    return out.select(ident, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col(ident)).alias("component_id"))


def one_of_each(docs: DataFrame, rule: Similar = Similar(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, one per component: the one with the smallest id (nulls last, equal ids by a hash
    of the text). Documents without a word link with nothing and all stay."""
    names = docs.columns
    plain = {c: f"_c{i}" for i, c in enumerate(names)}  # so that no column is named like one made here
    rows = docs.toDF(*plain.values())
    key = _text_hash(plain[text])
    known = cut_lineage(nodes(rows.select(F.struct(F.col(plain[ident]).alias("id"), key.alias("key")).alias("who"), plain[text]), rule, "who", plain[text]))
    plain_known = known.select(F.xxhash64("who.id", "who.key").alias("_ref"), "who", "n_shingles", "node")
    named = _linked(rows, plain_known, rule, plain[ident], plain[text]).filter("n_shingles > 0")
    first = named.groupBy("_c").agg(F.min(F.struct(F.col("who.id").isNull(), "who.id", "who.key")).alias("f"))
    chosen = first.select(F.col("f.id").alias("_id"), F.col("f.key").alias("_key"))
    some = F.regexp_like(F.coalesce(F.col(plain[text]), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    kept = rows.filter(some).join(chosen, F.col(plain[ident]).eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left_semi")
    kept = kept.withColumn("_key", key).dropDuplicates([plain[ident], "_key"]).drop("_key").unionAll(rows.filter(~some))
    return kept.select(*[F.col(v).alias(c) for c, v in plain.items()])
