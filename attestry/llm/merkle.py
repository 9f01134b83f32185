"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf: the SHA-256 of its fields, each ``-`` if null, else its UTF-8 bytes behind their count and a colon. The
leaves of a group (say, a language) ascend by id and are hashed two by two, level by level, to the group's subroot (the last node of a
level may be alone and is hashed alone; a single node is the root itself); the subroots, ordered by group, give the root.
A leaf's proof is its siblings up to the root. Digests are hashed as hexadecimal text.

A tree is worked off in the order of node labels (level, index): each node receives what was sent to its label from a priority
queue, computes, and sends on to labels that come later. On the way up children send digests to their parent; in
the reversed sweep a parent sends each child the proof from there on, the sibling in front. The queue is external: leaves are
numbered by a range sort, aligned blocks of ``2 ** bits`` neighbours are one task's queue at a time, and what leaves a block is
a row (label of the receiver, digest or proof) that Spark's shuffle sorts and spills for the next round. So n leaves take
log(n) / ``bits`` rounds each way, every task holds one block, and one hot group is as many blocks as it needs. Each round is a table
in the shared folder: a lost executor costs the rows of its tasks. The driver sees one number per round.

Null groups come first and are a group; null ids come first in their group; rows of equal ids are ordered by their leaf, so equal
rows are interchangeable. Null and empty texts have different leaves. An empty table has no leaf, and gives an empty frame. Texts are
hashed where they lie and never shuffled, whatever their length. Only the named columns are read."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 12
ALONE, LEFT, RIGHT = 0, 1, 2  # where a sibling stands

Path = tuple | None  # (where, sibling, the path from the parent on)


def leaf_digest(fields: Sequence[Column]) -> Column:
    def framed(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[framed(c) for c in fields]), 256))


def digest(*children: bytes) -> bytes:
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


class TimeForward:
    """Messages to node labels, received in the order of the labels; those to one label in the order of ``place``."""

    def __init__(self) -> None:
        self._queue: list[tuple] = []
        self._sent = 0

    def send(self, label: tuple[int, int], place: int, message: object) -> None:
        self._sent += 1
        heapq.heappush(self._queue, (label, place, self._sent, message))

    def receive(self) -> tuple[tuple[int, int], list]:
        label = self._queue[0][0]
        out = []
        while self._queue and self._queue[0][0] == label:
            out.append(heapq.heappop(self._queue)[3])
        return label, out

    def __bool__(self) -> bool:
        return bool(self._queue)


def height(nodes: int, total: int, bits: int) -> int:
    """Levels above a block's nodes: ``bits`` in a tree of several blocks, else up to the root."""
    return bits if total > 1 << bits else (nodes - 1).bit_length()


def forward(leaves: Sequence[bytes], levels: int) -> list[tuple[tuple[int, int], bytes]]:
    """All nodes (label, digest) of a block in the order of their labels; the last is its root."""
    queue = TimeForward()
    for i, leaf in enumerate(leaves):
        queue.send((0, i), 0, leaf)
    nodes = []
    while queue:
        (level, i), received = queue.receive()
        own = digest(*received) if level else received[0]
        nodes.append(((level, i), own))
        if level < levels:
            queue.send((level + 1, i // 2), i % 2, own)
    return nodes


def backward(nodes: Sequence[tuple[tuple[int, int], bytes]], above: Path) -> list[Path]:
    """The path of each leaf, given that of the block's root."""
    of = dict(nodes)
    queue = TimeForward()
    (level, i), _ = nodes[-1]
    queue.send((-level, -i), 0, above)
    paths: list[Path] = []
    while queue:
        (level, i), (path,) = queue.receive()
        level, i = -level, -i
        if not level:
            paths.append(path)
            continue
        first, second = of[level - 1, 2 * i], of.get((level - 1, 2 * i + 1))
        if second is None:
            queue.send((1 - level, -2 * i), 0, (ALONE, b"", path))
        else:
            queue.send((1 - level, -2 * i), 0, (RIGHT, second, path))
            queue.send((1 - level, -2 * i - 1), 0, (LEFT, first, path))
    return paths[::-1]


def steps(path: Path) -> Iterator[tuple[int, bytes]]:
    while path is not None:
        where, sibling, path = path
        yield where, sibling


def folded(own: bytes, path: Path) -> bytes:
    """The root that a leaf and its siblings give."""
    for where, sibling in steps(path):
        own = digest(sibling, own) if where == LEFT else digest(own, sibling)
    return own


def packed(path: Path) -> bytes:
    return b"".join(bytes([where]) + bytes.fromhex(sibling.decode()) for where, sibling in steps(path))


def unpacked(raw: bytes) -> Path:
    at, found = 0, []
    while at < len(raw):
        size = 0 if raw[at] == ALONE else 32
        found.append((raw[at], raw[at + 1 : at + 1 + size].hex().encode()))
        at += 1 + size
    path: Path = None
    for where, sibling in reversed(found):
        path = (where, sibling, path)
    return path


def _blocks(rows: DataFrame, columns: Sequence[str], made: Callable[[list[dict]], dict[str, list]], schema: pa.Schema, spark_schema: str) -> DataFrame:
    """``made`` of the rows of each (tree, block), in order of kind and place, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["tree"], row["block"])
                if held and key != current:
                    yield pa.RecordBatch.from_pydict(made(held), schema)
                    held = []
                current = key
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pydict(made(held), schema)

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("tree", "block", *columns).repartition(partitions, "tree", "block").sortWithinPartitions("tree", "block", *columns[:2])
    return dealt.mapInArrow(run, spark_schema)


def numbered(rows: DataFrame, tree: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` as a table with each one's place in its tree and the tree's size, by a range sort and the counts of its ranges."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = cut_lineage(dealt.select("*", F.spark_partition_id().alias("_range"), own.alias("_row")))
    counts = at.groupBy("_range", tree).agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(tree)
    before = F.coalesce(F.sum("n").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select(F.col("_range").alias("_r"), F.col(tree).alias("_t"), (before - F.col("first")).alias("shift"), F.sum("n").over(by).alias("total"))
    met = at.join(shift, (F.col("_range") == F.col("_r")) & F.col(tree).eqNullSafe(F.col("_t")))
    return met.select(*rows.columns, (F.col("_row") + F.col("shift")).alias("pos"), "total")


def rounds_up(leaves: DataFrame, bits: int) -> list[DataFrame]:
    """Tables (tree, pos, total, h), from the leaves to the one node per tree that is its root."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("h", pa.binary())])

    def made(rows: list[dict]) -> dict[str, list]:
        total = rows[0]["total"]
        root = forward([r["h"].hex().encode() for r in rows], height(len(rows), total, bits))[-1][1]
        return {"tree": [rows[0]["tree"]], "pos": [rows[0]["block"]], "total": [-(-total // (1 << bits))], "h": [bytes.fromhex(root.decode())]}

    tables = [leaves]
    while (leaves.agg(F.max("total")).head()[0] or 0) > 1:
        rows = leaves.withColumn("block", F.shiftright("pos", bits))
        leaves = cut_lineage(_blocks(rows, ["pos", "total", "h"], made, schema, "tree string, pos long, total long, h binary"))
        tables.append(leaves)
    return tables


def rounds_down(tables: Sequence[DataFrame], above: DataFrame, made: Callable, schema: pa.Schema, spark_schema: str, bits: int) -> DataFrame:
    """``above``, the paths (tree, pos, path, subroot, root) of the last table's nodes, carried to the rows of the first.

    ``made(row, path, message)`` gives the last round's rows."""
    kept = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])

    def carried(row: dict, path: Path, message: dict) -> dict:
        return {"tree": row["tree"], "pos": row["pos"], "path": packed(path), "subroot": message["subroot"], "root": message["root"]}

    def worked(each: Callable, out: pa.Schema) -> Callable[[list[dict]], dict[str, list]]:
        def work(rows: list[dict]) -> dict[str, list]:
            message, nodes = rows[0], rows[1:]
            tree = forward([r["h"].hex().encode() for r in nodes], height(len(nodes), nodes[0]["total"], bits))
            found = [each(r, p, message) for r, p in zip(nodes, backward(tree, unpacked(message["path"])), strict=True)]
            return {name: [f[name] for f in found] for name in out.names}

        return work

    none = F.lit(None).cast("binary")
    if len(tables) == 1:  # every tree is one node: a round of blocks of one
        tables = [tables[0], tables[0].select("tree", "pos", "total", "h")]
    for k in range(len(tables) - 2, -1, -1):
        extra = [c for c in tables[k].columns if c not in ("tree", "pos", "total", "h")]
        lacking = [F.lit(None).cast(tables[k].schema[c].dataType).alias(c) for c in extra]
        zero = F.lit(0).cast("bigint")
        told = above.select("tree", F.col("pos").alias("block"), F.lit(0).alias("kind"), zero.alias("pos"), zero.alias("total"), none.alias("h"), "path", "subroot", "root", *lacking)
        nodes = tables[k].select("tree", F.shiftright("pos", bits).alias("block"), F.lit(1).alias("kind"), "pos", "total", "h", none.alias("path"), none.alias("subroot"), none.alias("root"), *extra)
        columns = ["kind", "pos", "total", "h", "path", "subroot", "root", *extra]
        if k:
            above = cut_lineage(_blocks(told.unionAll(nodes), columns, worked(carried, kept), kept, "tree string, pos long, path binary, subroot binary, root binary"))
        else:
            return _blocks(told.unionAll(nodes), columns, worked(made, schema), schema, spark_schema)
    raise AssertionError("no round")


def verified(
    docs: DataFrame, found: Mapping[str, Column] | None = None, fields: Sequence[str] = FIELDS, ident: str = "doc_id", group: str = "lang", bits: int = BITS
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of the rows, and whether they still prove it.

    ``found`` names fields that now hold something else; a leaf made with them is folded with the siblings of the manifest."""
    changes = dict(found or {})
    leaf = leaf_digest([F.col(c) for c in fields])
    now = F.lit(None).cast("binary")
    if changes:
        differs = F.lit(False)
        for name, value in changes.items():
            differs = differs | ~F.col(name).eqNullSafe(value)
        now = F.when(differs, leaf_digest([changes.get(c, F.col(c)) for c in fields]))
    rows = docs.select(F.col(ident).alias("id"), F.col(group).cast("string").alias("tree"), leaf.alias("h"), now.alias("now"))
    first = [F.asc_nulls_first("tree"), F.asc_nulls_first("id"), F.asc("h"), F.asc_nulls_first("now")]
    leaves = numbered(cut_lineage(rows), "tree", first)
    trees = rounds_up(cut_lineage(leaves), bits)
    subroots = trees[-1].select(F.col("tree").alias("member"), "h", F.lit("").alias("tree"))
    tops = rounds_up(cut_lineage(numbered(subroots, "tree", [F.asc_nulls_first("member")])), bits)
    none = F.lit(b"")
    start = tops[-1].select("tree", "pos", none.alias("path"), F.col("h").alias("subroot"), F.col("h").alias("root"))

    def subroot_paths(row: dict, path: Path, message: dict) -> dict:
        return {"tree": row["member"], "pos": 0, "path": packed(path), "subroot": row["h"], "root": message["root"]}

    kept = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])
    above = cut_lineage(rounds_down(tops, start, subroot_paths, kept, "tree string, pos long, path binary, subroot binary, root binary", bits))

    def row_of(row: dict, path: Path, message: dict) -> dict:
        root = message["root"].hex()
        end = folded((row["now"] or row["h"]).hex().encode(), path).decode()
        return {
            "id": row["id"], "leaf": row["h"].hex(), "subroot": message["subroot"].hex(), "root": root,
            "proof_sha256": digest(*[sibling for _, sibling in steps(path)]).decode(), "folded_root": end, "verified": end == root,
        }

    kind = docs.schema[ident].dataType.simpleString()
    text = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = pa.schema([("id", id_type), *[(c, pa.string()) for c in text], ("verified", pa.bool_())])
    out = rounds_down(trees, above, row_of, schema, f"id {kind}, " + ", ".join(f"{c} string" for c in text) + ", verified boolean", bits)
    return out.withColumnRenamed("id", ident)


# The same in SQL: levels by a recursive query, the checksum by its definition (fixed polynomial 0xEDB88320, reflected).
ORACLE_SQL = r"""
WITH RECURSIVE
sums AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS inverted
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
framed AS (SELECT d.doc_id, d.lang, coalesce(xor(s.inverted, 4294967295) % 7 = 0, FALSE) AND n_chars IS NOT NULL AS tampered,
    coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || CAST(d.doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    CAST(n_chars AS VARCHAR) AS n, CAST(n_chars + 1 AS VARCHAR) AS more, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id),
hashed AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n) || ':' || n, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || strlen(more) || ':' || more || tail) END AS changed FROM framed),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
trees(lvl, lang, pos, h) AS (
  SELECT 0::BIGINT, lang, pos, leaf FROM leaves
  UNION ALL SELECT lvl + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM trees) WHERE n > 1 GROUP BY lvl, lang, pos // 2),
tops AS (SELECT lang, max(lvl) AS height, max_by(h, lvl) AS subroot FROM trees GROUP BY lang),
ordered AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tops),
crown(lvl, pos, h) AS (
  SELECT 0::BIGINT, pos, subroot FROM ordered
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM crown) WHERE n > 1 GROUP BY lvl, pos // 2),
summit AS (SELECT max(lvl) AS height, max_by(h, lvl) AS root FROM crown),
own AS (SELECT row_number() OVER () AS r, l.doc_id, l.lang, l.pos, l.leaf, coalesce(l.changed, l.leaf) AS begin_at, o.height, o.subroot, o.pos AS top_pos, s.height AS top_height, s.root
  FROM leaves l JOIN ordered o ON l.lang IS NOT DISTINCT FROM o.lang CROSS JOIN summit s),
climbs AS (SELECT r, lang, k AS lvl, pos // CAST(2 ** k AS BIGINT) AS at FROM own, unnest(range(height)) AS t(k)),
top_climbs AS (SELECT r, k AS lvl, top_pos // CAST(2 ** k AS BIGINT) AS at FROM own, unnest(range(top_height)) AS t(k)),
steps AS (
  SELECT c.r, c.lvl, c.at % 2 = 1 AS is_right, coalesce(t.h, '') AS h FROM climbs c LEFT JOIN trees t ON t.lvl = c.lvl AND t.lang IS NOT DISTINCT FROM c.lang AND t.pos = xor(c.at, 1)
  UNION ALL SELECT c.r, 1000 + c.lvl, c.at % 2 = 1, coalesce(t.h, '') FROM top_climbs c LEFT JOIN crown t ON t.lvl = c.lvl AND t.pos = xor(c.at, 1)),
paths AS (SELECT r, list({'is_right': is_right, 'h': h} ORDER BY lvl) AS path FROM steps GROUP BY r),
done AS (SELECT o.*, sha256(coalesce(list_aggregate(list_transform(path, lambda s: s.h), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(list_prepend({'is_right': FALSE, 'h': begin_at}, coalesce(path, [])), lambda a, b: {'is_right': FALSE, 'h': sha256(CASE WHEN b.is_right THEN b.h || a.h ELSE a.h || b.h END)}).h AS folded_root
  FROM own o LEFT JOIN paths p USING (r))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
