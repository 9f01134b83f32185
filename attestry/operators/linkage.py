"""Record linkage without cross joins.

* containment: an anchor n-gram of the key must occur in the text, so it is an equi join on grams;
* similarity: two keys within the threshold share one of their rarest bigrams (prefix filter),
  which is exact for the thresholds allowed here;
* cosine: two vectors within the threshold share a feature of their heavy prefix, also exact;
* weighted linkage: the master rows of one number or name lie in one row; in hot groups only the first k per combination of equal fields can matter.

Keys are made distinct before any pairing, so a repeated key costs one row however often it occurs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions.similarity import METRICS, ladder, match_grade
from attestry.operators import rank, vectors
from attestry.operators.vectors import Vectors
from attestry.session import cut_lineage


def grams(text: Column, n: int) -> Column:
    """Overlapping n-grams in one linear pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


IN_ROW_KEYS = 500  # up to here a text is searched for every key inside its row


def contains_join(texts: DataFrame, text_id: str, text: str, keys: DataFrame, key: str, q: int = 4, shortest: int = 3) -> DataFrame:
    """All distinct pairs (text id, key) where the key occurs in a text of that id; keys below ``shortest``
    characters are ignored. Both ways below give the same pairs.

    The keys are counted first. Few keys are searched inside each text row, so no text moves. Many
    keys, as far as they fit into the longest text, are found by their rarest q-gram: an equi join of the
    texts' grams with the keys, then the exact test."""
    words = keys.select(F.col(key).alias("_key")).filter(F.length("_key") >= shortest).distinct()
    few = [r[0] for r in words.limit(IN_ROW_KEYS + 1).collect()]
    if len(few) <= IN_ROW_KEYS:
        known = F.array(*[F.lit(k) for k in sorted(few)]).cast("array<string>")
        found = F.filter(known, lambda k: F.contains(F.col(text), k))
        return texts.select(text_id, F.explode(found).alias(key)).distinct()
    # no text holds a key longer than itself; without these, long keys are not cut into grams at all
    longest = texts.agg(F.max(F.length(text))).scalar()
    words = cut_lineage(words.filter(F.length("_key") <= longest))
    return gram_containment(texts, text_id, text, words, key, q, shortest)


def gram_candidates(texts: DataFrame, text_id: str, text: str, words: DataFrame, q: int = 4, shortest: int = 3) -> DataFrame:
    """(text id, _key) where the text may hold the key (column ``_key``): it holds one gram of it, the one that fewest texts hold.

    A key with a gram that no text holds is in none, so it goes on no further. Grams travel as hashes, so an exact test has to follow."""
    short = sorted(r[0] for r in words.select(F.length("_key").alias("n")).filter(f"n >= {shortest} and n < {q}").distinct().collect())
    of_text = F.flatten(F.array(*[grams(F.col(text), n) for n in [*short, q]]))
    pieces = texts.select(text_id, F.explode(F.array_distinct(F.transform(of_text, lambda g: F.xxhash64(g)))).alias("_g"))
    own = F.when(F.length("_key") < q, F.array("_key")).otherwise(grams(F.col("_key"), q))
    own = words.select("_key", F.explode(F.array_distinct(F.transform(own, lambda g: F.xxhash64(g)))).alias("_g"))
    held = pieces.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = own.join(held, "_g", "left").groupBy("_key").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("b"))
    anchored = cut_lineage(rarest.filter("b.n > 0").select("_key", F.col("b._g").alias("_g")))
    return pieces.join(anchored, "_g").select(text_id, "_key")


def gram_containment(texts: DataFrame, text_id: str, text: str, words: DataFrame, key: str, q: int = 4, shortest: int = 3) -> DataFrame:
    """Containment for any number of keys (column ``_key``): the candidates by grams, then the exact test."""
    candidates = gram_candidates(texts, text_id, text, words, q, shortest)
    checked = candidates.join(texts.select(F.col(text_id), F.col(text).alias("_t")), text_id)
    return checked.filter(F.contains(F.col("_t"), F.col("_key"))).select(text_id, F.col("_key").alias(key)).distinct()


def _prefix(keys: DataFrame, counts: DataFrame, overlap: Column) -> DataFrame:
    """The rarest grams of each key, as many as a partner within the threshold must hit."""
    sorted_grams = keys.join(counts, "_g").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_df", "_g"))).alias("_a"))
    need = F.greatest(F.lit(1), F.ceil(overlap)).cast("int")
    size = F.greatest(F.lit(1), F.size("_a") - need + 1)
    return sorted_grams.select("_k", F.explode(F.transform(F.slice("_a", F.lit(1), size), lambda s: s["_g"])).alias("_g"))


def fuzzy_pairs(left: DataFrame, lkey: str, right: DataFrame, rkey: str, threshold: float = 0.82, metric: str = "levenshtein") -> DataFrame:
    """All pairs of distinct keys with similarity >= ``threshold``: (left_key, right_key, score).
    The bound on shared bigrams is exact from 0.70 on (levenshtein) or above 0.80 (gestalt; at 0.80
    'ab' and 'acb' share none), and lower thresholds are refused.

    Bounds: with ratio 1 - d / max, keys of length n share at least (2t - 1) n - 1 bigrams with any
    partner; with the gestalt ratio at least (3t - 2) s - 1, s being the mean length."""
    if threshold < 0.70 or (metric != "levenshtein" and threshold <= 0.80):
        raise ValueError("the gram bound does not hold for so low a threshold")

    def tagged(df: DataFrame, col: str) -> DataFrame:
        keys = df.select(F.col(col).alias("_k")).filter(F.length("_k") >= 2).distinct()
        arr = keys.withColumn("_a", grams(F.col("_k"), 2))
        marked = F.transform(
            "_a", lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice("_a", F.lit(1), i), lambda x: x == g)).cast("string"))
        )
        return arr.select("_k", F.explode(marked).alias("_g"))

    a, b = tagged(left, lkey), tagged(right, rkey)
    counts = a.unionByName(b).groupBy("_g").agg(F.count("*").alias("_df"))
    n = F.length("_k")
    if metric == "levenshtein":
        overlap = (2 * threshold - 1) * n - 1
    else:
        overlap = (3 * threshold - 2) * n * (1 + threshold / (2 - threshold)) / 2 - 1
    pa = _prefix(a, counts, overlap).withColumnRenamed("_k", "_l")
    pb = _prefix(b, counts, overlap).withColumnRenamed("_k", "_r")
    pairs = pa.join(pb, "_g").select("_l", "_r").distinct()
    small, large = F.least(F.length("_l"), F.length("_r")), F.greatest(F.length("_l"), F.length("_r"))
    limit = small / large >= threshold if metric == "levenshtein" else 2 * small / (small + large) >= threshold
    scored = pairs.filter(limit).withColumn("score", METRICS[metric](F.col("_l"), F.col("_r")))
    # equal keys too short for bigrams
    same = left.select(F.col(lkey).alias("_l")).filter(F.length("_l") == 1).distinct().join(
        right.select(F.col(rkey).alias("_r")).distinct(), F.col("_l") == F.col("_r")
    ).withColumn("score", F.lit(1.0))
    return scored.filter(F.col("score") >= threshold).unionByName(same).select(F.col("_l").alias("left_key"), F.col("_r").alias("right_key"), "score")


def best_fuzzy(pairs: DataFrame) -> DataFrame:
    """Best partner per left key; the smallest key on ties."""
    best = pairs.groupBy("left_key").agg(F.min(F.struct((-F.col("score")).alias("neg"), "right_key")).alias("b"))
    return best.select("left_key", F.col("b.right_key").alias("right_key"), (-F.col("b.neg")).alias("score"))


def resolve_receivers(suppliers: DataFrame, overrides: DataFrame, candidates: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Receiver of a supplier: confirmed override 1.0, own column .95, equal key .90, most similar key,
    else missing. Only keys without an earlier answer enter the similarity join."""
    ov = rank.best_per_key(overrides.select("supplier_key", "final_to"), ["supplier_key"], [F.col("final_to")], largest=False)
    ca = rank.best_per_key(candidates.select("supplier_key", "emails"), ["supplier_key"], [F.col("emails")], largest=False)
    first = suppliers.join(ov, "supplier_key", "left").join(ca.withColumnRenamed("emails", "_exact"), "supplier_key", "left")
    open_keys = first.filter(F.col("final_to").isNull() & F.col("own_email").isNull() & F.col("_exact").isNull())
    near = best_fuzzy(fuzzy_pairs(open_keys, "supplier_key", ca, "supplier_key", threshold)).join(
        ca.withColumnRenamed("supplier_key", "right_key"), "right_key"
    ).select(F.col("left_key").alias("supplier_key"), F.col("emails").alias("_fuzzy"), "score")
    out = first.join(near, "supplier_key", "left")
    answer = F.coalesce(
        F.when(F.col("final_to").isNotNull(), F.struct(F.col("final_to").alias("to"), F.lit("override").alias("source"), F.lit(1.0).alias("score"))),
        F.when(F.col("own_email").isNotNull(), F.struct(F.col("own_email").alias("to"), F.lit("own_column").alias("source"), F.lit(0.95).alias("score"))),
        F.when(F.col("_exact").isNotNull(), F.struct(F.col("_exact").alias("to"), F.lit("equal_key").alias("source"), F.lit(0.90).alias("score"))),
        F.when(F.col("_fuzzy").isNotNull(), F.struct(F.col("_fuzzy").alias("to"), F.lit("similar_key").alias("source"), F.round("score", 3).alias("score"))),
        F.struct(F.lit("").alias("to"), F.lit("missing").alias("source"), F.lit(0.0).alias("score")),
    )
    return out.select(*suppliers.columns, answer.alias("_r")).select(*suppliers.columns, "_r.to", "_r.source", "_r.score")


GROUP_ROWS = 128  # up to here the master rows of one number or name lie in one row


def top_matches(
    items: DataFrame, item_id: str, master: DataFrame, order: Sequence[str], weights: Mapping[str, int], anchors: Sequence[str], k: int = 5
) -> DataFrame:
    """The k best master rows per item by the sum of the weights of equal fields; ties by ``order``, which names a master row.

    A match must share an anchor field (number or name). Master rows with the same anchor are packed into one row, an item meets its
    pack and takes the k best in its own row. Anchors of more than ``GROUP_ROWS`` master rows are not packed but go by
    :func:`_hot_matches`, so no key ever pairs a hot group with a hot group. Both ways are exact."""
    names = list(weights)
    master = cut_lineage(master.select(*order, *names))
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(n).alias(f"f{i}") for i, n in enumerate(names)])
    found = []
    for anchor in anchors:
        known = master.filter(F.col(anchor).isNotNull())
        hot = cut_lineage(known.groupBy(anchor).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > GROUP_ROWS).select(anchor))
        packs = known.join(hot, anchor, "left_anti").groupBy(F.col(anchor).alias("_anchor")).agg(F.collect_list(packed).alias("_m"))

        def scored(m: Column) -> Column:
            equal = [F.coalesce(F.col(n) == m[f"f{i}"], F.lit(False)) for i, n in enumerate(names)]
            score = sum((F.when(e, F.lit(w)).otherwise(F.lit(0)) for e, w in zip(equal, weights.values(), strict=True)), F.lit(0))
            return F.struct((-score).alias("_neg"), *[m[f"o{i}"].alias(c) for i, c in enumerate(order)], *[e.alias(f"same_{n}") for e, n in zip(equal, names, strict=True)])

        met = items.select(item_id, *names).join(packs, F.col(anchor) == F.col("_anchor"))
        best = met.select(item_id, F.inline(F.slice(F.array_sort(F.transform("_m", scored)), 1, k)))
        found.append(best.select(item_id, *order, (-F.col("_neg")).alias("score"), *[f"same_{n}" for n in names]))
        if not hot.isEmpty():
            some = items.select(item_id, *names).join(hot, anchor, "left_semi")
            found.append(_hot_matches(some, item_id, known.join(hot, anchor, "left_semi"), order, weights, anchor, k))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return rank.top_per_group(out.distinct(), [item_id], [F.desc("score"), *[F.asc(c) for c in order]], k, "rank_no")


def _hot_matches(items: DataFrame, item_id: str, master: DataFrame, order: Sequence[str], weights: Mapping[str, int], anchor: str, k: int) -> DataFrame:
    """Candidates that hold the k best master rows per item among those with the item's ``anchor``.

    For a set S of equal fields only the first k master rows with the item's values in S can reach the top k: whatever equals in S
    scores at least as much and comes earlier. So both sides are keyed by every set with the anchor, and each key keeps k master
    rows before the join."""
    names = list(weights)
    masks = [m for m in range(1, 1 << len(names)) if m >> names.index(anchor) & 1]

    def keyed(df: DataFrame, keep: Sequence[str], side: str) -> DataFrame:
        mask = F.col("_mask")
        fields = [F.col(n).alias(f"_{side}_{n}") for n in names]
        blank = sum((F.when(F.col(n).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(names)), F.lit(0))
        sets = df.select(*keep, *fields, blank.alias("_blank"), F.explode(F.array(*[F.lit(m) for m in masks])).alias("_mask"))
        parts = [F.when(mask.bitwiseAND(1 << i) != 0, F.col(f"_{side}_{n}")) for i, n in enumerate(names)]
        full = sets.filter(mask.bitwiseAND(F.col("_blank")) == 0)
        return full.select(*keep, *[f"_{side}_{n}" for n in names], F.xxhash64(mask, *parts).alias("_key"))

    first = rank.top_per_group(keyed(master, order, "m"), ["_key"], [F.asc(c) for c in order], k, "_n").drop("_n")
    # the fields travel with the keys, so neither side is read again
    full = keyed(items, [item_id], "i").join(first, "_key").drop("_key").distinct()
    equal = {n: F.coalesce(F.col(f"_i_{n}") == F.col(f"_m_{n}"), F.lit(False)) for n in names}
    score = sum((F.when(equal[n], F.lit(w)).otherwise(F.lit(0)) for n, w in weights.items()), F.lit(0))
    scored = full.select(item_id, *order, score.alias("score"), *[equal[n].alias(f"same_{n}") for n in names])
    return scored.filter(f"same_{anchor}")  # a hash may collide, a match may not


def grade_pairs(pairs: DataFrame, weights: Mapping[str, int], maker: str, products: Sequence[str]) -> DataFrame:
    """Score and level of item-to-master pairs: columns q_<field> against <field>, both as keys.

    Equal fields count in full, contained ones at 65 per cent. STRONG and REVIEW need both the maker
    and a product field."""
    grade = {f: match_grade(F.col(f"q_{f}"), F.col(f)) for f in weights}
    out = pairs.select("*", *[g.alias(f"grade_{f}") for f, g in grade.items()])
    score = sum(
        (F.when(F.col(f"grade_{f}") >= 100, F.lit(w)).when(F.col(f"grade_{f}") >= 75, F.lit(w * 65 // 100)).otherwise(F.lit(0)) for f, w in weights.items()), F.lit(0)
    )
    product = F.greatest(*[F.col(f"grade_{p}") for p in products], F.lit(0))
    level = (
        F.when((F.col(f"grade_{maker}") >= 90) & (product >= 90), F.lit("STRONG"))
        .when((F.col(f"grade_{maker}") >= 75) & (product >= 75), F.lit("REVIEW")).otherwise(F.lit("WEAK"))
    )
    return out.withColumn("score", score.cast("bigint")).withColumn("level", level)


def link_status(matches: DataFrame, item_id: str, gap: int = 25) -> DataFrame:
    """Level of the best match and whether it may be linked without review."""
    first = F.col("rank_no") == 1
    top = matches.groupBy(item_id).agg(
        F.max(F.when(first, F.col("score"))).alias("top_score"), F.max(F.when(F.col("rank_no") == 2, F.col("score"))).alias("second_score"),
        F.bool_or(first & F.col("strong")).alias("strong"), F.count("*").alias("candidates"),
    )
    unclear = F.coalesce(F.col("top_score") - F.col("second_score") < gap, F.lit(False))
    return top.withColumn("ambiguous", unclear).withColumn(
        "link_status", F.when(F.col("strong") & ~unclear, F.lit("AUTO_READY")).otherwise(F.lit("REVIEW_REQUIRED"))
    )


MAX_CLASSES = 2000  # issuers known to the template store; checked, not assumed


PACK, SLOTS = 1 << 15, 16  # references that a task holds at a time, and shares of the targets that meet them


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (class, pack, slot): references first, then the targets that meet them. The three best likenesses of each target."""
    current, refs, ids, sigs = None, [], np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        cls, pack, slot, target = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cls", "_pack", "_slot", "_target"))
        ident, known = batch.column("_id").to_numpy(zero_copy_only=False), batch.column("sig").is_valid().to_numpy(zero_copy_only=False)
        sig = batch.column("sig").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        cut = np.flatnonzero((cls[1:] != cls[:-1]) | (pack[1:] != pack[:-1]) | (slot[1:] != slot[:-1]) | (target[1:] != target[:-1])) + 1
        rows, best = [], []
        for low, high in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            if low == high:
                continue
            key = (cls[low], pack[low], slot[low])
            if key != current:
                current, refs, ids, sigs = key, [], np.zeros(0, np.int64), np.zeros(0, np.uint64)
            if not target[low]:
                own = low + np.flatnonzero(known[low:high])
                refs.append((ident[own], sig[own]))
                continue
            if refs:
                ids, sigs = (np.concatenate(x) for x in zip((ids, sigs), *refs, strict=True))
                order = np.argsort(ids, kind="stable")
                ids, sigs, refs = ids[order], sigs[order], []
            for at in range(low, high, 64):
                to = min(at + 64, high)
                far = np.bitwise_count(sig[at:to, None] ^ sigs[None, :])
                first, last = np.searchsorted(ids, ident[at:to]), np.searchsorted(ids, ident[at:to], "right")
                for i in np.flatnonzero(last > first):
                    far[i, first[i] : last[i]] = 255  # no target is its own reference
                three = np.full((to - at, 3), 255, np.uint8)
                here = np.arange(to - at)
                for k in range(min(3, len(sigs))):
                    place = far.argmin(axis=1)
                    three[:, k] = far[here, place]
                    far[here, place] = 255
                rows.append(np.arange(at, to))
                best += [[1 - d / 64 for d in t if d != 255] if ok else [None] for t, ok in zip(three.tolist(), known[at:to].tolist(), strict=True)]
        if rows:
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(at), batch.column("_cls").take(at), pa.array(best, pa.list_(pa.float64()))], names=["_id", "_cls", "_best"])


def class_scores(targets: DataFrame, refs: DataFrame, ident: str, cls: str) -> DataFrame:
    """Score of each target against each class: .7 best + .3 mean of the three best references, by the share of equal bits of the
    64-bit signatures ``sig``. Idents and classes are whole numbers.

    Every target meets every reference, so the work is quadratic, in blocks of bits: references lie in packs of at most about ``PACK`` of
    one class, targets in ``SLOTS`` shares pass each pack in a task and leave with three numbers. No pair is ever a row, and a
    task holds one pack. The target itself is never its own reference."""
    refs, targets = refs.filter(F.col(ident).isNotNull()), targets.filter(F.col(ident).isNotNull())  # nothing is known to differ from null
    sizes = [(r[0], max(1, -(-r[1] // PACK))) for r in refs.filter(F.col(cls).isNotNull()).groupBy(cls).count().limit(MAX_CLASSES + 1).collect()]
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if not sizes:
        return targets.select(ident, F.lit(None).cast(refs.schema[cls].dataType).alias(cls), F.lit(0.0).alias("score")).limit(0)
    packs = F.create_map(*[F.lit(x) for pair in sizes for x in pair])
    key = F.col(cls).cast("bigint").alias("_cls")
    held = refs.filter(F.col(cls).isNotNull()).select(key, F.pmod(F.xxhash64(ident), packs[F.col(cls)]).cast("int").alias("_pack"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("_slot"), F.lit(False).alias("_target"), F.col(ident).cast("bigint").alias("_id"), "sig")
    route = F.array(*[F.struct(F.lit(c).cast("bigint").alias("_cls"), F.lit(n).alias("_pack")) for c, many in sizes for n in range(many)])
    asked = targets.select(F.inline(route), F.pmod(F.xxhash64(ident, F.lit(1)), F.lit(SLOTS)).cast("int").alias("_slot"), F.lit(True).alias("_target"), F.col(ident).cast("bigint").alias("_id"), "sig")
    by = ["_cls", "_pack", "_slot"]
    partitions = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = held.unionByName(asked.select(*held.columns)).repartition(partitions, *by).sortWithinPartitions(*by, "_target")
    found = met.mapInArrow(_nearest, "_id long, _cls long, _best array<double>").filter(F.size("_best") > 0)
    three = found.groupBy("_id", "_cls").agg(F.slice(F.sort_array(F.flatten(F.collect_list("_best")), asc=False), 1, 3).alias("_b"))
    mean = F.aggregate("_b", F.lit(0.0), lambda x, y: x + y) / F.size("_b")
    kinds = {c: refs.schema[c].dataType for c in (ident, cls)}
    return three.select(F.col("_id").cast(kinds[ident]).alias(ident), F.col("_cls").cast(kinds[cls]).alias(cls), (0.7 * F.col("_b")[0] + 0.3 * mean).alias("score"))


def near_duplicates(features: DataFrame, cls: str, ident: str, feature: str, weight: str, threshold: float = 0.97) -> DataFrame:
    """All pairs of one class with cosine >= ``threshold`` over non-negative weights: (a, b, cosine).

    Collapse exact copies before calling this. The result is quadratic in a cluster; for its components use :func:`duplicate_components`."""
    return near_pairs(vectors.of_rows(features, cls, ident, feature, weight, threshold))


def near_pairs(known: Vectors) -> DataFrame:
    """(a, b, cosine) of all pairs within the threshold of the vectors.

    A close pair must share a heavy feature, so the join on heavy features is complete. At the first feature two vectors share, all they
    have in common lies behind: the product of the remaining lengths bounds their cosine."""
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.n") < F.col("y.n"))
    pairs = known.heavy.alias("x").join(known.heavy.alias("y"), same & (F.col("x.rest") * F.col("y.rest") >= known.threshold * (1 - 1e-9)))
    pairs = cut_lineage(pairs.select(F.col("x.n").alias("a"), F.col("y.n").alias("b")).distinct())
    return vectors.cosines(pairs, known).filter(F.col("cosine") >= known.threshold)


def _labelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (n, root) after links between nodes have joined their components."""
    over = links.join(labels.select(F.col("n").alias("a"), F.col("root").alias("ra")), "a").join(labels.select(F.col("n").alias("b"), F.col("root").alias("rb")), "b")
    merged = components(over.select("ra", "rb"), "ra", "rb").select(F.col("n").alias("root"), F.col("root").alias("_to"))
    return cut_lineage(labels.join(merged, "root", "left").select("n", F.coalesce("_to", "root").alias("root")))


def duplicate_components(features: DataFrame, cls: str, ident: str, feature: str, weight: str, threshold: float = 0.97, rounds: int = 2) -> DataFrame:
    """(n, root): the components of all pairs that :func:`near_duplicates` would give, for every ident."""
    return near_components(vectors.of_rows(features, cls, ident, feature, weight, threshold), rounds)


def near_components(known: Vectors, rounds: int = 2) -> DataFrame:
    """(n, root): the components of all pairs that :func:`near_pairs` would give, for every vector, without making the pairs.

    In each bucket of a heavy feature the members are compared with one leader only; near copies of one text thereby become one
    component through a row per member. After ``rounds`` of other leaders, what is left to compare are members of different components
    that share a bucket: a member meets a component's longest rest first, and its members only where that can suffice."""
    bound, heavy = known.threshold * (1 - 1e-9), known.heavy
    labels = cut_lineage(known.names.withColumn("root", F.col("n")))
    for turn in range(rounds):
        at = heavy.join(labels, "n")
        leader = at.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "n").alias("h"), F.col("n").alias("b"), F.col("root").alias("rb"), F.col("rest").alias("sb"))).alias("l"))
        pairs = at.join(leader, "key").filter((F.col("root") != F.col("l.rb")) & (F.col("rest") * F.col("l.sb") >= bound)).select(F.col("n").alias("a"), F.col("l.b").alias("b")).distinct()
        labels = _labelled(labels, cut_lineage(vectors.cosines(cut_lineage(pairs), known).filter(F.col("cosine") >= known.threshold)))
    at = heavy.join(labels, "n")
    mixed = at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    open_ = cut_lineage(at.join(mixed, "key", "left_semi"))
    groups = open_.groupBy("key", "root").agg(F.max("rest").alias("most")).withColumnRenamed("root", "other")
    asked = open_.join(groups, "key").filter((F.col("other") < F.col("root")) & (F.col("rest") * F.col("most") >= bound)).select("key", F.col("n").alias("a"), F.col("rest").alias("sa"), "other")
    members = open_.select("key", F.col("root").alias("other"), F.col("n").alias("b"), F.col("rest").alias("sb"))
    pairs = asked.join(members, ["key", "other"]).filter(F.col("sa") * F.col("sb") >= bound).select("a", "b").distinct()
    return _labelled(labels, cut_lineage(vectors.cosines(cut_lineage(pairs), known).filter(F.col("cosine") >= known.threshold)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: every node of an edge with the smallest node id of its component, as (n, root).

    Edges are rewired in two steps per round: every node's larger neighbours are tied to its smallest one, then every node is
    tied to the smallest of its smaller neighbours, which also ties those together. Chains halve, and no node keeps a long
    list. Each round is a table in the shared folder; a count and a checksum reach the driver, which end the rounds when nothing moves."""
    links = cut_lineage(edges.select(F.col(a).alias("n"), F.col(b).alias("m")).filter("n <> m").distinct())
    before = None
    while True:
        both = links.unionAll(links.select("m", "n"))
        least = both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("to"))
        large = both.filter("m > n").join(least, "n").select(F.col("m").alias("n"), F.col("to").alias("m")).filter("n <> m")
        down = large.select(F.greatest("n", "m").alias("n"), F.least("n", "m").alias("m"))
        lowest = down.groupBy("n").agg(F.min("m").alias("to"))
        tied = down.join(lowest, "n").filter("m <> to").select(F.col("m").alias("n"), F.col("to").alias("m"))
        links = cut_lineage(tied.unionAll(lowest.select("n", F.col("to").alias("m"))).distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("n", "m").cast("decimal(38,0)"))).head())
        if now == before:
            break
        before = now
    roots = links.select("m").distinct().select(F.col("m").alias("n"), F.col("m").alias("root"))
    return links.select("n", F.col("m").alias("root")).unionAll(roots)


def deepest_folder(rows: DataFrame, number: str, folders: DataFrame) -> DataFrame:
    """Deepest folder along 102 -> 102_2 -> 102_2_1 while the chain is unbroken.

    ``folders`` has (prefix, folder); a number has as many prefixes as levels."""
    parts = F.split(F.col(number), "_")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("level"), F.array_join(F.slice(parts, F.lit(1), k), "_").alias("prefix")))
    spread = rows.select(number, F.inline(steps))
    single = rank.best_per_key(folders.select("prefix", "folder"), ["prefix"], [F.col("folder")], largest=False)
    found = spread.join(single, "prefix", "left").groupBy(number).agg(
        F.min(F.when(F.col("folder").isNull(), F.col("level"))).alias("_gap"), F.map_from_entries(F.collect_list(F.struct("level", F.coalesce("folder", F.lit(""))))).alias("_f"), F.max("level").alias("_deep")
    )
    level = F.coalesce(F.col("_gap") - 1, F.col("_deep"))
    return found.select(number, level.alias("level"), F.coalesce(F.try_element_at("_f", level), F.lit("")).alias("folder"))


def link_products(master: DataFrame, products: DataFrame, doc: str, mid: str, mname: str, line: str, name: str, threshold: float = 0.70) -> DataFrame:
    """Best product line per master row of the same document, by the contained-or-similar ladder.

    Names are compared once per distinct pair over all documents, and only pairs that can reach
    ``threshold`` are made. Of equal names in one document two lines are enough for best and margin."""
    near = fuzzy_pairs(master, mname, products, name, threshold).select(F.col("left_key").alias("_m"), F.col("right_key").alias("_n"))
    mids = master.select(F.col(mname).alias("_m")).distinct()
    names = products.select(F.col(name).alias("_n")).distinct()
    inside = contains_join(mids, "_m", "_m", names, "_n", q=3, shortest=1)
    around = contains_join(names, "_n", "_n", mids, "_m", q=3, shortest=1)
    pairs = near.unionByName(inside.select("_m", "_n")).unionByName(around.select("_m", "_n")).distinct()
    pairs = pairs.withColumn("score", F.round(ladder(F.col("_m"), F.col("_n"), base=0.86, span=0.14), 6)).filter(F.col("score") >= threshold)
    two = rank.top_per_group(products.select(doc, F.col(line), F.col(name).alias("_n")), [doc, "_n"], [F.asc(line)], 2, "_k")
    met = master.select(doc, mid, F.col(mname).alias("_m")).join(pairs, "_m").join(two, [doc, "_n"])
    best = rank.top_two(met, [doc, mid], "score", line)
    return master.select(doc, mid).join(best, [doc, mid], "left")

