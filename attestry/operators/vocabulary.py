"""Rule vocabularies held in tables.

Aliases, markers, anchors, patterns and repairs are DataFrames of any size, never rows of Python. Literal terms are found
by an index: every term is entered under its rarest gram of eight characters (of three, if it is shorter), a text is cut into short
parts with a halo, its grams meet the terms' grams in one equi join per size, and a candidate is compared with the text at its offset. Grams are
hashed a batch of parts at a time, and a bit per gram of the table is looked up first, so a row is made only where a gram of a term may stand, and holds as
much text as the longest term needs. The term table is written first, and sent to every executor while it has few rows; a part is at most ``PART`` + 2 * ``longest`` characters, so one
huge document is as many rows as it needs.

Terms and texts are compared in upper case with white space squashed to single blanks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import dates as D
from attestry.functions import text as X
from attestry.operators import extract as EX
from attestry.operators import rank
from attestry.session import cut_lineage

GRAM, LONG_GRAM = 3, 8
PART = 256
ROWS = 1024  # parts whose grams are held at a time
SENT = 50_000  # terms of an index that is sent to every executor: some 10 MB
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
EVERY_ISSUER = ("", "ALL", "ANY", "*")
UNKNOWN = "UNKNOWN"


def folded(c: Column) -> Column:
    return F.upper(X.squash(c))


def _parts(docs: DataFrame, ident: str, text: str, halo: int) -> DataFrame:
    """(id, part, body, lead, core): the folded text in parts of ``core`` characters, with up to ``halo`` more on both sides."""
    cut = docs.select(F.col(ident).alias("_id"), F.regexp_extract_all(folded(F.col(text)), F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("_cut"))
    whole = F.transform(
        "_cut",
        lambda p, i: F.struct(
            F.coalesce(F.right(F.get("_cut", i - 1), F.lit(halo)), F.lit("")).alias("before"), p.alias("core"),
            F.coalesce(F.left(F.get("_cut", i + 1), F.lit(halo)), F.lit("")).alias("behind"), i.alias("part"),
        ),
    )
    rows = cut.select("_id", F.explode(whole).alias("p"))
    return rows.select(
        "_id", F.col("p.part").alias("_part"), F.concat("p.before", "p.core", "p.behind").alias("_body"), F.length("p.before").alias("_lead"), F.length("p.core").alias("_core")
    )


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each gram of ``size`` code points, by the place where it begins."""
    n = max(0, len(codes) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * MULTIPLIER + codes[k : k + n]
    h = (h ^ (h >> np.uint64(31))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text begins."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])


def _own(batch: pa.RecordBatch, size: int, keep: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(bodies, part, place in its body, hash) of the grams that begin in the parts' cores and that ``keep`` finds among all hashes, ``ROWS`` parts at a time."""
    for at in range(0, batch.num_rows, ROWS):
        some = batch.slice(at, ROWS)
        bodies = some.column("_body").to_pylist()
        codes, starts = _codes(bodies)
        h = _hashes(codes, size)
        found = keep(h)
        part = np.searchsorted(starts, found, "right") - 1
        place = found - starts[part]
        lead, core = (some.column(c).to_numpy() for c in ("_lead", "_core"))
        own = (place >= lead[part]) & (place < lead[part] + core[part]) & (found + size <= starts[part + 1])
        yield bodies, part[own] + at, place[own], h[found[own]].view(np.int64)


def _bits(index: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """A bit per hash of a gram of the index, as whole numbers, and how many of them: 16 bits a row, 2 MB at most."""
    words = 1 << max(4, min(18, (rows // 4).bit_length()))
    word, bit = F.pmod(F.shiftright("gram", 6), F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("gram").bitwiseAND(63).cast("int"))
    full = index.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(words, np.int64)
    bits[full.column("w").to_numpy()] = full.column("b").to_numpy()
    return bits.view(np.uint64), words


def _likely(parts: DataFrame, size: int, bits: np.ndarray, words: int, before: int, behind: int) -> DataFrame:
    """A row per gram that begins in a part's core and whose bit is set, with its hash and no more text than a term around it can need.

    Other grams are not in the index; a bit may be set for two, so the join still decides."""
    low, six, last = np.uint64(words - 1), np.uint64(6), np.uint64(63)

    def known(h: np.ndarray) -> np.ndarray:
        return np.flatnonzero(bits[(h >> six) & low] >> (h & last) & np.uint64(1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for bodies, part, place, h in _own(batch, size, known):
                begin = np.maximum(place - before, 0)
                near = [bodies[i - first][b:e] for i, b, e in zip(part.tolist(), begin.tolist(), (place + behind).tolist(), strict=True)]
                at = pa.array(part)
                own = pa.array((place - batch.column("_lead").take(at).to_numpy() + 1).astype(np.int32))
                fields = [batch.column("_id").take(at), batch.column("_part").take(at), own, pa.array(h), pa.array((place - begin + 1).astype(np.int32)), pa.array(near, pa.string())]
                yield pa.RecordBatch.from_arrays(fields, names=["_id", "_part", "_at", "_gram", "_here", "_near"])
                first += ROWS

    return parts.mapInArrow(rows, f"_id {parts.schema['_id'].dataType.simpleString()}, _part int, _at int, _gram long, _here int, _near string")


def anchored(docs: DataFrame, terms: DataFrame, text: str, gram: int, longest: int, sample: float) -> DataFrame:
    """(term, size, gram, offset): the hash and the place of each term's gram that is rarest in a sample of the texts. The choice bears on cost alone."""
    if longest > PART:
        raise ValueError(f"terms reach over more than one part of {PART} characters")
    short = F.length("term") < GRAM
    long = F.length("term") > longest
    checked = terms.select(
        F.when(short | long, F.raise_error(F.concat(F.lit(f"a term has {GRAM} to {longest} characters: "), "term")).cast("string")).otherwise(F.col("term")).alias("term")
    )

    def of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("term").to_pylist()
            codes, starts = _codes(names)
            h = _hashes(codes, gram)
            row = np.searchsorted(starts, np.arange(len(h)), "right") - 1
            own = np.flatnonzero(np.arange(len(h)) + gram <= starts[row + 1])
            fields = [batch.column("term").take(pa.array(row[own])), pa.array((own - starts[row[own]]).astype(np.int32)), pa.array(h[own].view(np.int64))]
            yield pa.RecordBatch.from_arrays(fields, names=["term", "offset", "gram"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, h in _own(batch, gram, lambda h: np.arange(len(h))):
                yield pa.RecordBatch.from_arrays([*map(pa.array, np.unique(h, return_counts=True))], names=["gram", "n"])

    grams = checked.mapInArrow(of_terms, "term string, offset int, gram long")
    some = _parts(docs.sample(sample, 7).withColumn("_n", F.lit(0)), "_n", text, gram - 1).mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rare = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("gram").alias("h"), "offset", "gram")
    best = grams.join(some, "gram", "left").groupBy("term").agg(F.min(rare).alias("b"))
    return best.select("term", F.length("term").alias("size"), F.col("b.gram").alias("gram"), F.col("b.offset").alias("offset"))


def phrase_hits(docs: DataFrame, vocabulary: DataFrame, ident: str = "doc_id", text: str = "text", term: str = "term", longest: int = 100, sample: float = 0.01) -> DataFrame:
    """(id, term, position): every place of every term in every text, in folded form; positions count from 1.

    Terms have ``GRAM`` to ``longest`` characters; others raise. Null and empty texts and terms have no hits."""
    terms = vocabulary.select(folded(F.col(term)).alias("term")).filter("term <> ''").distinct()

    def found(some: DataFrame, size: int) -> DataFrame:
        # As a written table its size is known when the join is planned, and its grams can be looked for before any row is made.
        index = cut_lineage(anchored(docs, some, text, size, longest, sample))
        whole = index.agg(F.count(F.lit(1)), F.max("offset"), F.max(F.col("size") - F.col("offset")), F.max("size")).head()
        rows, before, behind, largest = (x or 0 for x in whole)
        bits, words = _bits(index, rows)
        # Spark would go by the size of the written file, and a packed file is many times as large in memory.
        index = index.hint("broadcast" if rows <= SENT else "merge")
        met = _likely(_parts(docs, ident, text, largest), size, bits, words, before, behind).join(index, F.col("_gram") == F.col("gram"))
        begin = F.col("_here") - F.col("offset")
        right = (begin >= 1) & (F.substring(F.col("_near"), begin, F.col("size")) == F.col("term"))
        position = F.col("_part") * PART + F.col("_at") - F.col("offset")
        return met.filter(right).select(F.col("_id").alias(ident), "term", position.cast("bigint").alias("position"))

    long = F.length("term") >= LONG_GRAM
    return found(terms.filter(long), LONG_GRAM).unionAll(found(terms.filter(~long), GRAM))


def _named(docs: DataFrame, rules: DataFrame, ident: str, text: str, term: str) -> DataFrame:
    """Each rule whose term the document holds, once per document."""
    seen = phrase_hits(docs, rules, ident, text, term).select(ident, "term").distinct()
    return seen.join(rules.withColumn("term", folded(F.col(term))), "term")


def reference_terms(sent: DataFrame, text: str = "text", shortest: int = 3, longest: int = 80) -> DataFrame:
    """(term): the distinct phrases between separators in sent texts, in folded form. Null and empty texts have none.

    All texts count and no term is left out, so the table grows with what was sent."""
    pieces = F.transform(F.split(F.col(text), r"[\n\r,/|;:()\[\]<>]+"), folded)
    return sent.select(F.explode(pieces).alias("term")).filter(F.length("term").between(shortest, longest)).distinct()


def held_terms(docs: DataFrame, terms: DataFrame, ident: str = "doc_id", text: str = "text", most: int = 5) -> DataFrame:
    """(id, terms): the ``most`` longest terms that the text holds, joined by ', ', equal lengths in alphabetical order.

    Texts without a term have no row. A task ranks only its own ``most`` terms of a text before the shuffle; texts with equal ids are one."""
    found = phrase_hits(docs, terms, ident, text, longest=160).select(ident, "term").distinct()
    first = rank.top_per_group(found, [ident], [F.desc(F.length("term")), F.asc("term")], most, "_n")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "term"))), lambda x: x["term"])
    return first.groupBy(ident).agg(F.array_join(listed, ", ").alias("terms"))


def issuer_by_alias(docs: DataFrame, aliases: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, issuer) by an alias table (issuer, alias, priority, needed).

    The issuer of smallest priority that shows as many aliases as it needs wins; if none does, the first that shows any; else UNKNOWN."""
    once = aliases.groupBy("issuer", folded(F.col("alias")).alias("alias")).agg(F.min("priority").alias("priority"), F.max("needed").alias("needed"))
    known = _named(docs, once, ident, text, "alias")
    per = known.groupBy(ident, "issuer").agg(F.count(F.lit(1)).alias("hits"), F.min("priority").alias("priority"), F.max("needed").alias("needed"))
    rank = F.struct((F.col("hits") < F.col("needed")).alias("weak"), "priority", "issuer")
    best = per.groupBy(ident).agg(F.min(rank)["issuer"].alias("issuer"))
    return docs.select(ident).join(best, ident, "left").select(ident, F.coalesce("issuer", F.lit(UNKNOWN)).alias("issuer"))


def issuer_by_marker(docs: DataFrame, markers: DataFrame, least: int = 40, gap: int = 25, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, issuer, score, margin) by a marker table (issuer, marker, weight).

    Below ``least`` points, or within ``gap`` of the runner-up, the issuer stays UNKNOWN; ties go by name."""
    sums = _named(docs, markers, ident, text, "marker").groupBy(ident, "issuer").agg(F.sum("weight").alias("score"))
    place = F.row_number().over(Window.partitionBy(ident).orderBy(F.desc("score"), "issuer"))
    two = sums.withColumn("place", place).filter("place <= 2").groupBy(ident)
    best = two.agg(F.max(F.when(F.col("place") == 1, F.struct("issuer", "score"))).alias("b"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0)).alias("second"))
    rows = docs.select(ident).join(best, ident, "left")
    score, second = F.coalesce("b.score", F.lit(0)), F.coalesce("second", F.lit(0))
    clear = (score >= least) & ((second == 0) | (score - second >= gap))
    return rows.select(
        ident, F.when(clear, F.col("b.issuer")).otherwise(F.lit(UNKNOWN)).alias("issuer"), score.cast("bigint").alias("score"), (score - second).cast("bigint").alias("margin")
    )


def _by_issuer(rules: DataFrame, order: str, columns: Sequence[str], name: str) -> DataFrame:
    """(issuer, array of rules in order); rules are configuration, so an issuer has a handful or some hundreds."""
    return rules.groupBy(F.col("issuer").alias(f"{name}_of")).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))


def codes_by_table(docs: DataFrame, patterns: DataFrame, repairs: DataFrame, issuer: str = "issuer", text: str = "text") -> DataFrame:
    """``docs`` with ``codes`` (all codes by pattern order, distinct), ``cert_no`` and ``source``.

    patterns (issuer, priority, pattern, part, longest_first): every match of the issuer's patterns; with ``longest_first`` on any of
    them the codes go by length, then by number of hyphens, the longest first. repairs (issuer, priority, pattern, part, if_empty, find, put,
    source): the first repair of the issuer that matches the text replaces the value by its own match, after ``find`` was replaced by ``put``;
    one with ``if_empty`` only where there is no code. A bad pattern in the table raises."""
    rules = _by_issuer(patterns, "priority", ["pattern", "part", "longest_first"], "_patterns")
    mends = _by_issuer(repairs, "priority", ["pattern", "part", "if_empty", "find", "put", "source"], "_repairs")
    rows = docs.join(rules, F.col(issuer) == F.col("_patterns_of"), "left").join(mends, F.col(issuer) == F.col("_repairs_of"), "left")
    body = F.upper(X.clean_scan(F.col(text)))
    strip = lambda v: F.regexp_replace(X.squash(v), r"^[ .:\-]+|[ .:\-]+$", "")

    def search(t: Column) -> Column:
        found = F.flatten(F.transform("_patterns", lambda r: F.regexp_extract_all(t, r["pattern"], r["part"])))
        return F.filter(F.array_distinct(F.transform(found, strip)), lambda v: v != "")

    rank = lambda v: F.struct((-F.length(v)).alias("size"), (F.length(F.replace(v, F.lit("-"))) - F.length(v)).alias("hyphens"))
    found = F.coalesce(X.let(body, search), F.array().cast("array<string>"))
    rows = rows.withColumn("_found", found)
    placed = F.array_sort(F.transform("_found", lambda v, i: F.struct(rank(v).alias("rank"), i.alias("i"), v.alias("v"))))
    by_length = F.coalesce(F.exists("_patterns", lambda r: r["longest_first"]), F.lit(False))
    rows = rows.withColumn("codes", F.when(by_length, F.transform(placed, lambda p: p["v"])).otherwise(F.col("_found")))
    first = F.coalesce(F.get("codes", 0), F.lit(""))

    def mend(t: Column) -> Column:
        tried = F.transform(
            "_repairs",
            lambda r: F.struct(
                F.when(~r["if_empty"] | (first == ""), F.regexp_replace(F.get(F.regexp_extract_all(t, r["pattern"], r["part"]), 0), r["find"], r["put"])).alias("value"), r["source"].alias("source")
            ),
        )
        return F.get(F.filter(tried, lambda r: F.coalesce(r["value"], F.lit("")) != ""), 0)

    rows = rows.withColumn("_mended", X.let(body, mend))
    source = F.coalesce("_mended.source", F.when(first != "", F.lit("BASE")).otherwise(F.lit("")))
    kept = [c for c in docs.columns if c not in ("codes", "cert_no", "source")]
    return rows.select(*kept, "codes", F.coalesce("_mended.value", first).alias("cert_no"), source.alias("source"))


def _capitals(line: Column) -> Column:
    """The line in upper case where that keeps every character's place and its ASCII letters stand for what a search ignoring case would
    find; else NULL. The Kelvin sign and the dotted capital I are the only characters that such a search takes for ASCII letters and upper case does not."""
    return X.let(F.upper(line), lambda up: F.when((F.length(up) == F.length(line)) & ~line.rlike("[\u0130\u212a]"), up))


def _dated(line: Column, capitals: Column, rule: Column) -> Column:
    """First date behind the rule's anchors, in order, each at all its places, within the window and before a stop word.

    Once a date is found the pieces behind it are not read: a frequent anchor has as many as the text is long. Anchors of a ``plain`` rule
    are literals that cannot overlap themselves, so the line is split at them."""
    stops = F.concat(F.lit("(?is)(?<=.)(?:\\Q"), F.array_join(rule["stop_before"], "\\E|\\Q"), F.lit("\\E).*"))
    read = lambda p: F.get(D.dates_in(F.when(F.size(rule["stop_before"]) > 0, F.regexp_replace(p, stops, F.lit(""))).otherwise(p)), 0)
    anchors = F.filter(F.transform(rule["anchors"], X.squash), lambda a: a != "")

    def searched(anchor: Column) -> Column:
        rest = F.greatest(rule["window"] - F.length(anchor), F.lit(0)).cast("string")
        pieces = F.regexp_extract_all(line, F.concat(F.lit("(?isu)(?=(\\Q"), anchor, F.lit("\\E.{0,"), rest, F.lit("}))")), F.lit(1))
        return F.aggregate(pieces, F.lit(None).cast("date"), lambda found, p: F.coalesce(found, read(p)))

    def split(anchor: Column) -> Column:
        gaps = F.split(capitals, F.concat(F.lit("\\Q"), F.upper(anchor), F.lit("\\E")), -1)
        start = F.struct(F.lit(1).alias("at"), F.lit(None).cast("date").alias("found"))

        def behind(acc: Column, gap: Column) -> Column:
            here = acc["at"] + F.length(gap)
            # behind the last gap stands no anchor, and the text is at its end
            found = F.coalesce(acc["found"], F.when(here <= F.length(line), read(F.substring(line, here, F.greatest(rule["window"], F.length(anchor))))))
            return F.when(acc["found"].isNotNull(), acc).otherwise(F.struct((here + F.length(anchor)).alias("at"), found.alias("found")))

        return F.aggregate(gaps, start, behind, lambda acc: acc["found"])

    first = lambda anchor: F.when(rule["plain"] & capitals.isNotNull(), split(anchor)).otherwise(searched(anchor))
    return F.aggregate(anchors, F.lit(None).cast("date"), lambda found, a: F.coalesce(found, first(a))).cast("string")


def _codes_of(text: Column, rules: Column) -> Column:
    """map(pattern, what it finds) of the rules' patterns; many rules share one, and a text is searched once for it."""
    patterns = F.array_distinct(F.array_compact(F.flatten(F.transform(F.filter(rules, lambda r: r["rule_kind"] == "code_pattern"), lambda r: r["patterns"]))))
    find = lambda p: F.nullif(F.regexp_replace(F.regexp_substr(text, F.concat(F.lit("(?i)"), p)), r"\s+", ""), F.lit(""))
    return X.let(patterns, lambda ps: F.map_from_arrays(ps, F.transform(ps, find)))


def _coded(codes: Column, rule: Column) -> Column:
    return F.get(F.filter(F.transform(rule["patterns"], lambda p: codes[p]), lambda v: v.isNotNull()), 0)


def _literal(rules: DataFrame) -> DataFrame:
    """The rules that are switched on, their empty cells filled."""
    target = F.upper(F.trim(F.coalesce("target_org", F.lit(""))))
    on = rules.filter(F.coalesce("enabled", F.lit(True))).withColumn("target_org", F.when(target.isin(*EVERY_ISSUER), F.lit("ALL")).otherwise(target))
    on = on.withColumn("window", F.coalesce("window", F.lit(650)))
    for name in ("anchors", "stop_before", "patterns", "markers"):
        on = on.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    ends = lambda a: F.transform(F.sequence(F.lit(1), F.length(a)), lambda k: F.left(a, k))
    itself = lambda a: F.exists(F.slice(ends(a), 1, F.length(a) - 1), lambda x: F.endswith(a, x))
    plain = F.forall(F.transform("anchors", folded), lambda a: a.isNotNull() & (a != "") & ~a.rlike(r"[^\x00-\x7f]|\\E") & ~itself(a))
    raw = F.forall("anchors", lambda a: a.isNotNull() & ~a.rlike(r"[^\x00-\x7f]"))
    return on.withColumn("plain", F.coalesce(plain & raw, F.lit(False)))


def _with_turns(docs: DataFrame, rules: DataFrame, versions: Sequence[str], ident: str, text: str, issuer: str) -> DataFrame:
    """``docs`` with an array ``_turn_<version>`` of the rules of each version that may reach the document, in their order."""
    on = _literal(rules)
    order = F.struct("priority", "rule_id", "rule_kind", "target_org", "target_field", "anchors", "stop_before", "window", "patterns", "markers", "plain").alias("_rule")
    shows = F.col("rule_kind").isin("date_anchor", "non_cert_doc")
    literal, other = on.filter(shows), on.filter(~shows).select("version", "target_org", order)
    phrases = literal.select(F.explode(F.when(F.col("rule_kind") == "date_anchor", F.col("anchors")).otherwise(F.col("markers"))).alias("phrase"), "version", "rule_id").filter(F.trim("phrase") != "")
    seen = _named(docs, phrases, ident, text, "phrase").select(F.col(ident).alias("_id"), "version", "rule_id").distinct()
    orgs = docs.select(F.col(ident).alias("_id"), F.coalesce(F.upper(issuer), F.lit("")).alias("_org"))
    shown = seen.join(literal.select("version", "rule_id", "target_org", order), ["version", "rule_id"]).join(orgs, "_id")
    shown = shown.filter((F.col("target_org") == F.col("_org")) | F.col("target_org").isin("ALL", UNKNOWN))
    listed = lambda of: [F.collect_list(F.when(F.col("version") == v, F.col("_rule"))).alias(f"_{of}_{v}") for v in versions]
    # Reading the rules costs far more than moving them, so the rows go to a number of tasks that is not lowered by their size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_doc = shown.repartition(tasks, "_id").groupBy("_id").agg(*listed("shown"))
    # Rules without a phrase go by issuer. Each stands once in what every task is sent; those for all and for UNKNOWN are a value beside the rows.
    shared = F.col("target_org").isin("ALL", UNKNOWN)
    common = other.filter(shared).agg(F.struct(*listed("own"))).scalar()
    per_org = other.filter(~shared).groupBy(F.col("target_org").alias("_target")).agg(*listed("own")).hint("broadcast")
    rows = docs.repartition(tasks, ident).join(per_doc, F.col(ident) == F.col("_id"), "left").join(per_org, F.coalesce(F.upper(issuer), F.lit("")) == F.col("_target"), "left")
    rows = rows.withColumn("_common", common)
    none = F.array().cast(rows.schema[f"_own_{versions[0]}"].dataType)
    turns = {f"_turn_{v}": F.array_sort(F.concat(F.coalesce(f"_shown_{v}", none), F.coalesce(f"_own_{v}", none), F.col(f"_common._own_{v}"))) for v in versions}
    return rows.select(*docs.columns, *[c.alias(n) for n, c in turns.items()])


def _after(turn: Column, text: str, issuer: str, fields: Sequence[str], company_rules: Mapping[str, Sequence[str]]) -> Column:
    """struct(issuer, fields, parse_status, applied) of a document after the rules, one after the other."""
    names = [*fields, "parse_status"]
    log = "array<struct<rule_id:string,field:string,before:string,after:string>>"
    start = F.struct(F.col(issuer).cast("string").alias("issuer"), *[F.col(n).cast("string").alias(n) for n in names], F.array().cast(log).alias("applied"))

    def step(acc: Column, rule: Column, it: Column) -> Column:
        matches = (rule["target_org"] == "ALL") | (rule["target_org"] == F.upper(acc["issuer"]))
        kind = rule["rule_kind"]
        rejected = matches & (kind == "non_cert_doc")
        field = F.coalesce(rule["target_field"], F.when(kind == "maker_cleanup", F.lit("maker")).when(kind == "code_pattern", F.lit("cert_no")))
        now = F.lit(None).cast("string")
        for n in fields:
            now = F.when(field == n, acc[n]).otherwise(now)
        cleaned = F.nullif(EX.clean_company(now, company_rules), F.lit(""))
        read = F.when(matches, F.when(kind == "date_anchor", _dated(it["line"], it["capitals"], rule)).when(kind == "code_pattern", _coded(it["codes"], rule)).when(kind == "maker_cleanup", cleaned))
        # what a rule reads is used several times below, and read once
        return X.let(read, lambda value: follow(acc, rule, matches, rejected, field, value))

    def follow(acc: Column, rule: Column, matches: Column, rejected: Column, field: Column, value: Column) -> Column:
        fresh = {n: F.when(rejected, F.lit("")).when((field == n) & value.isNotNull(), value).otherwise(acc[n]) for n in fields}
        fresh["parse_status"] = F.when(rejected, F.lit("NON_CERTIFICATE_DOC")).otherwise(acc["parse_status"])
        org = F.when(rejected, F.lit(UNKNOWN)).otherwise(acc["issuer"])
        change = lambda n, new: F.struct(rule["rule_id"].cast("string").alias("rule_id"), F.lit(n).alias("field"), acc[n].alias("before"), new.alias("after"))
        done = [F.when(~new.eqNullSafe(acc[n]), change(n, new)) for n, new in {**fresh, "issuer": org}.items()]
        return F.struct(org.alias("issuer"), *[fresh[n].alias(n) for n in names], F.concat(acc["applied"], F.array_compact(F.array(*done))).alias("applied"))

    def fold(it: Column) -> Column:
        found = F.filter(it["turn"], lambda r: (r["rule_kind"] != "code_pattern") | _coded(it["codes"], r).isNotNull())  # a pattern that is not found changes nothing
        return F.aggregate(found, start, lambda acc, rule: step(acc, rule, it))

    # rules for UNKNOWN have a turn only behind one that rejects the document, unless that is its issuer
    rejecting = F.exists(turn, lambda r: r["rule_kind"] == "non_cert_doc")
    reached = F.filter(turn, lambda r: (r["target_org"] == "ALL") | (r["target_org"] == F.upper(F.col(issuer))) | ((r["target_org"] == UNKNOWN) & rejecting))
    known = lambda line: X.let(reached, lambda rules: F.struct(rules.alias("turn"), _codes_of(F.col(text), rules).alias("codes"), line.alias("line"), _capitals(line).alias("capitals")))
    return X.let(X.let(X.squash(F.col(text)), known), fold)


FIELDS = ("cert_no", "expiry", "maker")


def apply_rule_table(
    docs: DataFrame, rules: DataFrame, ident: str = "doc_id", text: str = "text", issuer: str = "issuer",
    fields: Sequence[str] = FIELDS, company_rules: Mapping[str, Sequence[str]] = EX.COMPANY_RULES,
) -> DataFrame:
    """``docs`` after the extension rules, in order of priority, each where its issuer matches at its turn; and ``applied``, what
    each rule that took effect did: array<struct<rule_id, field, before, after>>.

    rules (rule_id, priority, enabled, target_org, rule_kind, target_field, anchors, stop_before, window, patterns, markers). Kinds as
    in :func:`attestry.operators.extract.apply_overrides`. Rules with anchors or markers reach a document through the phrase index, so only those
    that it shows are looked at; pattern and clean-up rules reach it by issuer. Issuer, fields and ``parse_status`` are columns of ``docs``;
    a document's text is shuffled once, to meet its rules."""
    rows = _with_turns(docs, rules.withColumn("version", F.lit("now")), ["now"], ident, text, issuer)
    rows = rows.withColumn("_end", _after(F.col("_turn_now"), text, issuer, fields, company_rules))
    changed = (*fields, "parse_status")
    kept = [F.col(f"_end.{'issuer' if c == issuer else c}").alias(c) if c == issuer or c in changed else F.col(c) for c in docs.columns]
    return rows.select(*kept, F.col("_end.applied").alias("applied"))


def what_if(
    docs: DataFrame, rules: DataFrame, candidate: DataFrame, ident: str = "doc_id", text: str = "text", issuer: str = "issuer",
    fields: Sequence[str] = FIELDS, company_rules: Mapping[str, Sequence[str]] = EX.COMPANY_RULES,
) -> DataFrame:
    """What a candidate rule table would change: (id, field, before, after, kind, rule_id), a row per field that differs.

    Every document meets the rules of both tables in one pass and is folded twice. ``before`` and ``after`` are the values under the two tables; ``kind`` is
    ADDED, REMOVED or CHANGED; ``rule_id`` is the last rule of the candidate table that set the field, or, where none did, the rule
    of the present table whose effect is gone."""
    both = rules.withColumn("version", F.lit("before")).unionByName(candidate.withColumn("version", F.lit("after")))
    rows = _with_turns(docs, both, ["before", "after"], ident, text, issuer)
    ends = rows.select(ident, *[_after(F.col(f"_turn_{v}"), text, issuer, fields, company_rules).alias(v) for v in ("before", "after")])

    def last(version: str, field: str) -> Column:
        return F.try_element_at(F.filter(F.col(f"{version}.applied"), lambda a: a["field"] == field), F.lit(-1))["rule_id"]

    def differs(field: str) -> Column:
        old, new = F.col(f"before.{field}"), F.col(f"after.{field}")
        blank = lambda c: F.coalesce(c, F.lit("")) == ""
        kind = F.when(blank(old), F.lit("ADDED")).when(blank(new), F.lit("REMOVED")).otherwise(F.lit("CHANGED"))
        who = F.coalesce(last("after", field), last("before", field))
        return F.when(~old.eqNullSafe(new), F.struct(F.lit(field).alias("field"), old.alias("before"), new.alias("after"), kind.alias("kind"), who.alias("rule_id")))

    changes = F.array_compact(F.array(*[differs(f) for f in ("issuer", *fields, "parse_status")]))
    return ends.select(ident, F.explode(changes).alias("c")).select(ident, "c.*")
