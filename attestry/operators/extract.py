"""Field extraction from document text, driven by rule tables.

Vocabularies, patterns and labels are arguments. A document is read inside its own row, as
one string or one array of lines, so extraction adds no shuffle to a scan of the texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import dates as D
from attestry.functions import text as X
from attestry.functions.similarity import ladder, ladder_from
from attestry.operators import rules


def detect_issuer(blob: Column, aliases: Sequence[tuple[str, Sequence[str], int]]) -> Column:
    """Ordered alias table (issuer, aliases, hits needed). The first issuer with enough hits wins;
    if none has enough, the first with any hit; else UNKNOWN."""

    def pick(text: Column) -> Column:
        hits = [reduce(lambda a, b: a + b, [text.contains(a.upper()).cast("int") for a in names]) for _, names, _ in aliases]
        enough = [(h >= need, org) for h, (org, _, need) in zip(hits, aliases)]
        weak = [(h >= 1, org) for h, (org, _, _) in zip(hits, aliases)]
        return rules.decide(enough + weak, "UNKNOWN")

    return X.let(F.upper(blob), pick)


def weigh_issuers(text: Column, markers: Sequence[tuple[str, str, int]], least: int = 40, gap: int = 25) -> Column:
    """Marker table (issuer, pattern, weight) -> struct(issuer, score, margin). Below ``least`` points
    or within ``gap`` of the runner-up the issuer stays UNKNOWN; ties go by name."""
    issuers = sorted({org for org, _, _ in markers})

    def weigh(t: Column) -> Column:
        sums = [
            F.struct((-rules.points([(t.rlike(p), w) for o, p, w in markers if o == org])).alias("neg"), F.lit(org).alias("org"))
            for org in issuers
        ]

        def choose(ranked: Column) -> Column:
            best, second = -ranked[0]["neg"], -F.coalesce(F.get(ranked, 1)["neg"], F.lit(0))
            clear = (best >= least) & ((second == 0) | (best - second >= gap))
            return F.struct(
                F.when(clear, ranked[0]["org"]).otherwise(F.lit("UNKNOWN")).alias("issuer"), best.alias("score"), (best - second).alias("margin")
            )

        return X.let(F.array_sort(F.array(*sums)), choose)

    return X.let(F.upper(text), weigh)


def issuer_in_name(name: Column, markers: Sequence[tuple[str, str]]) -> Column:
    """Issuer named earliest in a file name, the longest on equal places."""
    spots = [
        F.when(
            F.upper(name).rlike(p),
            F.struct(F.regexp_instr(F.upper(name), F.lit(p)).alias("at"), (-F.length(F.regexp_extract(F.upper(name), p, 0))).alias("len"), F.lit(org).alias("org")),
        )
        for org, p in markers
    ]
    return F.coalesce(F.array_min(F.array_compact(F.array(*spots)))["org"], F.lit("UNKNOWN"))


def find_codes(text: Column, issuer: Column, patterns: Mapping[str, Sequence[tuple[str, int]]], default: Sequence[tuple[str, int]] = ()) -> Column:
    """All codes of the issuer's patterns (pattern, group) in pattern order, distinct; the first is the value."""

    def take(rows: Sequence[tuple[str, int]], t: Column) -> Column:
        found = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(g)) for p, g in rows])) if rows else F.array().cast("array<string>")
        return F.array_distinct(F.transform(found, lambda v: F.regexp_replace(v, r"\s+", "")))

    return X.let(F.upper(text), lambda t: rules.decide([(issuer == org, take(rows, t)) for org, rows in patterns.items()], take(default, t)))


# Words near a date that make it an expiry candidate.
EXPIRY_WORDS = ("valid", "validity", "until", "expiry", "expired", "expiration", "expire", "berlaku", "hingga", "sampai", "유효", "만료", "유효기간", "기간", "~")


def scored_dates(text: Column, from_name: bool = False, size: int | None = None) -> Column:
    """Date candidates ``array<struct<score, date>>``: 90 near an expiry word, else 50, 8 more for a file
    name; best per date, by score then date; the first ``size`` if it is given."""
    near = "|".join("\\Q" + w + "\\E" for w in EXPIRY_WORDS)

    def score(t: Column) -> Column:
        hits = F.transform(
            X.occurrences(t, D.ANY_DATE),
            lambda h: F.struct(
                (-(F.when(F.lower(F.substring(t, F.greatest(h["start"] - 100, F.lit(1)), F.least(h["start"] - 1, F.lit(100)) + 140)).rlike(near), F.lit(90)).otherwise(F.lit(50))
                   + F.lit(8 if from_name else 0))).alias("neg"),
                D.parse_date_text(h["hit"]).cast("string").alias("date"),
            ),
        )
        valid = F.array_sort(F.filter(hits, lambda c: c["date"].isNotNull()))
        first = X.let(valid, lambda v: X.let(F.transform(v, lambda c: c["date"]), lambda ds: F.filter(v, lambda c, i: F.array_position(ds, c["date"]) == i + 1)))
        return F.transform(first if size is None else F.slice(first, 1, size), lambda c: F.struct((-c["neg"]).alias("score"), c["date"].alias("date")))

    return X.let(X.html_text(text), score)


# Legal forms that mark a company line, and lines that are none.
COMPANY_LINE = r"(?i)\b(?:CO\.?,?\s*LTD\.?|LTD\.?|LIMITED|COMPANY|CORPORATION|CORP\.?|INC\.?|GMBH|B\.?V\.?|S\.A\.|SAS|SDN\s*BHD|PTE\s*LTD)(?![A-Za-z])"
NOT_COMPANY = (
    r"(?i)^(?:NAME OF (?:THE )?PRODUCTS|PRODUCT NAME|PRODUCTS|PRODUCT LIST|CERTIFICATE NO|ISSUE DATE|EXPIRED DATE|EXPIRY DATE|FACTORY ADDRESS|COMPANY ADDRESS|ADDRESS)$"
    r"|^(?:PLOT|NO\.?|ROAD|STREET|DISTRICT|SECTOR|VILLAGE|ADDRESS)\b|\b(?:TEL|FAX|EMAIL|E-MAIL|WWW|PHONE)\b"
)
# Rules of the demo; a caller brings its own table of the same four lists.
COMPANY_RULES = {
    "labels": ("company name & address", "name of company", "manufactured by", "company name", "manufacturer", "company"),
    "next_labels": ("address", "plant", "factory"),
    "street_words": ("street", "road", "avenue", "lane"),
    "never_in_a_name": ("certificate", "valid until", "attached list", "page "),
}


def _any_of(words: Sequence[str]) -> str:
    longest_first = sorted(words, key=lambda w: (-len(w), w))
    return "(?:" + "|".join(r"\s+".join(re.escape(w) for w in entry.split()) for entry in longest_first) + ")"


def clean_company(c: Column, table: Mapping[str, Sequence[str]] = COMPANY_RULES) -> Column:
    """Company name without its label, what the next label or a street address begins, and surrounding marks."""
    begin = rf"^{_any_of(table['labels'])}\s*[:：]"
    end = rf"\s(?:{_any_of(table['next_labels'])}\s*[:：]|\d+,?\s(?:\S+\s+)*?{_any_of(table['street_words'])}\b).*$"
    return F.regexp_replace(X.squash(F.regexp_replace(X.squash(c), f"(?i){begin}|{end}", "")), r"^[\s.:：ㆍ,\-]+|[\s:,\-]+$", "")


def suspicious_company(c: Column, table: Mapping[str, Sequence[str]] = COMPANY_RULES, shortest: int = 4, least_letters: float = 0.45) -> Column:
    """Whether a text is no company name: too short, mostly no letters, or with words that no name has."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z가-힣]", ""))
    odd = F.lower(c).rlike("|".join(re.escape(w) for w in table["never_in_a_name"]))
    return c.isNull() | (F.length(c) < shortest) | odd | (letters < least_letters * F.length(c))


def find_company(lines: Column, marker: str, reach: int = 8) -> Column:
    """Maker from an array of line texts: value behind a marker, else the nearest company line below it,
    else the first company line of the document. NULL if what is found is suspicious."""
    usable = lambda t: (t != "") & ~t.rlike(NOT_COMPANY)

    def at(line: Column, i: Column) -> Column:
        inline = F.regexp_replace(F.regexp_extract(line, f"(?i)(?:{marker})(.*)$", 1), r"^[ :：\-]+", "")
        below = F.filter(F.slice(lines, i + 2, reach), lambda t: usable(t) & t.rlike(COMPANY_LINE))
        return F.when(line.rlike(f"(?i){marker}"), F.when(usable(inline), inline).otherwise(F.get(below, 0)))

    marked = F.get(F.array_compact(F.transform(lines, at)), 0)
    anywhere = F.get(F.filter(lines, lambda t: usable(t) & t.rlike(COMPANY_LINE)), 0)
    return X.let(clean_company(F.coalesce(marked, anywhere)), lambda v: F.when(~suspicious_company(v), v))


def find_country(text: Column, words: Mapping[str, str], labels: str, excluded: str | None = None, block_chars: int = 300) -> Column:
    """Country by the longest vocabulary word: in the block behind an address label, else in the whole
    text without the excluded sentence."""
    ordered = sorted(words.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    vocabulary = F.array(*[F.struct(F.lit(f" {w.upper()} ").alias("w"), F.lit(c).alias("c")) for w, c in rules._bounded(ordered)])

    def longest(t: Column) -> Column:
        key = F.concat(F.lit(" "), X.norm_key(t, keep="A-Z0-9_", sep=" "), F.lit(" "))
        return X.let(key, lambda k: F.get(F.filter(vocabulary, lambda v: F.contains(k, v["w"])), 0)["c"])

    block = F.regexp_extract(text, f"(?is)(?:{labels})(.{{0,{block_chars}}})", 1)
    body = F.regexp_replace(text, excluded, " ") if excluded else text
    return F.coalesce(longest(block), longest(body))


# Lines that look numbered but are no product.
PRODUCT_NOISE = (
    r"(?i)^PAGE\s+\d+|^CERT(?:IFICATE)?\b|^DATE\b|^VALID\b|^ISSUE\b|^PRODUCT\s*(?:NAME|TYPE|CODE)|^NO\.?$|QR\s*CODE|^NAMA\s+PRODUK|^DAFTAR\s+PRODUK|^DOKUMEN\b"
    r"|^THIS\s+CERTIFICATE\b|^NAME\s*:|^(?:\d{2,5}\s+){2,}\d{2,5}$|\bROAD\b|\bFLOOR\b|\bBUILDING\b|\bFAX\b|\bTEL\b|\bE-?MAIL\b|@"
)


def find_products(lines: Column) -> Column:
    """Numbered products ``array<struct<no, name>>``: 'n name' on one line, or 'n' and the name below it;
    noise out, first spelling kept."""

    def at(line: Column, i: Column) -> Column:
        same = F.regexp_extract(line, r"^(\d{1,4})[.)]?\s+(.{2,})$", 2)
        below = F.when(line.rlike(r"^\d{1,4}$"), F.get(lines, i + 1))
        name = F.coalesce(F.nullif(same, F.lit("")), below)
        ok = name.isNotNull() & ~name.rlike(PRODUCT_NOISE) & name.rlike("[A-Za-z가-힣]")
        return F.when(ok, F.struct(F.regexp_extract(line, r"^(\d{1,4})", 1).cast("int").alias("no"), F.trim(name).alias("name")))

    def first(found: Column) -> Column:
        return X.let(F.transform(found, lambda p: F.upper(p["name"])), lambda ks: F.filter(found, lambda p, i: F.array_position(ks, F.upper(p["name"])) == i + 1))

    return X.let(F.array_compact(F.transform(lines, at)), first)


def best_product(products: Column, target: Column) -> Column:
    """struct(score, name) of the product most like the expected name; the earliest on ties."""
    scored = F.transform(
        products,
        lambda p, i: F.struct(F.round(ladder(X.product_key(target), X.product_key(p["name"])), 6).alias("score"), (-i).alias("ord"), p["name"].alias("name")),
    )
    return F.array_max(scored)


def apply_overrides(docs: DataFrame, text: str, issuer: str, override_rules: Sequence[Mapping]) -> DataFrame:
    """Extension rules in order, each where its issuer matches (ALL and * match every issuer).

    Kinds: date_anchor (anchors, window, stop_before), maker_cleanup, code_pattern (patterns),
    non_cert_doc (markers). A rule with ``enabled`` false is passed over; a date search ends where one of
    the ``stop_before`` words begins. One projection per rule; Catalyst merges them into one pass."""
    for rule in rules._bounded([r for r in override_rules if r.get("enabled", True)]):
        target = str(rule.get("target_org", "")).upper().strip()
        applies = F.lit(True) if target in ("", "ALL", "ANY", "*") else F.upper(issuer) == target
        kind, field = rule["rule_kind"], rule.get("target_field")
        if kind == "date_anchor":
            value = D.date_after(F.col(text), list(rule["anchors"]), int(rule.get("window", 650)), rule.get("stop_before", ())).cast("string")
        elif kind == "maker_cleanup":
            field = field or "maker"
            value = F.nullif(clean_company(F.col(field)), F.lit(""))
        elif kind == "code_pattern":
            found = [F.nullif(F.regexp_replace(F.regexp_extract(text, "(?i)" + p, 0), r"\s+", ""), F.lit("")) for p in rule["patterns"]]
            value = F.coalesce(*found)
        elif kind == "non_cert_doc":
            hit = applies & rules.any_contained(F.upper(text), [m.upper() for m in rule["markers"]])
            cleared = {f: F.when(hit, F.lit("")).otherwise(F.col(f)) for f in ("cert_no", "expiry", "maker") if f in docs.columns}
            docs = docs.withColumns({**cleared, issuer: F.when(hit, F.lit("UNKNOWN")).otherwise(F.col(issuer)),
                                     "parse_status": F.when(hit, F.lit("NON_CERTIFICATE_DOC")).otherwise(F.col("parse_status"))})
            continue
        else:
            raise ValueError(f"unknown rule kind {kind!r}")
        docs = docs.withColumn(field, F.when(applies & value.isNotNull(), value).otherwise(F.col(field)))
    return docs


FOUND = 0.72  # fixed value: score from which a line is evidence


def value_evidence(lines: Column, value: Column, field: Column) -> Column:
    """Best line for a value: struct(score, line_index, method). Parsed date or equal key 1, contained
    .96, else similarity (makers and products only, where it can reach ``FOUND``)."""
    def search(v: Column) -> Column:
        def at(line: Column, i: Column) -> Column:
            # each key once a line; for a line of ASCII alone both keys come from one pass, as the letters that need more care are others
            capital = F.upper(line)
            plain = (F.octet_length(line) == F.length(line)) & ~capital.contains("FAMILY OF PRODUCTS")
            spaced = F.when(plain, F.trim(F.regexp_replace(capital, "[^A-Z0-9]+", " ")))
            dated = (field == "expiry") & line.rlike("[0-9]") & F.exists(D.dates_in(line), lambda d: d.cast("string") == v["raw"])

            def of_keys(own: Column, name: Column) -> Column:
                return (
                    F.when(dated, F.lit(1.0)).when((v["key"] != "") & (own == v["key"]), F.lit(1.0)).when((v["key"] != "") & own.contains(v["key"]), F.lit(0.96))
                    .when(field.isin("maker", "product"), X.let(F.coalesce(name, X.product_key(line)), lambda k: ladder_from(v["name"], k, FOUND))).otherwise(F.lit(0.0))
                )

            score = X.let(spaced, lambda k: X.let(F.coalesce(F.replace(k, F.lit(" "), F.lit("")), X.norm_key(line)), lambda own: of_keys(own, k)))
            return F.struct(F.round(score, 6).alias("score"), (-i).alias("neg"))

        return F.array_max(F.transform(lines, at))

    wanted = F.struct(value.alias("raw"), X.norm_key(value).alias("key"), X.product_key(value).alias("name"))
    return X.let(
        X.let(wanted, search),
        lambda b: F.struct(b["score"].alias("score"), F.when(b["score"] > 0, -b["neg"]).alias("line_index"), (b["score"] >= FOUND).alias("found")),
    )


CERT_LABEL = r"(?i)^.*?(?:certificate|registration|cert\.?|license)\s*(?:no|number|id)?\.?\s*[:：#]?\s*"
MAKER_LABEL = r"(?i)^.*?(?:manufactured\s+by|manufacturer|company\s+name|factory|applicant)\s*[:：]?\s*"


def value_of_line(field: str, line: Column, countries: Mapping[str, str]) -> Column:
    """The value a chosen line carries for a field."""
    if field == "cert_no":
        rest = F.regexp_replace(line, CERT_LABEL, "")
        tokens = F.filter(F.regexp_extract_all(F.upper(rest), F.lit("[A-Z0-9][A-Z0-9./_-]{4,}"), F.lit(0)), lambda t: t.rlike("[0-9]"))
        stripped = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[._/\-]+|[._/\-]+$", ""))
        ranked = F.transform(stripped, lambda t, i: F.struct(F.length(F.regexp_replace(t, "[^0-9]", "")).alias("d"), F.length(t).alias("n"), (-i).alias("i"), t.alias("t")))
        return F.coalesce(F.array_max(ranked)["t"], X.squash(rest))
    if field == "maker":
        return F.regexp_replace(F.regexp_replace(line, MAKER_LABEL, ""), r"^[ .,:;\-]+|[ .,:;\-]+$", "")
    if field == "expiry":
        return F.get(D.dates_in(line), 0).cast("string")
    if field == "country":
        return F.coalesce(find_country(line, countries, "zzz"), X.squash(line))
    return X.squash(line)


def name_hints(name: Column, issuer: Column) -> dict[str, Column]:
    """Expiry and product name written into a file name."""
    base = X.file_stem(name)
    base = F.regexp_replace(F.regexp_replace(base, r"(?i)^[A-F0-9]{12}__", ""), r"^\d+[_ .\-]*", "")
    base = F.regexp_replace(base, F.concat(F.lit(r"(?i)\[\Q"), issuer, F.lit(r"\E[^\]]*\].*$")), F.lit(""))
    base = F.regexp_replace(F.regexp_replace(base, r"\([^)]*\)\s*$", ""), r"^[ _.\-]+|[ _.\-]+$", "")
    return {"expiry_hint": D.table_date(F.regexp_extract(name, r"20\d{2}[-./]\d{1,2}[-./]\d{1,2}", 0)).cast("string"), "product_hint": X.squash(base)}
