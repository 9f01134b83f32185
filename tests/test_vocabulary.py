from __future__ import annotations

import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attestry.operators import extract as EX
from attestry.operators import vocabulary as V

RULES = (
    "rule_id long, priority long, enabled boolean, target_org string, rule_kind string, target_field string, anchors array<string>, stop_before array<string>, "
    "window int, patterns array<string>, markers array<string>"
)


def rule(no, kind, org="ALL", field=None, **more):
    row = {"enabled": True, "anchors": None, "stop_before": None, "window": None, "patterns": None, "markers": None, **more}
    return (no, no, row["enabled"], org, kind, field, row["anchors"], row["stop_before"], row["window"], row["patterns"], row["markers"])


def fold(text):
    return re.sub(r"\s+", " ", text or "").strip().upper()


def test_every_place_of_every_term(spark):
    rng = random.Random(1)
    parts = ["abc", "de", "fgh", "Ab", "c d", "é\n", "a" * 90]
    rows = [(i, None if i == 3 else " ".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 300, 900])))) for i in range(40)]
    terms = sorted({" ".join(rng.choice(["abc", "de", "fgh", "ab", "c", "é"]) for _ in range(rng.randrange(1, 6))) for _ in range(80)} | {"a" * 100, "zzz"})
    terms = [t for t in terms if len(t) >= 3]
    got = V.phrase_hits(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in [*terms, None, " "]], "term string"))
    want = []
    for doc, text in rows:
        folded = fold(text)
        want += [(doc, t, m.start() + 1) for t in {x.upper() for x in terms} for m in re.finditer(f"(?={re.escape(t)})", folded)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_terms_that_the_index_cannot_hold_raise(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    for term in ("ab", "x" * 101):
        with pytest.raises(PySparkException, match="a term has 3 to 100 characters"):
            V.phrase_hits(docs, spark.createDataFrame([(term,)], "term string")).collect()
    with pytest.raises(ValueError, match="more than one part"):
        V.phrase_hits(docs, spark.createDataFrame([("abc",)], "term string"), longest=1000)


def test_a_word_in_every_text_and_one_huge_text_stay_linear(spark):
    word = "common"
    docs = spark.createDataFrame([(i, f"{word} text number {i}") for i in range(2000)] + [(9999, "filler words " * 200_000 + "last phrase here")], "doc_id long, text string")
    terms = spark.createDataFrame([(f"{word} phrase {k}",) for k in range(3000)] + [("last phrase here",), (f"{word} text",)], "term string")
    hits = V.phrase_hits(docs, terms)
    assert hits.groupBy("term").count().orderBy("count").collect()[0]["term"] == "LAST PHRASE HERE"
    assert hits.count() == 2001


def test_aliases_and_markers_from_tables(spark):
    docs = spark.createDataFrame([(1, "isa\nislamic"), (2, "isa only"), (3, "isa and alpha"), (4, "none"), (5, None)], "doc_id long, text string")
    aliases = spark.createDataFrame([("A", "ALPHA", 1, 1), ("I", "isa", 2, 2), ("I", "Islamic", 3, 2)], "issuer string, alias string, priority int, needed int")
    assert dict(map(tuple, V.issuer_by_alias(docs, aliases).collect())) == {1: "I", 2: "I", 3: "A", 4: "UNKNOWN", 5: "UNKNOWN"}
    markers = spark.createDataFrame([("B", "isa", 50), ("A", "isa", 30), ("A", "alpha", 20), ("C", "only", 39)], "issuer string, marker string, weight int")
    got = {r[0]: tuple(r[1:]) for r in V.issuer_by_marker(docs, markers).collect()}
    assert got == {1: ("UNKNOWN", 50, 20), 2: ("UNKNOWN", 50, 11), 3: ("UNKNOWN", 50, 0), 4: ("UNKNOWN", 0, 0), 5: ("UNKNOWN", 0, 0)}


def test_rule_table_agrees_with_unrolled_rules(spark):
    rows = [
        ("HQC", "Valid until\n2027-03-01. REF ZZ 77", "x", "", "Company: Acme Ltd 5 High Street"), ("IFB", "license 2020-01-01 valid until 2021-02-03", "x", "", "Y"),
        (None, "valid until STOP 2021-02-03", "x", "", None), ("HQC", None, "x", "", "Z"), ("HQC", "", "x", "", "For ever Co"),
    ]
    docs = spark.createDataFrame([(i, *r, "LOW") for i, r in enumerate(rows)], "doc_id int, issuer string, text string, cert_no string, expiry string, maker string, parse_status string")
    table = [
        rule(1, "date_anchor", "HQC", "expiry", anchors=["VALID UNTIL"]), rule(2, "date_anchor", "", "expiry", anchors=["VALID UNTIL"], stop_before=["STOP"]),
        rule(3, "code_pattern", patterns=[r"nothing", r"zz\s*\d+"]), rule(4, "maker_cleanup", "hqc"), rule(5, "non_cert_doc", "*", markers=["LICENSE"]),
        rule(6, "date_anchor", "UNKNOWN", "expiry", anchors=["license"]), rule(7, "code_pattern", "HQC", patterns=["REF"], enabled=False), rule(8, "date_anchor", "MUI", "expiry", anchors=["VALID UNTIL"]),
    ]
    got = {r["doc_id"]: r for r in V.apply_rule_table(docs, spark.createDataFrame(table, RULES)).collect()}
    fields = lambda r: (r["issuer"], r["cert_no"], r["expiry"], r["maker"], r["parse_status"])
    assert fields(got[0]) == ("HQC", "zz77".upper(), "2027-03-01", "Acme Ltd", "LOW")
    assert fields(got[1]) == ("UNKNOWN", "", "2020-01-01", "", "NON_CERTIFICATE_DOC")
    assert fields(got[2]) == (None, "x", "", None, "LOW")
    assert fields(got[3]) == ("HQC", "x", "", "Z", "LOW") and fields(got[4]) == ("HQC", "x", "", "For ever Co", "LOW")
    assert [(a["rule_id"], a["field"], a["after"]) for a in got[1]["applied"]] == [
        ("2", "expiry", "2021-02-03"), ("5", "cert_no", ""), ("5", "expiry", ""), ("5", "maker", ""), ("5", "parse_status", "NON_CERTIFICATE_DOC"), ("5", "issuer", "UNKNOWN"), ("6", "expiry", "2020-01-01"),
    ]
    plain = [{"rule_kind": "code_pattern", "target_org": "ALL", "target_field": "cert_no", "patterns": [r"zz\s*\d+"]}, {"rule_kind": "maker_cleanup", "target_org": "HQC"}]
    unrolled = {r["doc_id"]: r for r in EX.apply_overrides(docs, "text", "issuer", plain).collect()}
    assert all(unrolled[i]["maker"] == got[i]["maker"] for i in (0, 3, 4))


def test_what_if_names_the_rule(spark):
    docs = spark.createDataFrame(
        [(1, "A", "due 2027-01-01 sold 2028-01-01", "c", "", "m", "LOW"), (2, "A", "due 2027-05-05", "c", "", "m", "LOW"), (3, "B", "no label", "c", "", "m", "LOW")],
        "doc_id int, issuer string, text string, cert_no string, expiry string, maker string, parse_status string",
    )
    now = spark.createDataFrame([rule(1, "date_anchor", "A", "expiry", anchors=["due"]), rule(3, "non_cert_doc", "B", markers=["label"])], RULES)
    new = spark.createDataFrame([rule(1, "date_anchor", "A", "expiry", anchors=["due"]), rule(2, "date_anchor", "A", "expiry", anchors=["sold"])], RULES)
    got = sorted(map(tuple, V.what_if(docs, now, new).collect()))
    assert got == [
        (1, "expiry", "2027-01-01", "2028-01-01", "CHANGED", "2"), (3, "cert_no", "", "c", "ADDED", "3"), (3, "issuer", "UNKNOWN", "B", "CHANGED", "3"),
        (3, "maker", "", "m", "ADDED", "3"), (3, "parse_status", "NON_CERTIFICATE_DOC", "LOW", "CHANGED", "3"),
    ]


def test_codes_and_repairs_from_tables(spark):
    docs = spark.createDataFrame([(1, "A", "no a-1 and A-1 . A-22"), (2, "A", None), (3, "B", "b 7 V 9 V 1"), (4, "B", "b5"), (5, "X", "b5"), (6, None, "a-1")], "doc_id int, issuer string, text string")
    patterns = spark.createDataFrame([("A", 1, "A-[0-9]+", 0, True), ("B", 2, r"\bB([0-9]+)", 1, False)], "issuer string, priority int, pattern string, part int, longest_first boolean")
    repairs = spark.createDataFrame([("B", 1, "[0-9] V [0-9]", 0, True, " V ", "/", "MENDED")], "issuer string, priority int, pattern string, part int, if_empty boolean, find string, put string, source string")
    got = {r["doc_id"]: (r["codes"], r["cert_no"], r["source"]) for r in V.codes_by_table(docs, patterns, repairs).collect()}
    assert got == {1: (["A-22", "A-1"], "A-22", "BASE"), 2: ([], "", ""), 3: ([], "7/9", "MENDED"), 4: (["5"], "5", "BASE"), 5: ([], "", ""), 6: ([], "", "")}


def test_the_grams_of_the_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    hits = V.phrase_hits(docs, spark.createDataFrame([(f"label {k}",) for k in range(100)] + [("abc",)], "term string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_held_terms_like_brute_force(spark):
    hot = "common part"
    sent = [f"Re: {hot}, item {k % 7}; (Maker {k}) / ab\nLine {k}" for k in range(60)] + [None, "", "x,  ,\n", "straße;STRASSE", "y" * 81]
    terms = {p for t in sent if t for p in map(fold, re.split(r"[\n\r,/|;:()\[\]<>]+", t)) if 3 <= len(p) <= 80}
    mails = [(k, f"about the {hot} and  maker {k % 90} with line\t{k}, item {k % 9}", "x") for k in range(300)]
    mails += [(300, None, "x"), (301, "", "x"), (302, "nothing of it", "x"), (303, "die Strasse", "x"), (304, "z " * 20_000 + "maker 12 " + "z" * 30_000, "x"), (None, "line 5", "x"), (5, "item 3", "x")]
    docs = spark.createDataFrame(mails, "id long, body string, terms string").repartition(5)
    known = V.reference_terms(spark.createDataFrame([(t, "t") for t in sent], "text string, term string"))
    assert {r.term for r in known.collect()} == terms and known.count() == len(terms)
    want = {}
    for k, body, _ in mails:
        want.setdefault(k, set()).update(t for t in terms if body and t in fold(body))
    want = {k: ", ".join(sorted(v, key=lambda t: (-len(t), t))[:5]) for k, v in want.items() if v}
    got = V.held_terms(docs, known, "id", "body").collect()
    assert {r.id: r.terms for r in got} == want and len(got) == len(want)
    assert V.held_terms(docs.limit(0), known, "id", "body").count() == 0 == V.held_terms(docs, known.limit(0), "id", "body").count()


def test_characters_that_begin_no_term_make_no_row(spark):
    """Only places whose gram the index knows become rows, with the text that a term can need and no more."""
    docs = spark.createDataFrame([(1, "no such thing here, " * 400 + "green apples of autumn")], "doc_id long, text string")
    terms = spark.createDataFrame([("green apples",)], "term string")
    index = V.anchored(docs, terms.select(V.folded(F.col("term")).alias("term")), "text", V.LONG_GRAM, 100, 1.0)
    bits, words = V._bits(index, 1)
    likely = V._likely(V._parts(docs, "doc_id", "text", 12), V.LONG_GRAM, bits, words, 12, 12)
    made = likely.select("_near").collect()
    assert 1 <= len(made) < 400 and max(len(r[0]) for r in made) <= 24
    assert [tuple(r) for r in V.phrase_hits(docs, terms).collect()] == [(1, "GREEN APPLES", 8001)]


def test_dates_behind_frequent_and_odd_anchors(spark):
    """Lines are split at literals that cannot overlap themselves, and searched for the others; both find what a search for each place finds."""
    day = lambda k: f"20{10 + k % 80}-0{1 + k % 9}-1{k % 10}"
    texts = [
        "due soon " * 50 + "due " + day(1), "DUE 2020-13-40 due\n" + day(2), "a b a b a " + day(3), "straße due " + day(4), "Kin due " + day(5) + " kin " + day(6),
        "due", "no anchor " + day(7), "x" * 30 + "due " + "y" * 12 + " " + day(8), "dİe due " + day(9), "due stop " + day(10) + " due " + day(11),
    ]
    cases = [("due", 20, None), ("a b a", 17, None), ("kin", 30, None), ("straße", 30, None), ("due", 40, ["stop"]), ("DUE ", 15, None)]
    rows = [(100 * c + i, f"R{c}", t, "c", "", "m", "LOW") for c in range(len(cases)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, issuer string, text string, cert_no string, expiry string, maker string, parse_status string")
    table = [rule(c, "date_anchor", f"R{c}", "expiry", anchors=[a], window=w, stop_before=s) for c, (a, w, s) in enumerate(cases)]

    def read(anchor, window, stops, text):
        line = re.sub(r"\s+", " ", text).strip()
        for m in re.finditer(f"(?i)(?={re.escape(anchor)})", line):
            piece = line[m.start() : m.start() + max(window, len(anchor))]
            piece = re.split("(?i)(?<=.)(?:" + "|".join(map(re.escape, stops)) + ")", piece)[0] if stops else piece
            found = [d for d in re.findall(r"\b(20\d\d)-(\d{1,2})-(\d{1,2})\b", piece) if int(d[1]) <= 12]
            if found:
                return "{}-{:0>2}-{:0>2}".format(*found[0])
        return ""

    got = {r["doc_id"]: r["expiry"] for r in V.apply_rule_table(docs, spark.createDataFrame(table, RULES)).collect()}
    want = {100 * c + i: read(a.strip(), w, s, t) for c, (a, w, s) in enumerate(cases) for i, t in enumerate(texts)}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {} and len(got) == len(want) and sum(v != "" for v in want.values()) > 15


def test_rules_without_a_phrase_meet_documents_without_a_shuffle_by_issuer(spark):
    """Issuers are few: rows dealt by issuer would be as many tasks as there are issuers, and an equal pattern is one search."""
    docs = spark.createDataFrame([(i, "AB"[i % 2], f"qq{i}", "c", "", "m", "LOW") for i in range(6)], "doc_id int, issuer string, text string, cert_no string, expiry string, maker string, parse_status string")
    table = [rule(k, "code_pattern", "A", patterns=["qq[0-9]"]) for k in range(5)] + [rule(9, "date_anchor", "ALL", "expiry", anchors=["never"]), rule(10, "code_pattern", "UNKNOWN", patterns=["q"]), rule(11, "code_pattern", "ALL", patterns=["qq5"])]
    done = V.apply_rule_table(docs, spark.createDataFrame(table, RULES))
    assert "hashpartitioning(coalesce(upper(issuer" not in done._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["cert_no"] for r in done.collect()} == {0: "qq0", 1: "c", 2: "qq2", 3: "c", 4: "qq4", 5: "qq5"}


def test_a_large_term_table_is_not_sent_to_every_executor(spark, monkeypatch):
    monkeypatch.setattr(V, "SENT", 10)
    docs = spark.createDataFrame([(1, "label 7 and label 55 abc")], "doc_id long, text string")
    hits = V.phrase_hits(docs, spark.createDataFrame([(f"label {k}x",) for k in range(100)] + [("label 55",), ("label 7",)], "term string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and sorted(map(tuple, hits.collect())) == [(1, "LABEL 55", 13), (1, "LABEL 7", 1)]
