"""Properties, safety rules, hot keys, and exactness against brute force on small fixtures."""

from __future__ import annotations

import math
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import dates as D
from attestry.functions import text as X
from attestry.operators import aggregate, decisions as DEC, extract as EX, filters, lines, linkage as L, mailing, rank, reshape, state

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- normalisers -----------------------------------------------------------------------------


@SLOW
@given(st.lists(st.text(alphabet="aB1 .,-_(주)é\n\tO2", max_size=20), min_size=5, max_size=20))
def test_normalisers_are_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for fn in (X.squash, X.to_dash, X.norm_key, X.clean_scan, X.entity_key, X.mail_subject, X.safe_component, X.material_no):
        if fn is X.mail_subject:
            continue  # one prefix is stripped per call
        out = df.select(fn(F.col("v")).alias("a")).select("a", fn(F.col("a")).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b")))
        assert out.count() == 0, fn.__name__


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2026-02-30", None), ("31/12/2026", "2026-12-31"), ("August 5th, 2027", "2027-08-05"), ("3rd April 2031", "2031-04-03"),
        ("15 Mei 2029", "2029-05-15"), ("26.12.17", "2026-12-17"), ("60.01.02", "1960-01-02"), ("2O26-O1-O9", "2026-01-09"), ("nothing", None), ("", None),
        ("13/13/2026", None),
    ],
)
def test_parse_date(spark, text, expected):
    got = one(spark, D.parse_date_text(F.lit(text)).cast("string"))
    assert got == expected


def test_dates_in_document_order(spark):
    text = "issued 9 Mei 2031 and 17/04/2026 " + "x" * 100 + ", footer F.8.2 11 Oktober 2019 " + "x" * 100 + " March 7\n TH, 2033"
    found = one(spark, D.find_dates(F.lit(text)))
    assert [str(r["date"]) for r in found] == ["2031-05-09", "2026-04-17", "2033-03-07"]


def test_addresses_are_no_dates(spark):
    text = "from 10.11.12.13 or 25.10.11.12, version 3.24.01.02 and 24.01.02. 23.10.9"
    assert [str(r["date"]) for r in one(spark, D.find_dates(F.lit(text)))] == ["2024-01-02", "2023-10-09"]
    assert one(spark, D.parse_date_text(F.lit("10.11.12.13"))) is None


def test_keys_fold_letter_by_letter(spark):
    assert one(spark, X.norm_key(F.lit("Von erungpf ß, \ufb01x é ı"))) == "VONERUNGPFXI"
    docs = spark.createDataFrame([("a ß",), ("a ßb",), ("abc",)], "line string")
    fit = docs.filter(lines.eligible("manufacturer", F.col("line"), F.lit(1)))
    assert [r[0] for r in fit.collect()] == ["abc"]


def test_label_offsets_survive_case_changes(spark):
    text = "Straße " * 60 + "valid UNTIL 2027-01-05"
    assert str(one(spark, D.date_after(F.lit(text), ["VALID UNTIL"]))) == "2027-01-05"


def test_company_core_keeps_a_name(spark):
    assert one(spark, X.company_core(F.lit("Acme Co., Ltd."))) == "ACME"
    assert one(spark, X.company_core(F.lit("LTD"))) == "LTD"


def test_add_year_on_leap_day(spark):
    assert str(one(spark, D.next_year(F.lit("2024-02-29").cast("date")))) == "2025-02-28"


# --- safety rules ----------------------------------------------------------------------------


def test_issuer_conflict_is_manual_review(spark):
    t, f = F.lit(True), F.lit(False)
    day = F.lit("2027-01-01").cast("date")
    out = DEC.reconcile(F.lit("HIGH"), F.lit("HQC"), F.lit("MUI"), t, t, t, day, day, f)
    assert one(spark, out["parse_status"]) == "MANUAL_REVIEW" and not one(spark, out["auto_confirm"])


def test_earlier_date_never_confirms(spark):
    t, f = F.lit(True), F.lit(False)
    old, new = F.lit("2026-01-01").cast("date"), F.lit("2027-01-01").cast("date")
    out = DEC.reconcile(F.lit("HIGH"), F.lit("HQC"), F.lit("HQC"), t, t, t, new, old, f)
    assert not one(spark, out["auto_confirm"]) and one(spark, out["date_regression"])
    out = DEC.reconcile(F.lit("HIGH"), F.lit("HQC"), F.lit("HQC"), t, t, t, old, new, f)
    assert one(spark, out["auto_confirm"])
    master = spark.createDataFrame([(1, "HQC", "2027-01-01")], "k int, org string, expiry string").withColumn("expiry", F.to_date("expiry"))
    upd = spark.createDataFrame([(1, "HQC", "2026-01-01")], "k int, norg string, nexp string").withColumn("nexp", F.to_date("nexp"))
    got = state.apply_updates(master, upd, "k", {"org": "norg", "expiry": "nexp"}, "expiry").first()
    assert got["outcome"] == "REFUSED_EARLIER_EXPIRY" and str(got["expiry"]) == "2027-01-01"


def test_no_auto_confirm_with_regression_anywhere(spark):
    from __spark_entry__ import queries

    gate = queries()["dec_4_context_gate"](spark, "/root/testdata/sf0.001")
    assert gate.filter("auto_confirm and date_regression").count() == 0
    assert gate.filter("context_status = 'CONFLICT' and parse_status <> 'MANUAL_REVIEW'").count() == 0


def test_previous_number_and_expiry_are_never_copied(spark):
    day = F.lit("2027-01-01").cast("date")
    cur = {"org": F.lit("HQC"), "cert_no": F.lit("CN1"), "expiry": day, "maker": F.lit("A")}
    for missing in ({"cert_no": F.lit("")}, {"expiry": F.lit(None).cast("date")}):
        inc = {**cur, **missing}
        code = DEC.change_code(cur, inc, F.lit(True), DEC.same_maker(cur["maker"], inc["maker"]))
        assert one(spark, code) == "INCOMPLETE_CERTIFICATE_REVIEW"
    assert "cert_no" not in DEC.reconcile(F.lit("HIGH"), F.lit("A"), F.lit("A"), F.lit(True), F.lit(True), F.lit(True), day, day, F.lit(False))


def test_canonical_name_only_if_seen(spark):
    body = F.lit("made by SOLARIS FOODS CO LTD in town")
    lines_ = F.split(body, "\n")
    for expected, want in (("Solaris Foods Co., Ltd.", "Solaris Foods Co., Ltd."), ("Nowhere Trading", "read")):
        seen = DEC.name_in_text(body, lines_, F.lit(expected))
        assert one(spark, DEC.canonical_name(F.lit("read"), F.lit(expected), seen["matched"], F.lit(False))) == want
    assert one(spark, DEC.canonical_name(F.lit("read"), F.lit("x"), F.lit(True), F.lit(True))) == "read"


def test_maintained_issuer_keeps_blank_expiry(spark):
    names = mailing.target_names(F.lit("1"), F.lit("Oil"), F.lit("ACME"), F.lit("S"), F.lit("bpjph"), F.lit("2027-01-01").cast("date"))
    assert one(spark, names["file_name"]) == "1. Oil(ACME)[BPJPH]S.pdf"
    none = mailing.target_names(F.lit("1"), F.lit("Oil"), F.lit("ACME"), F.lit("S"), F.lit("hqc"), F.lit(None).cast("date"))
    assert one(spark, none["file_name"]) is None
    got = DEC.consensus_status(F.lit("expiry"), F.lit("BPJPH"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(False), F.lit(0.0), F.lit(False))
    assert one(spark, got) == "MISSING_ALLOWED"
    for left, kind in ((-1, "KEEP_CHECK"), (5, None), (70, None)):
        got = aggregate.request_kind(F.lit("BPJPH"), F.date_add(F.lit("2026-06-30").cast("date"), left), "2026-06-30")
        assert one(spark, got) == kind


@pytest.mark.parametrize("left,kind", [(-400, "NOTICE"), (30, "NOTICE"), (31, None), (59, None), (60, "UPCOMING"), (90, "UPCOMING"), (91, None)])
def test_request_kind_limits(spark, left, kind):
    got = aggregate.request_kind(F.lit("HQC"), F.date_add(F.lit("2026-06-30").cast("date"), left), "2026-06-30")
    assert one(spark, got) == kind


# --- gate ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "code,asked,action,error",
    [
        ("SAME_AUTHORITY_RENEWAL", "", "UPDATE_CURRENT", None), ("SAME_AUTHORITY_RENEWAL", "REPLACE_CURRENT", None, "CANNOT_OVERRIDE"),
        ("CERTIFICATE_NUMBER_CHANGED", "approve_renewal", "UPDATE_CURRENT", None), ("AUTHORITY_CHANGE_REVIEW", "HOLD", None, "NOT_A_CONFIRMATION"),
        ("AUTHORITY_CHANGE_REVIEW", "", None, "ACTION_REQUIRED"), ("WRONG_CERTIFICATE", "REJECT", None, "BLOCKED"), ("DUPLICATE", "", None, "NOT_A_CONFIRMATION"),
    ],
)
def test_confirm_gate(spark, code, asked, action, error):
    a, _, e = DEC.confirm_gate(F.lit(code), F.lit(asked))
    assert (one(spark, a), one(spark, e)) == (action, error)


# --- hot keys: a third of the rows in one group ------------------------------------------------


def hot(spark, n=3000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 11).alias("v")
    )


def test_running_sums_match_window(spark):
    df = hot(spark)
    got = rank.running_sums(df, ["k"], [F.asc("o")], F.floor(F.col("o") / 100), {"s": F.col("v")})
    want = df.withColumn("s", F.sum("v").over(W.partitionBy("k").orderBy("o")))
    assert rows(got.select("k", "o", "s")) == rows(want.select("k", "o", "s"))


def test_neighbours_match_window(spark):
    df = hot(spark)
    got = rank.with_neighbours(df, ["k"], ["o"], F.floor(F.col("o") / 64), ["o"]).select("k", "o", "prev.o", "next.o")
    w = W.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.lag("o").over(w), F.lead("o").over(w))
    assert rows(got) == rows(want)


def test_fill_from_above_over_chunks(spark):
    df = spark.range(2000).select(F.lit("s").alias("s"), F.col("id").alias("p"), F.when((F.col("id") % 97 == 0) & (F.col("id") % 5 != 0), F.col("id").cast("string")).alias("v"))
    got = reshape.fill_from_above(df, "s", "p", "v", reach=50, chunk=64).select("p", "filled")
    want = df.select("p", F.last("v", True).over(W.partitionBy("s").orderBy("p").rowsBetween(-50, 0)))
    assert rows(got) == rows(want)


def test_large_group_is_sent_in_parts(spark):
    items = hot(spark, 300).filter("k = 'hot'").select(F.lit("S").alias("supplier"), "o", F.col("o").cast("string").alias("path"), F.lit("m").alias("maker"))
    out = mailing.render_bodies(items, ["supplier"], "o", "path", {"maker": "maker"}, "[ITEMS]", per_message=30, bucket=40)
    assert sorted(r["item_count"] for r in out.collect()) == [10, 30, 30, 30]
    numbers = [r[0] for r in out.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^(\d+)\. "), F.lit(1)))).collect()]
    assert sorted(map(int, numbers)) == list(range(1, 101))


def test_page_lines_number_through_pages(spark):
    pages = spark.range(50).select(F.lit(1).alias("d"), F.col("id").alias("page"), F.concat(F.lit("a\n\nb"), F.col("id").cast("string")).alias("t"))
    got = lines.page_lines(pages, "d", "page", "t", bucket=7).orderBy("global_index").collect()
    assert [r["global_index"] for r in got] == list(range(100))
    assert [r["line_no"] for r in got][:4] == [1, 3, 1, 3] and got[-1]["line"] == "b49"


# --- history ---------------------------------------------------------------------------------


def brute_history(events):
    table = []
    for e in sorted(events, key=lambda x: (x["at"], x["id"])):
        if e["action"] == "ADD_SECONDARY":
            if not any(t["material"] == e["material"] and t["role"] == "SECONDARY" and t["key"] == (e["org"], e["cert_no"], e["expiry"]) for t in table):
                table.append({"id": e["id"], "material": e["material"], "role": "SECONDARY", "status": "ACTIVE", "sup": None, "key": (e["org"], e["cert_no"], e["expiry"])})
            continue
        old = [t for t in table if t["material"] == e["material"] and t["role"] == "PRIMARY" and t["status"] == "ACTIVE"]
        for t in old:
            t["status"] = "SUPERSEDED"
        table.append({"id": e["id"], "material": e["material"], "role": "PRIMARY", "status": "ACTIVE", "sup": old[-1]["id"] if old else None, "key": None})
    return sorted(((t["id"], t["material"], t["role"], t["status"], t["sup"]) for t in table), key=str)


def random_events(n, seed):
    rnd = random.Random(seed)
    return [
        {"id": i, "material": 0 if i % 3 == 0 else rnd.randrange(1, 9), "org": rnd.choice("AB"), "cert_no": rnd.choice("12"), "expiry": "2026", "action": rnd.choice(["UPDATE_CURRENT", "REPLACE_CURRENT", "ADD_SECONDARY"]), "at": i}
        for i in range(1, n + 1)
    ]


SCHEMA = "id bigint, material bigint, org string, cert_no string, expiry string, action string, at bigint"


def test_history_matches_sequential_fold(spark):
    events = random_events(400, 1)
    df = spark.createDataFrame([tuple(e.values()) for e in events], SCHEMA)
    out = state.certificate_history(df, ["material"], F.floor(F.col("at") / 50))
    assert rows(out.select("id", "material", "role", "status", "supersedes_id")) == brute_history(events)
    active = out.filter("role = 'PRIMARY' and status = 'ACTIVE'").groupBy("material").count().filter("count > 1")
    assert active.count() == 0


def test_rollback_restores_previous_primary(spark):
    df = spark.createDataFrame(
        [(1, 5, "A", "1", "x", "UPDATE_CURRENT", 1, None), (2, 5, "A", "2", "x", "UPDATE_CURRENT", 2, None), (3, 5, "A", "2", "x", "ROLLBACK", 3, 2)], SCHEMA + ", target_id bigint"
    )
    out = state.certificate_history(state.drop_rolled_back(df), ["material"], F.floor(F.col("at") / 50)).collect()
    assert [(r["id"], r["status"]) for r in out] == [(1, "ACTIVE")]


def test_history_stream_of_many_batches_equals_batch(spark, tmp_path):
    from attestry.streaming import feeds

    events = random_events(300, 2)
    df = spark.createDataFrame([tuple(e.values()) for e in events], SCHEMA)
    for part in range(5):
        df.filter((F.col("at") > part * 60) & (F.col("at") <= part * 60 + 60)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = feeds.landed(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    feeds.run_available(stream, out, str(tmp_path / "cp"), "append", feeds.history_batches(["material"], out, F.floor(F.col("at") / 50)))
    got = feeds.read_history(spark, out, ["material"]).select("id", "material", "role", "status", "supersedes_id")
    assert spark.read.parquet(f"{out}/opened").select("batch").distinct().count() == 5
    assert rows(got) == brute_history(events)


# --- linkage against brute force ---------------------------------------------------------------


def words(n, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcd ") for _ in range(rnd.randrange(2, 14))) for _ in range(n)]
    noisy = [w[: i % len(w)] + rnd.choice("abcd") + w[i % len(w) + (i % 2):] for i, w in enumerate(base)]
    return base, noisy


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("metric,threshold", [("levenshtein", 0.7), ("levenshtein", 0.82), ("gestalt", 0.81), ("gestalt", 0.82)])
def test_fuzzy_pairs_are_complete(spark, metric, threshold):
    a, b = words(80, 3)
    got = L.fuzzy_pairs(spark.createDataFrame([(w,) for w in a], "w string"), "w", spark.createDataFrame([(w,) for w in b], "w string"), "w", threshold, metric)
    ratio = (lambda x, y: 1 - edit(x, y) / max(len(x), len(y))) if metric == "levenshtein" else (lambda x, y: SequenceMatcher(None, x, y).ratio())
    want = {(x, y) for x in a for y in b if x and y and ratio(x, y) >= threshold}
    assert {(r["left_key"], r["right_key"]) for r in got.collect()} == want


def test_thresholds_below_the_bound_are_refused(spark):
    df = spark.createDataFrame([("ab",)], "w string")
    for metric, threshold in (("levenshtein", 0.69), ("gestalt", 0.80)):
        with pytest.raises(ValueError):
            L.fuzzy_pairs(df, "w", df, "w", threshold, metric)


def test_containment_paths_agree(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc") for _ in range(60)) for _ in range(40)]
    keys = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 8))) for _ in range(60)]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    k = spark.createDataFrame([(x,) for x in keys], "k string")
    want = sorted({(i, x) for i, s in enumerate(texts) for x in keys if x in s}, key=str)
    assert rows(L.contains_join(t, "i", "t", k, "k")) == want
    by_grams = L.gram_containment(t, "i", "t", k.select(F.col("k").alias("_key")).distinct(), "k")
    assert rows(by_grams) == want


def test_keys_that_begin_alike_do_not_meet_every_text(spark):
    t = spark.range(300).select("id", F.format_string("the text %04d", "id").alias("t"))
    k = spark.range(300).select(F.format_string("the text %04d", F.col("id") * 2).alias("_key"))
    candidates = L.gram_candidates(t, "id", "t", k, 4)
    assert candidates.count() == 150
    assert rows(L.gram_containment(t, "id", "t", k, "k")) == sorted(((i, f"the text {i:04d}") for i in range(0, 300, 2)), key=str)


def test_pages_of_a_long_text_cut_it_once(spark):
    import time

    from attestry.operators import lines

    n = 8000
    docs = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("[PAGE "), i.cast("string"), F.lit("]\nline "), i.cast("string"))), "").alias("t"))
    docs = docs.withColumn("t", F.concat(F.lit("lead "), "t"))
    began = time.monotonic()
    got = docs.select(F.inline(lines.lines_of(F.col("t")))).collect()
    assert [tuple(r) for r in got] == [(i, 2, f"line {i}") for i in range(1, n + 1)]
    assert time.monotonic() - began < 15  # cut again for each page, this text takes minutes


def test_evidence_of_plain_and_other_lines(spark):
    from attestry.operators import extract as EX

    lines = ["Solaris Web Co., Ltd.", "Solaris Family of Products Web Co Ltd", "SOLARIS® WEB CO LTD", "Stra\u00dfe 9", "", "Solaris Web"]
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate(lines)], "i int, l array<string>")
    evidence = EX.value_evidence(F.col("l"), F.lit("SOLARIS WEB CO LTD"), F.lit("maker"))
    got = [(r[0], r[1]) for r in df.orderBy("i").select(evidence.alias("e")).select("e.score", "e.found").collect()]
    assert [f for _, f in got] == [True, True, True, False, False, True]
    assert got[0][0] == 1.0 and got[2][0] == 1.0


def test_near_duplicates_are_complete(spark):
    rnd = random.Random(5)
    docs = []
    for i in range(60):
        base = {f"w{rnd.randrange(40)}": rnd.randrange(1, 6) for _ in range(12)} if i % 3 else dict(docs[-1] if docs else {"w1": 3.0})
        if not i % 3:
            base[f"w{rnd.randrange(40)}"] = 1
        docs.append(base)
    long = [(("c" if i % 2 else "d"), i, f, float(w)) for i, dct in enumerate(docs) for f, w in dct.items()]
    df = spark.createDataFrame(long, "cls string, id int, f string, w double")

    def cos(a, b):
        dot = sum(w * b.get(f, 0) for f, w in a.items())
        return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    for threshold in (0.8, 0.97):
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and cos(docs[i], docs[j]) >= threshold}
        got = {(r["a"], r["b"]) for r in L.near_duplicates(df, "cls", "id", "f", "w", threshold).collect()}
        assert got == want


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, j) for j in range(2, 40)] + [(500, 501)]
    got = dict(tuple(r) for r in L.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {got[i] for i in range(100, 141)} == {100} and {got[j] for j in range(1, 40)} == {1} and got[501] == 500


def test_top_matches_with_hot_group(spark):
    rnd = random.Random(6)
    names = ["cert", "name", "maker", "org"]
    weights = {"cert": 120, "name": 90, "maker": 60, "org": 35}

    def attrs(i):
        return (None if rnd.random() < 0.3 else f"c{rnd.randrange(40)}", "hot" if i % 3 == 0 else f"n{rnd.randrange(8)}", f"m{rnd.randrange(3)}", f"o{rnd.randrange(2)}")

    master = [(i, *attrs(i)) for i in range(300)]
    items = [(i, *attrs(i)) for i in range(40)]
    m = spark.createDataFrame(master, "pos int, cert string, name string, maker string, org string")
    it = spark.createDataFrame(items, "item int, cert string, name string, maker string, org string")
    got = L.top_matches(it, "item", m, ["pos"], weights, ["cert", "name"], 5)
    want = []
    for item in items:
        scored = []
        for row in master:
            same = [a is not None and a == b for a, b in zip(item[1:], row[1:])]
            if same[0] or same[1]:
                scored.append((-sum(w for w, s in zip(weights.values(), same) if s), row[0]))
        want += [(item[0], pos, -neg) for neg, pos in sorted(scored)[:5]]
    assert rows(got.select("item", "pos", "score")) == sorted(want, key=str)
    assert names == list(weights)


def test_top_matches_pack_small_groups(spark, monkeypatch):
    """Small groups are not multiplied by the sets of equal fields; packed and hot groups give the same rows."""
    rnd = random.Random(9)
    row = lambda i: (i, rnd.choice([None, f"c{i % 50}"]), f"n{i % 60}", rnd.choice([None, "m1", "m2"]), f"o{i % 3}")
    m = spark.createDataFrame([row(i) for i in range(400)], "pos int, cert string, name string, maker string, org string")
    it = spark.createDataFrame([row(i) for i in range(120)], "item int, cert string, name string, maker string, org string")
    weights = {"cert": 120, "name": 90, "maker": 60, "org": 35}
    match = lambda: L.top_matches(it, "item", m, ["pos"], weights, ["cert", "name"], 3)
    small = match()
    assert "_mask" not in small._jdf.queryExecution().optimizedPlan().toString()
    want = rows(small)
    monkeypatch.setattr(L, "GROUP_ROWS", 6)
    mixed = match()
    assert "_mask" in mixed._jdf.queryExecution().optimizedPlan().toString()
    assert rows(mixed) == want and len(want) > 120


# --- extraction ------------------------------------------------------------------------------


def test_override_rule_kinds(spark):
    docs = spark.createDataFrame([("HQC", "Valid until 2027-03-01. REF ZZ 77", "x", "", "Company: Acme Ltd 5 High Street", "LOW")], "issuer string, text string, cert_no string, expiry string, maker string, parse_status string")
    rules_ = [
        {"rule_kind": "date_anchor", "target_org": "MUI", "target_field": "expiry", "anchors": ["VALID UNTIL"]},
        {"rule_kind": "code_pattern", "target_org": "ALL", "target_field": "cert_no", "patterns": [r"ZZ\s*\d+"]},
        {"rule_kind": "maker_cleanup", "target_org": "HQC"},
    ]
    got = EX.apply_overrides(docs, "text", "issuer", rules_).first()
    assert (got["expiry"], got["cert_no"], got["maker"]) == ("", "ZZ77", "Acme Ltd")
    with pytest.raises(ValueError):
        EX.apply_overrides(docs, "text", "issuer", [{"rule_kind": "other"}])


def test_never_raises_on_odd_documents(spark):
    from attestry.plans.extraction import read_documents

    odd = ["", " ", "\n\n", "[PAGE 1]", "ß" * 50, "Valid until 99/99/2099", "1.\n2\n", "\u0000", "Manufactured by:", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id int, text string")
    assert read_documents(df).count() == len(odd)
    assert len(read_documents(df).collect()) == len(odd)


def test_issuer_needs_enough_hits(spark):
    table = [("A", ["ALPHA"], 1), ("I", ["ISA", "ISLAMIC"], 2)]
    for text, want in (("isa islamic", "I"), ("isa only", "I"), ("isa and alpha", "A"), ("none", "UNKNOWN")):
        assert one(spark, EX.detect_issuer(F.lit(text), table)) == want


def test_texts_and_lists_are_whole_by_default(spark):
    from pyspark.sql import functions as F

    from attestry.functions import text as X
    from attestry.operators import rules

    pages = ["a" * 9000, "b" * 900, "c", "d", "e", "f" * 900]
    text = "".join(f"mark {k:03d} " + "x" * 200 for k in range(60))
    terms = [f"term {k:03d}" for k in range(100)]
    df = spark.createDataFrame([(pages, text, ",".join(terms))], "pages array<string>, text string, list string")
    weighted, windows, found = df.select(
        rules.weighted_text(F.col("pages")), rules.marker_windows(F.col("text"), ["mark"], 5, 20, whole=6000), X.simple_terms(F.col("list"), ["stop"])
    ).first()
    assert weighted == " ".join(pages[:1] * 3 + pages[1:])
    assert all(f"mark {k:03d}" in windows for k in range(60))
    assert found == terms
    long, none = df.select(
        rules.marker_windows(F.col("text"), ["mark"], 180, 5000, whole=6000), rules.marker_windows(F.col("text"), ["absent"], 180, 520, whole=6000)
    ).first()
    assert len(long) > 6000 and none == text


def test_levels_are_exploded_before_cells_are_cleaned(spark):
    """An exploded expression is copied into what is asked of its fields, so a search over cleaned cells was never planned."""
    cells = {2: " Salt ", 4: "Maker 1", 0: "7", 15: "nan", 17: "Maker 1", 24: "Oil", 26: " - ", 33: None, 42: "  ", 43: "x"}
    wide = spark.range(1).select(F.col("id").alias("row_pos"), *[F.when(F.col("id") == 0, F.lit(cells.get(i)).cast("string")).alias(f"c{i}") for i in range(51)])
    long = reshape.flatten_master(wide)
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(trim" in plan and "lower(trim" not in plan[plan.index("Generate inline(") :]
    assert long.columns == ["row_pos", "material_no", "supplier", "email", "depth", "name", "english_name", "maker", "maker_country", "org", "cert_no", "expiry"]
    assert rows(long.select("row_pos", "material_no", "depth", "name", "maker")) == [(0, "7", 0, "Salt", "Maker 1"), (0, "7", 2, "Oil", None)]
    found = filters.search_levels(long, "Maker 1", "row_pos", "depth", ["name", "maker"], 5)
    assert rows(found) == [(0, 0, "Salt", "Maker 1")]


def test_keys_longer_than_every_text_are_not_cut_into_grams(spark, monkeypatch):
    cut, whole = [], L.gram_containment
    monkeypatch.setattr(L, "gram_containment", lambda texts, text_id, text, words, *more: cut.append(words.count()) or whole(texts, text_id, text, words, *more))
    texts = spark.createDataFrame([(1, "short text of a name"), (2, "xx"), (3, None)], "i long, t string")
    keys = spark.createDataFrame([(f"key {k} " * 50,) for k in range(600)] + [("text",), ("a name",), ("xx",), ("of a nam",)], "k string")
    assert rows(L.contains_join(texts, "i", "t", keys, "k", shortest=1)) == [(1, "a name"), (1, "of a nam"), (1, "text"), (2, "xx")]
    assert L.contains_join(texts.limit(0), "i", "t", keys, "k").count() == 0 and cut == [4, 0]
