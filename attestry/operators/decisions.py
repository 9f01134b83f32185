"""Decision tables of the certificate life cycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.functions.similarity import METRICS, ladder_from
from attestry.operators import rules

# Issuers without a fixed expiry, and what counts as no issuer.
EXPIRY_OPTIONAL = ("BPJPH",)
NO_ISSUER = ("", "UNKNOWN", "UNDETECTED", "NO_TEXT")

# Code -> (review, blocked, action, may update, options).
CHANGE_OUTCOMES = {
    "WRONG_CERTIFICATE": (True, True, "BLOCK", False, ("REJECT", "MANUAL_REASSIGN")),
    "MANUFACTURER_CHANGED": (True, True, "BLOCK", False, ("APPROVE_MANUFACTURER_CHANGE", "REJECT")),
    "OCR_REVIEW_REQUIRED": (True, True, "REVIEW", False, ("MANUAL_CORRECTION", "REJECT")),
    "NEW_CERTIFICATE": (True, False, "REVIEW", False, ("REGISTER_AS_PRIMARY", "REJECT")),
    "AUTHORITY_CHANGE_REVIEW": (True, False, "REVIEW", False, ("REPLACE_CURRENT", "ADD_SECONDARY", "HOLD", "REJECT")),
    "INCOMPLETE_CERTIFICATE_REVIEW": (True, False, "REVIEW", False, ("MANUAL_CORRECTION", "KEEP_EXISTING_VALUE", "REJECT")),
    "DUPLICATE": (False, False, "SKIP", False, ()),
    "SAME_AUTHORITY_RENEWAL": (False, False, "UPDATE_CURRENT", True, ()),
    "OLDER_CERTIFICATE": (True, False, "REVIEW", False, ("KEEP_CURRENT", "REGISTER_AS_HISTORY", "REJECT")),
    "SAME_AUTHORITY_UPDATE_REVIEW": (True, False, "REVIEW", False, ("UPDATE_CURRENT", "KEEP_CURRENT", "REJECT")),
    "CERTIFICATE_NUMBER_CHANGED": (True, False, "REVIEW", False, ("APPROVE_RENEWAL", "ADD_SECONDARY", "KEEP_CURRENT", "REJECT")),
}


def _plain(c: Column) -> Column:
    return X.norm_key(F.coalesce(c, F.lit("")), keep="A-Z0-9")


def same_maker(current: Column, incoming: Column, metric: str = "levenshtein") -> Column:
    """NULL if one side is unknown; else equal, nearly equal, or equal without legal form."""
    a, b = _plain(current), _plain(incoming)
    core_a, core_b = X.company_core(F.coalesce(current, F.lit(""))), X.company_core(F.coalesce(incoming, F.lit("")))
    near = METRICS[metric]
    close = (
        (a == b) | (near(a, b) >= 0.92) | ((core_a != "") & (core_a == core_b))
        | ((F.least(F.length(core_a), F.length(core_b)) >= 8) & (near(core_a, core_b) >= 0.92))
    )
    return F.when((a != "") & (b != ""), close)


def change_code(cur: dict[str, Column], inc: dict[str, Column], product_match: Column, maker_match: Column) -> Column:
    """What an incoming certificate means for the current one.

    ``cur`` and ``inc`` hold org, cert_no, maker (text) and expiry (date)."""
    text = lambda c: X.squash(F.coalesce(c, F.lit("")))
    inc_org = F.upper(text(inc["org"]))
    has_current = (
        (text(cur["org"]) != "") | (text(cur["cert_no"]) != "") | cur["expiry"].isNotNull() | (text(cur["maker"]) != "")
    )
    missing = (
        (text(inc["cert_no"]) == "") | (inc["expiry"].isNull() & ~inc_org.isin(*EXPIRY_OPTIONAL)) | (text(inc["maker"]) == "")
    )
    same_no = _plain(cur["cert_no"]) == _plain(inc["cert_no"])
    return rules.decide([
        (~product_match, "WRONG_CERTIFICATE"),
        (F.coalesce(~maker_match, F.lit(False)), "MANUFACTURER_CHANGED"),
        (inc_org.isin(*NO_ISSUER), "OCR_REVIEW_REQUIRED"),
        (~has_current, "NEW_CERTIFICATE"),
        (_plain(cur["org"]) != _plain(inc["org"]), "AUTHORITY_CHANGE_REVIEW"),
        (missing, "INCOMPLETE_CERTIFICATE_REVIEW"),
        (same_no & cur["expiry"].eqNullSafe(inc["expiry"]), "DUPLICATE"),
        (same_no & F.coalesce(inc["expiry"] > cur["expiry"], F.lit(False)), "SAME_AUTHORITY_RENEWAL"),
        (same_no & F.coalesce(inc["expiry"] < cur["expiry"], F.lit(False)), "OLDER_CERTIFICATE"),
        (same_no, "SAME_AUTHORITY_UPDATE_REVIEW"),
    ], "CERTIFICATE_NUMBER_CHANGED")


def change_outcome(code: Column) -> Column:
    """Attributes of a change code as one struct."""
    def pick(i: int) -> Column:
        return rules.decide([(code == k, F.lit(v[i])) for k, v in CHANGE_OUTCOMES.items()])

    options = rules.decide(
        [(code == k, F.array(*[F.lit(o) for o in v[4]]).cast("array<string>")) for k, v in CHANGE_OUTCOMES.items()], F.lit(None).cast("array<string>")
    )
    return F.struct(pick(0).alias("requires_review"), pick(1).alias("blocked"), pick(2).alias("auto_action"), pick(3).alias("can_update"), options.alias("review_options"))


def field_changes(cur: dict[str, Column], inc: dict[str, Column]) -> Column:
    """Per field what was, what would be, and whether it differs beyond notation."""
    pairs = []
    for name in cur:
        before, after = cur[name].cast("string"), inc[name].cast("string")
        pairs += [F.lit(name), F.struct(before.alias("before"), after.alias("after"), (_plain(before) != _plain(after)).alias("changed"))]
    return F.create_map(*pairs)


def parse_status(failed: Column, non_cert: Column, has_text: Column, org: Column, expiry: Column, cert_no: Column, maker: Column,
                 products: Column, product_score: Column, filename_only: Column) -> tuple[Column, Column]:
    """Reading status and confidence of a document."""
    known = org != "UNKNOWN"
    full = known & expiry & (cert_no | products | maker)
    matched = products & (product_score >= 0.72)
    cases = [
        (failed, "TESSERACT_ERROR", "LOW"),
        (non_cert, "NON_CERTIFICATE_DOC", "HIGH"),
        (~has_text, "SCANNED_NEED_OCR", "LOW"),
        ((org == "BPJPH") & (cert_no | products), "BPJPH_MAINTENANCE_ONLY", "MEDIUM"),
        (org == "BPJPH", "BPJPH_MAINTENANCE_ONLY", "LOW"),
        (filename_only, "FILENAME_ONLY", "LOW"),
        (full & matched, "RULE_MATCHED", "HIGH"),
        (full, "LOW_CONFIDENCE", "MEDIUM"),
        (known & (expiry | cert_no), "LOW_CONFIDENCE", "MEDIUM"),
    ]
    return (
        rules.decide([(p, s) for p, s, _ in cases], "MANUAL_REVIEW"),
        rules.decide([(p, c) for p, _, c in cases], "LOW"),
    )


def reconcile(reliability: Column, expected_org: Column, read_org: Column, maker_verified: Column, product_verified: Column,
              cert_no_match: Column, current_expiry: Column, read_expiry: Column, blocking: Column) -> dict[str, Column]:
    """Cross-check of a reading with its request and master context.

    Invariants: an issuer conflict always ends in MANUAL_REVIEW; an expiry earlier than the
    current one is never confirmed; the previous number and expiry are compared, never copied."""
    read_known = F.coalesce(read_org != "UNKNOWN", F.lit(False))
    conflict = F.coalesce(read_known & expected_org.isNotNull() & (read_org != expected_org), F.lit(False))
    fallback = ~read_known & expected_org.isNotNull() & reliability.isin("HIGH", "MEDIUM")
    org_match = F.coalesce(read_known & (read_org == expected_org), F.lit(False)) | fallback
    regression = F.coalesce(read_expiry < current_expiry, F.lit(False))
    score = rules.points([(org_match, 35), (maker_verified, 30), (product_verified, 25), (cert_no_match, 10)])
    final_org = F.when(fallback, expected_org).otherwise(read_org)
    dated = (final_org == "BPJPH") | read_expiry.isNotNull()
    eligible = (
        (reliability == "HIGH") & ~conflict & ~blocking & ~regression & org_match & (maker_verified | product_verified) & dated
    )
    status = rules.decide([(conflict, "CONFLICT"), (blocking, "PROFILE_REVIEW"), (eligible, "VERIFIED"), (score >= 35, "ASSISTED")], "UNVERIFIED")
    parse = rules.decide([
        (status.isin("CONFLICT", "PROFILE_REVIEW"), "MANUAL_REVIEW"), (status == "VERIFIED", "RULE_MATCHED"), (status == "ASSISTED", "LOW_CONFIDENCE"),
    ], "UNCHANGED")
    return {
        "final_org": final_org, "context_score": score, "context_status": status, "parse_status": parse,
        "date_regression": regression, "auto_confirm": F.coalesce(eligible, F.lit(False)),
    }


def name_in_text(text: Column, lines: Column, expected: Column) -> Column:
    """struct(matched, score): whether an expected name stands in a text, as a whole or nearly in one line."""
    def search(key: Column) -> Column:
        scores = F.transform(lines, lambda ln: X.let(X.norm_key(ln), lambda k: ladder_from(k, key, 0.74, base=0.75, span=0.20, shortest=4)))
        score = F.when(key == "", F.lit(0.0)).when(F.contains(X.norm_key(text), key), F.lit(1.0)).otherwise(F.coalesce(F.array_max(scores), F.lit(0.0)))
        return X.let(F.round(score, 4), lambda v: F.struct((v >= 0.74).alias("matched"), v.alias("score")))

    return X.let(X.norm_key(F.coalesce(expected, F.lit(""))), search)


def canonical_name(read: Column, expected: Column, seen: Column, conflict: Column) -> Column:
    """The master's spelling only where the text shows the name and the issuers agree; else what was read."""
    return F.when(expected.isNotNull() & seen & ~conflict, expected).otherwise(read)


# Quality flags that stop an automatic confirmation.
BLOCKING_FLAGS = (
    "FILENAME_ORG_CONFLICT", "CERT_NO_MISSING", "CERT_NO_OCR_UNCERTAIN", "EXPIRY_MISSING", "EXPIRY_LABEL_UNREADABLE", "MANUFACTURER_UNRELIABLE",
)


def finalise_profile(body_org: Column, name_org: Column, base_org: Column, cert_no: Column, expiry: Column, expiry_from_name: Column,
                     anchor_present: Column, maker_suspicious: Column) -> dict[str, Column]:
    """Issuer by strength of its source, and the quality flags of a reading."""
    known = lambda c: c != "UNKNOWN"
    source = rules.decide([(known(body_org), "TEXT_STRONG"), (known(name_org), "FILENAME_FALLBACK")], "BASE_RULE")
    org = rules.decide([(known(body_org), body_org), (known(name_org), name_org)], base_org)
    dated = ~org.isin(*EXPIRY_OPTIONAL)
    flags = rules.reasons([
        (known(body_org) & known(name_org) & (body_org != name_org), "FILENAME_ORG_CONFLICT"),
        (org != base_org, "ORG_CHANGED_FROM_BASE_RULE"),
        (source == "FILENAME_FALLBACK", "FILENAME_DEPENDENT_ORG"),
        (dated & ~cert_no, "CERT_NO_MISSING"),
        (dated & ~expiry, "EXPIRY_MISSING"),
        (maker_suspicious, "MANUFACTURER_UNRELIABLE"),
        (expiry & expiry_from_name, "EXPIRY_FROM_FILENAME"),
        (expiry & expiry_from_name & dated & anchor_present, "EXPIRY_LABEL_UNREADABLE"),
    ])
    return {"org": org, "org_source": source, "flags": flags, "blocking": F.sort_array(F.array_intersect(flags, F.array(*[F.lit(b) for b in BLOCKING_FLAGS])))}


def final_issuer(excluded: Column, admin_org: Column, image_decision: Column, image_org: Column, text_org: Column) -> tuple[Column, Column, Column]:
    """Issuer from image, text and administrator: (issuer, source, conflict)."""
    no_text = text_org.isNull() | text_org.isin("", "UNKNOWN")
    org = rules.decide([
        (excluded, "-"), (admin_org.isNotNull(), admin_org), (image_decision == "AUTO_IMAGE", image_org), (~no_text, text_org),
    ], image_org)
    source = rules.decide([
        (excluded, "ADMIN_EXCLUDED"), (admin_org.isNotNull(), "ADMIN"), (image_decision == "AUTO_IMAGE", "IMAGE_AUTO"), (~no_text, "TEXT_RULE"),
    ], "IMAGE_REVIEW_CANDIDATE")
    conflict = F.when(excluded | no_text, F.lit(False)).otherwise(image_org != text_org)
    return org, source, conflict


# Weight of a vote by its source.
SOURCE_WEIGHTS = {"master": 5, "full_rule": 4, "conditional_rule": 3, "filename": 2}


def consensus(votes: DataFrame, keys: Sequence[str], source: str, value: str) -> DataFrame:
    """Weighted vote per (document, field): winning value, its sources, and whether others disagree."""
    weight = rules.decide([(F.col(source) == s, w) for s, w in SOURCE_WEIGHTS.items()], 1)
    keyed = votes.filter(~X.is_missing(F.col(value))).withColumn("_k", X.norm_key(F.col(value))).filter("_k <> ''")
    groups = keyed.groupBy(*keys, "_k").agg(
        F.sum(weight).alias("w"), F.count("*").alias("n"), F.sort_array(F.collect_set(source)).alias("sources"),
        F.min_by(value, -weight).alias("value"),
    )
    best = groups.groupBy(*keys).agg(
        F.max_by(F.struct("value", "sources", "w"), F.struct("w", "n", "_k")).alias("b"), F.count("*").alias("values_n")
    )
    return best.select(*keys, "b.value", "b.sources", F.col("b.w").alias("weight"), (F.col("values_n") > 1).alias("conflict"))


def consensus_status(field: Column, issuer: Column, value: Column, sources: Column, conflict: Column, evidence: Column, strong_link: Column) -> Column:
    """READY, CANDIDATE, REVIEW or MISSING from agreement and evidence in the text."""
    both = F.array_contains(sources, "full_rule") & F.array_contains(sources, "conditional_rule")
    linked = strong_link & F.array_contains(sources, "master")
    return rules.decide([
        (value.isNull() & (field == "expiry") & issuer.isin(*EXPIRY_OPTIONAL), "MISSING_ALLOWED"),
        (value.isNull(), "MISSING_REQUIRED"),
        (conflict, "REVIEW_REQUIRED"),
        (field.isin("cert_no", "expiry") & both & (evidence >= 0.95), "AUTO_READY"),
        (field.isin("cert_no", "expiry") & linked & (evidence >= 0.72), "AUTO_READY"),
        ((field == "maker") & linked & (evidence >= 0.72), "AUTO_READY"),
        ((field == "maker") & both & (evidence >= 0.90), "AUTO_READY"),
        ((field == "country") & (linked | (both & (evidence >= 0.95))), "AUTO_READY"),
    ], "CANDIDATE_ONLY")


def promotable(field: Column, status: Column, value: Column, sources: Column, evidence: Column, company_like: Column) -> Column:
    """Whether a reviewed label is safe to train on: both rule paths agree and the text shows it.
    Countries and products are never promoted."""
    both = F.array_contains(sources, "full_rule") & F.array_contains(sources, "conditional_rule")
    per_field = rules.decide([
        (field == "cert_no", (evidence >= 0.95) & (F.length(value) >= 5)),
        (field == "maker", (evidence >= 0.90) & (F.length(value) >= 4) & company_like),
        (field == "expiry", (evidence >= 0.95) & value.rlike(r"^\d{4}-\d{2}-\d{2}$")),
    ], F.lit(False))
    return F.coalesce((status == "REVIEW_REQUIRED") & both & per_field, F.lit(False))


def classify_field_change(field: Column, before: Column, after: Column, expected: Column) -> Column:
    """Effect of a rule change on one field. Dates are ISO text here, so they compare as text."""
    b, a = F.coalesce(X.to_null(before), F.lit("")), F.coalesce(X.to_null(after), F.lit(""))
    iso = r"^\d{4}-\d{2}-\d{2}$"
    dated = (field == "expiry") & b.rlike(iso) & a.rlike(iso)
    return rules.decide([
        (b == a, "UNCHANGED"),
        (F.coalesce(F.array_contains(expected, a), F.lit(False)), "IMPROVED"),
        ((b == "") & (a != ""), "IMPROVED"),
        ((b != "") & (a == ""), "REGRESSION"),
        (dated & (a < b), "REGRESSION"),
        (field.isin("org", "cert_country") & ~dated, "MANUAL_REVIEW"),
    ], "CHANGED_REVIEW")


def may_auto_apply(target_org: Column, target_field: Column, risk: Column, regressions: Column, improved: Column) -> Column:
    wildcard = F.upper(F.trim(F.coalesce(target_org, F.lit("")))).isin("", "ALL", "ANY", "*")
    return ~wildcard & ~target_field.isin("org", "cert_country") & risk.isin("LOW", "MEDIUM") & (regressions == 0) & (improved >= 1)


# Reading states that cannot be confirmed.
BLOCKED_PARSE = ("LOW_CONFIDENCE", "MANUAL_REVIEW", "TESSERACT_ERROR", "SCANNED_NEED_OCR", "NO_TEXT", "ERROR")


def filing_checks(job_status: Column, parse: Column, org: Column, expiry: Column, cert_no: Column, material: dict[str, Column],
                  has_item: Column, planned_expiry: Column) -> dict[str, Column]:
    """Warnings, blockers and hard blockers before a certificate is filed."""
    kept = F.coalesce(org, F.lit("")) == "BPJPH"
    hard = [(~has_item, "no_request_item")]
    soft = [
        (F.upper(job_status) != "DONE", "job_not_done"),
        (parse.isin(*BLOCKED_PARSE), "reading_not_confirmed"),
        (org.isNull() | org.isin("", "UNKNOWN"), "no_issuer"),
        *[(X.is_missing(c), f"no_{name}") for name, c in material.items()],
        (~kept & expiry.isNull(), "no_expiry"),
        (kept & has_item & planned_expiry.isNull(), "no_planned_expiry"),
    ]
    return {
        "warnings": rules.reasons([(X.is_missing(cert_no), "no_cert_no")]),
        "hard_blockers": rules.reasons(hard),
        "blockers": rules.reasons(hard + soft),
    }


AUTO_MATCH_SCORE = 150  # fixed value: points from which the best master row is taken without a question


def auto_match(hard_blockers: Column, parse: Column, score: Column, selectable: Column) -> Column:
    """Whether a filing takes its best master row by itself: enough points, a clear choice, a sure reading, no hard blocker."""
    sure = ~F.coalesce(parse, F.lit("")).isin(*BLOCKED_PARSE)
    return (F.coalesce(score, F.lit(0)) >= AUTO_MATCH_SCORE) & F.coalesce(selectable, F.lit(False)) & sure & (F.size(hard_blockers) == 0)


# Action names that mean the same, and what they make of a filing.
ACTION_ALIASES = {"APPROVE_RENEWAL": "UPDATE_CURRENT", "REGISTER_AS_PRIMARY": "UPDATE_CURRENT"}
FILING_STATUS = {"UPDATE_CURRENT": "CONFIRMED", "REPLACE_CURRENT": "REPLACED", "ADD_SECONDARY": "SECONDARY_ADDED"}


def _alias(action: Column) -> Column:
    name = F.upper(F.trim(F.coalesce(action, F.lit(""))))
    return rules.decide([(name == a, b) for a, b in ACTION_ALIASES.items()], name)


def confirm_gate(code: Column, requested: Column) -> tuple[Column, Column, Column]:
    """(action, filing status, error) of a confirmation. An automatic decision cannot be overridden,
    a blocked one cannot be confirmed, and only three actions confirm at all."""
    out = change_outcome(code)
    wanted, automatic = _alias(requested), _alias(out["auto_action"])
    allowed = F.transform(out["review_options"], _alias)
    review = out["requires_review"]
    action = F.when(review, wanted).otherwise(automatic)
    error = rules.decide([
        (out["blocked"], "BLOCKED"),
        (review & (wanted == ""), "ACTION_REQUIRED"),
        (review & ~F.array_contains(allowed, wanted), "ACTION_NOT_ALLOWED"),
        (~review & (wanted != "") & (wanted != automatic), "CANNOT_OVERRIDE"),
        (~action.isin(*FILING_STATUS), "NOT_A_CONFIRMATION"),
    ], F.lit(None).cast("string"))
    status = rules.decide([(action == a, s) for a, s in FILING_STATUS.items()])
    return F.when(error.isNull(), action), F.when(error.isNull(), status), error


def structure(numbers: DataFrame, doc: str, number: str, is_item: str, is_document: str) -> DataFrame:
    """Document structure from its distinct item numbers and document numbers.

    Distinct numbers are found by an aggregate per (document, number), then counted; no number
    list is ever built."""
    each = numbers.groupBy(doc, number).agg(F.bool_or(is_item).alias("i"), F.bool_or(is_document).alias("d"))
    counts = each.groupBy(doc).agg(F.count_if("i").alias("items"), F.count_if(F.col("d") & ~F.col("i")).alias("own"))
    kind = rules.decide([
        ((F.col("items") >= 2) & (F.col("own") > 0), "MIXED"), (F.col("items") >= 2, "ITEM_LEVEL"), (F.col("own") > 0, "DOCUMENT_LEVEL"),
    ], "UNKNOWN")
    return counts.select(doc, kind.alias("structure"))
