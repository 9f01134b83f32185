"""Documents as pages and lines.

Line context is taken from the array inside the document's own row, so neither page
numbers nor neighbouring lines need a shuffle; a document is never split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import rank

PAGE_MARKER = r"(?i)\[PAGE (\d+)\]"
NEW_LINE = r"\r\n|\r|\n"


def pages_of(text: Column, marker: str = PAGE_MARKER) -> Column:
    """``array<struct<page, text>>``; a text without markers is one page."""
    bodies = F.split(text, marker, -1)
    marks = F.regexp_extract_all(text, F.lit(marker), F.lit(1))
    # zipped, as what a lambda names is worked out again for each of its elements
    marked = F.zip_with(marks, F.slice(bodies, 2, 1 << 30), lambda m, t: F.struct(m.cast("int").alias("page"), t.alias("text")))
    whole = F.array(F.struct(F.lit(1).alias("page"), text.alias("text")))
    return F.when(text.rlike(marker), marked).otherwise(whole)


def lines_of(text: Column, marker: str = PAGE_MARKER) -> Column:
    """``array<struct<page, line_no, line>>`` of all non-empty lines in document order."""

    def page_lines(p: Column) -> Column:
        rows = F.transform(
            F.split(p["text"], NEW_LINE),
            lambda ln, i: F.struct(
                p["page"].alias("page"), (i + 1).alias("line_no"), X.squash(F.replace(ln, F.lit(" "), F.lit(" "))).alias("line")
            ),
        )
        return F.filter(rows, lambda r: r["line"] != "")

    return F.flatten(F.transform(pages_of(text, marker), page_lines))


def document_lines(docs: DataFrame, text: str, keep: list[str], marker: str = PAGE_MARKER) -> DataFrame:
    """One row per line with its neighbours: keep.., global_index, page, line_no, line, prev, next."""
    arrays = docs.select(*keep, lines_of(F.col(text), marker).alias("_lines"))
    lines = F.col("_lines")
    rows = F.transform(
        lines,
        lambda r, i: F.struct(
            i.alias("global_index"), r["page"].alias("page"), r["line_no"].alias("line_no"), r["line"].alias("line"),
            F.coalesce(F.get(lines, i - 1)["line"], F.lit("")).alias("prev"),
            F.coalesce(F.get(lines, i + 1)["line"], F.lit("")).alias("next"),
        ),
    )
    return arrays.select(*keep, F.inline(rows))


def page_lines(pages: DataFrame, doc: str, page: str, text: str, header_lines: int = 0, bucket: int = 1000) -> DataFrame:
    """Lines of documents stored as one row per page: doc, global_index, page, line_no, line.

    Pages are read where they lie. Only their line counts are summed along the document, in two
    levels, so a document of any number of pages never meets in one task. ``header_lines`` counts
    lines of a page, such as its marker, that the text column leaves out."""
    rows = F.transform(F.split(F.col(text), NEW_LINE), lambda ln, i: F.struct((i + 1 + header_lines).alias("line_no"), X.squash(ln).alias("line")))
    arrays = pages.select(doc, page, F.filter(rows, lambda r: r["line"] != "").alias("_l"))
    counts = arrays.select(doc, page, F.size("_l").cast("bigint").alias("_n"))
    ends = rank.running_sums(counts, [doc], [F.asc(page)], F.floor(F.col(page) / bucket), {"_end": F.col("_n")})
    placed = arrays.join(ends.select(doc, page, (F.col("_end") - F.col("_n")).alias("_start")), [doc, page])
    out = placed.select(doc, page, "_start", F.posexplode("_l").alias("_i", "_r"))
    return out.select(doc, (F.col("_start") + F.col("_i")).alias("global_index"), page, "_r.line_no", "_r.line")


def line_spans(docs: DataFrame, text: str, keep: list[str], longest: int = 3, max_chars: int | None = None, marker: str = PAGE_MARKER) -> DataFrame:
    """Spans of 1..``longest`` lines of one page with the lines around them; longer ones than ``max_chars`` are left out if it is given."""
    arrays = docs.select(*keep, lines_of(F.col(text), marker).alias("_lines"))
    lines = F.col("_lines")

    def from_line(r: Column, i: Column) -> Column:
        def span(n: int) -> Column:
            part = F.filter(F.slice(lines, i + 1, n), lambda x: x["page"] == r["page"])
            joined = F.array_join(F.transform(part, lambda x: x["line"]), " ")
            return F.when(
                (F.size(part) == n) & (F.lit(True) if max_chars is None else F.length(joined) <= max_chars),
                F.struct(
                    i.alias("first_index"), F.lit(n).alias("span_lines"), r["page"].alias("page"), r["line_no"].alias("line_no"),
                    joined.alias("span"),
                    F.coalesce(F.get(lines, i - 1)["line"], F.lit("")).alias("prev"),
                    F.coalesce(F.get(lines, i + n)["line"], F.lit("")).alias("next"),
                ),
            )

        return F.array_compact(F.array(*[span(n) for n in range(1, longest + 1)]))

    return arrays.select(*keep, F.inline(F.flatten(F.transform(lines, from_line))))


HAS_DATE = r"(?i)\b20\d{2}[-./]\d{1,2}[-./]\d{1,2}\b|\b\d{1,2}[-./]\d{1,2}[-./]20\d{2}\b|\b\d{1,2}(?:st|nd|rd|th)?\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*,?\s+20\d{2}\b"
COMPANY_SUFFIX = r"(?i)(?:^|[^\p{L}\p{N}_])(?:co|company|corp|corporation|inc|ltd|limited|llc|plc|gmbh|sdn|bhd)(?:$|[^\p{L}\p{N}_])"


def eligible(field: str, line: Column, page: Column) -> Column:
    """Whether a line may carry a field: length, page and content tests per field."""
    usable = F.length(line).between(2, 280)
    worded = line.rlike("[A-Za-z가-힣]") & (F.length(X.norm_key(line)) >= 3) & (page <= 4)
    tests = {
        "cert_no": (page <= 3) & (line.rlike(r"\d") | F.upper(line).rlike("CERT|REGISTRATION")),
        "expiry_date": (page <= 4) & (line.rlike(HAS_DATE) | F.upper(line).rlike("VALID|EXPIR|UNTIL|PERIOD|DATE")),
        "manufacturer": worded,
        "manufacturing_country": worded,
    }
    return usable & tests[field]


def feature_text(field: str, issuer: Column, line: Column, prev: Column, following: Column, page: Column, line_no: Column) -> Column:
    """Model input of a line: where it stands, what it is made of, and its words between those of its neighbours."""

    def capped(n: Column) -> Column:
        return F.least(n.cast("int"), F.lit(9)).cast("string")

    made_of = {"digits": "[^0-9]", "capitals": "[^A-Z]", "signs": "[^:/.-]"}
    facts = {
        "issuer": F.regexp_replace(F.lower(issuer), "[^a-z0-9]+", "_"), "page": capped(page), "tenth": capped(F.floor(line_no / 10)),
        **{name: capped(F.length(F.regexp_replace(line, other, ""))) for name, other in made_of.items()},
        "dated": line.rlike(HAS_DATE).cast("string"), "firm": line.rlike(COMPANY_SUFFIX).cast("string"), "size": capped(F.floor(F.length(line) / 20)),
    }
    head = F.concat_ws(" ", F.lit(f"field={field}"), *[F.concat(F.lit(f"{name}="), value) for name, value in facts.items()])
    return F.concat_ws("\n", head, F.concat(F.lit("above "), prev), F.concat(F.lit("here "), line), F.concat(F.lit("below "), following))
