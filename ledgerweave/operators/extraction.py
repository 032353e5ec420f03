"""Text to typed invoice fields: labels in order of priority, each field with its confidence and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.dates import parse_date
from ..functions.money import MONEY, parse_money
from ..functions.names import cited_order
from ..functions.text import currency_of

#: Label patterns with their confidences, most specific first.
MONEY_TOKEN = r"[\$€£₹]?\s?\(?-?\d[\d,]*(?:\.\d{1,2})?\)?"
_ID = r"([A-Za-z0-9][A-Za-z0-9\-/]{2,})"
NUMBER_LABELS = (
    (0.95, rf"(?i)invoice\s*(?:number|no\.?|#|num)\s*[:#]?\s*{_ID}"),
    (0.93, rf"(?i)\bbill\s*(?:number|no\.?|#)\s*[:#]?\s*{_ID}"),
    (0.90, rf"(?i)\binv\s*[:#]\s*{_ID}"),
)
ORDER_LABELS = (
    (0.95, r"(?i)(?:purchase\s*order|p\.?o\.?)\s*(?:number|no\.?|#|ref)?\s*[:#]?\s*(PO[-\s]?\d+|\d{3,})"),
    (0.90, r"(?i)\bpo\b\s*[:#]?\s*(PO[-\s]?\d+|\d{3,})"),
    (0.85, r"(?i)\bref(?:erence)?\s*[:#]?\s*(PO[-\s]?\d+)"),
)
TOTAL_LABELS = ((0.95, r"(?i)(?:grand\s*total|total\s*due|amount\s*due|balance\s*due|total\s*payable|amount\s*payable|invoice\s*total)"), (0.75, r"(?i)\btotal\b"))
SUBTOTAL_LABELS = ((0.92, r"(?i)(?:sub\s*total|subtotal|net\s*amount|net\s*total)"),)
TAX_LABELS = ((0.90, r"(?i)\b(?:tax|vat|gst|sales\s*tax)\b"),)
DATE_LABELS = ((0.95, r"(?i)invoice\s*date"), (0.95, r"(?i)date\s*of\s*issue"), (0.90, r"(?i)issue\s*date"), (0.80, r"(?i)\bdated\b"))
VENDOR_LABEL = (0.92, r"(?i)(?:bill\s*from|sold\s*by|supplier|vendor)\s*[:#]?\s*(.+)")
TITLES = ("invoice", "tax invoice", "bill", "statement", "receipt")
TABLE_WORDS = ("description", "qty", "quantity", "unit", "price", "amount", "rate", "item")
TABLE_END = r"(?i)subtotal|sub total|total|tax|vat|gst|balance|amount due"


def non_empty_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != "")


def _field(value: Column, confidence: float, source: str) -> Column:
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))))


def _first_of(fields: list[Column], kind: str) -> Column:
    missing = F.struct(F.lit(None).cast(kind).alias("value"), F.lit(0.0).alias("confidence"), F.lit("not-found").alias("source"))
    return F.coalesce(*fields, missing)


def _has(pattern: str):
    return lambda x: x.rlike(pattern)


def _capture(pattern: str):
    return lambda x: F.trim(F.regexp_extract(x, pattern, 1))


def _after(pattern: str):
    """What follows the pattern's last match."""
    return lambda x: F.regexp_replace(x, f"(?i)^.*(?:{pattern[4:]})", "")


def labelled_id(lines: Column, labels) -> Column:
    """The first label's first line whose capture has a digit."""
    out = []
    for confidence, pattern in labels:
        found = F.filter(F.transform(lines, _capture(pattern)), lambda v: v.rlike("[0-9]"))
        out.append(_field(F.get(found, F.lit(0)), confidence, "label"))
    return _first_of(out, "string")


def _money_tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(MONEY_TOKEN), F.lit(0))


def last_money(line: Column) -> Column:
    return parse_money(F.try_element_at(_money_tokens(line), F.lit(-1)))


def labelled_money(lines: Column, labels, without: tuple[str, ...] = ()) -> Column:
    """The last amount of the first line that has the label and none of the excluded words."""
    def read(allowed):
        out = []
        for confidence, pattern in labels:
            found = F.filter(F.transform(F.filter(allowed, _has(pattern)), last_money), lambda v: v.isNotNull())
            out.append(_field(F.get(found, F.lit(0)), confidence, "label"))
        return _first_of(out, MONEY)

    return let(F.filter(lines, lambda x: ~F.lower(x).rlike("|".join(without))), read) if without else read(lines)


def _dates_in(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, lambda t: parse_date(F.trim(t))), lambda d: d.isNotNull())


def labelled_date(lines: Column) -> Column:
    """What stands after a label's last place on a line that is not about a due date; then a bare "Date" line."""
    def read(allowed):
        out = []
        for confidence, pattern in DATE_LABELS:
            tails = F.transform(F.filter(allowed, _has(pattern)), _after(pattern))
            found = _dates_in(F.flatten(F.transform(tails, lambda t: F.split(t, r"[:#]|\s{2,}"))))
            out.append(_field(F.get(found, F.lit(0)), confidence, "label"))
        bare = F.filter(allowed, lambda x: x.rlike(r"(?i)^date\b"))
        found = _dates_in(F.flatten(F.transform(bare, lambda x: F.slice(F.split(x, "[:#]"), 2, 64))))
        out.append(_field(F.get(found, F.lit(0)), 0.65, "label"))
        return _first_of(out, "date")

    return let(F.filter(lines, lambda x: ~F.lower(x).contains("due")), read)


def vendor_field(lines: Column) -> Column:
    """A labelled vendor, else the first of four head lines that is no title."""
    confidence, pattern = VENDOR_LABEL
    labelled = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, pattern, 1))), lambda v: v != "")
    bare = lambda x: F.regexp_replace(F.lower(x), "^[ :-]+|[ :-]+$", "")
    head = F.filter(F.slice(lines, 1, 4), lambda x: ~bare(x).isin(*TITLES) & x.rlike("[A-Za-z]{3,}") & ~x.rlike("(?i)^(invoice|bill|date|po)"))
    return _first_of([_field(F.get(labelled, F.lit(0)), confidence, "label"), _field(F.get(head, F.lit(0)), 0.62, "header-line")], "string")


def line_items(lines: Column) -> Column:
    """Rows between the first line with two table words and the first line with a closing word."""
    hits = lambda x: let(F.lower(x), lambda low: sum(low.contains(w).cast("int") for w in TABLE_WORDS))
    after = lambda head: F.when(head > 0, F.slice(lines, F.greatest(head, F.lit(1)).cast("int") + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    until = lambda rest, end: F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(rest)
    closed = lambda rest: let(F.array_position(F.transform(rest, lambda x: x.rlike(TABLE_END)), True), lambda end: until(rest, end))
    body = let(F.array_position(F.transform(lines, lambda x: hits(x) >= 2), True), lambda head: let(after(head), closed))

    def item(x):
        strip = lambda s: F.regexp_replace(s, r"^[ .\-\t]+|[ .\-\t]+$", "")
        words = F.trim(F.regexp_replace(strip(F.regexp_replace(x, MONEY_TOKEN, "")), r"^\d+(\.\d+)?\s*", ""))
        return F.struct(
            F.coalesce(F.nullif(words, F.lit("")), F.lit("(unlabelled)")).alias("description"),
            F.nullif(F.regexp_extract(x, r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast(MONEY).alias("quantity"),
            parse_money(F.try_element_at(_money_tokens(x), F.lit(-2))).alias("unit_price"),
            last_money(x).alias("amount"),
        )

    return F.filter(F.transform(body, item), lambda i: i["amount"].isNotNull())


def ingest_quality(text: Column) -> Column:
    """Whether a page text is a usable text layer: 40 characters and 5 digits at least."""
    return (F.length(text) >= 40) & (F.length(F.regexp_replace(text, "[^0-9]", "")) >= 5)


def ingest(docs: DataFrame, text_col: str = "raw_text", kind_col: str | None = None) -> DataFrame:
    """Adds source_kind, ocr_needed and ingest_confidence.  Rows of kind "text" are taken as they are."""
    plain = F.col(kind_col) == "text" if kind_col else F.lit(False)
    usable = ingest_quality(F.trim(F.coalesce(F.col(text_col), F.lit(""))))
    return docs.withColumns(
        {
            "source_kind": F.when(plain, "text-file").when(usable, "text-pdf").otherwise("scanned-image"),
            "ocr_needed": ~plain & ~usable,
            "ingest_confidence": F.when(plain, 1.0).when(usable, 0.98).otherwise(0.15),
        }
    )


def extract(docs: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Adds the fields of an invoice: values, their confidences (map ``fields``) and the overall confidence."""
    rows = docs.withColumn("_lines", non_empty_lines(F.coalesce(F.col(text_col), F.lit(""))))
    lines = F.col("_lines")
    rows = rows.withColumns(
        {
            "_number": labelled_id(lines, NUMBER_LABELS),
            "_order": labelled_id(lines, ORDER_LABELS),
            "_date": labelled_date(lines),
            "_vendor": vendor_field(lines),
            "_total": labelled_money(lines, TOTAL_LABELS, ("subtotal", "sub total")),
            "_subtotal": labelled_money(lines, SUBTOTAL_LABELS),
            "_tax": labelled_money(lines, TAX_LABELS, ("subtotal",)),
        }
    )
    named = {"invoice_number": "_number", "po_reference": "_order", "invoice_date": "_date", "vendor": "_vendor", "total": "_total", "subtotal": "_subtotal", "tax": "_tax"}
    mean = (F.col("_number.confidence") + F.col("_date.confidence") + F.col("_total.confidence") + F.col("_vendor.confidence")) / 4
    fields = F.create_map(*(x for k, c in named.items() for x in (F.lit(k), F.struct(F.col(f"{c}.confidence").alias("confidence"), F.col(f"{c}.source").alias("source")))))
    return rows.withColumns(
        {
            "invoice_number": F.col("_number.value"),
            "po_reference": cited_order(F.col("_order.value")),
            "invoice_date": F.col("_date.value"),
            "vendor_raw": F.col("_vendor.value"),
            "total": F.col("_total.value"),
            "subtotal": F.col("_subtotal.value"),
            "tax": F.col("_tax.value"),
            "currency": F.coalesce(currency_of(F.col(text_col)), F.lit("USD")),
            "line_items": line_items(lines),
            "fields": fields,
            "extraction_confidence": F.round(F.col("ingest_confidence") * mean, 3),
        }
    ).drop("_lines", *named.values())
