"""Descriptions, titles, cites and codes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Words that say nothing about a product.
STOP_WORDS = "mm inch in approx approximately set sets pcs pc nos no of the for and with x size grade".split()


def words_of(description: Column) -> Column:
    """Profile T: tokens of letters and digits, bend read as elbow, stop words gone."""
    s = F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), "[^a-z0-9 ]+", " ")
    tokens = F.filter(F.split(s, r"\s+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return F.transform(tokens, lambda w: F.when(w == "bend", "elbow").otherwise(w))


def product_name(description: Column) -> Column:
    return F.array_join(words_of(description), " ")


def long_words(description: Column) -> Column:
    """Profile B: tokens of three characters and more."""
    s = F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), "[^a-z0-9 ]", " ")
    return F.filter(F.split(s, r"\s+"), lambda w: F.length(w) >= 3)


def set_jaccard(a: Column, b: Column) -> Column:
    sizes = F.struct(F.size(F.array_intersect(a, b)).alias("both"), (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))).alias("sum"))
    return let(sizes, lambda x: F.try_divide(x["both"], x["sum"] - x["both"]))


def token_jaccard(a: Column, b: Column) -> Column:
    """Profile B: words that only the first list has count as often as they stand there; 0 if a list is empty."""

    def of(x):
        union = F.size(F.array_distinct(x["b"])) + F.size(F.filter(x["a"], lambda w: ~F.array_contains(x["b"], w)))
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(x["a"], x["b"])), union), F.lit(0.0)))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def same_product(a: Column, b: Column, least: float = 0.6) -> Column:
    """Equal, contained, or alike by tokens; false when either says nothing."""

    def of(x):
        na, nb = F.array_join(x["a"], " "), F.array_join(x["b"], " ")
        alike = set_jaccard(x["a"], x["b"]) >= least
        return F.when((na == "") | (nb == ""), False).otherwise((na == nb) | na.contains(nb) | nb.contains(na) | F.coalesce(alike, F.lit(False)))

    return let(F.struct(words_of(a).alias("a"), words_of(b).alias("b")), of)


def code_valid(code: Column) -> Column:
    """Four, six or eight digits; null for no code."""
    return F.when(F.coalesce(code, F.lit("")) != "", code.rlike("^([0-9]{4}|[0-9]{6}|[0-9]{8})$"))


def page_kind(head: Column) -> Column:
    """What document a page begins: the first title found, invoice before receipt before order; else a continuation."""
    h = F.upper(head)
    return (
        F.when(h.rlike(r"\b(TAX INVOICE|INVOICE|BILL OF SUPPLY|CREDIT NOTE|DEBIT NOTE)\b"), "invoice")
        .when(h.rlike(r"\b(GOODS RECEIPT|GRN|MATERIAL RECEIPT|GOODS RECEIVED)\b"), "grn")
        .when(h.rlike(r"\b(PURCHASE ORDER|WORK ORDER|SERVICE ORDER|PURCHASE REQUISITION)\b"), "po")
        .otherwise("continuation")
    )


def page_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def cite_page(value: Column) -> Column:
    """A positive page number, else 1."""
    n = value.cast("string").try_cast("int")
    return F.when(n > 0, n).otherwise(1)


def sheet_safe(s: Column) -> Column:
    """For a sheet's cell language: double quotes become single, line breaks blanks, bars slashes; nothing is cut."""
    return F.regexp_replace(F.translate(s, '"|', "'/"), r"[\r\n]+", " ")


def csv_cell(value: Column) -> Column:
    """Quoted only when it has a quote, a comma or a line break; null is empty."""
    s = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def same_site(a: Column, b: Column) -> Column:
    """True when the words of one are among the other's; null when that cannot be told."""
    wa, wb = words_of(a), words_of(b)
    contained = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    return F.when((F.size(wa) > 0) & (F.size(wb) > 0) & contained, True)


def column_letters(n: int) -> str:
    """Spreadsheet letters of a zero-based column."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def media_type(name_or_type: Column) -> Column:
    s = F.lower(F.coalesce(name_or_type, F.lit("")))
    return F.when(s.rlike(r"jpe?g"), "image/jpeg").when(s.contains("png"), "image/png").when(s.contains("webp"), "image/webp").when(s.contains("gif"), "image/gif").otherwise("application/pdf")


def currency_of(text: Column) -> Column:
    """Symbols before codes, the dollar first; null when neither is there."""
    code = F.nullif(F.regexp_extract(text, r"\b(USD|EUR|GBP|INR)\b", 1), F.lit(""))
    return F.when(text.contains("$"), "USD").when(text.contains("€"), "EUR").when(text.contains("£"), "GBP").when(text.contains("₹"), "INR").otherwise(code)
