"""Keys of names, orders, invoices and tax ids: one function per profile, never merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Legal forms, in the order in which they are taken off.
SUFFIXES = (" inc", " incorporated", " llc", " ltd", " limited", " corp", " corporation", " co", " company", " gmbh")


def _words(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _spaced(c: Column) -> Column:
    """As _words, of a text whose only white space is the blank: single blanks stay as they are."""
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def vendor_name(name: Column) -> Column:
    """Profiles P and B: punctuation becomes a blank after trimming, so a name that ends in one keeps its legal form."""
    s = F.replace(F.translate(F.lower(F.trim(name)), ",.", "  "), F.lit("  "), F.lit(" "))
    bare = s
    for suffix in SUFFIXES:
        bare = F.regexp_replace(bare, suffix + "$", "")
    # most names end in none of them, which one look tells
    return _words(F.when(s.rlike(f" (?:{'|'.join(x.strip() for x in SUFFIXES)})$"), bare).otherwise(s))


def company_name(name: Column) -> Column:
    """Profile T: letters and digits; words of legal form, "and" and "the" go."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9 ]+", " ")
    # the look-ahead passes over most characters before a word's bound is looked for
    return _spaced(F.regexp_replace(s, r"(?=[acilpt])\b(private|pvt|limited|ltd|llp|inc|co|company|and|the)\b", " "))


def party_name(name: Column) -> Column:
    """Profiles V and F: as company_name, with "m s" and "corporation" gone too."""
    return _spaced(F.regexp_replace(company_name(name), r"(?=[mcl])\b(m s|corp|corporation|llc)\b", " "))


def order_key(number: Column) -> Column:
    """Profile P: upper case, no blanks, every "PO" gone, no leading dash or hash."""
    s = F.replace(F.replace(F.upper(number), F.lit(" "), F.lit("")), F.lit("PO"), F.lit(""))
    return F.regexp_replace(s, "^[-#]+", "")


def cited_order(text: Column) -> Column:
    """Profile P: the order number in a cited text; bare digits get the prefix PO-."""
    found = F.upper(F.replace(F.regexp_extract(text, r"(?i)(PO[-\s]?\d+|\d{3,})", 1), F.lit(" "), F.lit("")))
    return let(found, lambda m: F.when(m.startswith("PO"), m).when(m != "", F.concat(F.lit("PO-"), m)))


def clean_order(text: Column) -> Column:
    """Profile B: PO-123 or PR-123."""
    found = F.regexp_replace(F.upper(F.regexp_extract(text, r"(?i)(P[OR][-\s]?\d+|\d{3,})", 1)), r"\s", "")
    return let(found, lambda m: F.when(m.rlike("^P[OR]"), F.regexp_replace(m, "^(P[OR])-?", "$1-")).when(m != "", F.concat(F.lit("PO-"), m)))


def batch_order_key(number: Column) -> Column:
    """Profile B: letters and digits without a leading PO or PR."""
    return F.regexp_replace(reference_key(number), "^P[OR]", "")


def reference_key(ref: Column) -> Column:
    """Profile T: upper-case letters and digits."""
    return F.regexp_replace(F.upper(F.coalesce(ref, F.lit(""))), "[^A-Z0-9]", "")


def invoice_key(number: Column) -> Column:
    """Profile F: letters and digits, leading zeros gone."""
    return F.regexp_replace(reference_key(number), "^0+", "")


def tax_id(value: Column) -> Column:
    """Upper-case letters and digits; null when nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(value), "[^A-Z0-9]", ""), F.lit(""))


def bare_tax_id(value: Column) -> Column:
    """Upper case without blanks; null when nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(value), r"\s+", ""), F.lit(""))


def tax_ids_equal(a: Column, b: Column) -> Column:
    """Null when either is missing."""
    return bare_tax_id(a) == bare_tax_id(b)


TAX_ID_PATTERN = r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b"
