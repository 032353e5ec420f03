"""Amounts: parsing by profile, tolerances and formatting, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

MONEY = "decimal(18,2)"
DASH = "—"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def _plain_number(s: Column) -> Column:
    """Separators resolved: with both, commas group; commas alone group only in threes, else they are the decimal sign."""
    both = s.contains(",") & s.contains(".")
    grouped = s.rlike(r"^\d{1,3}(,\d{3})+$")
    return F.when(both | grouped, F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit(".")))


def _parsed(text: Column, codes: str, value_of) -> Column:
    """value_of(digits with separators and sign resolved), negated for an accounting negative in parentheses."""

    def read(s):
        digits = F.nullif(F.regexp_replace(F.regexp_replace(s, codes, ""), r"[^0-9.,\-]", ""), F.lit(""))
        value = let(digits, lambda d: value_of(_plain_number(d)))
        return F.when(s.startswith("(") & s.endswith(")"), -value).otherwise(value)

    return let(blank_to_null(text), read)


def parse_money(text: Column) -> Column:
    """Profile P: decimal(18,2) or null; "(120.00)" is negative; currency codes count as words."""
    return _parsed(text, r"(?i)\b(usd|eur|gbp|inr|rs)\b", lambda n: n.try_cast(MONEY)).cast(MONEY)


def to_cents(text: Column) -> Column:
    """Profile B: whole cents, halves up; currency codes go anywhere in the text."""
    return _parsed(text, r"(?i)(usd|eur|gbp|inr|rs)", lambda n: F.floor(n.try_cast("decimal(24,6)") * 100 + F.lit(0.5).cast("decimal(2,1)")).cast("bigint"))


def to_number(value: Column) -> Column:
    """Profile T: a plain number without symbols, commas, blanks and parentheses; a percent sign makes it null."""
    return F.regexp_replace(value.cast("string"), r"[$€£₹,\s()]", "").try_cast("double")  # an empty text is no number either


def first_number(text: Column) -> Column:
    """The first number in a text, commas dropped."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def clean_number(text: Column) -> Column:
    """As to_number, and a percent sign is dropped too."""
    return F.regexp_replace(text.cast("string"), r"[$€£₹,%\s()]", "").try_cast("double")


def number_or_zero(x: Column) -> Column:
    return F.coalesce(x.cast("string").try_cast("double"), F.lit(0.0))


def number_or_null(x: Column) -> Column:
    return F.nullif(x.cast("string"), F.lit("")).try_cast("double")


def tax_fraction(v: Column) -> Column:
    """A rate as a fraction: more than 1 is a percentage."""
    n = clean_number(v)
    return F.when(n > 1, n / 100).otherwise(n)


def money_text(amount: Column) -> Column:
    """Profile P: $1,234.56, the sign after the symbol; a dash for null."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(amount, 2)), F.lit(DASH))


def cents_text(cents: Column) -> Column:
    """Profile B: the sign before the symbol; a dash for null."""
    body = F.format_number(F.abs(cents).cast("decimal(20,2)") / 100, 2)
    return F.coalesce(F.concat(F.when(cents < 0, "-$").otherwise("$"), body), F.lit(DASH))


def percent_text(part: Column, base: Column, places: int = 1) -> Column:
    share = F.coalesce(F.try_divide(part.cast("double") * 100, F.nullif(base.cast("double"), F.lit(0.0))), F.lit(0.0))
    return F.format_string(f"%.{places}f", share)


def round_to(x: Column, places: int) -> Column:
    """Halves go up, as in scripts that scale, round and divide."""
    scale = F.lit(10**places)
    return F.floor(x.cast("double") * scale + 0.5) / scale


def at_least(base: Column, pct, floor) -> Column:
    """The wider of a share of the base and a fixed amount; null for a null base."""
    return F.when(base.isNotNull(), F.greatest(base * F.lit(pct), F.lit(floor)))


def cents_band(base: Column, pct: float, floor: int) -> Column:
    return F.when(base.isNotNull(), F.greatest(F.floor(base * F.lit(pct) + 0.5).cast("bigint"), F.lit(floor).cast("bigint")))


def amounts_equal(a: Column, b: Column, pct: float = 0.005, floor: float = 1.0) -> Column:
    """Null when one is missing; else within the wider of the floor and a share of b."""
    return F.abs(a - b) <= F.greatest(F.lit(floor), F.abs(b) * F.lit(pct))


def cents_tie(a: Column, b: Column, pct: float = 0.005, floor: int = 1) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(floor).cast("bigint"), F.floor(F.abs(b) * pct + 0.5).cast("bigint")), F.lit(False))


def rates_equal(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return F.abs(round_to(a, 2) - round_to(b, 2)) <= tolerance + 1e-9


def percents_equal(a: Column, b: Column, tolerance: float = 0.0001) -> Column:
    return F.abs(a - b) <= tolerance


def quantity_within(a: Column, b: Column) -> Column:
    return a <= b + 1e-9
