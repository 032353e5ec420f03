"""Dates: three parsers that differ in which day-month order they assume, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Shapes and patterns of the invoice profile, first match wins: day before month where both could be.
P_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}\s+[A-Za-z]+\s+\d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3}\s+\d{1,2},\s+\d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]+\s+\d{1,2},\s+\d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def parse_date(text: Column) -> Column:
    """Profile P: DATE or null."""
    return let(F.regexp_replace(F.trim(text), r"\s+", " "), _parse_date)


def _parse_date(s: Column) -> Column:
    return F.coalesce(*(F.when(s.rlike(shape), F.try_to_date(F.initcap(F.lower(s)) if "MMM" in p else s, p)) for shape, p in P_FORMATS))


def _month(name: Column) -> Column:
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, ((at - 1) / 4 + 1).cast("int"))


def _iso(y: Column, m: Column, d: Column) -> Column:
    """yyyy-mm-dd when month and day are in range; a day that the month lacks is kept."""
    ok = m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.format_string("%s-%02d-%02d", y, m, d))


def _part(s: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(s, pattern, k)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def parse_date_text(text: Column) -> Column:
    """Profile B: ISO text or null; of two numbers the day is first unless that cannot be."""
    return let(F.trim(text), _parse_date_text)


def _parse_date_text(s: Column) -> Column:
    ymd, dmy, mdy, num = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[ -]([A-Za-z]{3,})[ -,]+(\d{4})$", r"^([A-Za-z]{3,})[ ]+(\d{1,2}),?[ ]+(\d{4})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
    a, b = _int(_part(s, num, 1)), _int(_part(s, num, 2))
    swap = (b > 12) & (a <= 12)
    plain = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\z"  # ISO text already, as most is: one look instead of taking it apart
    return (
        F.when(s.rlike(plain), s)
        .when(s.rlike(ymd), _iso(_part(s, ymd, 1), _int(_part(s, ymd, 2)), _int(_part(s, ymd, 3))))
        .when(s.rlike(dmy) & _month(_part(s, dmy, 2)).isNotNull(), _iso(_part(s, dmy, 3), _month(_part(s, dmy, 2)), _int(_part(s, dmy, 1))))
        .when(s.rlike(mdy) & _month(_part(s, mdy, 1)).isNotNull(), _iso(_part(s, mdy, 3), _month(_part(s, mdy, 1)), _int(_part(s, mdy, 2))))
        .when(s.rlike(num), F.when(swap, _iso(_part(s, num, 3), a, b)).otherwise(_iso(_part(s, num, 3), b, a)))
    )


def to_iso(text: Column) -> Column:
    """Profile T: ISO text, day first; what cannot be read stays as it is."""
    return let(F.trim(text), _to_iso)


def _to_iso(s: Column) -> Column:
    ymd, num, name = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", r"^(\d{1,2})[ -]([A-Za-z]{3,9})[ -,]+(\d{4})$"
    return F.coalesce(
        F.when(s.rlike(ymd), _iso(_part(s, ymd, 1), _int(_part(s, ymd, 2)), _int(_part(s, ymd, 3)))),
        F.when(s.rlike(num), _iso(_part(s, num, 3), _int(_part(s, num, 2)), _int(_part(s, num, 1)))),
        F.when(s.rlike(name), _iso(_part(s, name, 3), _month(_part(s, name, 2)), _int(_part(s, name, 1)))),
        s,
    )


def age_days(date: Column, today) -> Column:
    return F.datediff(F.lit(today), date)


def within(date: Column, start, end) -> Column:
    """Null for a missing date."""
    return (date >= F.lit(start)) & (date <= F.lit(end))
