"""Personal data: expressions propose spans, validators confirm them, context words adjust the score.

Only DataFrame functions.  Offsets come from the text between matches: the
lengths of ``split`` parts and of the matches themselves, summed up in order.
The expressions are written without backtracking (possessive, and anchored to
the begin of a run of characters), which finds the same leftmost matches and
keeps long runs linear.

Defined results: null text is the empty text and has no spans; offsets count
code points, the end is exclusive; a proposal that its validator refuses is
dropped without a retry.  An IBAN is proposed at its country's length; under a
country code without a known length, as far as capitals and digits go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
#: Length of an IBAN -> its countries.
IBAN = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN.items())
_LISTED = "|".join(" ".join(IBAN.values()).split())
#: kind -> (quick test that every text with a confirmed match passes, expression)
PATTERNS = {
    "email": (lambda t: t.contains("@"), rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"), r"[0-9](?:[ -]?[0-9])++"),
    "phone": (lambda t: t.rlike(r"\+[0-9]"), r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), rf"(?<![A-Za-z0-9])(?:{_IBAN}|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"),
}
#: Words that, shortly before a span, make it more likely.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|server|host|network|login",
    "card": "card|visa|credit|debit|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
}
#: Score of a validated span, and what a context word adds.
SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT_GAIN = 0.2
CONTEXT_WIDTH = 40
_STEP = 512


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count 10 to 35, and the remainder is 1."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), "")
    digit = lambda c: F.ascii(c) < 58
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda a, c: F.when(digit(c), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(m)
    return F.lit(True)


#: A proposed match, with the number of characters between it and the one before.
_ITEMS = "array<struct<gap:int,m:string>>"


def _ends(items: Column) -> Column:
    """Where each match ends: gaps and lengths added up, in blocks, so that growing the list costs little however many there are."""
    state = lambda pos, out: F.struct(pos.alias("pos"), out.alias("out"))
    none = F.array().cast("array<int>")

    def one(a, x):
        end = a["pos"] + x["gap"] + F.length(x["m"])
        return state(end, F.array_append(a["out"], end))

    def block(a, i):
        inner = F.aggregate(F.slice(items, i * _STEP + 1, F.lit(_STEP)), state(a["pos"], none), one)
        return state(inner["pos"], F.concat(a["out"], inner["out"]))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / F.lit(_STEP)).cast("int"))
    return F.aggregate(blocks, state(F.lit(0), none), block)["out"]


def _scored(kind: str, text: Column, items: Column, ends: Column) -> Column:
    """array<struct<kind, start, end, m, score>> of the confirmed matches, in order."""
    span = lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("m"))
    kept = F.filter(F.zip_with(items, ends, span), lambda x: confirmed(kind, x["m"]))

    def one(x):
        first = F.greatest(x["start"] - CONTEXT_WIDTH, F.lit(0))
        before = F.lower(F.substring(text, first + 1, x["start"] - first))
        gain = F.when(before.rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
        score = (F.lit(SCORE[kind]) + gain).alias("score")
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), score)

    return F.transform(kept, one)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one array of (kind, start, end, m, score) per kind) of every row.

    Each step is a projection of its own whose columns the next one uses more than once, so the optimizer keeps them
    apart: an expression runs once a text, and the gaps are looked for only in texts with a match.
    """
    text = F.col("text")
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    match = lambda k: F.when(PATTERNS[k][0](text), F.regexp_extract_all(text, F.lit(PATTERNS[k][1]), F.lit(0)))
    out = out.select("doc_id", "text", *(F.coalesce(match(k), F.array().cast("array<string>")).alias(k) for k in KINDS))

    def items(k):
        gaps = F.slice(F.split(text, PATTERNS[k][1], -1), F.lit(1), F.size(k))
        both = F.zip_with(gaps, F.col(k), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
        return F.when(F.size(k) > 0, both).otherwise(F.array().cast(_ITEMS)).alias(k)

    out = out.select("doc_id", "text", *map(items, KINDS))
    ends = lambda k: F.when(F.size(k) > 0, _ends(F.col(k))).otherwise(F.array().cast("array<int>")).alias(f"{k}_ends")
    out = out.select("doc_id", "text", *KINDS, *map(ends, KINDS))
    return out.select("doc_id", *(_scored(k, text, F.col(k), F.col(f"{k}_ends")).alias(k) for k in KINDS))


def joined(*spans) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", *(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))) for s in spans))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.concat_ws(",", F.transform("spans", lambda x: F.format_number(x["score"], 2)))
    found = found.select("doc_id", *counts, F.concat(*BASE).alias("base"), F.concat(*KINDS).alias("spans"))
    base = F.sha2(joined("base"), 256).alias("base_sha256")
    return found.select("doc_id", *(f"n_{k}" for k in BASE), base, joined("spans").alias("spans"), scores.alias("scores"))
