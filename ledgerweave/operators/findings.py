"""Findings as ordered arrays, and the fold of a list into one decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import HOLD, OK, REJECT, REVIEW, SEVERITIES, WARN

FINDING = "struct<code:string,severity:int,message:string,evidence:map<string,string>>"
NONE = f"array<{FINDING}>"

OUTCOMES = {REJECT: "REJECT", REVIEW: "NEEDS_REVIEW", HOLD: "HOLD_FOR_APPROVAL"}
HEADLINES = {
    "AUTO_APPROVE": "Every check passed; the invoice can be paid.",
    "HOLD_FOR_APPROVAL": "Matched, with a bounded variance that a person has to approve.",
    "NEEDS_REVIEW": "Not decidable by rules; a person gets the reasons.",
    "REJECT": "Blocked; not to be paid as it is.",
}
#: Next step by the code that drove the decision.
ACTIONS = {
    "DUPLICATE_EXACT": "Close as a duplicate of the earlier payment.",
    "DUPLICATE_NEAR": "Compare with the earlier invoice and pay only a separate charge.",
    "CUMULATIVE_OVERBILL": "Return it, or have the order raised before anything more is paid.",
    "CUMULATIVE_OVERBILL_APPROVABLE": "Ask the owner of the order to raise it.",
    "AMOUNT_EXCEEDS_BAND": "Ask the vendor about the overage.",
    "AMOUNT_OVER_TOLERANCE": "Ask the budget's approver for the variance.",
    "VENDOR_NOT_APPROVED": "Have the vendor approved first.",
    "PO_VENDOR_MISMATCH": "Attach this vendor's order, or reject.",
    "PO_CLOSED": "Ask procurement for an open order.",
    "CURRENCY_MISMATCH": "Settle the currency with vendor and owner.",
    "TOTAL_DOESNT_RECONCILE": "Ask for an invoice that adds up.",
    "MISSING_CRITICAL_FIELDS": "Ask for the missing fields.",
    "LOW_EXTRACTION_CONFIDENCE": "Key the fields in by hand and run again.",
    "PO_UNRESOLVED": "Have the right order attached and run again.",
    "PO_REFERENCE_UNKNOWN": "Check the cited order number with the vendor.",
    "SECOND_INVOICE_ON_SINGLE_PO": "Make sure that it is no duplicate, then have the order changed.",
}
DEFAULT_ACTIONS = {
    "AUTO_APPROVE": "Release the payment on the vendor's terms.",
    "HOLD_FOR_APPROVAL": "Route to the approver.",
    "NEEDS_REVIEW": "Assign to a specialist.",
    "REJECT": "Return to the sender with the reason.",
}


def finding(code: str, severity: int, message, **evidence) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    facts = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), facts.alias("evidence"))


def listed(*found: Column) -> Column:
    """Those that are not null, in order."""
    return F.array_compact(F.array(*found)).cast(NONE)


def worst(findings: Column) -> Column:
    return F.array_max(F.transform(findings, lambda f: f["severity"]))


def _lookup(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def decide(findings: Column) -> Column:
    """outcome, confidence, headline, reasons and action of a list of findings; an empty list goes to review."""
    top = worst(findings)
    outcome = F.coalesce(_lookup(top, OUTCOMES), F.when(F.size(findings) == 0, "NEEDS_REVIEW").otherwise("AUTO_APPROVE"))
    drivers = F.filter(findings, lambda f: F.when(top >= HOLD, f["severity"] == top).otherwise(f["severity"] == OK))
    warnings = F.size(F.filter(findings, lambda f: f["severity"] == WARN))
    confidence = (
        F.when(F.size(findings) == 0, 0.0)
        .when(outcome == "AUTO_APPROVE", F.round(F.greatest(F.lit(0.80), F.lit(0.98) - warnings * 0.05), 2))
        .when(outcome == "REJECT", 0.95)
        .when(outcome == "NEEDS_REVIEW", 0.60)
        .otherwise(0.75)
    )
    acts = F.array_compact(F.transform(drivers, lambda f: _lookup(f["code"], ACTIONS)))
    reasons = F.transform(drivers, lambda f: F.concat(F.lit("["), f["code"], F.lit("] "), f["message"]))
    return F.struct(
        outcome.alias("outcome"),
        confidence.alias("confidence"),
        _lookup(outcome, HEADLINES).alias("headline"),
        F.when(F.size(findings) == 0, F.array(F.lit("No checks ran."))).otherwise(reasons).alias("reasons"),
        F.coalesce(F.get(acts, F.lit(0)), _lookup(outcome, DEFAULT_ACTIONS)).alias("action"),
    )


def stage_summary(findings: Column, kind: str) -> Column:
    issues = F.filter(findings, lambda f: f["severity"] >= HOLD)
    name = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.coalesce(worst(issues), F.lit(0)) + 1)
    return F.when(F.size(issues) == 0, F.format_string(f"All {kind} checks passed (%d run).", F.size(findings))).otherwise(
        F.concat(F.size(issues).cast("string"), F.lit(f" {kind} issue(s); worst = "), name, F.lit(" ("), F.get(issues, F.lit(0))["code"], F.lit(")."))
    )


def trace_rows(decided, id_col: str, *stages: str):
    """Long form of the stages' findings: id, stage number, stage, place, code, severity, message."""
    from functools import reduce

    parts = [decided.select(id_col, F.lit(k).alias("stage_no"), F.lit(s).alias("stage"), F.posexplode(f"{s}_findings").alias("place", "f")) for k, s in enumerate(stages)]
    return reduce(lambda a, b: a.unionByName(b), parts).select(id_col, "stage_no", "stage", "place", "f.code", "f.severity", "f.message")
