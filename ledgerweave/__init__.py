"""Reconciliation analytics as Spark plans: extraction, matching, checks, verdicts and reports."""
