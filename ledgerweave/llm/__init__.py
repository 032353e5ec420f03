"""Operators for preparing large text corpora.

Nothing outside this folder imports it; ``__spark_entry__.py`` registers its
queries when it is present.
"""
