"""Similar names against all pairs, what the index of adjacent characters rests on, and how evenly it deals names."""

import random
from collections import Counter
from difflib import SequenceMatcher
from math import ceil

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import similarity
from ledgerweave.operators.similarity import similar_names


def test_similar_strings_share_two_adjacent_characters():
    rng = random.Random(1)
    met = 0
    for _ in range(60000):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(2, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "d", "b"])
        b = "".join(b)
        if len(b) >= 2 and a != b and SequenceMatcher(None, a, b).ratio() >= 0.82:
            met += 1
            both = Counter(a[i : i + 2] for i in range(len(a) - 1)) & Counter(b[i : i + 2] for i in range(len(b) - 1))
            assert both.total() >= 3 * ceil(0.41 * (len(a) + len(b)) - 1e-9) - len(a) - len(b) - 1 > 0, (a, b)
    assert met > 5000


def test_all_pairs(spark):
    rng = random.Random(2)
    base = ["acme tools", "north star", "blue river", "old town works", "ak", "a", "river blue"]
    vary = lambda s: "".join(c if rng.random() > 0.08 else rng.choice("xyz") for c in s)
    names, known = sorted({vary(b) for b in base for _ in range(12)}), sorted({vary(b) for b in base for _ in range(6)})
    left = spark.createDataFrame([(n,) for n in names], "name string")
    right = spark.createDataFrame([(n,) for n in known], "candidate string")
    got = {(r["name"], r["candidate"]): round(r["ratio"], 9) for r in similar_names(left, right, 0.82, blank=F.trim).collect()}
    want = {(a, b): round(SequenceMatcher(None, a.strip(), b.strip()).ratio(), 9) for a in names for b in known}
    assert got == {k: v for k, v in want.items() if v >= 0.82}


def made_names(many, seed):
    """Firms of a few words in common, with typing errors; and names that are alike by chance."""
    rng = random.Random(seed)
    words = ["acme", "trading", "steel", "works", "north", "general", "supplies", "and", "sons", "river", "tools", "international", "jo"]
    out = set()
    while len(out) < many:
        s = " ".join(rng.choices(words, k=rng.randint(1, 4))) if rng.random() < 0.7 else "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9)))
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(s) + 1)
            s = s[:k] + rng.choice(["", "x", "e"]) + s[k + rng.randint(0, 1) :]
        out.add(s.strip() or "q")
    return sorted(out)


def test_two_thousand_names(spark):
    """Recall of 1 against all pairs."""
    names, known = made_names(2000, 7), made_names(150, 8)
    got = {(r["key"], r["other"]): r["ratio"] for r in similarity.similar_keys(spark.createDataFrame([(n,) for n in names], "key string"), spark.createDataFrame([(n,) for n in known], "key string"), 0.82).collect()}
    want = {}
    for b in known:
        for a in names:
            if 2 * min(len(a), len(b)) >= 0.82 * (len(a) + len(b)) and (x := SequenceMatcher(None, a, b).ratio()) >= 0.82:
                want[a, b] = x
    assert len(want) > 300 and got == want


def test_no_key_of_the_index_holds_many_names(spark):
    """Thousands of names that end alike: their pairs of characters are in all of them, yet few names meet."""
    rng = random.Random(3)
    names = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(9, 14))) + " works",) for _ in range(2000)]
    left = spark.createDataFrame(names, "key string")
    pairs = similarity.met(left, left, 0.82)
    assert pairs.distinct().count() < 2000 * 2000 // 10, pairs.distinct().count()
    typed = left.select(F.regexp_replace("key", "^(.)(.)", "$2").alias("key"))
    assert similarity.similar_keys(typed, left, 0.82).where("substring(other, 2) = key").count() >= typed.distinct().count()


def test_a_ratio_too_low_for_the_index_is_refused(spark):
    one = spark.createDataFrame([("abcd",)], "key string")
    with pytest.raises(ValueError):
        similarity.similar_keys(one, one, 0.7)


def test_names_that_share_a_key_and_nulls(spark):
    left = spark.createDataFrame([("Acme Inc",), ("ACME, inc",), (None,), ("",), ("a",), ("zz",)], "name string")
    right = spark.createDataFrame([("Acme", 1), ("acme Ltd", 2), (None, 3), ("Acmee", 4), ("a", 5)], "candidate string, id int")
    from ledgerweave.functions.names import vendor_name

    got = {(r["name"], r["id"], round(r["ratio"], 4)) for r in similar_names(left, right, 0.82, vendor_name).collect()}
    assert got == {(n, i, x) for n in ("Acme Inc", "ACME, inc") for i, x in ((1, 1.0), (2, 1.0), (4, 0.8889))} | {("a", 5, 1.0)}
    best = {(r["name"], r["id"]) for r in similar_names(left, right, 0.82, vendor_name, best_only=True).collect()}
    assert best == {(n, i) for n in ("Acme Inc", "ACME, inc") for i in (1, 2)} | {("a", 5)}
