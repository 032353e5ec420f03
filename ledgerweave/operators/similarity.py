"""Names that are alike by difflib's ratio, found through an index of rare pairs of adjacent characters.

A ratio of r says that at least M = ceil(r * (n + m) / 2) characters of two strings of n and m match in order.  What does
not match cuts them into at most n + m - 2M + 1 runs, so at least t = 3M - (n + m) - 1 pairs of adjacent characters are
in both, each moved by no more than what is left over on either side.  Hence:

* prefix: of a string's pairs, rarest first, the first (n - 1) - t + 1 hold one that the other string's first ones hold too;
* length and position: the two lie in neighbouring length and position buckets, which are part of the join's key, so
  the frequent pairs of names made of the same words are dealt over many keys;
* count: strings share at least t pairs, so a bitmap of the one's pairs has few bits that the other's lacks; what passes
  is compared once.

No pair of strings is lost as long as t is positive for all lengths, which ``least`` is checked for.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio

#: Lengths, and positions, that share a key.
LENGTHS, PLACES = 6, 8


def matched(both: Column, least: float) -> Column:
    """The characters that have to match in two strings of so many characters together."""
    return F.ceil(both * (least / 2) - 1e-9).cast("int")


def shared(both: Column, least: float) -> Column:
    """The pairs of adjacent characters that they have to share."""
    return matched(both, least) * 3 - both - 1


def checked(least: float) -> float:
    if any(3 * ceil(least / 2 * s - 1e-9) - s - 1 < 1 for s in range(3, 200)):
        raise ValueError(f"strings with a ratio of {least} need not share two adjacent characters")
    return least


def _shortest(n: Column, least: float) -> Column:
    return F.ceil(n * (least / (2 - least)) - 1e-9).cast("int")


def _longest(n: Column, least: float) -> Column:
    return F.floor(n * ((2 - least) / least) + 1e-9).cast("int")


def _grams(key: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.struct(F.substring(key, i, F.lit(2)).alias("gram"), i.alias("pos")))


def _bitmap(of: Column, seed: int) -> Column:
    """64 bits, of which each pair sets one."""
    return F.aggregate(of, F.lit(0).cast("bigint"), lambda a, e: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(e["gram"], F.lit(seed)), F.lit(64)).cast("int"))))


def prefixes(keys: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """(key, n, b0, b1, gram, pos): the pairs by which a key is looked up, rarest first, and two bitmaps of all its pairs."""
    n = F.col("n")
    rows = keys.where(F.length("key") > 1).select("key", F.explode(_grams(F.col("key"))).alias("g")).select("key", "g.gram", "g.pos").join(frequency, "gram")
    rows = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("f", "gram", "pos"))).alias("every"))
    rows = rows.withColumns({"n": F.length("key"), "b0": _bitmap(F.col("every"), 0), "b1": _bitmap(F.col("every"), 1)})
    fewest = F.array_min(F.transform(F.sequence(_shortest(n, least), _longest(n, least)), lambda m: shared(n + m, least)))
    own = ("key", "n", "b0", "b1")
    return rows.select(*own, F.explode(F.slice("every", F.lit(1), n - fewest)).alias("e")).select(*own, "e.gram", "e.pos")


def met(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(key, other): pairs of unequal keys that pass all filters, each as often as its prefixes meet.  left, right: distinct (key)."""
    one = left.union(right).distinct().where(F.length("key") > 1).select(F.explode(_grams(F.col("key"))).alias("g"))
    frequency = one.groupBy(F.col("g.gram").alias("gram")).agg(F.count("*").alias("f"))
    cell = lambda c, width: F.floor(c / width).cast("int")
    index = prefixes(right, frequency, least).select(F.col("key").alias("other"), F.col("n").alias("m"), F.col("b0").alias("o0"), F.col("b1").alias("o1"), "gram", F.col("pos").alias("at"), cell(F.col("n"), LENGTHS).alias("size"), cell(F.col("pos"), PLACES).alias("place"))
    n, low, high = F.col("n"), _shortest(F.col("n"), least), _longest(F.col("n"), least)
    before, after = n - matched(n + low, least), high - matched(n + high, least)
    cells = lambda a, b, width: F.sequence(cell(a, width), cell(b, width))
    probes = prefixes(left, frequency, least).select("*", F.explode(cells(low, high, LENGTHS)).alias("size"))
    probes = probes.select("*", F.explode(cells(F.col("pos") - before, F.col("pos") + after, PLACES)).alias("place"))
    both, moved = n + F.col("m"), F.col("at") - F.col("pos")
    fits = (F.least(n, F.col("m")) >= matched(both, least)) & moved.between(matched(both, least) - n, F.col("m") - matched(both, least))
    lacking = lambda a, b, size: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))) < size - shared(both, least)
    enough = lacking("b0", "o0", n) & lacking("b1", "o1", n) & lacking("o0", "b0", F.col("m")) & lacking("o1", "b1", F.col("m"))
    return probes.join(index, ["gram", "size", "place"]).where(fits & (F.col("key") != F.col("other")) & enough).select("key", "other")


def similar_keys(left: DataFrame, right: DataFrame, least: float, similarity=ratio) -> DataFrame:
    """(key, other, ratio) of all pairs of distinct keys whose ratio reaches ``least``; equal ones have 1."""
    checked(least)
    equal = left.join(right, "key").select("key", F.col("key").alias("other"), F.lit(1.0).alias("ratio"))
    pairs = met(left, right, least).distinct().withColumn("ratio", similarity("key", "other")).where(F.col("ratio") >= least)
    return equal.unionByName(pairs)


def similar_names(names: DataFrame, candidates: DataFrame, least: float, blank, best_only: bool = False) -> DataFrame:
    """(name, candidate's columns, ratio) of all pairs from the ratio ``least`` on, compared by their keys (``blank``).

    Each distinct key is compared once, however many names or candidates have it.  best_only: names that have an equal
    candidate are not compared with others, since nothing beats it.
    """
    left = names.select("name", blank(F.col("name")).alias("key")).distinct()
    right = candidates.withColumn("other", blank(F.col("candidate")))
    known = right.where("other IS NOT NULL").select(F.col("other").alias("key")).distinct()
    keys = left.where("key IS NOT NULL").select("key").distinct()
    if best_only:
        equal = keys.join(known, "key", "left_semi").select("key", F.col("key").alias("other"), F.lit(1.0).alias("ratio"))
        pairs = equal.unionByName(similar_keys(keys.join(known, "key", "left_anti"), known, least))
    else:
        pairs = similar_keys(keys, known, least)
    return left.join(pairs, "key").join(right, "other").drop("key", "other")
