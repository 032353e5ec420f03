"""Collocations by brute force, sorts and keys of the method by plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerweave.llm import phrases

DOCS = "lang string, text string, word string, n string, key string, rank string"


def brute(rows, least, longest, top, share):
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[k : k + m])) for k in range(len(words) - m + 1))
    out = {}
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in candidates.items():
        longer = [b for (other, x), b in candidates.items() if other == lang and len(x) > len(w) and any(x[k : k + len(w)] == w for k in range(len(x)))]
        if any(100 * b >= share * a for b in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, totals[lang], -s) for lang, got in out.items() for i, (s, a, p, left, right) in enumerate(sorted(got)[:top], 1))


def made(seed, many):
    """Rows with nulls, empties, repeats, odd separators, a hot word, a hot pair and a language that holds most rows."""
    rng = random.Random(seed)
    words = ["New", "york", "été", "a-b", " x", "\x01", "of", "THE", "straße", "İst", "𝒳", "\x1f", " y"]
    rows = [(None, None), ("en", ""), ("en", " \t . ,;"), (None, "of the of the of the"), ("und", "of the"), ("xx", "a"), ("en", "z " * 3000), ("en", "." * 500)]
    for _ in range(many):
        text = "".join(rng.choice(words[: rng.randint(2, 13)]) + rng.choice([" ", " ", "  ", "\t", " ", " ", ", ", "\n", "\r\n", "! ", "\x0b", "\x0c"]) for _ in range(rng.randint(0, 60)))
        rows += [(rng.choice(["en", "en", "en", "fr", None]), text)] * rng.choice([1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("least, longest, top, share, block, chunk", [(3, 3, 2000, 50, 1 << 20, 1 << 20), (2, 4, 40, 80, 300, 7), (5, 2, 5, 50, 50, 1 << 20), (10**6, 3, 10, 50, 100, 50)])
def test_phrases_by_brute_force(spark, monkeypatch, least, longest, top, share, block, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = made(block, 60)
    df = spark.createDataFrame([(*r, "x", "y", "z", "q") for r in rows], DOCS).repartition(3)
    got = phrases.mine(df, least=least, longest=longest, top=top, share=share, block_words=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, top, share)


def test_no_rows(spark):
    assert phrases.mine(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.mine(spark.createDataFrame([(None, None, "x", "y", "z", "q")], DOCS)).collect() == []


def test_products_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits, floored exactly."""
    key = bytes([0, 0, 0, 1, 0, 0, 0, 2])
    for a, left, right in [(10**14 + 7, 10**14 + 9, 10**15 - 1), (10**15 - 1, 10**15 - 1, 10**15 - 1), (3, 10**15 - 1, 3)]:
        candidates = spark.createDataFrame([(key, a)], "key binary, a long")
        frequent = spark.createDataFrame([("en", b"x", left, 1), ("en", b"y", right, 2)], "lang string, word binary, f long, id long")
        row = phrases.scored(candidates, frequent, 50).first()
        assert (row["phrase"], row["l"], row["r"], row["score"]) == ("x y", left, right, 10**6 * a * a // (left * right))


@pytest.mark.parametrize("seed", range(5))
def test_radix_runs_and_packing(seed):
    rng = np.random.default_rng(seed)
    high = [3, 1 << 16, 1 << 32, 70000, 2][seed]
    columns = [rng.integers(0, high, 500, np.uint32) for _ in range(3)]
    counts = rng.integers(1, 9, 500)
    want = Counter()
    for *row, n in zip(*columns, counts):
        want[tuple(map(int, row))] += int(n)
    distinct, sums = phrases.run_lengths(columns, counts)
    assert list(zip(map(tuple, np.stack(distinct, 1).tolist()), sums.tolist())) == sorted(want.items())
    assert np.array_equal(phrases.keys(distinct), np.sort(phrases.keys(distinct)))
    again, n = phrases.unpacked(phrases.packed(distinct, sums), 3)
    assert all(map(np.array_equal, [*again, n], [*distinct, sums]))


def test_numbers_are_dense(spark, tmp_path):
    from ledgerweave.llm.common import Tables

    words = spark.range(1000).selectExpr("'en' AS lang", "CAST(CAST(id AS STRING) AS BINARY) AS word", "id AS f").repartition(7)
    assert sorted(r["id"] for r in phrases.numbered(spark, Tables(spark, "test"), words).collect()) == list(range(1, 1001))
