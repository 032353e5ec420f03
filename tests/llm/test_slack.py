"""Minimum bin slack: the subset sum by enumeration, plans and packed tables by their rules."""

import random
import zlib
from collections import Counter
from itertools import product

import pytest

from ledgerweave.llm import packing, slack

DOCS = "doc_id long, text string, length string, ids string, uid string"


@pytest.mark.parametrize("seed", range(20))
def test_closest_by_enumeration(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
    room = rng.randint(1, 60)
    used = slack.closest(counts, room)
    assert all(0 < k <= counts[n] for n, k in used.items())
    sums = (sum(n * k for n, k in zip(counts, ks)) for ks in product(*(range(c + 1) for c in counts.values())))
    assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


HISTOGRAMS = [
    {}, {1: 3}, {600: 5000}, {1023: 3000}, {700: 333, 513: 222}, {1: 1, 1023: 1}, dict.fromkeys(range(1, 1024), 2),
    Counter(random.Random(1).randint(1, 1023) for _ in range(20000)), Counter(random.Random(2).randint(513, 1023) for _ in range(3000)),
]


@pytest.mark.parametrize("counts", HISTOGRAMS)
def test_plan_places_every_token_without_padding(counts):
    plan = slack.Plan(counts)
    tokens, filled = {}, {}
    for origin, rank, many, at, length, sequence, offset in plan.runs:
        for i in range(many):
            tokens.setdefault((origin, rank + i), []).append((at, length))
            filled.setdefault(sequence + i, []).append((offset, length))
    assert set(tokens) == {(n, r) for n, c in counts.items() for r in range(c)}
    for places, end in [(p, n) for (n, _), p in tokens.items()] + [(p, None) for p in filled.values()]:
        at = 0
        for a, n in sorted(places):
            assert a == at and n > 0
            at += n
        assert at == end or end is None and at <= 1024 and padding(at, 1024) == 0
    assert len(filled) == plan.sequences <= sum(n * c for n, c in counts.items()) // 1024 + 10
    assert plan.steps <= 10 * (1 + min(1024, sum(counts.values())))


def test_whole_documents_stay_whole_where_they_can():
    plan = slack.Plan({512: 100, 1000: 7, 24: 7})
    assert len(plan.runs) == 4 and all(run[3] == 0 and run[4] == run[0] for run in plan.runs)


def packed(df, capacity):
    return [tuple(r) for r in slack.pack(df, capacity=capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packed_rows(spark, capacity):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma ray", "  ", "été", "\n", "x" * 50, "<|endoftext|>", "12,5"]
    texts = [None, "", " ", "a"] + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(120)] + ["word " * 4000, "same text", "same text"]
    ids = [*range(len(texts) - 2), 500, 500]
    df = spark.createDataFrame([(i if k else None, t, "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts))], DOCS).repartition(3)
    rows = packed(df, capacity)
    encode = packing.encoder(packing.default_vocabulary())
    want = Counter()
    for k, (i, t) in enumerate(zip(ids, texts)):
        want[(i if k else None, tuple([*encode(t or ""), 0]))] += 1
    pieces, filled = {}, {}
    for doc, start, length, crc, tokens, sequence, offset in rows:
        pieces.setdefault(doc, []).append((start, length, crc, tokens))
        filled.setdefault(sequence, []).append((offset, length))
    for doc, tokens in want:
        times = want[doc, tokens]
        whole = Counter()
        for start, length, crc, n in pieces[doc]:
            assert n == len(tokens)
            assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in tokens[start : start + length])) == crc
            whole.update(range(start, start + length))
        assert whole == Counter(dict.fromkeys(range(len(tokens)), times))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity and padding(at, capacity) == 0
    assert len(filled) <= sum(len(t) * n for (_, t), n in want.items()) // capacity + capacity.bit_length()


def test_no_rows(spark):
    assert packed(spark.createDataFrame([], DOCS), 1024) == []
