"""Packing by minimum bin slack: each window takes the multiset of remaining lengths that fills it closest to capacity.

1. A text's ids and its end id are cut into whole windows and one rest, the last piece.
2. Only the histogram of rests (fewer lengths than the capacity) decides the plan.  The longest remaining length opens a
   window; a subset-sum over bits (bit s of an integer: the sum s can be reached) finds what beside it comes closest to
   capacity, tracing back how often each length is used, and the window is repeated as often as the counts allow.
3. What a window then lacks is cut from the shortest remaining length that is long enough, whose other part becomes a
   remaining length of its own; so every window is full while a window's worth of tokens is left.
4. The last tokens, fewer than a window, go to sequences whose lengths are powers of two, which need no padding.

The plan is a list of runs: the rests of one length with ranks a, a + 1, ... lie, from some of their tokens on, in
sequences s, s + 1, ... at one offset.  Ranks come from counts by (bucket, length), so no length, however frequent,
meets in one task.

Defined results: null text is the empty text (the end id alone); equal rows are separate documents; an empty table gives
no rows; columns beside id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, slices
from .common import Tables, documents, shuffle_partitions
from .packing import END_ID, encoder

CAPACITY = 1024
REST_SCHEMA = "doc_id long, doc_tokens long, start long, length int, ids_crc32 long, ids binary"
RUN_SCHEMA = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long"


def rests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every document's whole windows (ids null) and its rest (ids as unsigned little-endian 32-bit numbers, cut parts need them)."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        encode = encoder(path)
        for whole in batches:
            for batch in slices(whole, 1):
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = np.array([*encode(text or ""), END_ID], "<u4").tobytes()
                    for a in range(0, len(raw), 4 * capacity):
                        part = raw[a : a + 4 * capacity]
                        rows.append((doc, len(raw) // 4, a // 4, len(part) // 4, zlib.crc32(part), None if len(part) == 4 * capacity else part))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "doc_tokens", "start", "length", "ids_crc32", "ids"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, REST_SCHEMA)


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length so that their sum is as close to ``room`` as can be, and not beyond; long lengths first."""
    reach, target, steps = 1, 1 << room, []
    mask = (target << 1) - 1
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left, times = min(counts[n], room // n), 1
        while left and not reach & target:
            k = min(times, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left -= k
            times *= 2
    sum_left, used = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> sum_left & 1:  # this sum is only reached with k more of length n
            used[n] = used.get(n, 0) + k
            sum_left -= n * k
    return used


class Plan:
    """Runs (original length, first rank, how many, first token, tokens, first sequence, offset) for a histogram of lengths.

    ``steps`` counts the windows that were planned; each ends a length, or part of one, so it depends on the lengths, not
    on how many documents have them.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences, self.steps = capacity, 0, 0
        self.runs: list[tuple[int, int, int, int, int, int, int]] = []
        self.left = {n: c for n, c in counts.items() if c > 0}
        #: By remaining length: runs of documents (how many, original length, first rank, first token of the remaining part).
        self.lots = {n: deque([(c, n, 0, 0)]) for n, c in self.left.items()}
        while self.left:
            if sum(n * c for n, c in self.left.items()) < capacity:
                self._tail()
                break
            self._window()

    def _take(self, length: int, count: int, tokens: int, sequence: int, offset: int, each: int = 1) -> None:
        """``count`` documents of a remaining length give their first ``tokens`` tokens; every ``each`` of them share a sequence, side by side."""
        per_sequence = count // each
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
        for j in range(each):
            done = 0
            while done < per_sequence:
                many, origin, rank, at = self.lots[length].popleft()
                k = min(many, per_sequence - done)
                if k < many:
                    self.lots[length].appendleft((many - k, origin, rank + k, at))
                self.runs.append((origin, rank, k, at, tokens, sequence + done, offset + j * tokens))
                if tokens < length:
                    rest = length - tokens
                    self.left[rest] = self.left.get(rest, 0) + k
                    self.lots.setdefault(rest, deque()).append((k, origin, rank, at + tokens))
                done += k

    def _window(self) -> None:
        self.steps += 1
        first = max(self.left)
        others = dict(self.left)
        others[first] -= 1
        used = closest({n: c for n, c in others.items() if c}, self.capacity - first)
        used[first] = used.get(first, 0) + 1
        slack = self.capacity - sum(n * k for n, k in used.items())
        times = min(self.left[n] // k for n, k in used.items())
        if slack:
            # long enough, and still there: some length has more than the slack, or it would have been used itself
            cut = min(n for n, c in self.left.items() if n > slack and c > used.get(n, 0))
            times = min(times, self.left[cut] // (used.get(cut, 0) + 1))
        offset = 0
        for n in sorted(used, reverse=True):
            self._take(n, times * used[n], n, self.sequences, offset, used[n])
            offset += n * used[n]
        if slack:
            self._take(cut, times, slack, self.sequences, offset)
        self.sequences += times

    def _tail(self) -> None:
        left = sum(n * c for n, c in self.left.items())
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            offset = 0
            while offset < size:
                n = max(self.left)
                tokens = min(n, size - offset)
                self._take(n, 1, tokens, self.sequences, offset)
                offset += tokens
            self.sequences += 1

    def tables(self) -> dict[int, np.ndarray]:
        """By original length: rows (first rank, how many, first token, tokens, first sequence, offset)."""
        out: dict[int, list] = {}
        for origin, *run in sorted(self.runs):
            out.setdefault(origin, []).append(run)
        return {n: np.array(rows, np.int64) for n, rows in out.items()}


def ranked(rows: DataFrame, buckets: int) -> tuple[DataFrame, dict[int, int]]:
    """Rests numbered from 0 within their length, as (length, rank), and the histogram (at most one row a length)."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("bucket", "length", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "uid"))
    out = rows.withColumn("nth", nth).join(counts, ["bucket", "length"])
    return out.select("uid", "doc_id", "doc_tokens", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank")), histogram


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    tables = Tables(spark, "slack")
    # the number of a row is stored with it, so that a row read again is the same one
    all_rows = tables.write(rests(df, id_col, text_col, capacity, vocabulary).withColumn("uid", F.monotonically_increasing_id()))
    whole = all_rows.where(F.col("length") == capacity)
    rest = all_rows.where(F.col("length") < capacity)
    rows, histogram = ranked(rest.drop("ids"), 4 * shuffle_partitions(spark))
    plan = Plan(histogram, capacity)
    by_length = plan.tables()

    def place(batches):
        """A row per run that a rest takes part in; one that is used in parts has no digest yet."""
        for b in batches:
            length, rank = b.column(4).to_numpy(), b.column(6).to_numpy()
            at, run = [], []
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                own = own[np.argsort(rank[own], kind="stable")]
                runs = by_length[n]
                low, high = np.searchsorted(rank[own], runs[:, 0]), np.searchsorted(rank[own], runs[:, 0] + runs[:, 1])
                for k in np.flatnonzero(high > low):
                    at.append(own[low[k] : high[k]])
                    run.append(np.broadcast_to(runs[k], (high[k] - low[k], 6)))
            if not at:
                continue
            rows_at, runs = np.concatenate(at), np.concatenate(run)
            kept = b.take(pa.array(rows_at))
            part = runs[:, 3] < length[rows_at]
            crc = pa.array(kept.column(5).to_numpy(), pa.int64(), mask=part)
            sequence = runs[:, 4] + rank[rows_at] - runs[:, 0]
            columns = [kept.column(0), kept.column(1), kept.column(2), kept.column(3), pa.array(runs[:, 2]), pa.array(runs[:, 3]), crc, pa.array(sequence), pa.array(runs[:, 5])]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "doc_tokens", "start", "first", "length", "ids_crc32", "sequence_id", "offset"])

    placed = tables.write(rows.mapInArrow(place, "uid long, doc_id long, doc_tokens long, start long, first long, length long, ids_crc32 long, sequence_id long, offset long"))
    columns = ["doc_id", (F.col("start") + F.col("first")).alias("start"), "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    uncut = placed.where("ids_crc32 IS NOT NULL").select(columns)
    part = F.expr("crc32(substring(ids, CAST(4 * first + 1 AS INT), CAST(4 * length AS INT)))")
    cut = placed.where("ids_crc32 IS NULL").drop("ids_crc32").join(rest.select("uid", "ids"), "uid").withColumn("ids_crc32", part).select(columns)
    # a whole window is a sequence of its own, numbered after the planned ones by its row
    alone = whole.select("doc_id", "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", (F.lit(plan.sequences) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return uncut.unionByName(cut).unionByName(alone)


def op13_slack(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
