"""Best-fit packing of token sequences by a linear grouping scheme.

Only the histogram of piece lengths (at most ``capacity`` numbers) decides the
plan, so the driver holds a bounded table whatever the corpus size:

1. large lengths are sorted and cut into groups of equal cardinality, each
   rounded up to its longest member;
2. the problem with these few sizes is solved by configurations (multisets of
   sizes that fit one sequence), each used as often as its sizes allow;
3. actual documents, longest first, take the slots of their group;
4. small lengths go, longest first, into the tightest sequence with room.

The plan is a list of segments: documents of one length with ranks a, a + 1, ...
go to sequences s, s + 1, ... at a fixed offset.  Ranks come from counts by
(bucket, length), so no length, however frequent, meets in one task.

Defined results: null text is the empty text (one piece holding the end id
alone); equal rows are separate documents; the order among equal lengths is by
bucket, doc_id, piece and copy.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet, default_vocabulary, slices
from .common import Tables, documents, shuffle_partitions

CAPACITY = 2048
END_ID = 0
GROUPS = 300
#: Lengths up to this share of the capacity are small.
SMALL_SHARE = 0.4
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Runs in a text that only the vocabulary's own library encodes in bounded time and stack.
_LONG_RUN = re.compile(r"\s{1000}|\S{10000}")


@lru_cache(maxsize=2)
def encoder(json_path: str):
    """text -> ids as the vocabulary's own library, tokenizers, gives them.

    Where a token's id tells its merge's rank, a quicker library gives the same ids; texts with a long run go to the
    vocabulary's own.
    """

    @cache
    def library():
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(json_path)
        own.no_truncation()
        own.no_padding()
        return own

    by_library = lambda text: library().encode(text, add_special_tokens=False).ids
    spec = json.load(open(json_path, encoding="utf-8"))
    vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = {token: i for token, i in vocab.items() if token not in special}
    if merged != sorted(merged) or any(c not in alphabet for token in plain for c in token):
        return by_library
    import public_tokenizers
    import tiktoken

    ranks = {bytes(alphabet[c] for c in token): i for token, i in plain.items()}
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if _LONG_RUN.search(text):
            return by_library(text)
        return quick.encode(text, allowed_special="all") if any(x in text for x in special) else quick.encode_ordinary(text)

    return encode


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every document's ids, the end id last, cut into pieces; only documents over the capacity are cut, the first piece is the short one."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        encode = encoder(path)
        for whole in batches:
            for batch in slices(whole, 1):
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), END_ID], "<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECE_SCHEMA)


class Plan:
    """Segments (length, first rank, first sequence, offset) for a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_share: float = SMALL_SHARE):
        self.capacity = capacity
        self.segments: list[tuple[int, int, int, int]] = []
        self.sequences = 0
        self.next_rank = dict.fromkeys(counts, 0)
        self.room: list[tuple[int, int, int]] = []  # (room left, first sequence, how many), sorted
        small = int(capacity * small_share)
        self._large({n: c for n, c in counts.items() if n > small}, groups)
        for n in sorted((n for n in counts if n <= small), reverse=True):
            self._best_fit(n, counts[n])

    def _take(self, length: int, first: int, count: int, offset: int) -> None:
        self.segments.append((length, self.next_rank[length], first, offset))
        self.next_rank[length] += count

    def _large(self, counts: dict[int, int], groups: int) -> None:
        lengths = sorted(counts, reverse=True)
        if not lengths:
            return
        each = max(1, -(-sum(counts.values()) // groups))
        group: list[list[list[int]]] = []  # of [length, count], longest first
        filled = each
        for n in lengths:
            left = counts[n]
            if filled < each and left > each:  # a frequent length is a group of its own, with nothing to round
                filled = each
            if filled >= each:
                group.append([])
                filled = 0
            group[-1].append([n, left])
            filled += left
        sizes = [g[0][0] for g in group]
        left = [sum(c for _, c in g) for g in group]
        for g in range(len(group)):
            while left[g]:
                slots = self._configuration(g, sizes, left)
                times = min(left[k] // slots.count(k) for k in set(slots))
                for k in slots:
                    left[k] -= times
                self._substitute([group[k] for k in slots], times)

    def _configuration(self, g: int, sizes: list[int], left: list[int]) -> list[int]:
        """Groups whose sizes, beside one of group g, fill a sequence best (a bounded subset sum); fewest parts win ties."""
        room = self.capacity - sizes[g]
        reach: list[list[int] | None] = [None] * (room + 1)
        reach[0] = []
        for k in range(g, len(sizes)):
            have = left[k] - (k == g)
            if have <= 0 or sizes[k] > room:
                continue
            if reach[room] is not None:
                break
            for _ in range(min(have, room // sizes[k])):
                changed = False
                for r in range(room, sizes[k] - 1, -1):
                    if reach[r] is None and reach[r - sizes[k]] is not None:
                        reach[r] = [*reach[r - sizes[k]], k]
                        changed = True
                if not changed:
                    break
        return [g, *next(reach[r] for r in range(room, -1, -1) if reach[r] is not None)]

    def _substitute(self, slots: list[list[list[int]]], times: int) -> None:
        """``times`` sequences with one document of each slot's group; a run of sequences with equal layout is one segment a slot."""
        taken: list[list[tuple[int, int]]] = []
        for group in slots:
            need, got = times, []
            while need:
                n, c = group[0]
                k = min(c, need)
                got.append((n, k))
                need -= k
                if k == c:
                    group.pop(0)
                else:
                    group[0][1] -= k
            taken.append(got)
        edges = sorted({0} | {int(e) for got in taken for e in np.cumsum([k for _, k in got])})
        at = [0] * len(taken)
        used = [0] * len(taken)
        for a, b in zip(edges, edges[1:]):
            offset = 0
            for s, got in enumerate(taken):
                n, k = got[at[s]]
                self._take(n, self.sequences + a, b - a, offset)
                offset += n
                used[s] += b - a
                if used[s] == k:
                    at[s], used[s] = at[s] + 1, 0
            insort(self.room, (self.capacity - offset, self.sequences + a, b - a))
        self.sequences += times

    def _best_fit(self, length: int, count: int) -> None:
        while count:
            i = bisect_left(self.room, (length, -1, -1))
            if i < len(self.room):
                room, first, many = self.room.pop(i)
            else:
                room, first, many = self.capacity, self.sequences, -(-count // (self.capacity // length))
                self.sequences += many
            per = room // length
            if count >= per:
                use = min(many, count // per)
            else:
                per, use = count, 1
            for j in range(per):
                self._take(length, first, use, self.capacity - room + j * length)
            count -= per * use
            if use < many:
                insort(self.room, (room, first + use, many - use))
            if room - per * length:
                insort(self.room, (room - per * length, first, use))

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments sorted by (length, first rank)."""
        t = np.array(sorted(self.segments), np.int64).reshape(-1, 4)
        return t[:, 0], t[:, 1], t[:, 2], t[:, 3]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, groups: int = GROUPS, vocabulary: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    tables = Tables(spark, "packing")
    rows = tables.write(pieces(df, id_col, text_col, capacity, vocabulary))
    buckets = 4 * shuffle_partitions(spark)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    length, rank, sequence, offset = Plan(histogram, capacity, groups).table()
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", "length", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32", "start"))).join(before, ["bucket", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    low = np.searchsorted(length, np.arange(capacity + 2))

    def place(batches):
        for b in batches:
            n, r = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.empty(len(n), np.int64)
            for x in np.unique(n):
                own = n == x
                at[own] = low[x] + np.searchsorted(rank[low[x] : low[x + 1]], r[own], "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
