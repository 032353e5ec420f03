"""N-gram Jaccard join: rare-first prefix filtering, then one verification a pair.

A document is the set of its word n-grams.  Two documents link when
``den * |A & B| >= num * |A | B|``.  The steps:

1. One pass over the texts keeps, of every document, its set's size, a digest of
   the set and the head of the set in the order of hashes.  Documents with equal
   sets form a class with one representative.
2. N-grams that stand in the heads of many representatives are common; their
   frequency class goes before the hash in the order that all documents share, so
   that the prefixes hold the rarest n-grams.  Any shared order gives the same
   links; the classes only keep postings short.  A document whose head holds too
   few n-grams that are not common is looked up with its whole set.
3. Representatives meet at the n-grams of their prefixes.  Pairs pass a length
   filter, a positional filter and, before the sets are compared, a suffix filter.
4. First, each posting's most central member is verified against the others;
   the links give components.  Then only those pairs are verified whose members
   are still in different components: a group of near copies costs one
   verification a member, and no link between two components is lost.
   Long postings are compared block by block.

Of a join on a key that many rows may share (a common n-gram, the centre of a
group), the side with one row a key is broadcast up to ``BROADCAST_ROWS`` rows;
beyond, a key's rows are dealt over ``SALTS`` tasks.  Sets travel in parts of some
``PART`` n-grams, so that neither a long document nor a large group is held at once.

Defined results: null text, or text without words, is the empty set, which
links with nothing; fewer words than n are one n-gram; rows that share a doc_id
count as one document for linking and keep their own rows; a null doc_id links
with nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .bpe import slices
from .common import Tables, documents, shuffle_partitions

#: N-grams in more heads than this get a frequency class.
COMMON = 20
#: A side of a join with up to so many rows of a few numbers each is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1 << 18
#: Members of a posting that are compared in one block.
BLOCK = 1024
#: The rows of an n-gram that is in more sets are dealt over blocks.
HOT = 4 * BLOCK
#: Tasks among which the rows of one key are dealt.
SALTS = 16
#: Partners of a document that are verified in one group, and sets that one reading of a text sends.
FAN = 256
#: N-grams in a part of a set, about.
PART = 4096
#: Bytes of text that are hashed, and of sets that are sent, at once.
BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BREAK = np.zeros(256, bool)
_BREAK[[32, *range(9, 14)]] = True
_LOW_BYTES = np.array([*((1 << (8 * k)) - 1 for k in range(8)), (1 << 64) - 1], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of about ``BYTES`` bytes that end between words, and where they begin."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + BYTES)
        end = cut.start() if cut else len(raw)
        yield at, raw[at:end]
        at = end


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word, in order.

    Eight bytes at a time go through a mixing step that is not linear, so no two words collide by their make-up; long
    words are hashed by xxh3.
    """
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for offset, block in _blocks(raw):
        flat = np.frombuffer(block.lower() + b" " * 8, np.uint8)
        gap = _BREAK[flat]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        begin, end = edge[::2], edge[1::2]
        size = end - begin
        eight = np.lib.stride_tricks.as_strided(flat, (len(flat) - 7, 8), (1, 1))
        chunk = lambda at, left: np.ascontiguousarray(eight[at]).view("<u8")[:, 0] & _LOW_BYTES[np.minimum(left, 8)]  # noqa: B023, E731
        h = _mix(size.astype(np.uint64) * _MULTIPLIER ^ chunk(begin, size))
        own, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(own):
            h[own] = _mix(h[own] ^ chunk(begin[own] + k, size[own] - k)) * _MULTIPLIER
            k += 8
            own = own[size[own] > k]
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            h[w] = xxhash.xxh3_64_intdigest(flat[begin[w] : end[w]].tobytes())
        starts.append(begin + offset)
        hashes.append(h)
    return np.concatenate(starts), np.concatenate(hashes)


def ngram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes (int64) of each text's word n-grams."""
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    begin, word = word_hashes(b" ".join(texts))
    gram = np.zeros(max(len(word) - n + 1, 0), np.uint64)
    for k in range(n):
        gram = gram * _MULTIPLIER + word[k : k + len(gram)]
    gram = _mix(gram).view(np.int64)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(begin, starts)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            s = np.sort(gram[a : b - n + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in word[a:b]:
                h = h * _MULTIPLIER + w
            yield _mix(h).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _prefix(size, num: int, den: int):
    """So many n-grams of a set that each set that it links with holds one of them."""
    return size + (-num * size) // den + 1


def _head(size: int, num: int, den: int) -> int:
    """N-grams of a set, in the order of hashes, among which most documents have their prefix."""
    p = _prefix(size, num, den)
    return min(size, p + p // 4 + 8)


def _pair_need(a, b, num: int, den: int):
    """Least overlap of linked sets of sizes a and b: den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


class Rule:
    """Word n-grams of n words, linked from the similarity num / den on."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den

    def overlap(self, a: np.ndarray, b: np.ndarray) -> int:
        """Equal n-grams of two sets; 0 where the suffix filter shows that they are too few."""
        if len(a) > len(b):
            a, b = b, a
        most = len(a) + len(b) - 2 * _pair_need(len(a), len(b), self.num, self.den)
        if most < 0 or self._differ(a, b, most, 4) > most:
            return 0
        return common(a, b)

    def _differ(self, a: np.ndarray, b: np.ndarray, most: int, depth: int) -> int:
        """The suffix filter: at least so many n-grams are in one set alone.  Both are cut at the middle of b, again and again."""
        least = abs(len(a) - len(b))
        if not depth or least > most or len(a) < 8 or len(b) < 8:
            return least
        k = len(b) // 2
        j = int(np.searchsorted(a, b[k]))
        left = self._differ(a[:j], b[:k], most - abs(len(a) - j - len(b) + k), depth - 1)
        return left + self._differ(a[j:], b[k:], most - left, depth - 1)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Equal numbers of two sorted sets, the first not the longer one."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _batches(batches, text: int):
    for whole in batches:
        yield from slices(whole, text, BYTES)


def _described(docs: DataFrame, rule: Rule, whole: bool) -> DataFrame:
    """(doc_id, n, sig, grams) of every row; grams: the whole set or its head, in the order of hashes."""
    n, num, den = rule.n, rule.num, rule.den

    def run(batches):
        for b in _batches(batches, 1):
            size, sig, grams, ends = [], [], [], [0]
            for s in ngram_sets(b.column(1), n):
                size.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                grams.append(s if whole else s[: _head(len(s), num, den)])
                ends.append(ends[-1] + len(grams[-1]))
            flat = pa.array(np.concatenate([*grams, np.zeros(0, np.int64)]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            columns = [b.column(0), pa.array(size, pa.int32()), pa.array(sig, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, sig binary, grams array<long>")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast where so few rows allow it."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _dealt(rows: DataFrame, keyed: DataFrame, many: int, key: str, by: str) -> DataFrame:
    """rows joined to a table of so many rows, one a key.  If it is too large to broadcast, the rows of a key are dealt by another column."""
    if many <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed), key)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def _frequent(sets: DataFrame) -> DataFrame:
    """(gram, df) of n-grams of more than ``COMMON`` sets."""
    return sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") > COMMON)


def _marked(reps: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """reps, with the common ones of their grams as ``marks``."""
    seen = reps.select("rid", F.explode("grams").alias("gram")).join(_small(classes, rows), "gram")
    marks = seen.groupBy("rid").agg(F.collect_list(F.struct("gram", "df")).alias("marks"))
    return reps.join(marks, "rid", "left")


def _wanting(reps: DataFrame, classes: DataFrame, rows: int, rule: Rule) -> DataFrame:
    """node of those whose head, which is not the whole set, holds fewer n-grams that are not common than the prefix has."""
    one = reps.select("rid", "node", "n", F.size("grams").alias("head"), F.explode("grams").alias("gram"))
    seen = one.join(_small(classes, rows), "gram").groupBy("rid", "node", "n", "head").agg(F.count("*").alias("c"))
    prefix = F.col("n") - F.ceil(F.col("n") * rule.num / rule.den) + 1
    return seen.where((F.col("head") < F.col("n")) & (F.col("head") - F.col("c") < prefix)).select("node").distinct()


def _prefixes(marked: DataFrame, rule: Rule) -> DataFrame:
    """(gram, node, n, pos, df): the prefix in the order (class, hash); nothing of those that ``_wanting`` names."""
    num, den = rule.num, rule.den

    def run(batches):
        for b in batches:
            node, size = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            grams, marks = b.column(2), b.column(3)
            flat, ends = grams.flatten().to_numpy(), np.concatenate(([0], np.cumsum(grams.value_lengths().to_numpy())))
            common_flat = marks.flatten()
            key, df = common_flat.field(0).to_numpy(), common_flat.field(1).to_numpy()
            stops = np.concatenate(([0], np.cumsum(np.nan_to_num(marks.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
            out, ranks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(len(node)):
                s, p = flat[ends[k] : ends[k + 1]], _prefix(int(size[k]), num, den)
                rank = np.zeros(len(s), np.int64)
                if stops[k + 1] > stops[k]:
                    rank[np.searchsorted(s, key[stops[k] : stops[k + 1]])] = df[stops[k] : stops[k + 1]]
                    if len(s) < size[k] and (rank == 0).sum() < p:
                        p = 0
                    order = np.argsort(rank, kind="stable")
                    s, rank = s[order], rank[order]
                out.append(s[:p])
                ranks.append(rank[:p])
            many = np.array([len(s) for s in out[1:]], np.int64)
            pos = np.concatenate([np.arange(m) for m in many] or [np.zeros(0)]).astype(np.int32)
            columns = [np.concatenate(out), np.repeat(node, many), np.repeat(size, many), pos, np.concatenate(ranks)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "node", "n", "pos", "df"])

    return marked.where("node is not null").select("node", "n", "grams", "marks").mapInArrow(run, "gram long, node long, n int, pos int, df long")


def _postings(rows: DataFrame) -> DataFrame:
    """(gram, node, n, pos, df, hub, hub_n, hub_pos) of n-grams that two nodes have at least, with the first (most central) member of each.

    The rows of an n-gram that stands in very many sets are dealt over blocks, each with a hub of its own.
    """
    schema = "gram long, node long, n int, pos int, df long, hub long, hub_n int, hub_pos int"
    kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int32, np.int32)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        hub: np.ndarray | None = None  # the first member of the run that the last batch ended in
        told = True
        for b in batches:
            t = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(6)], 1)  # with the block as the last column
            if not len(t):
                continue
            if hub is not None:
                t = np.concatenate((hub[None], t))
            start = np.concatenate(([True], (t[1:, [0, 5]] != t[:-1, [0, 5]]).any(1)))
            first = np.maximum.accumulate(np.where(start, np.arange(len(t)), 0))
            more = ~start | np.concatenate((~start[1:], [False])) | (start & (t[:, 4] > HOT))
            if hub is not None and told:
                more[0] = False
            out = np.concatenate((t[:, :5], t[first][:, 1:4]), 1)[more]
            yield pa.RecordBatch.from_arrays([pa.array(out[:, k].astype(kinds[k])) for k in range(8)], names=names)
            same = hub is not None and first[-1] == 0
            told = bool(more[first[-1]]) or (same and told)
            hub = t[first[-1]].copy()

    block = F.when(F.col("df") > HOT, F.pmod(F.xxhash64("node"), F.ceil(F.col("df") / BLOCK))).otherwise(0).alias("block")
    dealt = rows.select("gram", "node", "n", "pos", "df", block).repartition("gram", "block").sortWithinPartitions("gram", "block", "pos", "node")
    return dealt.mapInArrow(run, schema)


def _meetings(postings: DataFrame, rule: Rule) -> DataFrame:
    """Feasible pairs (a, b, n of a): the hub of a posting or block and each of its members, and the hubs of an n-gram's blocks."""
    of = lambda c: F.struct(*(F.col(f"{c}{x}").alias(x) for x in ("node", "n", "pos")))
    own = postings.select(F.struct(F.col("hub").alias("node"), F.col("hub_n").alias("n"), F.col("hub_pos").alias("pos")).alias("a"), of("").alias("b"))
    hubs = postings.where((F.col("df") > HOT) & (F.col("hub") == F.col("node"))).select("gram", F.struct("pos", "node", "n").alias("b"))
    first = hubs.groupBy("gram").agg(F.min("b").alias("a"))
    more = hubs.join(first, "gram").select(*(F.struct(*(F.col(f"{x}.{c}").alias(c) for c in ("node", "n", "pos"))).alias(x) for x in "ab"))
    both = own.union(more).where(F.col("a.node") != F.col("b.node"))
    both = both.where(_feasible(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), rule))
    return both.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.max("a.n").alias("n"))


def _feasible(a_n, a_pos, b_n, b_pos, rule: Rule):
    """Length and positional filter of a pair that meets at positions a_pos and b_pos of its prefixes."""
    low, high = (F.least(a_n, b_n), F.greatest(a_n, b_n))
    rest = F.least(a_n - a_pos, b_n - b_pos)
    return (low * rule.den >= high * rule.num) & (rest * (rule.num + rule.den) >= (a_n + b_n) * rule.num)


def _verify(docs: DataFrame, pairs: DataFrame, many: int, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link; pairs: so many rows (a, b, n) with the size of a's set.

    Both sets go to the key (a, salt, part); a document with many partners has several salts, and a long set several parts,
    which are cut at the same hashes for a and b.  A text is read once for up to ``FAN`` keys.
    """
    n = rule.n
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"), F.max("n").alias("n"))
    fan = fan.select("a", "fan", F.greatest(F.ceil(F.log2(F.col("n") / PART)), F.lit(0)).cast("int").alias("bits"))
    salt = F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("salt")
    partner = _dealt(pairs.select("a", "b"), fan, many, "a", "b").select(F.col("b").alias("node"), F.col("a").alias("key"), salt, "bits")
    every = F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt")
    sending = partner.union(fan.select(F.col("a").alias("node"), F.col("a").alias("key"), every, "bits"))
    turns = sending.groupBy("node").agg(F.ceil(F.count("*") / FAN).cast("int").alias("turns"))
    dealt = sending.join(turns, "node").withColumn("turn", F.pmod(F.xxhash64("key", "salt"), F.col("turns")))
    need = dealt.groupBy("node", "turn").agg(F.collect_list(F.struct("key", "salt", "bits")).alias("keys"))
    rows = 2 * many  # no more keys than that in all lists together
    wanted = docs.join(_small(need, rows), F.col("doc_id") == F.col("node")).select("node", "text", *(F.col(f"keys.{c}").alias(c) for c in ("key", "salt", "bits")))
    names = ["key", "salt", "part", "other", "node", "n", "version", "grams"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def sets(batches):
        for b in _batches(batches, 1):
            rows, held = [], 0
            keys, salts, bits = (b.column(k).to_pylist() for k in (2, 3, 4))
            for node, s, own, salt, bit in zip(b.column(0).to_pylist(), ngram_sets(b.column(1), n), keys, salts, bits):
                version = xxhash.xxh3_64_intdigest(s.tobytes()) >> 1
                cuts: dict[int, list[bytes]] = {}
                for r in set(bit):
                    at = np.array([(k << (64 - r)) - (1 << 63) for k in range(1, 1 << r)], np.int64)
                    edges = [0, *np.searchsorted(s, at).tolist(), len(s)]
                    cuts[r] = [s[x:y].tobytes() for x, y in zip(edges, edges[1:])]
                for k, x, r in zip(own, salt, bit):
                    for part, raw in enumerate(cuts[r]):
                        rows.append((k, x, part, int(k != node), node, len(s), version, raw))
                        held += len(raw) + 64
                        if held > 2 * BYTES:
                            yield batch(rows)
                            rows, held = [], 0
            if rows:
                yield batch(rows)

    def compare(batches):
        at, mine = None, []
        for b in batches:
            out = []
            for key, salt, part, other, node, size, version, raw in zip(*(c.to_pylist() for c in b.columns)):
                if (key, salt, part) != at:
                    at, mine = (key, salt, part), []
                s = np.frombuffer(raw, np.int64)
                if not other:
                    mine.append((size, version, s))
                    continue
                for own_size, own_version, own in mine:
                    if len(own) == own_size and len(s) == size:
                        i = rule.overlap(own, s)
                    else:
                        i = common(own, s) if len(own) <= len(s) else common(s, own)
                    if i:
                        out.append((key, node, own_version, version, own_size, size, i))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 7
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "va", "vb", "na", "nb", "i"])

    sent = wanted.mapInArrow(sets, "key long, salt int, part int, other int, node long, n int, version long, grams binary")
    dealt = sent.repartition("key", "salt", "part").sortWithinPartitions("key", "salt", "part", "other")
    found = dealt.mapInArrow(compare, "a long, b long, va long, vb long, na long, nb long, i long")
    found = found.groupBy("a", "b", "va", "vb").agg(F.sum("i").alias("i"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return found.where(F.col("i") * rule.den >= (F.col("na") + F.col("nb") - F.col("i")) * rule.num).select("a", "b").distinct()


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root): root is the smallest node of the component.  Alternating large-star and small-star steps; each round is one table."""
    e, before = _rooted(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")), tables)
    while before[0]:
        both = e.select(F.col("x").alias("u"), F.col("y").alias("v")).union(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(_small(least, 2 * before[0]), "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        small = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(_small(small, 2 * before[0]), "x").select(F.greatest("y", "m").alias("x"), F.least("y", "m").alias("y"))
        new, now = _rooted(joined.union(small.select("x", F.col("m").alias("y"))), tables)
        tables.drop(e)
        e = new
        if now == before:
            break
        before = now
    return e.select(F.col("x").alias("node"), F.col("y").alias("root"))


def _rooted(edges: DataFrame, tables: Tables) -> tuple[DataFrame, tuple]:
    """The distinct edges as a table, and (count, sum of hashes) of them, gathered while it is written."""
    seen = Observation()
    marks = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h"))
    out = tables.write(edges.where("x <> y").distinct().observe(seen, *marks))
    return out, (seen.get["n"], seen.get["h"])


def _split_pairs(postings: DataFrame, stars: DataFrame, rule: Rule) -> DataFrame:
    """Feasible pairs (a, b, n) of one posting whose members are in different components."""
    rows = postings.select("gram", "node", "n", "pos").join(stars, "node", "left")
    rows = rows.select("gram", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("df"))
    mixed = mixed.where("r0 <> r1").select("gram", F.ceil(F.col("df") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(mixed, "gram").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("gram", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "node", "n", "pos", "root")
    num, den = rule.num, rule.den

    def pairs(t: np.ndarray):
        """t: rows (gram, p, q, node, n, pos, root) of whole blocks, by block and n; arrays (a, b, n of a).

        All rows are paired at once with the row d places on, for d = 1, 2, ..., until blocks end or lengths differ too much.
        """
        n = t[:, 4]
        last = np.flatnonzero(np.concatenate(((t[1:, :3] != t[:-1, :3]).any(1), [True])))
        end = last[np.searchsorted(last, np.arange(len(t)))] + 1
        i, d = np.arange(len(t)), 0
        while len(i):
            d += 1
            i = i[i + d < end[i]]
            i = i[n[i + d] * num <= n[i] * den]
            j = i + d
            rest = np.minimum(n[i] - t[i, 5], n[j] - t[j, 5])
            ok = (t[i, 6] != t[j, 6]) & (t[i, 3] != t[j, 3]) & (rest * (num + den) >= (n[i] + n[j]) * num)
            x, y = t[i[ok]], t[j[ok]]
            if len(x):
                swap = x[:, 3] > y[:, 3]
                yield np.where(swap, y[:, 3], x[:, 3]), np.where(swap, x[:, 3], y[:, 3]), np.where(swap, y[:, 4], x[:, 4])

    def run(batches):
        held: list[np.ndarray] = []

        def found(t):
            for a, b, n in pairs(t):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int32))], names=["a", "b", "n"])

        for batch in batches:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1))
            if sum(map(len, held)) >= 1 << 15:
                t = np.concatenate(held)
                cut = np.flatnonzero((t[1:, :3] != t[:-1, :3]).any(1))
                cut = int(cut[-1]) + 1 if len(cut) else 0  # the last block may go on
                held = [t[cut:]]
                yield from found(t[:cut])
        if held:
            yield from found(np.concatenate(held))

    many = shuffle_partitions(postings.sparkSession)  # more work than bytes, so these are not joined to few tasks
    dealt = rows.repartition(many, "gram", "p", "q").sortWithinPartitions("gram", "p", "q", "n")
    return dealt.mapInArrow(run, "a long, b long, n int").groupBy("a", "b").agg(F.max("n").alias("n"))


def _ranked(docs: DataFrame, reps: DataFrame, seen: tuple[DataFrame, int], rule: Rule, tables: Tables) -> DataFrame:
    """(gram, node, n, pos, df): the representatives' prefixes, rarest n-grams first; seen: the common n-grams of their heads."""
    whole = lambda few: _described(docs.join(_small(*few), F.col("doc_id") == F.col("node"), "left_semi"), rule, True).where("n > 0")
    classes, many = seen
    few = tables.counted(_wanting(reps, classes, many, rule))
    tables.release()
    if few[1]:
        # n-grams beyond the heads are as common, but were not counted yet
        both = classes.union(_frequent(whole(few))).groupBy("gram").agg(F.max("df").alias("df"))
        classes, many = tables.counted(both)
        few = tables.counted(_wanting(reps, classes, many, rule))
    rows = _prefixes(_marked(reps, classes, many), rule)
    if few[1]:
        named = whole(few).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("node"), "n", "grams")
        named = tables.write(named, small=True)
        rows = rows.union(_prefixes(_marked(named, classes, many), rule))
    return rows


def jaccard_components(
    df: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: its set's size and the smallest doc_id that links reach."""
    rule = Rule(words, num, den)
    tables = Tables(df.sparkSession, "jaccard")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    heads = tables.keep(_described(docs, rule, False).withColumn("rid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    classes = heads.where("n > 0").groupBy("sig").agg(first).select("sig", F.col("first.doc_id").alias("rep"), "first.rid")
    classes = tables.write(classes, small=True)
    base = tables.write(heads.select("doc_id", "n", "sig"), small=True)
    reps = tables.keep(heads.join(classes.select("rid"), "rid", "left_semi").select("rid", F.col("doc_id").alias("node"), "n", "grams"))
    seen = tables.counted(_frequent(reps))
    tables.drop(heads)
    postings = tables.keep(_postings(_ranked(docs, reps, seen, rule, tables)))
    tried, many = tables.counted(_meetings(postings, rule))
    tables.drop(reps)
    stars = components(_verify(docs, tried, many, rule), tables)
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tables.release()
    second, many = tables.counted(_split_pairs(postings, stars, rule).join(done, ["a", "b"], "left_anti"))
    tables.drop(postings)
    edges = stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_verify(docs, second, many, rule))
    found = components(edges, tables)
    tables.done()
    some = base.where("n > 0").select("doc_id", "n", "sig").join(classes.select("sig", "rep"), "sig")
    some = some.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "n", F.coalesce("root", "rep").alias("component_id"))
    none = base.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.union(none).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
