"""Phrase collocation mining over a dictionary of frequent words.

1. Texts are cut into words block by block (a block: about half a million words of one language); a block keeps its words'
   numbers, and its own dictionary with counts.
2. Word counts add up over the blocks' dictionaries.  A word of fewer than ``least`` occurrences can be in no candidate:
   the others get ids, which each block fetches for its own dictionary by a join; everywhere else pieces break.
3. The runs of 2 to ``longest`` ids are fixed-width keys (4 bytes a word, zeros behind shorter ones).  A block sorts its
   keys by radix, counts runs of equal ones, and deals the distinct ones to ranges of keys; a range's task sorts what it
   got by radix once more and adds up the counts of equal keys.  A key, however frequent, is there once a block.
4. Candidates meet the counts of their parts by joins.

The ranges' bounds come from keys of at most ``SAMPLE_BLOCKS`` blocks; they decide how evenly tasks are filled, nothing
else.  Products of counts are decimals of 38 digits: exact for counts up to 10**15.

Defined results: null text is the empty text, null lang is ``und``; equal rows count each; an empty table, or one without
a phrase of ``least`` occurrences, gives no rows; columns beside lang and text are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, documents, shuffle_partitions

LEAST, LONGEST, TOP, SHARE = 10, 3, 2000, 50
#: Words of a block.
BLOCK_WORDS = 1 << 19
#: Bytes of a text that are split at once.
CHUNK = 1 << 20
SAMPLE_BLOCKS, SAMPLE_KEYS = 32, 2000
#: Keys that a range holds at most if blocks shared none, in bytes.
RANGE_BYTES = 16 << 20
#: Parts in which a language is ranked first, and then.
SALTS = (64, 8)

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = b"."
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CLEAN = bytes.maketrans(_UPPER + b"\t" + _BREAKS, _UPPER.lower() + b" " + _BREAK * len(_BREAKS))
_GAP = re.compile(rb"[ .]")


class Block:
    """Words of one language as numbers of its own dictionary, in which 0 is a break."""

    def __init__(self):
        self.local = defaultdict(count().__next__)
        self.local[_BREAK]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        text = text.translate(_CLEAN)
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + CHUNK)
            end = gap.start() if gap else len(text)
            words = text[at:end].replace(_BREAK, b" . ").split()
            self.parts.append(np.fromiter(map(self.local.__getitem__, words), "<u4", len(words)))
            self.size += len(words)
            at = end
        self.parts.append(np.zeros(1, "<u4"))

    def row(self, lang: str) -> pa.RecordBatch:
        words = np.concatenate(self.parts)
        counts = np.bincount(words, minlength=len(self.local)).astype(np.int64)
        edges = pa.array([0, len(counts) - 1], pa.int32())
        columns = [
            pa.array([lang], pa.string()),
            pa.array([int(counts[1:].sum())], pa.int64()),
            pa.array([words.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary()),
            pa.ListArray.from_arrays(edges, pa.array(list(self.local)[1:], pa.binary())),
            pa.ListArray.from_arrays(edges, pa.array(counts[1:])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "n", "tokens", "words", "counts"])


def blocks(df: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = BLOCK_WORDS) -> DataFrame:
    """A row per block: lang, n (words), tokens (all lowest bytes of its numbers, then the next ones, for such files are compressed), words, counts."""

    def run(batches):
        held: dict[str, Block] = defaultdict(Block)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = held[lang]
                block.add(text.as_py() or b"")
                full = lang if block.size >= size else max(held, key=lambda k: held[k].size) if sum(b.size for b in held.values()) >= 4 * size else None
                if full is not None:
                    yield held.pop(full).row(full)
        for lang, block in held.items():
            yield block.row(lang)

    return df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "lang string, n long, tokens binary, words array<binary>, counts array<long>")


def numbered(spark, tables: Tables, words: DataFrame) -> DataFrame:
    """Rows with ids 1, 2, ...: numbered within partitions as they are written, then moved by the counts of the partitions before."""
    rows = tables.write(words.withColumn("at", F.monotonically_increasing_id()), small=True)
    part = F.shiftright("at", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row per partition
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["n"]
    if total >= 1 << 32:
        raise ValueError("more frequent words than 32-bit ids")
    offsets = spark.createDataFrame(before, "part long, before long")
    return rows.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("id", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", "at")


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by columns, the first one weighs most: 16 bits at a time from the least, by a stable counting sort."""
    order = np.arange(len(columns[0]), dtype=np.uint32)
    for column in reversed(columns):
        for shift in (0, 16):
            digit = (column >> shift).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def run_lengths(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and the sum of their counts (none: 1 each)."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(first, append=len(order)) if counts is None else np.add.reduceat(counts[order], first)


def grams(ids: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct runs of 2 to ``longest`` ids without a 0, zeros behind, and how often they occur."""
    columns: list[list[np.ndarray]] = [[] for _ in range(longest)]
    good = ids > 0
    for m in range(2, longest + 1):
        rows = len(ids) - m + 1
        if rows <= 0:
            break
        at = np.flatnonzero(np.logical_and.reduce([good[k : k + rows] for k in range(m)]))
        for k in range(longest):
            columns[k].append(ids[at + k] if k < m else np.zeros(len(at), np.uint32))
    flat = [np.concatenate(c) if c else np.zeros(0, np.uint32) for c in columns]
    return run_lengths(flat)


def keys(columns: list[np.ndarray]) -> np.ndarray:
    """Fixed-width keys: big-endian, so that their byte order is the order of the rows."""
    wide = np.stack(columns, 1).astype(">u4") if columns else np.zeros((0, 0), ">u4")
    return np.ascontiguousarray(wide).view(f"S{4 * len(columns)}").ravel()


def packed(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted distinct rows and counts; equal bytes of the numbers side by side, for shuffle files are compressed."""
    first = np.diff(columns[0], prepend=np.uint32(0))
    wide = [first, *columns[1:], counts.astype(np.uint32)]
    return np.stack([c.astype("<u4") for c in wide]).view(np.uint8).reshape(len(wide), -1, 4).transpose(0, 2, 1).tobytes()


def unpacked(raw: bytes, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    wide = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(longest + 1, 4, -1).transpose(0, 2, 1)).view("<u4")[..., 0]
    return [np.cumsum(wide[0], dtype=np.uint32), *wide[1:-1]], wide[-1].astype(np.int64)


def block_ids(left: pa.Table, right: pa.Table) -> np.ndarray:
    """A block's words by ids of the dictionary; 0 where a piece or a frequent stretch ends."""
    tokens = np.frombuffer(left.column("tokens")[0].as_py(), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    known = np.zeros(int(tokens.max()) + 1, np.uint32)
    known[right.column("local").to_numpy()] = right.column("id").to_numpy()
    return known[tokens]


def counted(tables: Tables, held: DataFrame, local: DataFrame, frequent: DataFrame, longest: int, least: int, ranges: int) -> DataFrame:
    """key (4 bytes a word), a: every phrase of 2 to ``longest`` words with at least ``least`` occurrences."""
    known = local.join(frequent.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), F.col("local").cast("int").alias("local"), "id")

    def by_block(some: list[int] | None, run, schema: str) -> DataFrame:
        left, right = held.select("block", "tokens"), known
        if some is not None:
            left, right = left.where(F.col("block").isin(some)), right.where(F.col("of").isin(some))
        return left.groupBy("block").cogroup(right.groupBy("of")).applyInArrow(run, schema)

    def sample(left: pa.Table, right: pa.Table) -> pa.Table:
        got = keys(grams(block_ids(left, right), longest)[0]) if left.num_rows else []
        some = [got[i].ljust(4 * longest, b"\0") for i in range(0, len(got), -(-len(got) // SAMPLE_KEYS) or 1)]
        return pa.table({"key": pa.array(some, pa.binary())})

    chosen = [r["block"] for r in held.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS).collect()]
    got = np.sort(np.array([bytes(r["key"]) for r in by_block(chosen, sample, "key binary").collect()], f"S{4 * longest}"))
    bounds = np.unique(got[np.arange(1, ranges) * len(got) // ranges]) if len(got) else got

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        columns, counts = grams(block_ids(left, right), longest) if left.num_rows else ([], np.zeros(0, np.int64))
        edges = [0, *np.searchsorted(keys(columns), bounds, "left").tolist(), len(counts)] if len(counts) else [0]
        parts = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return pa.table({"range": pa.array([k for k, _, _ in parts], pa.int32()), "part": pa.array([packed([c[a:b] for c in columns], counts[a:b]) for _, a, b in parts], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        got = [unpacked(raw.as_py(), longest) for raw in table.column("part")]
        columns, counts = run_lengths([np.concatenate([c[k] for c, _ in got]) for k in range(longest)], np.concatenate([n for _, n in got]))
        enough = counts >= least
        columns, counts = [c[enough] for c in columns], counts[enough]
        wide, size = np.stack(columns, 1).astype(">u4"), 4 * sum((c > 0).astype(np.int64) for c in columns)
        return pa.table({"key": pa.array([raw[:n] for raw, n in zip(map(bytes, wide), size.tolist())], pa.binary()), "a": pa.array(counts, pa.int64())})

    dealt = by_block(None, deal, "range int, part binary")
    return tables.write(dealt.groupBy("range").applyInArrow(merge, "key binary, a long"), small=True)


#: Of a phrase: the first k words and the rest for every cut, and its words, as (kind, place, key).
_PARTS = """explode(flatten(array(
    transform(sequence(1, m - 1), k -> struct('l' AS kind, k AS place, substring(key, 1, 4 * k) AS part)),
    transform(sequence(1, m - 1), k -> struct('r' AS kind, k AS place, substring(key, 4 * k + 1) AS part)),
    transform(sequence(1, m), k -> struct('w' AS kind, k AS place, substring(key, 4 * k - 3, 4) AS part)))))"""
#: The phrases of two words or more inside one of m words.
_INSIDE = "explode(flatten(transform(sequence(2, m - 1), n -> transform(sequence(0, m - n), k -> substring(key, 4 * k + 1, 4 * n)))))"
_SCORE = "CAST(CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(1000000 AS DECIMAL(7, 0)) div (CAST(l[k - 1] AS DECIMAL(15, 0)) * CAST(r[k - 1] AS DECIMAL(15, 0))) AS BIGINT)"


def scored(candidates: DataFrame, frequent: DataFrame, share: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers."""
    candidates = candidates.withColumn("m", F.expr("CAST(octet_length(key) / 4 AS INT)"))
    longer = candidates.where("m > 2").select(F.expr(_INSIDE).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, "key", "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
    counts = candidates.select(F.col("key").alias("part"), F.col("a").alias("f"), F.lit(None).cast("binary").alias("word"), F.lit(None).cast("string").alias("lang"))
    counts = counts.unionByName(frequent.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("part"), "f", "word", "lang"))
    parts = kept.select("key", "a", F.expr(_PARTS).alias("p")).select("key", "a", "p.*").join(counts, "part")
    rows = parts.groupBy("key", "a").agg(F.sort_array(F.collect_list(F.struct("kind", "place", "f", "word"))).alias("p"), F.max("lang").alias("lang"))
    own = lambda kind, field: F.expr(f"transform(filter(p, x -> x.kind = '{kind}'), x -> {field})")
    rows = rows.select("key", "lang", "a", own("l", "x.f").alias("l"), own("r", "x.f").alias("r"), F.array_join(own("w", "CAST(x.word AS STRING)"), " ").alias("phrase"))
    cut = F.array_min(F.expr(f"transform(sequence(1, size(l)), k -> struct({_SCORE} AS score, k AS k, l[k - 1] AS l, r[k - 1] AS r))"))
    return rows.withColumn("cut", cut).select("key", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def mine(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score.

    least: occurrences of a candidate; longest: its words at most; share: a candidate is dropped if a longer one that holds
    it has this share, in hundredths, of its occurrences.
    """
    spark = df.sparkSession
    tables = Tables(spark, "phrases")
    held = tables.write(blocks(df, lang_col, text_col, block_words).withColumn("block", F.monotonically_increasing_id()))
    totals = held.groupBy("lang").agg(F.sum("n").alias("n"))
    local = held.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("block", "lang", (F.col("at") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    frequent = local.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    frequent = numbered(spark, tables, frequent)
    tables.release()
    words = held.agg(F.sum("n")).first()[0] or 0
    ranges = max(4 * shuffle_partitions(spark), -(-words * (longest - 1) * 4 * (longest + 1) // RANGE_BYTES))
    candidates = counted(tables, held, local, frequent, longest, least, ranges)
    tables.release()
    rows = scored(candidates, frequent, share)
    order = (F.desc("score"), F.desc("a"), "phrase")
    for parts in SALTS:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(parts)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, 1 AS m, unnest(w) AS g FROM words
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM words
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM words),
f AS (SELECT lang, m, g, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
cuts AS (
    SELECT lang, m, g, a, w, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scores AS (
    SELECT c.lang, c.m, c.g, c.a, c.k, l.a AS l, r.a AS r, ((c.a::HUGEINT * c.a * 1000000) // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.m = c.k AND l.g = c.first JOIN f r ON r.lang = c.lang AND r.m = c.m - c.k AND r.g = c.rest),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, m, g ORDER BY score, k) = 1),
covered AS (
    SELECT lang, g, max(a) AS longer
    FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM candidates WHERE m = 3) GROUP BY lang, g),
kept AS (
    SELECT b.* FROM best b LEFT JOIN covered c ON b.m = 2 AND c.lang = b.lang AND c.g = b.g
    WHERE c.longer IS NULL OR 100 * c.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM kept)
SELECT r.lang, r.rank, r.g AS phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
