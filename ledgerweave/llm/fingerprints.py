"""Homomorphic multiset fingerprints of documents.

A text is a multiset of paragraphs (lines) and of chunks (up to ``CHUNK``
characters of a clause).  Each element is hashed to a wide vector, and the
vectors are summed modulo powers of two, so that the order of elements is of no
account and elements can be inserted or deleted by adding or subtracting theirs:

* the identity part sums, per paragraph, 16 lanes modulo 2 ** 32;
* the likeness part sums, per chunk, 120 lanes of one bit.  A lane's sum, doubled
  and less the number of chunks, adds a random sign per chunk: the cosine of two
  texts' lanes estimates the cosine of their chunk counts.  Three lanes are summed
  in one number, in blocks too small for a carry, and blocks' lanes are added apart.

The printed fingerprint holds the identity lanes, the number of chunks and the whole
likeness lanes, so likeness is a function of two fingerprints.  Paragraphs are the
lines that are not empty: texts that differ in blank lines alone share a fingerprint.

Only DataFrame functions.  The next document comes from a window over ranges of
doc_id; the first row of each range is copied to the range before it, so no
task sees more than its range.

Defined results: null text is the empty text (the fingerprint of nothing); two
empty texts are alike by 1, an empty and another one by 0; rows that share a
doc_id are ordered by text, descending; a null doc_id comes last.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

CHUNK = 16
CLAUSE = r"[^\n.,;:!?]"
WORDS = 8  # 64-bit hashes of a paragraph, two lanes of 32 bits each
SKETCHES = 2  # 64-bit hashes of a chunk, 60 lanes each
_SHIFTS = range(20)
BLOCK_BITS = 19  # a block has up to 2 ** 19 elements, so that no lane of 20 bits overflows
_MASK = (1 << 40) | (1 << 20) | 1


def elements(text: Column) -> Column:
    """array<struct<kind, parts>>: kind 0 the paragraphs, 1 the chunks."""
    lines = F.filter(F.split(text, "\n"), lambda s: s != "")
    chunks = F.regexp_extract_all(text, F.lit(CLAUSE + "{1,%d}" % CHUNK), F.lit(0))
    return F.array(F.struct(F.lit(0).alias("kind"), lines.alias("parts")), F.struct(F.lit(1).alias("kind"), chunks.alias("parts")))


def _sums() -> list[Column]:
    """Aggregates over rows (kind, s)."""
    out = []
    for w in range(WORDS):
        h = F.when(F.col("kind") == 0, F.xxhash64(F.lit(w), "s"))
        out += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"d{2 * w}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"d{2 * w + 1}")]
    for w in range(SKETCHES):
        h = F.when(F.col("kind") == 1, F.xxhash64(F.lit(WORDS + w), "s"))
        out += [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_MASK))).alias(f"s{w * len(_SHIFTS) + k}") for k in _SHIFTS]
    return [*out, F.count(F.when(F.col("kind") == 1, 1)).alias("n")]


def _added() -> list[Column]:
    """Aggregates over blocks' sums: dense, sketch (a number per lane) and n."""
    one = lambda c: F.coalesce(F.sum(c), F.lit(0))
    dense = [one(f"d{k}") % (1 << 32) for k in range(2 * WORDS)]
    sketch = [one(F.shiftrightunsigned(F.col(f"s{k}"), b).bitwiseAND(F.lit(0xFFFFF))) for k in range(SKETCHES * len(_SHIFTS)) for b in (0, 20, 40)]
    return [F.array(*dense).alias("dense"), F.array(*sketch).alias("sketch"), F.sum("n").alias("n")]


def text_of(dense: Column, sketch: Column, n: Column) -> Column:
    """The fingerprint as hexadecimal digits: identity lanes (8 each), the number of chunks (16), likeness lanes (as many each as that number has)."""
    digits = lambda a, width: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), width, F.lit("0"))), "")
    return F.concat(digits(dense, F.lit(8)), F.lpad(F.lower(F.hex(n)), F.lit(16), F.lit("0")), digits(sketch, F.length(F.hex(n))))


def lanes(sketch: Column, n: Column) -> Column:
    """Signed likeness lanes."""
    return F.transform(sketch, lambda x: x * 2 - n).cast("array<double>")


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Cosine of two lane arrays, from 0 to 1; 1 for equal fingerprints."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(equal, 1.0).when(norm == 0, 0.0).otherwise(F.round(F.least(F.greatest(dot(a, b) / norm, F.lit(0.0)), F.lit(1.0)), 6))


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, dense, sketch and n of each group of equal keys (each row, if they are unique); no shuffle if the rows are dealt by a key."""
    one = df.select(*keys, F.explode(elements(F.coalesce(F.col(text_col), F.lit("")))).alias("e"))
    one = one.select(*keys, F.col("e.kind").alias("kind"), F.posexplode_outer("e.parts").alias("at", "s"))
    one = one.select(*keys, F.shiftright(F.coalesce("at", F.lit(0)), BLOCK_BITS).alias("block_no"), F.when(F.col("s").isNotNull(), F.col("kind")).alias("kind"), "s")
    return one.groupBy(*keys, "block_no").agg(*_sums()).groupBy(*keys).agg(*_added())


def _ranged(docs: DataFrame) -> DataFrame:
    """Adds range_no and guest: each row in its range of doc_id, and rows with a range's largest doc_id also, as guests, in the range before (descending)."""
    many = 4 * shuffle_partitions(docs.sparkSession)
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [k / many for k in range(1, many)], 20 * many)).first()[0] or []
    splits = [float("-inf"), *(sorted({float(c) for c in cuts}) or [0.0]), float("inf")]
    place = lambda d: Bucketizer(splits=splits, inputCol="at", outputCol="range_no", handleInvalid="keep").transform(d.withColumn("at", F.col("doc_id").cast("double"))).withColumn("range_no", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("range_no")).cast("int")).drop("at")
    heads = place(ids).groupBy("range_no").agg(F.max("doc_id").alias("head")).orderBy(F.desc("range_no")).collect()  # a row per range
    hosts = [(heads[k]["head"], heads[k - 1]["range_no"]) for k in range(len(heads))]  # the first range's head is the last one's guest
    guests = docs.sparkSession.createDataFrame(hosts, "head long, host int")
    out = place(docs).join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    homes = F.array(F.struct(F.col("range_no").alias("r"), F.lit(0).alias("g")), F.struct(F.col("host").alias("r"), F.lit(1).alias("g")))
    return out.select("doc_id", "text", F.explode(F.filter(homes, lambda h: h["r"].isNotNull())).alias("h")).select(F.col("h.r").alias("range_no"), F.col("h.g").alias("guest"), "doc_id", "text")


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, that of the text with its last third replaced from the next document, and their likeness."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("range_no").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    rows = _ranged(docs).withColumn("nth", F.row_number().over(order)).withColumn("follower", F.lead("text").over(order))
    rows = rows.withColumn("edited", F.when(F.col("guest") == 0, F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.coalesce("follower", F.lit("")), F.lit(1), third))))
    keys = ["range_no", "nth", "guest", "doc_id", "n_chars", "edited_sha256", "which"]
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    rows = rows.select("range_no", "nth", "guest", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.filter(both, lambda b: b["t"].isNotNull())).alias("b")).select("range_no", "nth", "guest", "doc_id", "n_chars", "edited_sha256", "b.which", F.col("b.t").alias("text"))
    prints = fingerprints(rows, keys).withColumn("fp", F.struct("dense", "sketch", "n"))
    turn = Window.partitionBy("range_no").orderBy("nth", "which")
    prints = prints.select(*keys, "fp", F.lead("fp", 1).over(turn).alias("fp_edited"), F.lead("fp", 2).over(turn).alias("fp_next")).where("guest = 0 and which = 0")
    prints = prints.select("doc_id", "n_chars", "edited_sha256", *(c for f in ("fp", "fp_edited", "fp_next") for c in (text_of(F.col(f"{f}.dense"), F.col(f"{f}.sketch"), F.col(f"{f}.n")).alias(f"{f}_text"), lanes(F.col(f"{f}.sketch"), F.col(f"{f}.n")).alias(f"{f}_lanes"))))
    like = lambda f: likeness(F.col("fp_lanes"), F.col(f"{f}_lanes"), F.col("fp_text") == F.col(f"{f}_text"))
    return prints.select("doc_id", "n_chars", "edited_sha256", F.col("fp_text").alias("fingerprint"), F.col("fp_edited_text").alias("edited_fingerprint"), like("fp_edited").alias("near_edited"), like("fp_next").alias("near_next"))


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
