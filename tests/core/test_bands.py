"""Band joins against all pairs, how many rows they hand on, and sums of two."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions.money import amounts_equal, cents_tie
from ledgerweave.operators import batch, bands, fourway, invoices


def amounts(rng, many):
    out = [rng.choice([0.0, 0.5, 1.0, 100.0, 99.5, 1e12]) if rng.random() < 0.1 else round(10 ** rng.uniform(-2, 9), 2) for _ in range(many)]
    out += [round(x * rng.uniform(0.989, 1.011), 2) for x in out] + [x + rng.choice([-1, 1, 0.99, -1.01]) for x in out[:50]]
    return [-x if rng.random() < 0.1 else x for x in out] + [None]


@pytest.mark.parametrize("pct, floor", [(0.01, 1.0), (0.005, 100.0), (0.0, 1.0), (0.0, 0.01), (0.1, 2500.0), (0.5, 1.0)])
def test_what_ties_is_in_neighbouring_bands(spark, pct, floor):
    rng = random.Random(4)
    left, right = (spark.createDataFrame([(i, "k", x) for i, x in enumerate(amounts(rng, 150))], f"{n} int, k{n} string, x{n} double") for n in "ab")
    ties = amounts_equal(F.col("xa"), F.col("xb"), pct, floor)
    want = sorted((r["a"], r["b"]) for r in left.crossJoin(right).where(ties).collect())
    got = sorted((r["a"], r["b"]) for r in bands.band_join(left, right, [("ka", "kb")], ("xa", "xb"), pct, floor).where(ties).collect())
    assert got == want and len(want) > 20
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    a, b = left.withColumn("xa", cents("xa")), right.withColumn("xb", cents("xb"))
    tie = cents_tie(F.col("xa"), F.col("xb"), pct, int(floor) or 1)
    assert sorted(map(tuple, bands.band_join(a, b, [("ka", "kb")], ("xa", "xb"), pct, int(floor) or 1).where(tie).select("a", "b").collect())) == sorted(map(tuple, a.crossJoin(b).where(tie).select("a", "b").collect()))


def test_rows_follow_the_true_pairs(spark):
    """One vendor with 4,000 postings and as many invoices: what the join hands on is a small multiple of what ties."""
    rows = lambda n: spark.range(4000).select(F.col("id").alias(n), F.lit("v").alias(f"k{n}"), F.expr(f"round(exp(pmod(xxhash64(id, '{n}'), 100000) / 100000 * 12), 2)").alias(f"x{n}"))
    met = bands.band_join(rows("a"), rows("b"), [("ka", "kb")], ("xa", "xb"), 0.005, 1.0)
    true = met.where(amounts_equal(F.col("xa"), F.col("xb"), 0.005, 1.0)).count()
    assert 1000 < true and met.count() < 4 * true


def test_two_sums_by_brute_force(spark):
    rng = random.Random(6)
    parts = [(g, round(rng.choice([rng.uniform(1, 50), 10 ** rng.uniform(1, 6)]), 2), f"i{n:03d}") for n, g in enumerate(rng.choices("xyz", k=150))] + [("x", None, "i900"), (None, 5.0, "i901")]
    targets = [(g, round(sum(rng.sample([x for h, x, _ in parts if h == g and x], 2)) + rng.choice([0, 0, 0.7, -0.9, 3]), 2), n) for n, g in enumerate(rng.choices("xyz", k=80))] + [("x", None, 900), ("q", 7.0, 901)]
    got = bands.two_sum(spark.createDataFrame(targets, "g string, total double, row int"), spark.createDataFrame(parts, "g string, x double, id string"), ["g"], "total", "x", "id", 0.01, 1.0)
    ties = F.abs(F.col("amount_a") + F.col("amount_b") - F.col("total")) <= F.greatest(F.lit(1.0), F.abs("total") * 0.01)
    want = sorted((r, a, b) for g, t, r in targets for h, x, a in parts for k, y, b in parts if g == h == k and None not in (t, x, y) and a < b and abs(x + y - t) <= max(1.0, abs(t) * 0.01))
    assert sorted((r["row"], r["a"], r["b"]) for r in got.where(ties).collect()) == want and len(want) > 80


def test_a_vendor_of_five_thousand_invoices_a_month(spark):
    tax = "27AAAAA1111A1Z1"
    cents = F.expr("pmod(xxhash64(id), 500000000) + 100").alias("c")
    rows = spark.range(5000).select("id", cents)
    invoice = F.struct(F.lit(None).cast("string").alias("invoice_number"), F.lit("2025-08-10").alias("invoice_date"), F.lit("Firm").alias("vendor_name"), F.lit(tax).alias("vendor_gstin"), (F.col("c") / 100).alias("total"))
    invs = rows.select(F.format_string("i%05d", "id").alias("inv_id"), invoice.alias("invoice"))
    two = rows.where("id < 10").agg(*(F.sum(F.when(F.col("id").isin(2 * k, 2 * k + 1), F.col("c"))).alias(f"t{k}") for k in range(5))).first()
    reg = spark.createDataFrame([(k, tax, "2025-08-20", two[k] / 100) for k in range(5)], "register_row int, vendor_gstin string, booking_date string, total double")
    exact = fourway.MatchPolicy(profile="F", register_pct=0.0, amount_floor=0.005)
    got = {(r["register_row"], r["inv_a"], r["inv_b"]) for r in fourway.consolidated(reg, invs, spark.createDataFrame([], "register_row int"), exact).collect()}
    assert {(k, f"i{2 * k:05d}", f"i{2 * k + 1:05d}") for k in range(5)} <= got and len(got) < 500


def test_a_date_that_most_rows_share(spark):
    """Near repeats of unresolved vendors and within a batch: the date alone is no key, so the day is dealt over its amounts."""
    inv = spark.range(6000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS vendor_id", "concat('N', id) AS invoice_number", "CAST(id / 100 AS DECIMAL(18, 2)) AS total", "DATE'2025-01-01' AS invoice_date")
    led = spark.range(6000).selectExpr("id AS seq", "'v' AS vendor_id", "concat('L', id) AS invoice_number", "CAST(id / 100 AS DECIMAL(18, 2)) AS total", "DATE'2025-01-01' AS invoice_date", "'APPROVE' AS decision")
    hits = invoices.ledger_duplicates(inv, led)
    assert hits.agg(F.sum(F.size("hits"))).first()[0] == 3 * 6000 - 2
    rows = spark.range(4000).selectExpr("'b' AS batch_id", "CAST(id AS INT) AS index", "'Firm' AS vendor", "concat('N', id) AS invoice_number", "id * 2 - id % 2 AS total_cents", "DATE'2025-01-01' AS date")
    assert batch.batch_duplicates(rows).groupBy("kind").count().collect()[0]["count"] == 2000
