"""Each operator on the driver's star-schema tables, with SQL that computes the same.

Stand-ins: an order is a purchase order (status F closed, P billed in parts), the
lines of one order and supplier are a bill, suppliers are vendors.  Amounts are
whole cents, so that results do not depend on the order of additions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.money import parse_money, to_cents
from ..functions.names import clean_order, order_key, reference_key, vendor_name
from ..functions.text import code_valid, currency_of, page_kind
from ..operators.bands import band_join, met_once
from ..operators.batch import cross_run_duplicates as repeats_of_earlier_runs
from ..operators.batch import prior_by_order
from ..operators.extraction import extract, ingest, ingest_quality, labelled_id, non_empty_lines
from ..operators.findings import decide, finding, listed
from ..operators.invoices import amount_finding, cumulative_finding, decide_invoices, open_balance, plausible, replay_history, resolve_vendors
from ..operators.matching import count_phrase, coverage, duplicate_pairs, fan_out, first_by, flow_phrase, pivot_cells, row_type, segments
from ..operators.similarity import similar_names
from ..operators.tables import Stored
from ..operators.twoway import INVOICE, ORDER, all_agree, rate_of, state_text, two_way
from ..policy import HOLD, OK, REJECT, REVIEW, MatchPolicy
from ..sources.readers import ledger_defaults, order_defaults, vendor_defaults

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _cents(c) -> F.Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _money(c) -> F.Column:
    return (F.col(c).cast("decimal(18,2)") / 100).cast("decimal(18,2)")


def orders(spark, d) -> DataFrame:
    o = _read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust"), _cents("o_totalprice").alias("po_cents"), F.col("o_orderdate").cast("date").alias("po_date"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), (F.col("o_orderstatus") == "P").alias("partial"), F.col("o_orderpriority").alias("priority"))


def lines(spark, d) -> DataFrame:
    x = _read(spark, d, "lineitem")
    pct = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return x.select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("vendor"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").cast("bigint").alias("qty"), _cents("l_extendedprice").alias("ext"), pct("l_discount").alias("disc"), pct("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("date").alias("ship"))


#: Rows of a task, at most on average: a task's memory then does not grow with the tables.
TASK_ROWS = 500_000


def tasks_for(rows: DataFrame) -> int:
    """As many tasks as the rows need where these are more than the session's partitions, else 0."""
    needed = -(-rows.count() // TASK_ROWS)  # of files, which know their counts
    return needed if needed > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def dealt_out(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys: over as many partitions as the session has, or more where tasks would get more rows than a task should."""
    needed = tasks_for(rows)
    return rows.repartition(needed, *keys) if needed else rows.repartition(*keys)


def bills(spark, d, **more) -> DataFrame:
    """order_id, vendor, bill_date, cents: lines of one order and supplier with discount and tax; more: further sums of a bill's lines."""
    value = F.sum(F.col("ext") * (100 - F.col("disc")) * (100 + F.col("tax")))
    dealt = dealt_out(lines(spark, d), "order_id")  # what is grouped or joined by order later needs no further exchange
    return dealt.groupBy("order_id", "vendor").agg(F.max("ship").alias("bill_date"), value.alias("v"), *(c.alias(k) for k, c in more.items())).select("order_id", "vendor", "bill_date", F.expr("(v + 5000) div 10000").alias("cents"), *more)


_ORDERS = """o AS (SELECT o_orderkey AS order_id, o_custkey AS cust, CAST(round(o_totalprice * 100) AS BIGINT) AS po_cents, CAST(o_orderdate AS DATE) AS po_date,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, o_orderstatus = 'P' AS partial, o_orderpriority AS priority FROM orders)"""
_LINES = """x AS (SELECT l_orderkey AS order_id, l_suppkey AS vendor, l_partkey AS part, l_linenumber AS line_no, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS ext,
  CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax, l_returnflag AS flag, CAST(l_shipdate AS DATE) AS ship FROM lineitem)"""
_BILLS = f"""{_LINES}, b AS (SELECT order_id, vendor, max(ship) AS bill_date, CAST((sum(ext * (100 - disc) * (100 + tax)) + 5000) // 10000 AS BIGINT) AS cents FROM x GROUP BY ALL)"""
_AUTO, _BAND = "greatest(po_cents * 0.02, 10000)", "greatest(po_cents * 0.10, 250000)"
_SEVERITY = f"CASE WHEN abs(cents - po_cents) <= {_AUTO} THEN 0 WHEN abs(cents - po_cents) <= {_BAND} THEN 3 ELSE 5 END"
_OUTCOME = "CASE worst WHEN 5 THEN 'REJECT' WHEN 4 THEN 'NEEDS_REVIEW' WHEN 3 THEN 'HOLD_FOR_APPROVAL' ELSE 'AUTO_APPROVE' END"


def _whole(spark, d) -> DataFrame:
    """Orders with the sum of their bills."""
    b = bills(spark, d).groupBy("order_id").agg(F.sum("cents").alias("cents"))
    return orders(spark, d).join(b, "order_id")


_WHOLE = f"{_ORDERS}, {_BILLS}, w AS (SELECT o.*, s.cents FROM o JOIN (SELECT order_id, CAST(sum(cents) AS BIGINT) AS cents FROM b GROUP BY ALL) s USING (order_id))"


@query("po_variance_verdict", f"WITH {_WHOLE}, v AS (SELECT *, {_SEVERITY} AS worst FROM w) SELECT order_id, po_cents, cents AS billed_cents, CASE worst WHEN 0 THEN 'AMOUNT_WITHIN_TOLERANCE' WHEN 3 THEN 'AMOUNT_OVER_TOLERANCE' ELSE 'AMOUNT_EXCEEDS_BAND' END AS code, {_OUTCOME} AS outcome FROM v")
def po_variance_verdict(spark, d):
    found = listed(amount_finding(_money("cents"), _money("po_cents")))
    rows = _whole(spark, d).withColumn("findings", found).withColumn("decision", decide(F.col("findings")))
    return rows.select("order_id", "po_cents", F.col("cents").alias("billed_cents"), F.get("findings", F.lit(0))["code"].alias("code"), "decision.outcome")


@query("po_cumulative_billing", f"""WITH {_ORDERS}, {_BILLS}, r AS (SELECT b.*, po_cents, CAST(coalesce(sum(cents) OVER (PARTITION BY order_id ORDER BY bill_date, vendor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS billed_before FROM b JOIN o USING (order_id))
SELECT order_id, vendor, billed_before, cents, CASE WHEN billed_before + cents - po_cents <= 5 THEN 'PARTIAL_BILLING_OK' WHEN billed_before + cents - po_cents <= {_BAND} THEN 'CUMULATIVE_OVERBILL_APPROVABLE' ELSE 'CUMULATIVE_OVERBILL' END AS code FROM r""")
def po_cumulative_billing(spark, d):
    rows = bills(spark, d).withColumn("amount", _money("cents"))
    rows = replay_history(rows, "order_id", ["bill_date", "vendor"], "amount").join(orders(spark, d).select("order_id", "po_cents"), "order_id")
    code = cumulative_finding(F.col("amount"), F.col("billed_before"), _money("po_cents"))["code"]
    return rows.select("order_id", "vendor", (F.col("billed_before") * 100).cast("bigint").alias("billed_before"), "cents", code.alias("code"))


@query("po_remaining_balance", f"WITH {_ORDERS}, {_BILLS} SELECT o.order_id, po_cents, coalesce(s.n, 0) AS n_bills, CAST(coalesce(s.cents, 0) AS BIGINT) AS already_billed, CAST(po_cents - coalesce(s.cents, 0) AS BIGINT) AS remaining FROM o LEFT JOIN (SELECT order_id, count(*) AS n, sum(cents) AS cents FROM b GROUP BY ALL) s USING (order_id)")
def po_remaining_balance(spark, d):
    number = F.col("order_id").cast("string").alias("po_number")
    b = bills(spark, d)
    ledger = b.select(number, _money("cents").alias("amount_applied"))
    po = open_balance(orders(spark, d).select("order_id", number, "po_cents", _money("po_cents").alias("total_amount")), ledger)
    n = b.groupBy("order_id").agg(F.count("*").alias("n"))
    cents = lambda c: (F.col(c) * 100).cast("bigint").alias(c)
    return po.join(n, "order_id", "left").select("order_id", "po_cents", F.coalesce("n", F.lit(0)).alias("n_bills"), cents("already_billed"), cents("remaining"))


@query("severity_fold_decision", f"""WITH {_WHOLE}, f AS (SELECT order_id, {_SEVERITY} AS a, CASE WHEN status = 'closed' THEN 5 ELSE -1 END AS c, CASE WHEN cents % 7 = 0 THEN 2 ELSE -1 END AS l, CASE WHEN po_date < DATE '1995-01-01' THEN 4 ELSE -1 END AS s FROM w),
g AS (SELECT *, greatest(a, c, l, s) AS worst FROM f)
SELECT order_id, CAST(worst AS INTEGER) AS worst, {_OUTCOME} AS outcome, CASE worst WHEN 5 THEN 0.95 WHEN 4 THEN 0.6 WHEN 3 THEN 0.75 ELSE round(greatest(0.8, 0.98 - 0.05 * CASE WHEN l = 2 THEN 1 ELSE 0 END), 2) END::DOUBLE AS confidence,
CAST(CASE WHEN worst >= 3 THEN (a = worst)::INT + (c = worst)::INT + (s = worst)::INT ELSE (a = 0)::INT END AS INTEGER) AS n_reasons FROM g""")
def severity_fold_decision(spark, d):
    found = listed(
        amount_finding(_money("cents"), _money("po_cents")),
        F.when(F.col("status") == "closed", finding("PO_CLOSED", REJECT, "closed")),
        F.when(F.col("cents") % 7 == 0, finding("LINE_ITEMS_DONT_SUM", 2, "odd")),
        F.when(F.col("po_date") < F.lit("1995-01-01").cast("date"), finding("LOW_EXTRACTION_CONFIDENCE", REVIEW, "old")),
    )
    rows = _whole(spark, d).withColumn("f", found).withColumn("decision", decide(F.col("f")))
    return rows.select("order_id", F.array_max(F.transform("f", lambda f: f["severity"])).alias("worst"), "decision.outcome", "decision.confidence", F.size("decision.reasons").alias("n_reasons"))


@query("duplicate_exact_near", f"""WITH {_ORDERS}, n AS (SELECT *, 'N' || (order_id % 40) AS number FROM o)
SELECT p.order_id AS a, q.order_id AS b, CASE WHEN p.number = q.number THEN 'EXACT' ELSE 'NEAR' END AS kind FROM n p JOIN n q ON p.cust = q.cust AND p.order_id < q.order_id AND (p.number = q.number OR (p.po_date = q.po_date AND abs(p.po_cents - q.po_cents) <= 10000000))""")
def duplicate_exact_near(spark, d):
    rows = orders(spark, d).withColumn("number", F.concat(F.lit("n"), (F.col("order_id") % 40).cast("string")))
    return duplicate_pairs(rows, "order_id", "cust", "number", "po_cents", "po_date", 10_000_000)


@query("coverage_po_without_invoice", f"WITH {_ORDERS} SELECT order_id, po_cents FROM o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = order_id)")
def coverage_po_without_invoice(spark, d):
    missing, _ = coverage(orders(spark, d), lines(spark, d), ["order_id"])
    return missing.select("order_id", "po_cents")


@query("coverage_invoice_without_open_po", f"WITH {_ORDERS}, {_BILLS} SELECT order_id, vendor, cents FROM b WHERE order_id NOT IN (SELECT order_id FROM o WHERE status = 'open')")
def coverage_invoice_without_open_po(spark, d):
    _, lone = coverage(orders(spark, d).where("status = 'open'"), bills(spark, d), ["order_id"])
    return lone.select("order_id", "vendor", "cents")


_LADDER = f"""{_ORDERS}, {_BILLS}, k AS (SELECT *, order_id * 100000 + vendor AS bill FROM b),
c AS (SELECT bill, o.order_id AS po, 1 AS rung FROM k JOIN o USING (order_id) WHERE vendor % 3 = 0
 UNION ALL SELECT bill, o.order_id, 2 FROM k JOIN o ON o.po_date = k.bill_date AND abs(k.cents - o.po_cents) <= greatest(100, 0.005 * abs(o.po_cents))
 UNION ALL SELECT bill, o.order_id, 3 FROM k JOIN o ON o.po_date = k.bill_date AND o.cust % 97 = k.vendor % 97),
r AS (SELECT *, min(rung) OVER (PARTITION BY bill) AS first FROM c)"""


def _orders_of_a_day(spark, d) -> DataFrame:
    return orders(spark, d).select(F.col("order_id").alias("po"), "po_cents", "po_date", (F.col("cust") % 97).alias("po_g"))


def _tied(rows: DataFrame, po: DataFrame, how: str, parts: int) -> DataFrame:
    """Bills with the orders of their day and about their amount."""
    tie = F.abs(F.col("cents") - F.col("po_cents")) <= F.greatest(F.lit(100.0), F.abs("po_cents") * 0.005)
    return met_once(rows, po.drop("po_g"), [("bill_date", "po_date")], ("cents", "po_cents"), tie, 0.005, 100.0, how, parts)


def _first_rungs(spark, d) -> DataFrame:
    """A row per bill that has a candidate: its first rung, n_candidates, and the candidate (po) if there is but one.

    Candidates are counted where they meet their bill, so what is sent between tasks and written is bills and orders, never pairs.
    """
    tables, po = Stored(spark), _orders_of_a_day(spark, d)
    with Stored(spark) as passing:
        own = orders(spark, d).groupBy("order_id").agg(F.count("*").alias("n"))
        cites = F.when(F.col("vendor") % 3 == 0, F.col("n"))
        k = passing.write(bills(spark, d).join(own, "order_id", "left").select("order_id", "vendor", "bill_date", "cents", F.coalesce(cites, F.lit(0)).alias("n")))
        cited = k.where("n > 0").select("order_id", "vendor", "bill_date", "cents", F.lit(1).alias("rung"), F.col("n").alias("n"), F.when(F.col("n") == 1, F.col("order_id")).alias("po"))
        seen = _tied(k.where("n = 0").drop("n"), po, "left", tasks_for(k)).groupBy("bill_date", "_slot", "order_id", "vendor", "cents").agg(F.count("po_cents").alias("n"), F.min("po").alias("po"))
        seen = seen.select("order_id", "vendor", "bill_date", "cents", F.when(F.col("n") > 0, 2).otherwise(3).alias("rung"), "n", F.when(F.col("n") == 1, F.col("po")).alias("po"))
        settled = tables.write(cited.unionByName(seen))
    # the last rung's candidates are whole groups: their number is the group's size
    sizes = po.groupBy(F.col("po_date").alias("bill_date"), F.col("po_g").alias("g")).agg(F.count("*").alias("n"), F.min("po").alias("po"))
    loose = settled.where("rung = 3").drop("n", "po").withColumn("g", F.col("vendor") % 97).join(sizes, ["bill_date", "g"])
    loose = loose.select("order_id", "vendor", "bill_date", "cents", "rung", "n", F.when(F.col("n") == 1, F.col("po")).alias("po"), "g")
    every = settled.where("rung < 3").withColumn("g", F.col("vendor") % 97).unionByName(loose).withColumn("bill", F.col("order_id") * 100000 + F.col("vendor"))
    # a vendor's number of six digits can give a bill the number of another one: these two count as one bill
    k = settled.select((F.col("order_id") * 100000 + F.col("vendor")).alias("twin"))
    twins = tables.write(k.groupBy("twin").agg(F.count("*").alias("n")).where("n > 1").select("twin"))
    of = F.col("bill").eqNullSafe(F.col("twin"))
    w = Window.partitionBy("bill")
    joint = every.join(twins, of, "left_semi").withColumn("first", F.min("rung").over(w)).where("rung = first").drop("first").withColumn("n_candidates", F.sum("n").over(w))
    return every.join(twins, of, "left_anti").withColumn("n_candidates", F.col("n")).unionByName(joint.select(*every.columns, "n_candidates"))


@query("match_ladder_first_rung", f"WITH {_LADDER} SELECT bill, po, CAST(rung AS INTEGER) AS rung, CAST(count(*) OVER (PARTITION BY bill) AS BIGINT) AS n_candidates FROM r WHERE rung = first")
def match_ladder_first_rung(spark, d):
    first, po = _first_rungs(spark, d), _orders_of_a_day(spark, d)
    out = lambda rows: rows.select("bill", "po", "rung", "n_candidates")
    cited = first.where("rung = 1").select("bill", F.explode(F.array_repeat("order_id", F.col("n").cast("int"))).alias("po"), "rung", "n_candidates")
    tied = _tied(first.where("rung = 2").drop("po", "n"), po, "inner", tasks_for(lines(spark, d)))
    loose = first.where("rung = 3").drop("po", "n").join(po, (F.col("bill_date") == F.col("po_date")) & (F.col("g") == F.col("po_g")))
    return cited.unionByName(out(tied)).unionByName(out(loose))


@query("unique_candidate_inference", f"WITH {_LADDER}, z AS (SELECT bill, po, rung, count(*) OVER (PARTITION BY bill) AS n FROM r WHERE rung = first) SELECT bill, po, CAST(rung AS INTEGER) AS rung FROM z WHERE n = 1")
def unique_candidate_inference(spark, d):
    return _first_rungs(spark, d).where("n_candidates = 1").select("bill", "po", "rung")


@query("plausible_amounts", f"WITH {_WHOLE} SELECT order_id, CASE WHEN partial THEN cents > 0 AND cents <= po_cents // 2 + {_BAND} ELSE abs(cents - po_cents) <= {_BAND} END AS plausible FROM w")
def plausible_amounts(spark, d):
    rows = _whole(spark, d).withColumn("half", F.expr("po_cents div 2"))
    return rows.select("order_id", plausible(_money("cents"), _money("po_cents"), F.col("partial"), _money("half")).alias("plausible"))


@query("multi_po_sum_match", f"WITH {_WHOLE} SELECT cust, count(*) AS n_pos, CAST(sum(po_cents) AS BIGINT) AS po_sum, CAST(sum(cents) AS BIGINT) AS billed, abs(sum(cents) - sum(po_cents)) <= greatest(100, 0.005 * abs(sum(po_cents))) AS total_match FROM w GROUP BY cust")
def multi_po_sum_match(spark, d):
    g = _whole(spark, d).groupBy("cust").agg(F.count("*").alias("n_pos"), F.sum("po_cents").alias("po_sum"), F.sum("cents").alias("billed"))
    return g.withColumn("total_match", F.abs(F.col("billed") - F.col("po_sum")) <= F.greatest(F.lit(100.0), F.abs("po_sum") * 0.005))


@query("split_billing_groups", f"WITH {_ORDERS}, {_BILLS} SELECT order_id, count(*) AS n_invoices, CAST(sum(cents) AS BIGINT) AS cumulative, CASE WHEN sum(cents) - max(po_cents) > greatest(max(po_cents) * 0.10, 250000) THEN 'MISMATCH' ELSE 'PARTIAL' END AS status FROM b JOIN o USING (order_id) GROUP BY order_id HAVING count(*) >= 2 AND count(DISTINCT vendor) >= 2")
def split_billing_groups(spark, d):
    g = bills(spark, d).groupBy("order_id").agg(F.count("*").alias("n_invoices"), F.countDistinct("vendor").alias("n"), F.sum("cents").alias("cumulative")).where("n_invoices >= 2 and n >= 2")
    rows = g.join(orders(spark, d).select("order_id", "po_cents"), "order_id")
    beyond = F.col("cumulative") - F.col("po_cents") > F.greatest(F.col("po_cents") * 0.10, F.lit(250000.0))
    return rows.select("order_id", "n_invoices", "cumulative", F.when(beyond, "MISMATCH").otherwise("PARTIAL").alias("status"))


@query("three_state_header", f"""WITH {_WHOLE}, t AS (SELECT order_id, CASE WHEN cust % 11 = 0 THEN NULL ELSE cust % 5 > 0 END AS vendor_ok, abs(cents - po_cents) <= greatest(100, 0.005 * po_cents) AS total_ok, CASE WHEN order_id % 13 = 0 THEN NULL ELSE po_date >= DATE '1993-01-01' END AS date_ok FROM w)
SELECT order_id, CASE WHEN vendor_ok THEN 'agrees' WHEN NOT vendor_ok THEN 'fails' ELSE 'unverified' END AS vendor_match, CASE WHEN total_ok THEN 'agrees' WHEN NOT total_ok THEN 'fails' ELSE 'unverified' END AS total_match,
CASE WHEN (vendor_ok IS FALSE) OR (total_ok IS FALSE) OR (date_ok IS FALSE) THEN 'fails' WHEN vendor_ok IS NULL OR total_ok IS NULL OR date_ok IS NULL THEN 'unverified' ELSE 'agrees' END AS header FROM t""")
def three_state_header(spark, d):
    vendor = F.when(F.col("cust") % 11 != 0, F.col("cust") % 5 > 0)
    total = F.abs(F.col("cents") - F.col("po_cents")) <= F.greatest(F.lit(100.0), F.col("po_cents") * 0.005)
    date = F.when(F.col("order_id") % 13 != 0, F.col("po_date") >= F.lit("1993-01-01").cast("date"))
    return _whole(spark, d).select("order_id", state_text(vendor).alias("vendor_match"), state_text(total).alias("total_match"), state_text(all_agree(F.array(vendor, total, date))).alias("header"))


@query("date_order_flag", f"WITH {_ORDERS}, {_BILLS} SELECT order_id, vendor, bill_date >= po_date AS date_order, CAST(date_diff('day', po_date, bill_date) AS INTEGER) AS age_days FROM b JOIN o USING (order_id)")
def date_order_flag(spark, d):
    rows = bills(spark, d).join(orders(spark, d), "order_id")
    return rows.select("order_id", "vendor", (F.col("bill_date") >= F.col("po_date")).alias("date_order"), F.datediff("bill_date", "po_date").alias("age_days"))


@query("fy_window_check", f"WITH {_ORDERS} SELECT CAST(year(po_date) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (WHERE po_date BETWEEN DATE '1995-04-01' AND DATE '1996-03-31') AS n_inside FROM o GROUP BY ALL")
def fy_window_check(spark, d):
    inside = F.col("po_date").between(F.lit("1995-04-01").cast("date"), F.lit("1996-03-31").cast("date"))
    return orders(spark, d).groupBy(F.year("po_date").alias("year")).agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))


_RATES = ((3901, 18), (3907, 12), (3912, 5), (3930, 28), (3940, 0))


@query("hsn_rate_lookup", f"""WITH r(code, pct) AS (VALUES {', '.join(f'({a}, {b})' for a, b in _RATES)}) SELECT p_partkey AS part, CASE WHEN r.code IS NULL THEN NULL ELSE CAST(pct / 100 AS DOUBLE) END AS rate FROM part LEFT JOIN r ON r.code = 3900 + p_size""")
def hsn_rate_lookup(spark, d):
    """Codes of four digits, or of six under the same heading."""
    code = F.concat((F.col("p_size") + 3900).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "10").otherwise(""))
    rates = {str(a): float(b) for a, b in _RATES}
    return _read(spark, d, "part").select(F.col("p_partkey").alias("part"), rate_of(code, rates, True).alias("rate"))


_FLOW = f"{_LINES}, f AS (SELECT order_id, vendor, CAST(sum(qty) AS BIGINT) AS ordered, CAST(sum(CASE WHEN flag <> 'N' THEN qty + line_no % 2 END) AS BIGINT) AS received, CAST(sum(CASE WHEN line_no < 4 THEN qty ELSE 0 END) AS BIGINT) AS billed FROM x GROUP BY ALL)"


@query("qty_flow", f"WITH {_FLOW} SELECT *, CASE WHEN received IS NULL THEN NULL WHEN received > ordered THEN 'over-received' WHEN billed > received THEN 'billed more than received' WHEN received < ordered THEN 'part received' ELSE 'in full' END AS phrase FROM f")
def qty_flow(spark, d):
    g = lines(spark, d).groupBy("order_id", "vendor").agg(F.sum("qty").alias("ordered"), F.sum(F.when(F.col("flag") != "N", F.col("qty") + F.col("line_no") % 2)).cast("bigint").alias("received"), F.sum(F.when(F.col("line_no") < 4, F.col("qty")).otherwise(0)).alias("billed"))
    return g.withColumn("phrase", flow_phrase(F.col("ordered"), F.col("received"), F.col("billed")))


@query("line_summary_phrase", f"WITH {_ORDERS}, {_LINES}, s AS (SELECT order_id, partial, count(*) AS n, count(*) FILTER (WHERE disc < 5) AS m FROM x JOIN o USING (order_id) GROUP BY ALL) SELECT order_id, CASE WHEN partial THEN 'N/A — PO lump-sum' WHEN m = n THEN 'All matched (' || m || '/' || n || ')' WHEN m = 0 THEN 'None matched' ELSE m || ' of ' || n || ' matched' END AS phrase FROM s")
def line_summary_phrase(spark, d):
    g = lines(spark, d).join(orders(spark, d), "order_id").groupBy("order_id", "partial").agg(F.count("*").alias("n"), F.count_if(F.col("disc") < 5).alias("m"))
    return g.select("order_id", count_phrase(F.col("m"), F.col("n"), F.col("partial")).alias("phrase"))


@query("line_pair_rowtype", f"""WITH {_LINES}, i AS (SELECT order_id, part, CAST(sum(qty) AS BIGINT) AS q FROM x WHERE flag <> 'A' GROUP BY ALL), p AS (SELECT order_id, part, CAST(sum(qty) AS BIGINT) AS q FROM x WHERE line_no % 3 <> 0 GROUP BY ALL)
SELECT order_id, part, i.q AS billed, p.q AS ordered, CASE WHEN i.q IS NOT NULL AND p.q IS NOT NULL THEN 'pair' WHEN i.q IS NOT NULL THEN 'bill_only' ELSE 'po_only' END AS row_type FROM i FULL JOIN p USING (order_id, part)""")
def line_pair_rowtype(spark, d):
    x = lines(spark, d)
    i = x.where("flag <> 'A'").groupBy("order_id", "part").agg(F.sum("qty").alias("billed"))
    p = x.where("line_no % 3 <> 0").groupBy("order_id", "part").agg(F.sum("qty").alias("ordered"))
    return i.join(p, ["order_id", "part"], "full").select("order_id", "part", "billed", "ordered", row_type(F.col("billed"), F.col("ordered"), F.lit(None), F.lit(False)).alias("row_type"))


@query("token_jaccard", """WITH t AS (SELECT p_partkey AS part, p_brand AS brand, p_size AS size, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), u AS (SELECT a.part AS a, b.part AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS s FROM t a JOIN t b ON a.brand = b.brand AND a.size = b.size AND a.part < b.part)
SELECT a, b, round(i / (s - i), 6)::DOUBLE AS jaccard FROM u""")
def token_jaccard(spark, d):
    """Words of all parts of one brand and size, by pairs."""
    t = _read(spark, d, "part").select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("w"))
    # few bytes give many pairs: a number of partitions that is named is not cut down by the size of the parts
    t = t.withColumn("n", F.size("w")).repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "brand", "size")
    u = t.select(F.col("a").alias("b"), "brand", "size", F.col("w").alias("v"), F.col("n").alias("m"))
    pairs = t.join(u, ["brand", "size"]).where("a < b").select("a", "b", "n", "m", F.size(F.array_intersect("w", "v")).alias("both"))
    return pairs.select("a", "b", F.round(F.try_divide("both", F.col("n") + F.col("m") - F.col("both")), 6).alias("jaccard"))


@query("ratio_vendor_match")
def ratio_vendor_match(spark, d):
    n = _read(spark, d, "nation")
    names = n.select(F.concat(F.initcap(F.lower("n_name")), F.lit("s Ltd")).alias("name"))
    pairs = similar_names(names, n.select(F.col("n_name").alias("candidate"), "n_nationkey"), 0.82, vendor_name)
    return pairs.groupBy("name").agg(F.round(F.max("ratio"), 6).alias("ratio"), F.min_by("n_nationkey", F.struct(-F.col("ratio"), "n_nationkey")).alias("vendor"))


#: Names of ten letters, and what a customer writes for that of a supplier: by its number modulo 8 the name itself, in capitals with
#: a legal form, a letter less, another letter, a letter more, two letters swapped with a gap, two letters less, or a name of nobody's.
_LETTERS = "translate(substr(md5({}), 1, 14), '0123456789', 'ghijklmnop')"
_TYPED = """CASE k % 8 WHEN 0 THEN s WHEN 1 THEN upper(s) || ', Inc' WHEN 2 THEN substr(s, 1, 6) || substr(s, 8) WHEN 3 THEN substr(s, 1, 4) || 'z' || substr(s, 6)
WHEN 4 THEN substr(s, 1, 9) || 'q' || substr(s, 10) WHEN 5 THEN 'z' || substr(s, 2, 8) || 'z' || substr(s, 11) WHEN 6 THEN substr(s, 2, 6) || substr(s, 9) ELSE t END"""


@query("vendor_resolution", f"""WITH v AS (SELECT s_suppkey AS id, {_LETTERS.format("'v' || s_suppkey")} AS s FROM supplier),
c AS (SELECT c_custkey AS k, {_LETTERS.format("'v' || (c_custkey % (SELECT count(*) FROM supplier))")} AS s, {_LETTERS.format("'n' || c_custkey")} AS t FROM customer),
typed AS (SELECT k, regexp_replace(replace(lower({_TYPED}), ',', ''), ' inc$', '') AS name FROM c),
cut AS (SELECT DISTINCT s, g, n FROM (SELECT name AS s, name AS g, 0 AS n FROM typed UNION ALL SELECT s, s, 0 FROM v
 UNION ALL SELECT s, substr(s, 1, i - 1) || substr(s, i + 1), 1 FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM (SELECT name AS s FROM typed UNION SELECT s FROM v))
 UNION ALL SELECT s, substr(s, 1, i - 1) || substr(s, i + 1, j - i - 1) || substr(s, j + 1), 2 FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i, unnest([range(1, length(s) + 1)]) AS js FROM (SELECT name AS s FROM typed UNION SELECT s FROM v)), unnest(js) AS u(j) WHERE i < j)),
pair AS (SELECT a.s AS name, v.id, max(2.0 * length(a.g) / (length(a.s) + length(b.s))) AS ratio FROM (SELECT * FROM cut WHERE s IN (SELECT name FROM typed)) a JOIN cut b ON a.g = b.g JOIN v ON v.s = b.s GROUP BY a.s, v.id),
best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio DESC, id) AS nth FROM pair WHERE ratio >= 0.82)
SELECT k AS customer, id AS vendor, CAST(round(ratio, 6) AS DOUBLE) AS ratio FROM typed JOIN best USING (name) WHERE nth = 1""")
def vendor_resolution(spark, d):
    """Names as customers type them, resolved against the suppliers: the best ratio from 0.82 on, the first supplier wins ties."""
    vendors = _read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("vendor_id"), F.expr(_LETTERS.format("concat('v', s_suppkey)")).alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(True).alias("approved"), F.col("s_suppkey").alias("seq"))
    many = vendors.agg(F.count("*").alias("many"))
    c = _read(spark, d, "customer").crossJoin(F.broadcast(many)).select(F.col("c_custkey").alias("k"), F.expr(_LETTERS.format("concat('v', c_custkey % many)")).alias("s"), F.expr(_LETTERS.format("concat('n', c_custkey)")).alias("t"))
    typed = c.select("k", F.expr(_TYPED).alias("vendor_raw"))
    found = typed.join(resolve_vendors(typed, vendors), "vendor_raw")
    return found.select(F.col("k").alias("customer"), F.col("vendor_id").cast("bigint").alias("vendor"), F.round("vendor_ratio", 6).alias("ratio"))


@query("money_parse_roundtrip", f"WITH {_ORDERS} SELECT order_id, po_cents, CAST(CASE WHEN order_id % 4 = 1 THEN -po_cents ELSE po_cents END AS BIGINT) AS parsed_cents FROM o")
def money_parse_roundtrip(spark, d):
    plain = F.format_number(_money("po_cents"), 2)
    k = F.col("order_id") % 4
    text = F.when(k == 0, F.concat(F.lit("$"), plain)).when(k == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 2, F.concat(F.lit("USD "), F.replace(plain, F.lit(","), F.lit("")))).otherwise(F.concat(plain, F.lit(" EUR")))
    both = F.when(k == 2, (parse_money(text) * 100).cast("bigint")).otherwise(to_cents(text))
    return orders(spark, d).select("order_id", "po_cents", both.alias("parsed_cents"))


@query("date_parse_formats", f"WITH {_ORDERS} SELECT order_id, po_date AS parsed FROM o")
def date_parse_formats(spark, d):
    k, c = F.col("order_id") % 6, F.col("po_date")
    text = F.when(k == 0, F.date_format(c, "yyyy-MM-dd")).when(k == 1, F.date_format(c, "dd/MM/yyyy")).when(k == 2, F.date_format(c, "d MMM yyyy")).when(k == 3, F.date_format(c, "MMMM d, yyyy")).when(k == 4, F.date_format(c, "dd.MM.yyyy")).otherwise(F.date_format(c, "yyyy/MM/dd"))
    return orders(spark, d).select("order_id", parse_date(text).alias("parsed"))


@query("ref_key_normalise", f"WITH {_ORDERS} SELECT order_id, CAST(order_id AS VARCHAR) AS order_key, 'PO' || order_id AS reference_key, CASE WHEN order_id >= 100 THEN 'PO-' || order_id END AS clean FROM o")
def ref_key_normalise(spark, d):
    n = F.col("order_id").cast("string")
    text = F.when(F.col("order_id") % 2 == 0, F.concat(F.lit("po-"), n)).otherwise(F.concat(F.lit("PO "), n))
    return orders(spark, d).select("order_id", order_key(text).alias("order_key"), reference_key(text).alias("reference_key"), F.when(F.col("order_id") >= 100, clean_order(n)).alias("clean"))


@query("vendor_name_keys", "SELECT s_suppkey AS vendor, lower(s_name) AS key FROM supplier")
def vendor_name_keys(spark, d):
    s = _read(spark, d, "supplier")
    form = F.element_at(F.array(F.lit(" Inc"), F.lit(" LLC"), F.lit(" GmbH"), F.lit("")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return s.select(F.col("s_suppkey").alias("vendor"), vendor_name(F.concat("s_name", form)).alias("key"))


@query("ingest_quality_gate", "SELECT doc_id, length(trim(text)) >= 40 AND length(regexp_replace(trim(text), '[^0-9]', '', 'g')) >= 5 AS usable FROM documents")
def ingest_quality_gate(spark, d):
    return _read(spark, d, "documents").select("doc_id", ingest_quality(F.trim(F.coalesce("text", F.lit("")))).alias("usable"))


@query("currency_detect", r"SELECT doc_id, CASE WHEN contains(text, '$') THEN 'USD' WHEN contains(text, '€') THEN 'EUR' WHEN contains(text, '£') THEN 'GBP' WHEN contains(text, '₹') THEN 'INR' ELSE nullif(regexp_extract(text, '\b(USD|EUR|GBP|INR)\b', 1), '') END AS currency FROM documents")
def currency_detect(spark, d):
    return _read(spark, d, "documents").select("doc_id", currency_of(F.col("text")).alias("currency"))


@query("first_labelled_id", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_extract(x, '(?i)(?:token|key|secret|password)[^A-Za-z0-9]{0,4}([A-Za-z0-9][A-Za-z0-9/-]{2,})', 1)), lambda v: regexp_matches(v, '[0-9]')) AS ids FROM documents)
SELECT doc_id, ids[1] AS id FROM l""")
def first_labelled_id(spark, d):
    found = labelled_id(non_empty_lines(F.col("text")), ((0.9, "(?i)(?:token|key|secret|password)[^A-Za-z0-9]{0,4}([A-Za-z0-9][A-Za-z0-9/-]{2,})"),))
    return _read(spark, d, "documents").select("doc_id", found["value"].alias("id"))


@query("segment_bundles", """WITH s AS (SELECT conv_id, turn, CASE WHEN role = 'user' OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS st FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg FROM s)
SELECT conv_id, CAST(seg AS INTEGER) AS segment_index, min(turn) AS first_page, max(turn) AS last_page, count(*) AS n_pages, CASE WHEN min(turn) = max(turn) THEN CAST(min(turn) AS VARCHAR) ELSE min(turn) || '-' || max(turn) END AS pages FROM g GROUP BY conv_id, seg""")
def segment_bundles(spark, d):
    return segments(_read(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user")


@query("ledger_first_wins_dedup", "SELECT user_id, event_type, event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def ledger_first_wins_dedup(spark, d):
    return first_by(_read(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", _cents("value").alias("cents"))


@query("ledger_tail", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def ledger_tail(spark, d):
    return _read(spark, d, "events").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(200)


_RUNS = "e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, event_id % 5 < 3 AS prior FROM events)"


def _runs(spark, d) -> DataFrame:
    return _read(spark, d, "events").withColumns({"cents": _cents("value"), "prior": F.col("event_id") % 5 < 3})


@query("cross_run_cumulative_flags", f"""WITH {_RUNS}, p AS (SELECT user_id, sum(cents) AS s, count(*) AS n FROM e WHERE prior GROUP BY ALL), c AS (SELECT user_id, sum(cents) AS s FROM e WHERE NOT prior GROUP BY ALL)
SELECT user_id, CAST(p.s AS BIGINT) AS prior_billed, p.n AS prior_count, CAST(c.s AS BIGINT) AS this_batch, CAST(p.s + c.s AS BIGINT) AS cumulative FROM p JOIN c USING (user_id) WHERE p.s <> 0 AND p.s + c.s - 20000 > 2000""")
def cross_run_cumulative_flags(spark, d):
    """What earlier runs billed by key, beside this run's bills of the same key."""
    e, key = _runs(spark, d), F.concat(F.lit("PO-"), F.col("user_id").cast("string"))
    ledger = e.where("prior").select(F.col("event_id").alias("seq"), key.alias("po_number"), F.col("cents").alias("amount_cents"), F.lit(20000).cast("bigint").alias("po_total_cents"))
    now = e.where("not prior").groupBy(F.col("user_id").cast("string").alias("po_key"), "user_id").agg(F.sum("cents").alias("this_batch"))
    rows = now.join(prior_by_order(ledger), "po_key").withColumn("cumulative", F.col("prior_billed") + F.col("this_batch"))
    return rows.where("prior_billed <> 0 and cumulative - prior_ceiling > 2000").select("user_id", "prior_billed", "prior_count", "this_batch", "cumulative")


@query("cross_run_duplicates", f"WITH {_RUNS}, k AS (SELECT user_id, event_type, min(event_id) AS prior_id FROM e WHERE prior GROUP BY ALL) SELECT e.event_id, prior_id FROM e JOIN k USING (user_id, event_type) WHERE NOT prior")
def cross_run_duplicates(spark, d):
    """The first record of the ledger that a later one repeats, by vendor and number."""
    e = _runs(spark, d).withColumns({"vendor": F.concat(F.lit("User "), F.col("user_id").cast("string")), "number": F.concat_ws("-", F.col("user_id").cast("string"), "event_type")})
    none = F.lit(None).cast("string")
    ledger = e.where("prior").select(F.col("event_id").alias("seq"), "vendor", F.upper("number").alias("invoice_number"), F.col("cents").alias("amount_cents"), none.alias("invoice_date"))
    bills = e.where("not prior").select(F.lit("b").alias("batch_id"), F.col("event_id").alias("index"), "vendor", F.col("number").alias("invoice_number"), F.col("cents").alias("total_cents"), none.alias("date"))
    return repeats_of_earlier_runs(bills, ledger).select(F.col("index").alias("event_id"), F.col("prior_seq").alias("prior_id"))


@query("summary_counters", f"WITH {_WHOLE}, v AS (SELECT *, {_SEVERITY} AS s FROM w) SELECT count(*) AS matched, count(*) FILTER (WHERE s = 0) AS ok, count(*) FILTER (WHERE s = 3) AS hold, count(*) FILTER (WHERE s = 5) AS reject, count(*) FILTER (WHERE partial) AS partials, count(DISTINCT cust) AS customers FROM v")
def summary_counters(spark, d):
    rows = _whole(spark, d).withColumn("s", amount_finding(_money("cents"), _money("po_cents"))["severity"])
    return rows.agg(F.count("*").alias("matched"), F.count_if(F.col("s") == OK).alias("ok"), F.count_if(F.col("s") == HOLD).alias("hold"), F.count_if(F.col("s") == REJECT).alias("reject"), F.count_if("partial").alias("partials"), F.countDistinct("cust").alias("customers"))


@query("delivery_fanout_first_row", f"""WITH {_LINES}, k AS (SELECT order_id, ship, qty, row_number() OVER (PARTITION BY order_id ORDER BY ship, qty, ext, line_no, vendor, part) - 1 AS place, sum(qty) OVER (PARTITION BY order_id) AS received FROM x)
SELECT order_id, CAST(place AS INTEGER) AS place, qty, CASE WHEN place = 0 THEN CAST(received AS BIGINT) END AS received FROM k""")
def delivery_fanout_first_row(spark, d):
    g = lines(spark, d).groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("ship", "qty", "ext", "line_no", "vendor", "part"))).alias("grns"), F.sum("qty").alias("received"))
    return fan_out(g, "grns", "received").select("order_id", "place", F.col("item.qty").alias("qty"), "received")


@query("json_props_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props_extract(spark, d):
    return _read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_KINDS = ("click", "view", "purchase")


@query("pivot_cells", "SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN event_id END) AS \"{k}\"" for k in _KINDS) + " FROM events GROUP BY user_id")
def pivot_cells_query(spark, d):
    return pivot_cells(_read(spark, d, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("pos")), ["user_id"], "event_type", "event_id", list(_KINDS))


@query("invoice_decisions_from_text", f"""WITH {_WHOLE}, v AS (SELECT w.*, s.s_suppkey AS vendor, CASE WHEN status = 'closed' THEN 5 ELSE 0 END AS closed,
CASE WHEN partial THEN CASE WHEN cents - po_cents <= 5 THEN 0 WHEN cents - po_cents <= {_BAND} THEN 3 ELSE 5 END ELSE {_SEVERITY} END AS amount FROM w JOIN supplier s ON s.s_suppkey = w.cust % (SELECT count(*) FROM supplier)),
z AS (SELECT *, greatest(closed, amount) AS worst FROM v)
SELECT 'INV-' || order_id AS invoice_number, cents AS total_cents, {_OUTCOME} AS outcome, CASE worst WHEN 5 THEN 0.95 WHEN 3 THEN 0.75 ELSE 0.93 END::DOUBLE AS confidence, 'explicit-reference' AS basis FROM z""")
def invoice_decisions_from_text(spark, d):
    """Invoice texts made of orders and bills, read, matched, checked and decided."""
    firms, tables = _read(spark, d, "supplier").count(), Stored(spark)
    billed = bills(spark, d).groupBy("order_id").agg(F.sum("cents").alias("cents"), F.max("bill_date").alias("bill_date"))
    w = orders(spark, d).select("order_id", "cust").join(billed, "order_id")
    firm = lambda n: F.concat(F.lit("Firm "), n.cast("string"), F.lit(" Trading"))
    number = F.col("order_id").cast("string")
    text = F.concat_ws("\n", firm(F.col("cust") % firms), F.concat(F.lit("Invoice Number: INV-"), number), F.concat(F.lit("Invoice Date: "), F.date_format("bill_date", "yyyy-MM-dd")), F.concat(F.lit("PO Number: PO-"), number), F.concat(F.lit("Total Due: $"), F.format_number(_money("cents"), 2)))
    docs = w.select(F.col("order_id").alias("doc_id"), text.alias("raw_text"))
    vendors = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_suppkey").cast("string").alias("vendor_id"), firm(F.col("s_suppkey")).alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(True).alias("approved"), F.lit(None).cast("string").alias("payment_terms"))
    none = F.lit(None).cast("string")
    po = orders(spark, d).select(F.col("order_id").alias("seq"), F.concat(F.lit("PO-"), number).alias("po_number"), (F.col("cust") % firms).cast("string").alias("vendor_id"), _money("po_cents").alias("total_amount"), none.alias("currency"), "status", F.col("partial").alias("allow_partial"), none.alias("description"))
    ledger = spark.createDataFrame([], "seq int, invoice_number string, vendor_id string, po_number string, total string, invoice_date string, amount_applied string, decision string").where("false")  # a plan knows it to be empty
    out = decide_invoices(tables.write(extract(ingest(docs))), vendor_defaults(vendors), order_defaults(po), ledger_defaults(ledger), tables=tables)
    return out.select("invoice_number", (F.col("total") * 100).cast("bigint").alias("total_cents"), "decision.outcome", "decision.confidence", F.col("match_basis").alias("basis"))


_TIE = "abs(cents - po_cents) <= greatest(100, 0.005 * po_cents)"


@query("two_way_match", f"""WITH {_WHOLE}, l AS (SELECT order_id, max(bill_date) AS bill_date FROM b GROUP BY ALL), z AS (SELECT w.*, bill_date, CASE WHEN order_id % 3 = 0 THEN 1 WHEN order_id % 5 > 0 AND {_TIE} THEN 2 WHEN order_id % 5 > 0 THEN 3 ELSE 4 END AS rung,
bill_date BETWEEN DATE '1994-04-01' AND DATE '1997-03-31' AS bill_in, po_date BETWEEN DATE '1994-04-01' AND DATE '1997-03-31' AS po_in FROM w JOIN l USING (order_id))
SELECT order_id, CAST(rung AS INTEGER) AS rung, CASE WHEN (rung < 4 AND NOT ({_TIE})) OR NOT bill_in OR (rung < 4 AND NOT po_in) THEN 'No match' ELSE 'Match' END AS result, CASE WHEN rung < 4 THEN bill_date >= po_date END AS date_order FROM z""")
def two_way_match(spark, d):
    last = bills(spark, d).groupBy("order_id").agg(F.max("bill_date").alias("bill_date"))
    w = _whole(spark, d).join(last, "order_id")
    number, name = F.col("order_id").cast("string"), F.concat(F.lit("Firm "), F.col("cust").cast("string"))
    tax = F.concat(F.lit("27AAAAA"), F.lpad(F.col("cust").cast("string"), 8, "0"))
    none = F.lit(None).cast("string")
    amount = lambda c: (F.col(c) / 100).cast("double")
    cited = F.when(F.col("order_id") % 3 == 0, F.array(F.struct(F.concat(F.lit("po "), number).alias("value"), F.lit("buyer_pr_po").alias("kind"), F.lit(False).alias("handwritten"))))
    lines_of = INVOICE.split("lines:")[1][:-1]
    invoice = F.struct(F.concat(F.lit("INV-"), number), F.col("bill_date").cast("string"), name, F.when(F.col("order_id") % 5 > 0, tax), none, cited, F.lit(None).cast("double"), F.lit(None).cast("double"), amount("cents"), F.lit(None).cast(lines_of)).cast(INVOICE)
    po = F.struct(F.concat(F.lit("PO"), number), none, name, tax, none, F.col("po_date").cast("string"), none, amount("po_cents"), F.lit(True), F.lit(None).cast(lines_of)).cast(ORDER)
    out = two_way(w.select("order_id", invoice.alias("invoice"), F.array(po).alias("pos")), MatchPolicy(fy_start="1994-04-01", fy_end="1997-03-31"))
    return out.select("order_id", "ladder.rung", "result", "date_order")


@query("code_validity", "SELECT p_partkey AS part, length(CAST(p_partkey * 37 AS VARCHAR)) IN (4, 6, 8) AS valid FROM part")
def code_validity(spark, d):
    return _read(spark, d, "part").select(F.col("p_partkey").alias("part"), code_valid((F.col("p_partkey") * 37).cast("string")).alias("valid"))


@query("page_titles", r"SELECT page_id, CASE WHEN regexp_matches(upper(html), '\b(TAX INVOICE|INVOICE|BILL OF SUPPLY|CREDIT NOTE|DEBIT NOTE)\b') THEN 'invoice' WHEN regexp_matches(upper(html), '\b(GOODS RECEIPT|GRN|MATERIAL RECEIPT|GOODS RECEIVED)\b') THEN 'grn' WHEN regexp_matches(upper(html), '\b(PURCHASE ORDER|WORK ORDER|SERVICE ORDER|PURCHASE REQUISITION)\b') THEN 'po' ELSE 'continuation' END AS kind FROM pages")
def page_titles(spark, d):
    return _read(spark, d, "pages").select("page_id", page_kind(F.col("html")).alias("kind"))
