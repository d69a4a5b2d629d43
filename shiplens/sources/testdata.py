"""Adapter: TPC-H-style test tables -> ``order_lines``.

The test data has no order-line export, so the fields the analysis uses are
derived from lineitem / orders / customer / nation / part with fixed rules
(a deterministic mapping, documented in FIXTURES.md section 4). Only the
needed columns are read (parquet column pruning), each dimension is joined
once on its key; Spark chooses broadcast or sort-merge per join from the
sizes it sees (AQE re-plans at runtime; nation is 25 rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiplens.config import ZONE_FACTOR

# Fixed values of the adapter.
# Nation key 0..22 -> the 23 zone-card regions, in card order; keys 23, 24
# keep the nation name (an unmapped region that exercises the default zone).
NATION_REGIONS = tuple(ZONE_FACTOR.keys())
# Nation key ranges -> market.
MARKET_RANGES = (
    (0, 4, "USCA"),
    (5, 7, "LATAM"),
    (8, 11, "Europe"),
    (12, 17, "Pacific Asia"),
    (18, 22, "Africa"),
)
# Order priority -> shipping mode, shipping mode -> scheduled days.
PRIORITY_MODE = {
    "1-URGENT": "Same Day",
    "2-HIGH": "First Class",
    "3-MEDIUM": "Second Class",
    "4-NOT SPECIFIED": "Standard Class",
    "5-LOW": "Standard Class",
}
MODE_SCHED_DAYS = {"Same Day": 0, "First Class": 1, "Second Class": 2, "Standard Class": 4}
# Customer market segment -> customer segment (others: Consumer).
SEGMENT_MAP = {"BUILDING": "Corporate", "FURNITURE": "Home Office"}
SALES_DIVISOR = 300.0
QTY_BUCKETS = 5
TRANSIT_WEEK = 7


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _order_status(status: Column, line_no: Column) -> Column:
    pending = (F.when(line_no == 7, "PAYMENT_REVIEW")
               .when(line_no == 6, "SUSPECTED_FRAUD")
               .when(line_no == 5, "CANCELED")
               .otherwise("PENDING"))
    return (F.when(status == "F", "COMPLETE")
            .when(status == "O", "PROCESSING")
            .when(status == "P", pending))


def _market(nation_key: Column) -> Column:
    expr = None
    for lo, hi, name in MARKET_RANGES:
        cond = nation_key.between(lo, hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


# Schemas of the columns the adapter reads (explicit, so no footer inference).
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, "
                "l_returnflag string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_type string",
}


DIMENSIONS = ("customer", "part")


def order_lines_from_tables(spark: SparkSession, sf_dir: str, dims=DIMENSIONS) -> DataFrame:
    """``order_lines`` (the raw-export schema) built from the test tables.

    Join order keeps the fact table's shuffles to two: orders are first
    joined to their customer (and the 25-row nation table), then lineitem
    meets that on the order key and part on the part key. The fact-side
    join carries a ``merge`` hint: lineitem grows with the data, so it is
    never a broadcast candidate, whatever a size estimate says. The other
    joins are left to Spark's size checks (nation is broadcast; customer
    and part become sort-merge joins past the broadcast threshold), and a
    hot key on any join is split by AQE's skew-join handling.

    ``dims`` names the dimensions to look up: ``customer`` (region, market and
    segment, with nation) and ``part`` (category). A query states what it
    needs, so a KPI without product category never joins part and one without
    region, segment or market never joins customer, saving a full shuffle of
    the lines each; the attributes of a dimension left out are NULL. Lookups
    are LEFT joins on primary keys, with nothing between the exchange and the
    join's sort, which is what lets AQE split a hot key. A line whose dimension row is missing
    is kept with NULL attributes (unknown region -> default zone, NULL
    group keys dropped), it does not vanish.
    """
    read = lambda t: spark.read.schema(SCHEMAS[t]).parquet(f"{sf_dir}/{t}.parquet")
    lineitem, orders, customer, nation, part = (
        read(t) for t in ("lineitem", "orders", "customer", "nation", "part"))
    if "customer" in dims:
        cust = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        orders = orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
    else:
        orders = orders.withColumns({"c_nationkey": F.lit(None).cast("int"), "n_name": F.lit(None).cast("string"),
                                     "c_mktsegment": F.lit(None).cast("string")})
    lines = lineitem.hint("merge").join(orders, lineitem.l_orderkey == orders.o_orderkey)
    if "part" in dims:
        lines = lines.join(part, lineitem.l_partkey == part.p_partkey, "left")
    else:
        lines = lines.withColumn("p_type", F.lit(None).cast("string"))

    nk = F.col("c_nationkey")
    mode = F.try_element_at(_literal_map(PRIORITY_MODE), F.col("o_orderpriority"))
    real_days = F.pmod(F.datediff(F.col("l_shipdate"), F.col("o_orderdate")), F.lit(TRANSIT_WEEK))
    sched_days = F.try_element_at(_literal_map(MODE_SCHED_DAYS), mode)
    region_by_key = F.try_element_at(F.array(*[F.lit(r) for r in NATION_REGIONS]), nk + 1)
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("line_key"),
        F.col("o_orderdate").alias("order_ts"),
        F.col("l_shipdate").alias("ship_ts"),
        _order_status(F.col("o_orderstatus"), F.col("l_linenumber")).alias("order_status"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "Shipping canceled")
         .otherwise("Other").alias("delivery_status"),
        real_days.cast("int").alias("real_days"),
        sched_days.cast("int").alias("sched_days"),
        (real_days > sched_days).cast("int").alias("late_risk"),
        mode.alias("shipping_mode"),
        F.when(nk.between(0, len(NATION_REGIONS) - 1), region_by_key)
         .otherwise(F.col("n_name")).alias("order_region"),
        _market(nk).alias("market"),
        F.coalesce(F.try_element_at(_literal_map(SEGMENT_MAP), F.col("c_mktsegment")),
                   F.lit("Consumer")).alias("customer_segment"),
        F.col("p_type").alias("category_name"),
        (F.pmod(F.col("l_quantity").cast("int") - 1, F.lit(QTY_BUCKETS)) + 1).alias("qty"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / SALES_DIVISOR).alias("sales"),
    )
