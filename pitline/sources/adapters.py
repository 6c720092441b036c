"""Views of the driver's warehouse tables as bitemporal market facts.

Money is summed in whole cents, so prices do not depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.scalars import high_signal_role, observation_id
from pitline.schema import CONGRESS, FUNDAMENTAL, INSIDER, MACRO, NEWS, PRICE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def _label(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _bars(sales: DataFrame, unit: str) -> DataFrame:
    """Price bar per (entity, time) from sales lines: 100 plus a hundredth of the unit price."""
    return (
        sales.withColumn("event_time", F.date_trunc(unit, F.col("l_shipdate").cast("timestamp")))
        .groupBy("entity_id", "event_time")
        .agg(
            (F.sum(cents("l_extendedprice")) / F.sum(F.col("l_quantity").cast("long")) / 10000 + 100)
            .alias("close"),
            F.sum(F.col("l_quantity").cast("long")).cast("double").alias("volume"),
        )
    )


def supplier_bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Weekly price bars per supplier: the main panel, it grows with the data."""
    sales = table(spark, sf_dir, "lineitem").select(
        _label("S", "l_suppkey").alias("entity_id"),
        "l_shipdate",
        "l_extendedprice",
        "l_quantity",
    )
    return _bars(sales, unit)


def brand_bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Price bars per brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity_id"))
    sales = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity"
    )
    return _bars(sales.join(part, F.col("l_partkey") == F.col("p_partkey")), unit)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector map of the supplier universe: the supplier's nation."""
    return table(spark, sf_dir, "supplier").select(
        _label("S", "s_suppkey").alias("entity_id"),
        _label("N", "s_nationkey").alias("sector"),
    )


def sales_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as facts with real revisions: a line number can occur more than once."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("warehouse").alias("source"),
        F.concat(F.lit("filing."), F.col("l_linestatus")).alias("dataset"),
        F.lit("order").alias("entity_type"),
        _label("O", "l_orderkey").alias("entity_id"),
        F.col("l_linenumber").cast("string").alias("ref"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.col("l_shipdate").cast("timestamp").alias("knowledge_time"),
        (F.col("l_partkey") % 4).cast("int").alias("revision"),
        F.col("l_extendedprice").alias("close"),
        F.col("l_quantity").alias("open"),
        (F.col("l_discount") - 0.01).alias("low"),
    )


def sales_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales_facts`` with their derived ids."""
    return sales_facts(spark, sf_dir).withColumn("observation_id", observation_id())


def price_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier bars as price facts; both clocks read the bar time."""
    return supplier_bars(spark, sf_dir).select(
        F.lit("price").alias("source"),
        F.lit(PRICE).alias("dataset"),
        F.lit("equity").alias("entity_type"),
        "entity_id",
        F.lit(None).cast("string").alias("ref"),
        "event_time",
        F.col("event_time").alias("knowledge_time"),
        F.lit(0).alias("revision"),
        "close",
        "volume",
        F.concat_ws("|", "entity_id", F.col("event_time").cast("string")).alias("observation_id"),
    )


def disclosure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the columns of their order that ``disclosures`` reads; texts are made from them later.

    ``again`` marks lines that share the key of a disclosure with others. They meet in the join by order already.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus",
        "l_shipdate", "l_quantity",
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    same = W.partitionBy("l_orderkey", "l_linenumber", "l_suppkey", "o_orderdate")
    return joined.withColumn("again", F.count(F.lit(1)).over(same) > 1)


def disclosures(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Order lines as insider filings on the supplier by the ordering customer.

    ``lines`` are the ``disclosure_lines`` if they are written already; their ``again`` is kept.
    """
    kept = [] if lines is None else ["again"]
    lines = disclosure_lines(spark, sf_dir) if lines is None else lines
    role = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Leadership"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("committee:finance"))
        .otherwise(F.lit("member"))
    )
    rows = lines.select(
        F.lit("edgar").alias("source"),
        F.lit(INSIDER).alias("dataset"),
        _label("S", "l_suppkey").alias("entity_id"),
        F.concat_ws("|", "l_orderkey", "l_linenumber").alias("ref"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.col("l_shipdate").cast("timestamp").alias("knowledge_time"),
        (F.col("l_partkey") % 4).cast("int").alias("revision"),
        _label("C", "o_custkey").alias("insider_name"),
        (F.col("l_returnflag") == "R").alias("is_purchase"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("transaction_type"),
        role.alias("role"),
        F.col("l_quantity").alias("shares"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
        .alias("observation_id"),
        *kept,
    )
    return rows.withColumn("high_signal_role", high_signal_role("role"))


def congress_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same order lines read as trades disclosed by office holders."""
    return disclosures(spark, sf_dir).withColumn("dataset", F.lit(CONGRESS))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly earnings per supplier; filed 30 days after the quarter ends."""
    quarter = F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp"))
    profit = F.sum(cents("l_extendedprice") * (cents("l_discount") - 4))
    end = F.col("quarter") + F.expr("interval 3 months")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(_label("S", "l_suppkey").alias("entity_id"), quarter.alias("quarter"))
        .agg((profit / 1_000_000.0).alias("eps"))
        .select(
            F.lit("sec_xbrl").alias("source"),
            F.lit(FUNDAMENTAL).alias("dataset"),
            "entity_id",
            F.date_format(end, "yyyy-MM-dd").alias("ref"),
            end.alias("event_time"),
            (end + F.expr("interval 30 days")).alias("knowledge_time"),
            F.lit(0).alias("revision"),
            "eps",
            F.concat_ws("|", "entity_id", end.cast("string")).alias("observation_id"),
        )
    )


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two monthly rate series from order totals by priority; known a month later."""
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    series = F.when(F.col("o_orderpriority") == "1-URGENT", "DGS10").when(
        F.col("o_orderpriority") == "2-HIGH", "DGS2"
    )
    return (
        table(spark, sf_dir, "orders")
        .select(series.alias("entity_id"), month.alias("event_time"), "o_totalprice")
        .where(F.col("entity_id").isNotNull())
        .groupBy("entity_id", "event_time")
        .agg((F.sum(cents("o_totalprice")) / F.count(F.lit(1)) / 1e7).alias("value"))
        .select(
            F.lit("fred").alias("source"),
            F.lit(MACRO).alias("dataset"),
            "entity_id",
            F.lit(None).cast("string").alias("ref"),
            "event_time",
            (F.col("event_time") + F.expr("interval 1 month")).alias("knowledge_time"),
            F.lit(0).alias("revision"),
            "value",
            F.concat_ws("|", "entity_id", F.col("event_time").cast("string"))
            .alias("observation_id"),
        )
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as articles about a user; the tone is a whole number between -10 and 10."""
    return table(spark, sf_dir, "events").select(
        F.lit("gdelt").alias("source"),
        F.lit(NEWS).alias("dataset"),
        F.lit("equity").alias("entity_type"),
        _label("U", "user_id").alias("entity_id"),
        _label("e", "event_id").alias("ref"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("ts").cast("timestamp").alias("knowledge_time"),
        F.lit(0).alias("revision"),
        F.col("event_type").alias("title"),
        F.when(F.col("event_id") % 5 != 0, _label("http://n/", "event_id")).alias("url"),
        (cents("value") % 21 - 10).cast("double").alias("tone"),
        _label("e", "event_id").alias("observation_id"),
    )


def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored reads of news, from the JSON of the events table."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.lit("extract").alias("source"),
        _label("U", "user_id").alias("entity_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("ts").cast("timestamp").alias("knowledge_time"),
        (k / 50 - 1).alias("score"),
        (cents("value") % 101 / 100.0).alias("confidence"),
        F.col("event_id").alias("observation_id"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as index members from their first order until their last (if before 2001-06)."""
    last = F.max("o_orderdate").cast("date")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(_label("C", "o_custkey").alias("symbol"))
        .agg(
            F.min("o_orderdate").cast("date").alias("added"),
            F.when(last < F.lit("2001-06-01").cast("date"), last).alias("removed"),
        )
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as past situations: a vector, a regime and an outcome."""
    return table(spark, sf_dir, "embeddings").select(
        _label("v", "vec_id").alias("key"),
        F.col("embedding").cast("array<double>").alias("vector"),
        ((F.col("vec_id") * 37 % 101 - 50) / 1000.0).alias("outcome"),
        _label("r", "label").alias("regime"),
    )
