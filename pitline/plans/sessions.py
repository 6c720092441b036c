"""Queries over trading days, the market clock, halts and refused orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitline.functions import calendar as cl
from pitline.functions import scalars as fs
from pitline.operators import orders as od
from pitline.operators import returns as rt
from pitline.plans.books import Setup
from pitline.plans.oracle import cte
from pitline.plans.reads import weekly_slots
from pitline.plans.registry import query, r, shared
from pitline.sources import adapters as ad

# Weekdays from the first order on, without the days on which an urgent order of over 300,000 came in.
cte("tdays", [], """SELECT day, session, sum(session::INT) OVER (ORDER BY day) AS number FROM (SELECT d::DATE AS day, isodow(d) < 6 AND NOT
 d::DATE IN (SELECT o_orderdate::DATE FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000) AS session FROM
 (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2010-12-31', INTERVAL 1 DAY)) AS d))""")


def _calendar(spark, sf):
    def build():
        big = ad.table(spark, sf, "orders").where(
            (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)
        )
        days = cl.weekdays(spark, "1990-01-01", "2010-12-31")
        return cl.TradingCalendar(cl.without(days, big.select(F.to_date("o_orderdate").alias("day"))))

    return shared(spark, sf, "trading_days", build)


@query(["disc", "tdays"], """SELECT entity_id, count(*) AS n, sum(b.number - a.number)::BIGINT AS sessions, max(b.number - a.number)::BIGINT
 AS longest, sum(date_diff('day', event_time, knowledge_time))::BIGINT AS calendar_days FROM disc JOIN tdays a ON a.day =
 event_time::DATE JOIN tdays b ON b.day = knowledge_time::DATE GROUP BY 1""")
def trading_day_lag(spark, sf):
    """Sessions between a trade and its disclosure."""
    out = _calendar(spark, sf).between(ad.disclosures(spark, sf), "event_time", "knowledge_time", "lag")
    return out.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("lag").alias("sessions"), F.max("lag").alias("longest"),
        F.sum(fs.whole_days("knowledge_time", "event_time")).cast("long").alias("calendar_days"),
    )


@query(["tdays"], """SELECT o_orderkey, (SELECT day FROM tdays t WHERE t.session AND t.number = CASE WHEN s > 0 THEN n + s WHEN s = 0
 THEN n + 1 - i ELSE n - i + 1 + s END)::VARCHAR AS due FROM (SELECT o_orderkey, o_custkey % 7 - 3 AS s, number AS n, session::INT AS i
 FROM orders JOIN tdays ON day = o_orderdate::DATE)""")
def trading_day_due(spark, sf):
    """The day some sessions before or after each order."""
    orders = ad.table(spark, sf, "orders").withColumn("step", F.col("o_custkey") % 7 - 3)
    out = _calendar(spark, sf).add(orders, "o_orderdate", "step", "due")
    return out.select("o_orderkey", F.col("due").cast("string").alias("due"))


@query(None, """SELECT market, event_time FROM (SELECT *, lag(is_open) OVER (PARTITION BY market ORDER BY event_time, event_id) AS was FROM
 (SELECT 'M' || user_id % 5 AS market, ts AS event_time, event_id, CAST(round(value * 100) AS BIGINT) % 3 > 0 AS is_open FROM events))
 WHERE was AND NOT is_open""")
def session_edges(spark, sf):
    """Readings of the markets' clocks at which one turned from open to closed."""
    clock = ad.table(spark, sf, "events").select(
        F.concat(F.lit("M"), (F.col("user_id") % 5).cast("string")).alias("market"),
        F.col("ts").cast("timestamp").alias("event_time"), "event_id",
        (ad.cents("value") % 3 > 0).alias("is_open"),
    )
    return od.session_closes(clock, ["market"], ["event_time", "event_id"]).select("market", "event_time")


cte("daily", ["curve"], """SELECT strategy, event_time, equity, lag(equity) OVER (PARTITION BY strategy ORDER BY event_time) AS last_equity
 FROM curve""")


@query("daily", """SELECT strategy, event_time, coalesce(equity / last_equity - 1 <= -0.01 AND last_equity > 0, false) AS halted FROM daily""")
def halt_flags(spark, sf):
    """Days on which a strategy's loss against the last close reached a hundredth."""
    curve = rt.equity_curve(Setup(spark, sf).returns())
    days = cl.previous(curve, ["strategy"], F.year("event_time"), ["event_time"], "equity", "last_equity")
    return rt.halt_flags(days, 0.01).select(
        "strategy", "event_time", F.coalesce("halted", F.lit(False)).alias("halted")
    )


@query(None, """SELECT CASE WHEN l_quantity - 3 <= 0 THEN 'non-positive quantity' WHEN l_quantity - 3 > 40 THEN 'absurd quantity' WHEN
 l_linenumber % 2 = 0 AND abs(l_discount * 4.5) > 0.2 THEN 'limit price far from market' END AS problem, count(*) AS n FROM lineitem
 GROUP BY 1""")
def refused_orders(spark, sf):
    """Why orders made of the order lines must not be sent."""
    lines = ad.table(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    problem = fs.order_problem(
        F.col("l_quantity") - 3, F.when(F.col("l_linenumber") % 2 == 0, "limit").otherwise("market"),
        price + price * F.col("l_discount") * 4.5, price, max_qty=40.0, max_dev=0.2,
    )
    return lines.select(problem.alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


cte("totals", ["pos", "feat"], """SELECT account, as_of, sum(qty * px) AS market_value, sum(abs(qty * px)) AS deployed, sum(qty * (px - avg_price)) AS
 unrealized_pnl FROM (SELECT p.account, p.as_of, p.qty, 115.0 AS avg_price, coalesce(f.ff, 115.0) AS px FROM pos p LEFT JOIN feat f
 ON f.as_of = p.as_of AND f.entity_id = p.entity_id WHERE p.qty <> 0) GROUP BY 1, 2""")


@query("totals", """SELECT account, as_of, round(market_value, 4) + 0.0 AS market_value, round(deployed, 4) + 0.0 AS deployed,
 round(unrealized_pnl, 4) + 0.0 AS unrealized_pnl FROM totals""")
def account_totals(spark, sf):
    """Value, deployed capital and open profit of every account at every decision time."""
    from pitline.plans.decisions import _fills, _positions

    held = _positions(_fills(spark, sf), weekly_slots(spark, sf)).where("qty <> 0").withColumn("avg_price", F.lit(115.0))
    prices = Setup(spark, sf).at.select("as_of", "entity_id", F.col("ff").alias("price"))
    out = od.account_totals(held, prices, ["as_of"])
    return out.select("account", "as_of", *[r(c, 4).alias(c) for c in ("market_value", "deployed", "unrealized_pnl")])
