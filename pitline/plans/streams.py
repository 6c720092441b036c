"""Queries that run streams over the given tables until they are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitline.operators import bitemporal as bt
from pitline.plans.decisions import LEDGER
from pitline.plans.registry import query, r
from pitline.session import scratch_path
from pitline.sources import adapters as ad
from pitline import schema as sm
from pitline.sources.store import read_store
from pitline.streaming import jobs as sj
from pitline.streaming import passes as sp


def _news(spark, sf):
    events = sj.table_stream(spark, sf, "events")
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("ts").cast("timestamp").alias("knowledge_time"),
        (ad.cents("value") % 21 - 10).cast("double").alias("tone"),
        F.col("event_type").alias("source"),
        F.col("event_id"),
        "value",
    )


@query("news", """SELECT ends AS window_end, entity_id, count(*) AS n, count_if(event_time >= ends - INTERVAL 1 DAY)::BIGINT
 AS n_recent, round(avg(CASE WHEN event_time >= ends - INTERVAL 1 DAY THEN tone END), 6) + 0.0 AS recent_tone FROM news JOIN
 (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-02-13', INTERVAL 1 DAY)) AS ends) ON event_time < ends
 AND event_time >= ends - INTERVAL 14 DAY GROUP BY 1, 2""")
def stream_news_windows(spark, sf):
    """Sliding 14-day windows; every window that holds data is read back from the final state."""
    last = sj.final_state(sj.news_windows(_news(spark, sf)), "window", "entity_id")
    return last.select(F.col("window.end").alias("window_end"), "entity_id", "n", "n_recent",
                       r("recent_tone").alias("recent_tone"))


@query(None, """SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS event_time, event_type AS entity_id, arg_min(value, (ts, event_id)) AS open,
 max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events
 GROUP BY 1, 2""")
def stream_bars(spark, sf):
    """Hourly bars per event type, open windows included."""
    ticks = _news(spark, sf).select(
        F.col("source").alias("entity_id"), "event_time", F.col("value").alias("price"),
        F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"),
    )
    bars = sj.final_state(sj.minute_bars(ticks, "1 hour", "10 minutes"), "window", "entity_id")
    return bars.select(F.col("window.start").alias("event_time"), "entity_id", "open", "high", "low", "close", "volume")


@query(None, """SELECT event_type AS source, max(ts) AS last_knowledge_time FROM events GROUP BY 1""")
def stream_freshness(spark, sf):
    return sj.final_state(sj.freshness(_news(spark, sf)), "source")


def _sales_stream(spark, sf):
    lines = sj.table_stream(spark, sf, "lineitem")
    return lines.select(
        F.lit("warehouse").alias("source"), F.lit("filing.sale").alias("dataset"),
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("entity_id"),
        F.col("l_linenumber").cast("string").alias("ref"),
        F.lit("1995-01-01").cast("timestamp").alias("event_time"),
        F.col("l_shipdate").cast("timestamp").alias("knowledge_time"),
        (F.col("l_partkey") % 4).cast("int").alias("revision"),
        F.col("l_extendedprice").alias("close"),
    )


@query(None, """SELECT entity_id, ref, revision, knowledge_time, close FROM (SELECT 'O' || l_orderkey AS entity_id,
 CAST(l_linenumber AS VARCHAR) AS ref, CAST(l_partkey % 4 AS INTEGER) AS revision, l_shipdate AS knowledge_time,
 max(l_extendedprice) + 1 AS close FROM lineitem GROUP BY 1, 2, 3, 4)
 QUALIFY row_number() OVER (PARTITION BY entity_id, ref ORDER BY knowledge_time DESC, revision DESC) = 1""")
def stream_ingest(spark, sf):
    """Facts without ids streamed into the store twice with different payloads; of each the last copy stays."""
    store = scratch_path(spark)
    facts = _sales_stream(spark, sf).withColumn("arrival", ad.cents("close"))
    sj.ingest(facts, store, "arrival")
    sj.ingest(facts.withColumn("close", F.col("close") + 1), store, "arrival")
    rows = bt.as_of(read_store(spark, store), "2100-01-01")
    return rows.select("entity_id", "ref", "revision", "knowledge_time", "close")


CHECKS_SQL = """SELECT 'U' || user_id AS entity_id, ts AS event_time, event_id, CAST(round(value * 100) AS BIGINT) % 7 - 2 AS s,
 CAST(round(value * 100) AS BIGINT) % 5 AS v, event_id % 3 - 1 AS d FROM events"""


def _checks(events):
    c = ad.cents("value")
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        (c % 7 - 2).cast("double").alias("signal"),
        F.lit(0.5).alias("recent_vol"),
        (c % 5).cast("double").alias("volume_ratio"),
        (F.col("event_id") % 3 - 1).cast("double").alias("daily_signal"),
    )


CONFIRM_SQL = f"""WITH RECURSIVE c AS ({CHECKS_SQL}), d AS (SELECT *, CASE WHEN abs(s) >= 1 THEN sign(s) ELSE 0 END AS dir FROM c),
 m AS (SELECT *, sum(dir) OVER w AS tot, count(*) OVER w AS k FROM d WINDOW w AS (PARTITION BY entity_id ORDER BY event_time
 ROWS 1 PRECEDING)), p AS (SELECT entity_id, event_time, dir, row_number() OVER (PARTITION BY entity_id ORDER BY event_time) AS i
 FROM m WHERE k = 2 AND abs(tot) = 2 AND v >= 1.5 AND NOT (dir * d < 0)),
 walk AS (SELECT entity_id, i, event_time, event_time AS last, dir, true AS acts FROM p WHERE i = 1 UNION ALL SELECT p.entity_id,
 p.i, p.event_time, CASE WHEN p.event_time - w.last >= INTERVAL 1 DAY THEN p.event_time ELSE w.last END, p.dir,
 p.event_time - w.last >= INTERVAL 1 DAY FROM walk w JOIN p ON p.entity_id = w.entity_id AND p.i = w.i + 1)
 SELECT entity_id, event_time, CAST(dir AS INTEGER) AS action FROM walk WHERE acts"""
CONFIRM = {"persistence": 2, "sigma": 2.0, "volume": 1.5, "cooldown": 1440.0}


@query(None, CONFIRM_SQL)
def stream_confirmations(spark, sf):
    checks = _checks(sj.table_stream(spark, sf, "events"))
    return sj.run_to_table(sj.confirmations(checks, **CONFIRM))


@query(None, CONFIRM_SQL)
def confirmations(spark, sf):
    return sj.confirmations_batch(_checks(ad.table(spark, sf, "events")), **CONFIRM)


@query()
def stream_sleeve(spark, sf):
    events = sj.table_stream(spark, sf, "events")
    messages = events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity_id"),
        F.col("ts").cast("timestamp").alias("event_time"), F.col("value").alias("price"),
        F.when(F.col("event_type") == "purchase", F.md5(F.col("event_id").cast("string"))).alias("story_hash"),
        (F.col("event_id") % 3 - 1).cast("int").alias("direction"),
        (ad.cents("value") % 101 / 100.0).alias("confidence"),
    )
    rules = sj.SleeveRules(hold_days=2, stop=0.5, cooldown_days=1, min_confidence=0.2)
    return sj.run_to_table(sj.sleeve(messages, rules))


@query(None, """WITH b AS (SELECT event_type AS entity_id, floor(epoch(ts) / 3600)::BIGINT AS s, arg_max(value, (ts, event_id)) AS p FROM events
 GROUP BY 1, 2), l AS (SELECT *, lag(s) OVER w AS ps, p / lag(p) OVER w - 1 AS r FROM b WINDOW w AS (PARTITION BY entity_id ORDER BY s)),
 f AS (SELECT b.entity_id, b.s, any_value(b.p) AS p, arg_max(x.p, x.s) FILTER (x.s <= b.s - 24) AS m, arg_max(x.p, x.s) FILTER
 (x.s <= b.s - 5) AS v, coalesce(sum(x.r) FILTER (x.s > b.s - 24 AND x.ps > b.s - 180), 0) AS sr, coalesce(sum(x.r * x.r) FILTER
 (x.s > b.s - 24 AND x.ps > b.s - 180), 0) AS sq, least(24, b.s - min(x.s)) AS n FROM b JOIN l x ON x.entity_id = b.entity_id AND
 x.s <= b.s AND x.s > b.s - 180 GROUP BY 1, 2)
 SELECT entity_id, make_timestamp(s * 3600000000) AS event_time, p AS close, round(p / m - 1, 6) + 0.0 AS momentum, round(1 - p / v, 6)
 + 0.0 AS mean_reversion, CASE WHEN n > 0 THEN round(sqrt(greatest(0, sq / n - (sr / n) * (sr / n))), 5) + 0.0 END AS volatility FROM f""")
def stream_minute_features(spark, sf):
    """Features of hourly bars per event type from a buffer of 180 hours."""
    ticks = _news(spark, sf).select(
        F.col("source").alias("entity_id"), "event_time", F.col("event_id").alias("seq"), F.col("value").alias("price")
    )
    rules = sp.Intraday(step=3600, span=180, momentum=24, mean_reversion=5, volatility=24)
    last = sj.final_state(sp.minute_features(ticks, rules), "entity_id", "event_time")
    return last.select("entity_id", "event_time", "close", r("momentum").alias("momentum"),
                       r("mean_reversion").alias("mean_reversion"), r("volatility", 5).alias("volatility"))


PASSES = 6


@query(None, f"""WITH RECURSIVE e AS (SELECT 'U' || user_id AS e, ts, value AS price, CASE WHEN event_type = 'purchase' THEN md5(event_id::VARCHAR)
 END AS story, event_id % 3 - 1 AS dir, (CAST(round(value * 100) AS BIGINT) % 101) / 100.0::DOUBLE AS conf, least({PASSES - 1},
 date_diff('day', TIMESTAMP '2024-01-01', ts) // 6) AS i FROM events),
 q AS (SELECT i, list({{'e': e, 'p': p}}) AS quotes FROM (SELECT i, e, arg_max(price, (ts, price)) AS p FROM e WHERE price > 0 GROUP BY 1, 2)
 GROUP BY 1), n AS (SELECT i, max(ts) AS now FROM e GROUP BY 1),
 c AS (SELECT i, list({{'e': e, 'p': p, 'story': b.story}} ORDER BY b.conf DESC, e) AS cands FROM (SELECT i, e, max({{'conf': conf, 't': -epoch_us(ts),
 'story': story}}) AS b FROM e WHERE story IS NOT NULL AND dir > 0 AND conf >= 0.2 GROUP BY 1, 2) JOIN (SELECT i, unnest(quotes,
 recursive := true) FROM q) USING (i, e) GROUP BY 1),
 g AS (SELECT row_number() OVER (ORDER BY i) AS i, now, quotes, coalesce(cands, []) AS cands FROM n JOIN q USING (i) LEFT JOIN c USING (i)),
 walk AS (SELECT 0::BIGINT AS i, NULL::TIMESTAMP AS now, []::STRUCT(e VARCHAR, p DOUBLE, story VARCHAR, due TIMESTAMP)[] AS held,
 []::VARCHAR[] AS used, MAP {{}}::MAP(VARCHAR, TIMESTAMP) AS acted, []::STRUCT(e VARCHAR, p DOUBLE, status VARCHAR, reason VARCHAR)[] AS actions
 UNION ALL SELECT i, now, live || opens, used || list_transform(opens, lambda o: o.story),
 map_from_entries(list_concat(list_filter(map_entries(acted), lambda a: NOT list_contains(moved, a.key)),
 list_transform(moved, lambda m: {{'key': m, 'value': now}}))),
 list_transform(closed, lambda o: {{'e': o.e, 'p': o.q, 'status': 'closed', 'reason': CASE WHEN o.q / o.p - 1 <= -0.5 THEN 'stop' ELSE 'horizon'
 END}}) || list_transform(opens, lambda o: {{'e': o.e, 'p': o.p, 'status': 'open', 'reason': NULL::VARCHAR}}) FROM (SELECT *,
 list_distinct(list_transform(closed, lambda o: o.e) || list_transform(opens, lambda o: o.e)) AS moved FROM (SELECT *,
 list_transform(list_filter(cands, lambda x: NOT list_contains(used, x.story) AND NOT list_contains(list_transform(live, lambda o: o.e), x.e)
 AND (acted[x.e] IS NULL OR now - acted[x.e] >= INTERVAL 1 DAY))[1:greatest(0, 12 - len(live))],
 lambda x: {{'e': x.e, 'p': x.p, 'story': x.story, 'due': now + INTERVAL 8 DAY}}) AS opens FROM (SELECT *,
 list_transform(list_filter(priced, lambda o: NOT o.gone), lambda o: {{'e': o.e, 'p': o.p, 'story': o.story, 'due': o.due}}) AS live,
 list_filter(priced, lambda o: o.gone) AS closed FROM (SELECT *, list_transform(quoted, lambda o: {{'e': o.e, 'p': o.p, 'story': o.story,
 'due': o.due, 'q': o.q, 'gone': now >= o.due OR coalesce(o.q / o.p - 1 <= -0.5, false)}}) AS priced FROM (SELECT g.i, g.now, g.quotes,
 g.cands, w.used, w.acted, list_transform(w.held, lambda o: {{'e': o.e, 'p': o.p, 'story': o.story, 'due': o.due, 'q':
 list_filter(g.quotes, lambda x: x.e = o.e)[1].p}}) AS quoted FROM walk w JOIN g ON g.i = w.i + 1))))))
 SELECT now AS as_of, a.e AS entity_id, a.status AS status, a.p AS price, a.reason AS reason FROM (SELECT now, unnest(actions) AS a FROM walk)""")
def stream_capped_sleeve(spark, sf):
    """A sleeve of at most twelve names over six deliveries of events, resumed for each of them."""
    folder, marks, path = scratch_path(spark), scratch_path(spark), scratch_path(spark)
    events = ad.table(spark, sf, "events")
    days = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    part = F.least(F.lit(PASSES - 1), F.floor(days / 6))
    for i in range(PASSES):
        events.where(part == i).coalesce(1).write.mode("append").parquet(folder)
        new = spark.readStream.schema(events.schema).parquet(folder)
        messages = new.select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity_id"),
            F.col("ts").cast("timestamp").alias("event_time"), F.col("value").alias("price"),
            F.when(F.col("event_type") == "purchase", F.md5(F.col("event_id").cast("string"))).alias("story_hash"),
            (F.col("event_id") % 3 - 1).cast("int").alias("direction"),
            (ad.cents("value") % 101 / 100.0).alias("confidence"),
        )
        rules = sj.SleeveRules(hold_days=8, stop=0.5, cooldown_days=1, min_confidence=0.2)
        sp.capped_sleeve(messages, path, rules, 12, "sleeve", marks)
    log = sm.typed_view(read_store(spark, path), sm.NEWS_SLEEVE)
    return log.select(F.col("event_time").alias("as_of"), "entity_id", "status", F.col("entry_price").alias("price"), "reason")


@query(None, LEDGER)
def stream_positions(spark, sf):
    lines = sj.table_stream(spark, sf, "lineitem")
    fills = lines.select(
        F.concat(F.lit("A"), F.col("l_linenumber").cast("string")).alias("account"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity_id"),
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_quantity", "l_tax", "l_discount").alias("seq"),
        F.when(F.col("l_returnflag") == "N", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("signed_qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    last = sj.final_state(sj.positions(fills), "account", "entity_id")
    return last.select("account", "entity_id", "qty", r("avg_price", 4).alias("avg_price")).where(F.col("qty") != 0)
