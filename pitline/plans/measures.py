"""Queries over flow, news and fundamental features, events, studies and signal measurement."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pitline.functions import scalars as fs
from pitline.functions.timeline import Slots, make_schedule, sample_dates
from pitline.operators import analogs as an
from pitline.operators import events as ev
from pitline.operators import features as ft
from pitline.operators import panel as pn
from pitline.operators import signal_ic as si
from pitline.operators import strategies as st
from pitline.operators import study as sd
from pitline.operators import universe as un
from pitline.plans.books import Setup
from pitline.plans.oracle import cte
from pitline.plans.reads import bars, filings, office_trades, supplier_panel, weekly_schedule, weekly_slots
from pitline.plans.registry import query, r, shared
from pitline.session import materialize, scratch_path
from pitline.sources import adapters as ad
from pitline.sources import ledger as lg


def daily_slots(spark, sf):
    """The end of every day with events."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("interval 1 day")
    days = ad.table(spark, sf, "events").select(day.alias("as_of"))
    return shared(spark, sf, "daily_slots", lambda: Slots(make_schedule(days, "as_of")))


# --- features ----------------------------------------------------------------------------------


@query("netbuys", "SELECT as_of, entity_id, net::DOUBLE AS net FROM netbuys")
def insider_net_buys(spark, sf):
    out = ft.insider_net_buys(filings(spark, sf), weekly_slots(spark, sf), 90)
    return out.select("as_of", "entity_id", F.col("insider_net_buys_90d").cast("double").alias("net"))


# Visible filings per (insider, month, year) at every scan; routine = 3 distinct years in a month.
cte("routine", ["discv", "sched"], """SELECT DISTINCT as_of, insider_name FROM (SELECT as_of, insider_name,
 month(knowledge_time) AS m, count(DISTINCT year(knowledge_time)) AS y FROM sched JOIN discv ON knowledge_time <= as_of
 AND (known_until IS NULL OR known_until > as_of) GROUP BY 1, 2, 3) WHERE y >= 3""")


@query("routine", "SELECT as_of, count(*) AS n_routine FROM routine GROUP BY 1")
def routine_traders(spark, sf):
    slots = weekly_slots(spark, sf)
    spells = ft.routine_spells(filings(spark, sf))
    spans = slots.spans(spells, "from", "until")
    counted = slots.with_as_of(slots.rolling_sums(spans, ["insider_name"], {}))
    return counted.groupBy("as_of").agg(F.count(F.lit(1)).alias("n_routine"))


@query(["routine"], """SELECT as_of, entity_id, sum(CASE WHEN is_purchase THEN 1.0 ELSE -1.0 END)::DOUBLE AS net
 FROM (SELECT s.as_of, d.* FROM sched s JOIN discv d ON knowledge_time <= s.as_of AND knowledge_time > s.as_of -
 INTERVAL 90 DAY AND (known_until IS NULL OR known_until > s.as_of)) v WHERE NOT EXISTS (SELECT 1 FROM routine q
 WHERE q.as_of = v.as_of AND q.insider_name = v.insider_name) GROUP BY 1, 2""")
def opportunistic_net_buys(spark, sf):
    out = ft.insider_net_buys(filings(spark, sf), weekly_slots(spark, sf), 90, True)
    return out.select(
        "as_of", "entity_id", F.col("insider_net_buys_90d_opp").cast("double").alias("net")
    )


@query(["discv", "sched"], """SELECT as_of, entity_id, count(*) AS buys FROM sched JOIN discv ON knowledge_time <= as_of
 AND knowledge_time > as_of - INTERVAL 120 DAY AND (known_until IS NULL OR known_until > as_of)
 WHERE high_signal_role AND transaction_type = 'buy' GROUP BY 1, 2""")
def leadership_buys(spark, sf):
    out = ft.leadership_buys(ad.congress_trades(spark, sf), weekly_slots(spark, sf))
    return out.select("as_of", "entity_id", F.col("congress_lead_buys_120d").cast("long").alias("buys"))


@query(["news", "days"], """SELECT as_of, entity_id, round(ln(1 + count(*)), 6) + 0.0 AS news_attention_7,
 round(coalesce(avg(tone), 0), 6) + 0.0 AS news_tone_7 FROM days JOIN news ON knowledge_time <= as_of
 AND event_time >= as_of - INTERVAL 7 DAY GROUP BY 1, 2""")
def news_features(spark, sf):
    out = ft.news_features(ad.news(spark, sf), daily_slots(spark, sf), 7)
    return out.select("as_of", "entity_id", r("news_attention_7").alias("news_attention_7"),
                      r("news_tone_7").alias("news_tone_7"))


@query(["tsig", "days"], """SELECT as_of, entity_id, round(v, 6) + 0.0 AS sentiment FROM (SELECT as_of, entity_id,
 arg_max(score * confidence, (knowledge_time, observation_id)) AS v FROM days JOIN tsig ON knowledge_time <= as_of
 AND knowledge_time > as_of - INTERVAL 10 DAY GROUP BY 1, 2)""")
def text_sentiment(spark, sf):
    out = ft.text_sentiment(ad.text_signals(spark, sf), daily_slots(spark, sf), 10)
    return out.select("as_of", "entity_id", r("llm_news_sentiment_10d").alias("sentiment"))


cte("quarters", ["earn", "sched"], """SELECT as_of, entity_id, event_time, knowledge_time, eps,
 row_number() OVER (PARTITION BY as_of, entity_id ORDER BY event_time DESC) AS q,
 count(*) OVER (PARTITION BY as_of, entity_id) AS n,
 eps - lag(eps, 4) OVER (PARTITION BY as_of, entity_id ORDER BY event_time) AS diff
 FROM sched JOIN earn ON knowledge_time <= as_of""")
cte("fund", ["quarters"], """SELECT as_of, entity_id, CASE WHEN any_value(n) >= 4 THEN sum(CASE WHEN q <= 4 THEN eps END) END
 AS ttm, CASE WHEN any_value(n) >= 8 AND max(CASE WHEN q = 1 THEN knowledge_time END) > as_of - INTERVAL 90 DAY
 AND stddev_samp(CASE WHEN q > 1 THEN diff END) > 0 THEN max(CASE WHEN q = 1 THEN diff END) /
 stddev_samp(CASE WHEN q > 1 THEN diff END) END AS sue FROM quarters GROUP BY 1, 2""")


@query(["fund", "feat"], """SELECT f.as_of, f.entity_id, round(ttm / ff, 6) + 0.0 AS earnings_yield, round(sue, 6) + 0.0
 AS earnings_surprise FROM fund f LEFT JOIN feat p ON p.as_of = f.as_of AND p.entity_id = f.entity_id""")
def earnings_features(spark, sf):
    s = Setup(spark, sf)
    prices = s.at.select("as_of", "entity_id", F.col("ff").alias("price"))
    out = ft.earnings_features(ad.earnings(spark, sf), s.slots, prices)
    return out.select("as_of", "entity_id", r("earnings_yield").alias("earnings_yield"),
                      r("earnings_surprise").alias("earnings_surprise"))


cte("regime", ["macro", "sched"], """SELECT as_of, round(l - s, 6) + 0.0 AS yield_curve_slope, l - s IS NULL OR l - s > 0
 AS risk_on, n AS n_series FROM (SELECT as_of, max(CASE WHEN entity_id = 'DGS10' THEN value END) AS l,
 max(CASE WHEN entity_id = 'DGS2' THEN value END) AS s, count(value) AS n FROM sched LEFT JOIN (SELECT as_of,
 entity_id, arg_max(value, knowledge_time) AS value FROM sched JOIN macro ON knowledge_time <= as_of GROUP BY 1, 2)
 USING (as_of) GROUP BY 1)""")


@query("regime", "SELECT * FROM regime")
def macro_regime(spark, sf):
    out = ft.macro_regime(ad.macro_series(spark, sf), weekly_slots(spark, sf))
    return out.select("as_of", r("yield_curve_slope").alias("yield_curve_slope"), "risk_on",
                      F.col("n_series").cast("long").alias("n_series"))


@query("members", """SELECT as_of, count(*) AS n_members FROM members JOIN (SELECT unnest([TIMESTAMP '1996-03-01',
 TIMESTAMP '1998-03-01', TIMESTAMP '2000-03-01', TIMESTAMP '2001-07-01']) AS as_of) ON added <= as_of::DATE
 AND (removed IS NULL OR as_of::DATE < removed) GROUP BY 1""")
def membership(spark, sf):
    dates = spark.createDataFrame(
        [("1996-03-01",), ("1998-03-01",), ("2000-03-01",), ("2001-07-01",)], "d string"
    ).select(F.col("d").cast("timestamp").alias("as_of"))
    found = un.members_at(materialize(ad.members(spark, sf)), dates)
    return found.groupBy("as_of").agg(F.count(F.lit(1)).alias("n_members"))


@query("members", "SELECT symbol FROM members WHERE removed IS NOT NULL")
def delisted_members(spark, sf):
    return un.delisted(ad.members(spark, sf))


@query("sbars", """SELECT symbol, round(adv, 4) + 0.0 AS adv FROM (SELECT entity_id AS symbol, avg(close * volume) AS adv
 FROM sbars WHERE event_time >= TIMESTAMP '2000-01-01' GROUP BY 1 HAVING count(*) >= 15 AND
 max_by(close, event_time) >= 5 AND avg(close * volume) BETWEEN 2000 AND 200000) WHERE symbol NOT IN ('S1', 'S2')
 ORDER BY adv DESC, symbol LIMIT 50""")
def liquidity_screen(spark, sf):
    recent = ad.supplier_bars(spark, sf).where(F.col("event_time") >= "2000-01-01")
    exclude = spark.createDataFrame([("s1",), ("S2",)], "symbol string")
    out = un.liquidity_screen(
        recent.withColumnRenamed("entity_id", "symbol"), exclude, min_dollar_volume=2e3,
        max_dollar_volume=2e5, top_n=50,
    )
    return out.select("symbol", r("adv", 4).alias("adv"))


@query(["disc"], """SELECT entity_id, dataset, observation_id FROM disc QUALIFY row_number() OVER (PARTITION BY dataset
 ORDER BY knowledge_time DESC, event_time DESC, source DESC, entity_id DESC, revision DESC, observation_id DESC) <= 25""")
def recent_filings(spark, sf):
    return un.recent_rows(ad.disclosures(spark, sf), 25).select(
        "entity_id", "dataset", "observation_id"
    )


# --- signal measurement ------------------------------------------------------------------------

cte("icm", ["featall"], """SELECT event_time AS as_of, entity_id, mom_60, meanrev_5, vol_20,
 CASE WHEN n_dates - 1 - t >= 5 THEN coalesce(lead(ff, 5) OVER (PARTITION BY entity_id ORDER BY t) / coalesce(ff,
 first_value(ff IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 - 1, 0) END AS fwd, t FROM featall""")
cte("iclong", ["icm"], """SELECT as_of, signal, x, fwd, rf, n_common FROM (SELECT as_of, fwd, mom_60, meanrev_5, vol_20,
 rank() OVER (PARTITION BY as_of ORDER BY fwd) + (count(*) OVER (PARTITION BY as_of, fwd) - 1) / 2.0 AS rf,
 count(*) OVER (PARTITION BY as_of) AS n_common FROM icm WHERE fwd IS NOT NULL AND t >= 60 AND (t - 60) % 5 = 0)
 UNPIVOT (x FOR signal IN (mom_60, meanrev_5, vol_20))""")
cte("ics", ["iclong"], """SELECT signal, as_of, corr(rx, rf) AS ic, any_value(n_common) AS n_common FROM (SELECT *,
 rank() OVER (PARTITION BY as_of, signal ORDER BY x) + (count(*) OVER (PARTITION BY as_of, signal, x) - 1) / 2.0 AS rx
 FROM iclong) GROUP BY 1, 2 HAVING count(*) >= 5 AND any_value(n_common) >= 5 AND stddev_samp(x) > 0""")
cte("icsum", ["ics"], """SELECT signal, count(*) AS n_dates, sum(n_common)::BIGINT AS n_obs, avg(ic) AS mean_ic,
 stddev_samp(ic) AS ic_std, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_stat,
 avg((ic > 0)::INT::DOUBLE) AS hit_rate FROM ics GROUP BY 1""")
IC_NAMES = ["mom_60", "meanrev_5", "vol_20"]


def _ics(spark, sf):
    def build():
        panel = pn.with_forward_returns(ft.price_features(supplier_panel(spark, sf), IC_NAMES), 5)
        schedule = sample_dates(bars(spark, sf).select("event_time"), warmup=60, every=5)
        return materialize(si.date_ics(st.at_decisions(panel, schedule), IC_NAMES))

    return shared(spark, sf, "date_ics", build)


@query("ics", "SELECT signal, as_of, round(ic, 6) + 0.0 AS ic, n_common FROM ics")
def date_ics(spark, sf):
    return _ics(spark, sf).withColumn("ic", r("ic"))


@query("icsum", """SELECT signal, n_dates, n_obs, round(mean_ic, 6) + 0.0 AS mean_ic, round(ic_std, 6) + 0.0 AS ic_std,
 round(t_stat, 5) + 0.0 AS t_stat, round(hit_rate, 6) + 0.0 AS hit_rate FROM icsum""")
def signal_ic(spark, sf):
    out = si.summarize_ics(_ics(spark, sf))
    return out.select("signal", "n_dates", "n_obs", r("mean_ic").alias("mean_ic"),
                      r("ic_std").alias("ic_std"), r("t_stat", 5).alias("t_stat"),
                      r("hit_rate").alias("hit_rate"))


# The two-sided p-value under the normal distribution, by the series of the error function. The bar of
# |t| for 3 trials at 5% is 2.3939797998185104.
cte("icp", ["icsum"], """SELECT *, CASE WHEN abs(t_stat) > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum([CASE WHEN n % 2 = 0 THEN 1 ELSE -1
 END * pow(abs(t_stat) / sqrt(2), 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)) FOR n IN range(0, 90)]) END AS p_value FROM icsum""")
cte("icfam", ["icp"], """SELECT *, abs(t_stat) >= 2.3939797998185104 AS bonferroni, rk <= coalesce(max(CASE WHEN p_value <= rk / m * 0.05
 THEN rk END) OVER (), 0) AS fdr FROM (SELECT *, row_number() OVER (ORDER BY p_value, signal) AS rk, count(*) OVER () AS m FROM icp)""")
VERDICT = """CASE WHEN bonferroni THEN '[PASS family-wise (Bonferroni+FDR)]' WHEN fdr THEN '[pass FDR only]' WHEN abs(t_stat) >= 2 THEN
 '[raw |t|>=2 ONLY — fails correction]' ELSE '[n.s.]' END"""


@query("icfam", f"""SELECT signal, round(t_stat, 5) + 0.0 AS t_stat, round(p_value, 6) + 0.0 AS p_value, bonferroni, fdr,
 {VERDICT} AS verdict FROM icfam""")
def family_correction(spark, sf):
    out = si.correct_family(si.summarize_ics(_ics(spark, sf)))
    return out.select("signal", r("t_stat", 5).alias("t_stat"), r("p_value").alias("p_value"), "bonferroni",
                      "fdr", "verdict")


@query("icfam", f"""SELECT signal, n_dates, n_obs, round(mean_ic, 6) + 0.0 AS mean_ic, round(ic_std, 6) + 0.0 AS ic_std, round(hit_rate, 6) + 0.0
 AS hit_rate, round(t_stat, 5) + 0.0 AS t_stat, round(p_value, 6) + 0.0 AS p_value, bonferroni, fdr, 2.39398 AS bonferroni_t,
 {VERDICT} AS verdict FROM icfam""")
def signal_report(spark, sf):
    """Everything measured of each signal, with the verdict after correction for the family."""
    out = si.correct_family(si.summarize_ics(_ics(spark, sf)))
    return out.withColumns(
        {c: r(c) for c in ("mean_ic", "ic_std", "hit_rate", "p_value")} | {c: r(c, 5) for c in ("t_stat", "bonferroni_t")}
    )


@query(["ics", "scal"], """SELECT attempt, signal, n_dates, round(mean_ic, 6) + 0.0 AS mean_ic, round(t, 5) + 0.0 AS t_stat, abs(t) >= 2 AS passed,
 attempt = 2 OR (attempt = 3 AND signal <> 'vol_20') AS is_repeat FROM (SELECT signal, count(*) AS n_dates, avg(ic) AS mean_ic, avg(ic) /
 (stddev_samp(ic) / sqrt(count(*))) AS t FROM ics WHERE as_of >= (SELECT event_time FROM scal WHERE t = least(floor(n_dates * 0.8),
 n_dates - 1)) GROUP BY 1) CROSS JOIN (SELECT unnest([1, 2, 3]) AS attempt) WHERE attempt = 3 OR signal <> 'vol_20'""")
def sealed_holdout(spark, sf):
    """Three callers: two ask for the same signals, the third for one more. Each is measured once."""
    start = si.holdout_start(bars(spark, sf).select("event_time"), 0.2).first()["holdout_start"]
    sealed = _ics(spark, sf).where(F.col("as_of") >= F.lit(start))
    ledger = lg.SealedLooks(spark, scratch_path(spark))

    def measure(signals):
        found = si.summarize_ics(sealed.where(F.col("signal").isin(signals)))
        return found.select("signal", "n_dates", "mean_ic", "t_stat", (F.abs("t_stat") >= 2).alias("passed"))

    every = sorted(IC_NAMES)
    asked = [(1, every[:2]), (2, every[:2]), (3, every)]
    looks = [ledger.look(names, measure, dt.datetime(2024, 1, n)).withColumn("attempt", F.lit(n)) for n, names in asked]
    out = looks[0].unionByName(looks[1]).unionByName(looks[2])
    return out.select("attempt", "signal", "n_dates", r("mean_ic").alias("mean_ic"), r("t_stat", 5).alias("t_stat"),
                      "passed", "is_repeat")


@query("scal", """SELECT event_time AS holdout_start FROM scal WHERE t = least(floor(n_dates * 0.8), n_dates - 1)""")
def holdout_start(spark, sf):
    return si.holdout_start(bars(spark, sf).select("event_time"), 0.2)


@query("sched", """SELECT as_of, k < floor(count(*) OVER () * 0.6) AS is_train FROM sched""")
def time_split(spark, sf):
    return si.time_split(weekly_schedule(spark, sf), 0.6).select("as_of", "is_train")


# --- events ------------------------------------------------------------------------------------

cte("clusters", ["discv", "sched"], """SELECT as_of, entity_id, max(event_time) AS event_time, max(knowledge_time)
 AS knowledge_time, count(*) AS n_buys FROM sched JOIN discv ON knowledge_time <= as_of AND knowledge_time > as_of -
 INTERVAL 30 DAY AND (known_until IS NULL OR known_until > as_of) WHERE is_purchase GROUP BY 1, 2
 HAVING count(*) >= 3""")
cte("leads", ["discv", "sched"], """SELECT as_of, entity_id, event_time, knowledge_time, transaction_type FROM sched
 JOIN discv ON knowledge_time <= as_of AND (known_until IS NULL OR known_until > as_of) WHERE high_signal_role""")
cte("anchors", ["clusters", "leads"], """SELECT 'insider_cluster_buy' AS event_type, entity_id, knowledge_time AS anchor,
 min(as_of) AS as_of FROM clusters GROUP BY 1, 2, 3 UNION ALL SELECT 'leadership_congress_trade', entity_id,
 knowledge_time, min(as_of) FROM leads GROUP BY 1, 2, 3""")


@query("clusters", "SELECT as_of, entity_id, event_time, knowledge_time, n_buys FROM clusters")
def event_clusters(spark, sf):
    out = ev.insider_clusters(filings(spark, sf), weekly_slots(spark, sf))
    return out.select("as_of", "entity_id", "event_time", "knowledge_time", "n_buys")


@query(["clusters", "leads"], """SELECT as_of, event_type, count(*) AS n FROM (SELECT as_of, 'insider_cluster_buy'
 AS event_type FROM clusters UNION ALL SELECT as_of, 'leadership_congress_trade' FROM leads) GROUP BY 1, 2""")
def detect_events(spark, sf):
    events = ev.event_counts(filings(spark, sf), office_trades(spark, sf), weekly_slots(spark, sf))
    return events.groupBy("as_of", "event_type").agg(F.sum("n").alias("n"))


@query(["clusters", "leads"], """SELECT as_of, count(*) AS n_entities, sum(n)::BIGINT AS n_events, count_if(types = 2)::BIGINT AS n_both FROM
 (SELECT as_of, entity_id, count(*) AS n, count(DISTINCT event_type) AS types FROM (SELECT as_of, entity_id, 'c' AS event_type FROM clusters
 UNION ALL SELECT as_of, entity_id, 'l' FROM leads) GROUP BY 1, 2) GROUP BY 1""")
def event_entities(spark, sf):
    """How many different names have events at each scan, and how many have both kinds."""
    seen = ev.event_entities(filings(spark, sf), office_trades(spark, sf), weekly_slots(spark, sf))
    return seen.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n_entities"), F.sum("n_events").alias("n_events"),
        F.count(F.when(F.size("event_types") == 2, 1)).alias("n_both"),
    )


@query(["clusters", "leads"], """SELECT level, message, count(*) AS n FROM (SELECT 'high' AS level, n_buys ||
 ' insiders bought ' || entity_id AS message FROM clusters UNION ALL SELECT 'medium', 'leadership ' || transaction_type
 || ' in ' || entity_id FROM leads) GROUP BY 1, 2""")
def alerts(spark, sf):
    events = ev.event_counts(filings(spark, sf), office_trades(spark, sf), weekly_slots(spark, sf))
    return ev.alerts(events).groupBy("level", "message").agg(F.sum("n").alias("n"))


def _anchors(spark, sf, slots):
    return ev.anchors(filings(spark, sf), office_trades(spark, sf), slots)


@query("anchors", "SELECT event_type, entity_id, anchor, as_of FROM anchors")
def event_anchors(spark, sf):
    return _anchors(spark, sf, weekly_slots(spark, sf)).select(
        "event_type", "entity_id", "anchor", "as_of"
    )


@query(["news", "days"], """SELECT as_of, entity_id, CAST(sign(tone) AS INTEGER) AS direction, round(surge, 4) + 0.0 AS
 surge, round(tone, 4) + 0.0 AS tone, story_hash, n_recent, round(0.5 * least(1, surge / 4.4) + 0.5 * least(1,
 abs(tone) / 3.4), 4) + 0.0 AS confidence FROM (SELECT as_of, entity_id, n_recent, coalesce(tone, 0) AS tone, substr(sha1(story), 1, 16)
 AS story_hash, n_recent / greatest((n - n_recent) / 13.0, 0.5) AS surge FROM (SELECT as_of, entity_id, count(*) AS n,
 count_if(event_time >= as_of - INTERVAL 1 DAY)::BIGINT AS n_recent, avg(CASE WHEN event_time >= as_of - INTERVAL 1 DAY
 THEN tone END) AS tone, arg_max(coalesce(nullif(url, ''), nullif(title, ''), ''), (event_time, observation_id)) FILTER
 (event_time >= as_of - INTERVAL 1 DAY) AS story FROM days JOIN news ON knowledge_time <= as_of
 AND event_time >= as_of - INTERVAL 14 DAY GROUP BY 1, 2) WHERE n_recent >= 3) WHERE surge >= 2.2""")
def news_surges(spark, sf):
    out = ev.news_surges(ad.news(spark, sf), daily_slots(spark, sf), 2.2, 1.7)
    return out.withColumns({c: r(c, 4) for c in ("surge", "tone", "confidence")})


# --- studies -----------------------------------------------------------------------------------

cte("mkt", ["spanel"], """SELECT event_time, avg(ret) AS m FROM spanel WHERE t > 0 AND ret IS NOT NULL GROUP BY 1""")
cte("cars", ["mkt", "spanel"], """SELECT entity_id, t, s - k * alpha - beta * ms AS car, alpha, beta FROM (SELECT entity_id, t,
 row_number() OVER p - 1 AS pos, regr_intercept(ret, m) OVER f AS alpha, regr_slope(ret, m) OVER f AS beta,
 sum(ret) OVER w AS s, sum(m) OVER w AS ms, count(*) OVER w AS k FROM (SELECT p.*, m FROM spanel p JOIN mkt
 USING (event_time) WHERE t > 0 AND ret IS NOT NULL) WINDOW p AS (PARTITION BY entity_id ORDER BY t),
 f AS (PARTITION BY entity_id ORDER BY t ROWS BETWEEN 65 PRECEDING AND 6 PRECEDING),
 w AS (PARTITION BY entity_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) WHERE pos >= 65 AND k = 6""")
cte("anchored", ["anchors", "cars", "scal"], """SELECT event_type, a.entity_id, anchor, car FROM (SELECT *, (SELECT max(t)
 FROM scal WHERE event_time <= anchor) AS t FROM anchors) a JOIN cars c ON c.entity_id = a.entity_id AND c.t = a.t""")
cte("dist", ["anchored"], """SELECT event_type, count(*) AS n, avg(car) AS mean_car, stddev_samp(car) AS std_car,
 avg((car > 0)::INT::DOUBLE) AS share_positive, quantile_cont(car, 0.1) AS q10, quantile_cont(car, 0.5) AS q50,
 quantile_cont(car, 0.9) AS q90 FROM anchored GROUP BY 1""")


@query("cars", """SELECT entity_id, t, round(alpha, 6) + 0.0 AS alpha, round(beta, 6) + 0.0 AS beta, round(car, 6) + 0.0
 AS car FROM cars""")
def market_model(spark, sf):
    out = sd.abnormal_returns(supplier_panel(spark, sf))
    return out.select("entity_id", "t", *[r(c).alias(c) for c in ("alpha", "beta", "car")])


def _study(spark, sf, n_permutations=0):
    def inputs():
        dates = Slots(make_schedule(bars(spark, sf).select("event_time")))
        anchors = materialize(_anchors(spark, sf, weekly_slots(spark, sf)))
        return anchors, materialize(sd.abnormal_returns(Setup(spark, sf).panel)), dates

    anchors, cars, dates = shared(spark, sf, "study_inputs", inputs)
    return shared(
        spark, sf, f"study_{n_permutations}",
        lambda: sd.measure(anchors, cars, dates, n_permutations),
    )


@query("dist", """SELECT event_type, n, round(mean_car, 6) + 0.0 AS mean_car, round(std_car, 6) + 0.0 AS std_car,
 round(mean_car / (std_car / sqrt(n)), 5) + 0.0 AS t_stat, round(share_positive, 6) + 0.0 AS share_positive,
 round(q10, 6) + 0.0 AS q10, round(q50, 6) + 0.0 AS q50, round(q90, 6) + 0.0 AS q90 FROM dist""")
def car_distribution(spark, sf):
    out, _ = _study(spark, sf)
    cols = ["mean_car", "std_car", "share_positive", "q10", "q50", "q90"]
    return out.select("event_type", "n", r("t_stat", 5).alias("t_stat"), *[r(c).alias(c) for c in cols])


PLACEBO_MEANS = """SELECT a.event_type, perm, avg(car) AS m FROM (SELECT event_type, entity_id, perm, lo + 1 +
 CAST('0x' || substr(md5('0|' || perm || '|' || entity_id || '|' || strftime(anchor, '%Y-%m-%d %H:%M:%S')), 1, 8)
 AS BIGINT) % (hi - lo + 1) AS t FROM anchors CROSS JOIN (SELECT unnest(range(1, {n} + 1)) AS perm) CROSS JOIN
 (SELECT 65 AS lo, max(t) - 6 AS hi FROM scal)) a JOIN cars c ON c.entity_id = a.entity_id AND c.t = a.t GROUP BY 1, 2"""


@query(["dist"], f"""SELECT event_type, d.n AS n_events, count(*) AS n_permutations, round(any_value(mean_car), 6) + 0.0
 AS observed_mean_car, round(avg(m), 6) + 0.0 AS placebo_mean, round(stddev_samp(m), 6) + 0.0 AS placebo_std,
 round((1 + count_if(m >= mean_car)) / (1 + count(*)), 6) + 0.0 AS p_value FROM dist d JOIN ({PLACEBO_MEANS.format(n=200)}) p
 USING (event_type) GROUP BY 1, 2""")
def placebo(spark, sf):
    _, out = _study(spark, sf, 200)
    cols = ["observed_mean_car", "placebo_mean", "placebo_std", "p_value"]
    return out.select("event_type", "n_events", "n_permutations", *[r(c).alias(c) for c in cols])


@query("clusters", """SELECT as_of, entity_id, knowledge_time, as_of + INTERVAL 5 DAY AS exit_by, n_buys FROM clusters
 WHERE floor(epoch(as_of - knowledge_time) / 86400) <= 5 QUALIFY row_number() OVER (PARTITION BY as_of
 ORDER BY knowledge_time DESC, entity_id) <= 5""")
def cluster_entries(spark, sf):
    """Entries if the cluster type had passed the gate."""
    gate = spark.createDataFrame([(ev.CLUSTER, 0.01)], "event_type string, mean_car double")
    clusters = ev.insider_clusters(filings(spark, sf), weekly_slots(spark, sf))
    out = ev.cluster_entries(clusters, gate)
    return out.select("as_of", "entity_id", "knowledge_time", "exit_by", "n_buys")


@query(["dist"], f"""SELECT event_type, round(p, 6) + 0.0 AS p_value, n > 1 AND mean_car > 0 AND p <= 0.05 AS passed FROM
 (SELECT event_type, any_value(d.n) AS n, any_value(mean_car) AS mean_car, (1 + count_if(m >= mean_car)) / (1 + count(*))
 AS p FROM dist d JOIN ({PLACEBO_MEANS.format(n=100)}) p USING (event_type) GROUP BY 1)""")
def gate_types(spark, sf):
    """Every event type with its p-value and whether the gate lets it through."""
    _, nulls = _study(spark, sf, 100)
    passed = sd.gate(nulls).select("event_type", F.lit(True).alias("_passed"))
    return nulls.join(passed, "event_type", "left").select(
        "event_type", r("p_value").alias("p_value"),
        F.coalesce("_passed", F.lit(False)).alias("passed"),
    )


@query(["clusters", "dist"], f"""SELECT as_of, entity_id, knowledge_time, as_of + INTERVAL 5 DAY AS exit_by FROM clusters
 WHERE floor(epoch(as_of - knowledge_time) / 86400) <= 5 AND 'insider_cluster_buy' IN (SELECT event_type FROM (SELECT
 event_type, any_value(d.n) AS n, any_value(mean_car) AS mean_car, (1 + count_if(m >= mean_car)) / (1 + count(*)) AS p
 FROM dist d JOIN ({PLACEBO_MEANS.format(n=100)}) p USING (event_type) GROUP BY 1) WHERE n > 1 AND mean_car > 0 AND
 p <= 0.05) QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY knowledge_time DESC, entity_id) <= 5""")
def gated_entries(spark, sf):
    """Entries of the cluster type if it passes the gate on these data."""
    _, nulls = _study(spark, sf, 100)
    clusters = ev.insider_clusters(filings(spark, sf), weekly_slots(spark, sf))
    out = ev.cluster_entries(clusters, sd.gate(nulls))
    return out.select("as_of", "entity_id", "knowledge_time", "exit_by")


# --- analogs -----------------------------------------------------------------------------------

cte("epi", [], """SELECT 'v' || vec_id AS key, embedding::DOUBLE[] AS vector, (vec_id * 37 % 101 - 50) / 1000.0::DOUBLE
 AS outcome, 'r' || label AS regime FROM embeddings""")
cte("centre", ["epi"], """SELECT regime AS query, list(m ORDER BY i) AS vector FROM (SELECT regime, i, avg(v) AS m FROM
 (SELECT regime, unnest(vector) AS v, generate_subscripts(vector, 1) AS i FROM epi) GROUP BY 1, 2) GROUP BY 1""")
cte("knn", ["epi", "centre"], """SELECT * FROM (SELECT query, key, outcome, list_distance(e.vector, c.vector) AS distance,
 row_number() OVER (PARTITION BY query ORDER BY list_distance(e.vector, c.vector), key) AS rank FROM centre c
 JOIN epi e ON e.regime = c.query) WHERE rank <= 12""")


def _centres(spark, sf):
    """One query per regime: the mean vector of its episodes."""
    each = ad.episodes(spark, sf).select("regime", F.posexplode("vector").alias("i", "v"))
    means = each.groupBy("regime", "i").agg(F.avg("v").alias("m"))
    listed = means.groupBy("regime").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))
    return listed.select(
        F.col("regime").alias("query"), F.transform("s", lambda p: p["m"]).alias("vector"), "regime"
    )


@query("knn", "SELECT query, key, rank, round(distance, 6) + 0.0 AS distance FROM knn")
def nearest_episodes(spark, sf):
    found = an.nearest(ad.episodes(spark, sf), _centres(spark, sf), 12, match=["regime"])
    return found.select("query", "key", "rank", r("distance").alias("distance"))


@query("knn", """SELECT query, count(*) AS n, round(avg(outcome), 6) + 0.0 AS mean, round(quantile_cont(outcome, 0.5), 6)
 + 0.0 AS median, round(quantile_cont(outcome, 0.1), 6) + 0.0 AS q10, round(quantile_cont(outcome, 0.9), 6) + 0.0 AS q90,
 round(avg((outcome > 0)::INT::DOUBLE), 6) + 0.0 AS share_positive FROM knn GROUP BY 1""")
def knn_outcomes(spark, sf):
    found = an.nearest(ad.episodes(spark, sf), _centres(spark, sf), 12, match=["regime"])
    out = an.outcomes(found)
    return out.select("query", "n", *[r(c).alias(c) for c in ("mean", "median", "q10", "q90", "share_positive")])


# --- text and row-level ------------------------------------------------------------------------

@query(None, """SELECT event_id, round(greatest(-1, least(1, k / 50 - 1)), 6) + 0.0 AS score,
 round(CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE greatest(0, least(1, value / 100)) END, 6) + 0.0 AS confidence FROM
 (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1.1 AS k FROM events) WHERE event_id % 7 <> 0""")
def parse_replies(spark, sf):
    """Model replies with prose, fences, missing fields and broken JSON around the signal."""
    k = F.get_json_object("props", "$.k").cast("double") * 1.1
    confidence = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit(', "confidence": '), (F.col("value") / 100).cast("string"))
    )
    body = F.concat(F.lit('{"score": '), (k / 50 - 1).cast("string"), confidence,
                    F.lit(', "rationale": "r"}'))
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("no json { here "), F.col("props"), F.lit(" x")))
    text = text.otherwise(F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n``` done")))
    parsed = ad.table(spark, sf, "events").select("event_id", fs.parse_signal(text).alias("s"))
    return parsed.where(F.col("s").isNotNull()).select(
        "event_id", r("s.score").alias("score"), r("s.confidence").alias("confidence")
    )


@query(None, """SELECT o_orderkey, round(o_totalprice - 150000, 4) + 0.0 AS surprise, round((o_totalprice - 150000) /
 nullif(c_acctbal, 0), 6) + 0.0 AS standardized, CAST(sign(o_totalprice - 150000) AS INTEGER) AS direction FROM orders
 JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""")
def surprise(spark, sf):
    rows = ad.table(spark, sf, "orders").join(
        ad.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).where(F.col("c_acctbal") > 0)
    out = rows.select(
        "o_orderkey", fs.surprise("o_totalprice", F.lit(150000.0), F.col("c_acctbal")).alias("s")
    )
    return out.select("o_orderkey", r("s.surprise", 4).alias("surprise"),
                      r("s.standardized").alias("standardized"), "s.direction")
