"""Queries over predictions, forecasts, orders, ledgers and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitline.functions import crosssection as cs
from pitline.operators import analogs as an
from pitline.operators import features as ft
from pitline.operators import forecast as fc
from pitline.operators import grading as gr
from pitline.operators import orders as od
from pitline.operators import panel as pn
from pitline.operators import recall as rc
from pitline.operators import returns as rt
from pitline.operators import scoring as sc
from pitline.operators import strategies as st
from pitline.plans import jobs
from pitline.plans.books import Setup
from pitline.plans.measures import IC_NAMES
from pitline.plans.oracle import NAMES, cte
from pitline.plans.reads import bars, filings, office_trades, weekly_slots
from pitline.plans.registry import query, r, shared
from pitline.session import materialize
from pitline.sources import adapters as ad

cte("preds", ["score", "matrix"], """SELECT s.as_of, s.entity_id, (rank() OVER (PARTITION BY s.as_of ORDER BY s.score) +
 (count(*) OVER (PARTITION BY s.as_of, s.score) - 1) / 2.0) / count(*) OVER (PARTITION BY s.as_of) AS probability,
 m.mom_60, m.meanrev_5, m.vol_20, m.insider_net_buys_90d FROM score s JOIN matrix m ON m.as_of = s.as_of AND
 m.entity_id = s.entity_id""")
cte("graded", ["preds", "icm"], """SELECT p.*, fwd AS ret, (fwd > 0)::INT::DOUBLE AS outcome FROM preds p JOIN icm i
 ON i.as_of = p.as_of AND i.entity_id = p.entity_id WHERE fwd IS NOT NULL""")


def _predictions(s: Setup):
    build = lambda: materialize(gr.predictions(s.score(), s.matrix(), NAMES, "composite"))
    return shared(s.spark, s.sf, "predictions", build)


def _graded(spark, sf):
    s = Setup(spark, sf)
    fwd = pn.with_forward_returns(s.panel, 5).withColumnRenamed("event_time", "as_of")
    graded = shared(
        spark, sf, "graded", lambda: materialize(gr.matured(_predictions(s), fwd))
    )
    return graded, s


@query("preds", """SELECT as_of, entity_id, round(probability, 6) + 0.0 AS probability, round(mom_60, 6) + 0.0 AS mom_60,
 (mom_60 IS NOT NULL)::INT + (meanrev_5 IS NOT NULL)::INT + (vol_20 IS NOT NULL)::INT + 1 AS n_features FROM preds""")
def log_predictions(spark, sf):
    out = _predictions(Setup(spark, sf))
    return out.select("as_of", "entity_id", r("probability").alias("probability"),
                      r(F.try_element_at("features", F.lit("mom_60"))).alias("mom_60"),
                      F.size("features").alias("n_features"))


@query("graded", """SELECT count(*) AS n, round(avg((probability - outcome) * (probability - outcome)), 6) + 0.0 AS brier,
 round(avg(((probability > 0.5) = (outcome = 1))::INT::DOUBLE), 6) + 0.0 AS hit_rate FROM graded""")
def grade_predictions(spark, sf):
    graded, _ = _graded(spark, sf)
    return gr.score(graded).select("n", r("brier").alias("brier"), r("hit_rate").alias("hit_rate"))


@query("graded", """SELECT signal, round(ic, 6) + 0.0 AS ic, abs(ic) >= 0.02 AS kept FROM (SELECT signal, corr(x, ret) AS ic
 FROM graded UNPIVOT (x FOR signal IN (mom_60, meanrev_5, vol_20, insider_net_buys_90d)) GROUP BY 1
 HAVING stddev_samp(x) > 0)""")
def pooled_ic(spark, sf):
    graded, _ = _graded(spark, sf)
    return gr.prune(gr.pooled_ic(graded)).select("signal", r("ic").alias("ic"), "kept")


@query("graded", """SELECT bin, bin / 10 AS bin_lower, (bin + 1) / 10 AS bin_upper, round(mp, 6) + 0.0 AS mean_pred,
 round(fp, 6) + 0.0 AS frac_pos, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN (SELECT
 (probability >= 0.1)::INT + (probability >= 0.2)::INT + (probability >= 0.3)::INT + (probability >= 0.4)::INT +
 (probability >= 0.5)::INT + (probability >= 0.6)::INT + (probability >= 0.7)::INT + (probability >= 0.8)::INT +
 (probability >= 0.9)::INT AS bin, avg(probability) AS mp, avg(outcome) AS fp, count(*) AS n FROM graded GROUP BY 1)
 USING (bin)""")
def reliability_curve(spark, sf):
    graded, _ = _graded(spark, sf)
    return rt.reliability(graded).select("bin", "bin_lower", "bin_upper", r("mean_pred").alias("mean_pred"),
                                         r("frac_pos").alias("frac_pos"), "n")


@query(["graded", "regime"], """SELECT regime, count(*) AS n, round(avg((ret > 0)::INT::DOUBLE), 6) + 0.0 AS hit_rate,
 round(avg(ret), 6) + 0.0 AS mean_return FROM (SELECT g.*, CASE WHEN risk_on THEN 'risk_on' ELSE 'risk_off' END
 AS regime FROM graded g JOIN regime q ON q.as_of = g.as_of) GROUP BY ROLLUP (regime)""")
def attribution_rollup(spark, sf):
    graded, s = _graded(spark, sf)
    regimes = ft.macro_regime(ad.macro_series(spark, sf), s.slots)
    out = gr.attribution(gr.journal(graded, regimes))
    return out.select("regime", "n", r("hit_rate").alias("hit_rate"), r("mean_return").alias("mean_return"))


@query(["graded", "regime"], """SELECT regime, signal, round(corr(x, ret), 6) + 0.0 AS ic FROM (SELECT unnest(['all', CASE WHEN
 risk_on THEN 'risk_on' ELSE 'risk_off' END]) AS regime, g.* FROM graded g JOIN regime q ON q.as_of = g.as_of) UNPIVOT
 (x FOR signal IN (mom_60, meanrev_5, vol_20, insider_net_buys_90d)) GROUP BY 1, 2 HAVING stddev_samp(x) > 0""")
def attribution_ic(spark, sf):
    graded, s = _graded(spark, sf)
    regimes = ft.macro_regime(ad.macro_series(spark, sf), s.slots)
    return gr.attribution_ic(gr.journal(graded, regimes)).select("regime", "signal", r("ic").alias("ic"))


@query("graded", """SELECT round(hit, 6) + 0.0 AS hit_rate, round(hit - 0.7, 6) + 0.0 AS gap, abs(hit - 0.7) > 0.1 AS drifting
 FROM (SELECT avg(((probability > 0.5) = (outcome = 1))::INT::DOUBLE) AS hit FROM graded)""")
def drift_check(spark, sf):
    graded, _ = _graded(spark, sf)
    out = gr.drift(gr.score(graded), "hit_rate", 0.7, 0.1)
    return out.select(r("hit_rate").alias("hit_rate"), r("gap").alias("gap"), "drifting")


@query("graded", """SELECT side, entity_id, as_of, round(ret, 6) + 0.0 AS realized_return FROM (SELECT 'best' AS side, * FROM
 (SELECT * FROM graded ORDER BY ret DESC, entity_id, as_of LIMIT 5) UNION ALL SELECT 'worst', * FROM (SELECT * FROM graded
 ORDER BY ret, entity_id, as_of LIMIT 5))""")
def best_and_worst(spark, sf):
    graded, _ = _graded(spark, sf)
    out = gr.best_and_worst(graded)
    return out.select("side", "entity_id", "as_of", r("realized_return").alias("realized_return"))


# A prediction made at date t with a 5-bar horizon can be graded at the first rebalance at or after
# its fifth later bar.
@query(["graded", "sched", "scal"], """SELECT r.k, signal, count(*) AS n, round(corr(x, ret), 5) + 0.0 AS ic FROM sched r
 JOIN (SELECT g.*, s.t + 5 AS ready FROM graded g JOIN sched s ON s.as_of = g.as_of) UNPIVOT (x FOR signal IN
 (mom_60, meanrev_5, vol_20, insider_net_buys_90d)) u ON u.ready <= r.t GROUP BY 1, 2""")
def expanding_ic(spark, sf):
    graded, s = _graded(spark, sf)
    ready = jobs.grading_slots(s.panel, s.slots, 5)
    out = gr.expanding_ic(graded.join(ready, "as_of"), "matured_k", s.slots.schedule)
    return out.where(F.col("n") > 0).select(F.col("k").cast("long"), "signal", "n", r("ic", 5).alias("ic"))


# Every signal at every rebalance: what had been measured of it, and its weight.
cte("xic", ["graded", "sched"], """SELECT r.k, signal, corr(x, ret) AS ic FROM sched r JOIN (SELECT g.*, s.t + 5 AS ready FROM
 graded g JOIN sched s ON s.as_of = g.as_of) UNPIVOT (x FOR signal IN (mom_60, meanrev_5, vol_20, insider_net_buys_90d)) u
 ON u.ready <= r.t GROUP BY 1, 2""")
cte("evid", ["xic", "sched"], """SELECT s.k, s.as_of, n.signal, ic, CASE WHEN ic IS NULL OR isnan(ic) THEN 'cold' WHEN abs(ic) >= 0.05 THEN
 'measured' ELSE 'pruned' END AS state FROM sched s CROSS JOIN (SELECT unnest(['mom_60', 'meanrev_5', 'vol_20',
 'insider_net_buys_90d']) AS signal) n LEFT JOIN xic x ON x.k = s.k AND x.signal = n.signal""")
cte("wic", ["evid"], """SELECT k, as_of, signal, state, CASE WHEN tot = 0 THEN 0.25 ELSE greatest(-0.5, least(0.5, u / tot)) END AS weight FROM
 (SELECT *, sum(abs(u)) OVER (PARTITION BY k) AS tot FROM (SELECT *, CASE WHEN state = 'measured' THEN ic ELSE 0.0 END AS u FROM evid))""")


def _evidence(spark, sf):
    def build():
        graded, s = _graded(spark, sf)
        ready = jobs.grading_slots(s.panel, s.slots, 5)
        history = gr.expanding_ic(graded.join(ready, "as_of"), "matured_k", s.slots.schedule)
        return materialize(sc.evidence(history.where("n > 0"), NAMES, s.slots.schedule, 0.05))

    return shared(spark, sf, "evidence", build)


@query("wic", "SELECT k, signal, state, round(weight, 5) + 0.0 AS weight FROM wic")
def scorer_weights(spark, sf):
    """The weights of the scorer at each rebalance: even while cold, then by what was measured."""
    states = _evidence(spark, sf)
    out = sc.scorer_weights(states).join(states.select("k", "signal", "state"), ["k", "signal"])
    return out.select(F.col("k").cast("long").alias("k"), "signal", "state", r("weight", 5).alias("weight"))


@query(["evid", "scal"], """SELECT c.event_time AS day, signal, state FROM (SELECT event_time, (SELECT max(k) FROM sched WHERE as_of <= event_time)
 AS k FROM scal) c JOIN evid USING (k)""")
def scorer_states(spark, sf):
    """What each signal counted as on every day, by validity intervals of its state."""
    s = Setup(spark, sf)
    intervals = materialize(sc.evidence_intervals(_evidence(spark, sf)))
    days = s.panel.select(F.col("event_time").alias("day")).distinct()
    return sc.evidence_at(intervals, s.slots, days, "day").select("day", "signal", "state")


@query(["wic", "zm"], """SELECT z.as_of, z.entity_id, round((coalesce(z_mom_60, 0) * a + coalesce(z_meanrev_5, 0) * b + coalesce(z_vol_20, 0)
 * c + coalesce(z_insider_net_buys_90d, 0) * d) / nullif(abs(a) + abs(b) + abs(c) + abs(d), 0), 5) + 0.0 AS score FROM zm z JOIN (SELECT
 as_of, max(weight) FILTER (signal = 'mom_60') AS a, max(weight) FILTER (signal = 'meanrev_5') AS b, max(weight) FILTER (signal =
 'vol_20') AS c, max(weight) FILTER (signal = 'insider_net_buys_90d') AS d FROM wic GROUP BY 1) w ON w.as_of = z.as_of""")
def learned_scores(spark, sf):
    """Scores of the replay: each decision time with the weights that were known by then."""
    s = Setup(spark, sf)
    weights = s.slots.with_as_of(sc.scorer_weights(_evidence(spark, sf)))
    out = sc.composite(s.matrix(), NAMES, materialize(weights.select("as_of", "signal", "weight")))
    return out.select("as_of", "entity_id", r("score", 5).alias("score"))


VIEWS_SQL = """SELECT date_trunc('day', ts)::TIMESTAMP AS as_of, 'U' || user_id AS entity_id, CASE WHEN event_type = 'error' THEN
 'risk' ELSE event_type END AS role, avg((CAST(round(value * 100) AS BIGINT) % 201 - 100)) / 100.0 AS score,
 avg(CAST(round(value * 100) AS BIGINT) % 101) / 100.0 AS confidence FROM events GROUP BY 1, 2, 3"""
cte("views", [], VIEWS_SQL)
cte("viewsum", ["views"], """SELECT *, role <> 'risk' AND confidence > 0 AS d FROM views""")


@query("viewsum", """SELECT as_of, entity_id, round(CASE WHEN n = 0 THEN 0 ELSE s END, 6) + 0.0 AS score, round(CASE WHEN n = 0
 THEN 0 ELSE greatest(0, least(1, w / n * greatest(0, least(1, 1 - dev / w / 2)) * CASE WHEN rc > 0 THEN 1 - rc * (1 -
 (1 - 0.5 * (1 - rs) / 2)) ELSE 1 END)) END, 6) + 0.0 AS confidence FROM (SELECT as_of, entity_id, any_value(w) AS w,
 any_value(n) AS n, any_value(s) AS s, max(rs) AS rs, max(rc) AS rc, sum(CASE WHEN d THEN abs(score - s) * confidence END)
 AS dev FROM (SELECT *, sum(CASE WHEN d THEN confidence END) OVER g AS w, count(CASE WHEN d THEN 1 END) OVER g AS n,
 sum(CASE WHEN d THEN score * confidence END) OVER g / sum(CASE WHEN d THEN confidence END) OVER g AS s,
 CASE WHEN role = 'risk' THEN score END AS rs, CASE WHEN role = 'risk' THEN confidence END AS rc FROM viewsum
 WINDOW g AS (PARTITION BY as_of, entity_id)) GROUP BY 1, 2)""")
def panel_synthesis(spark, sf):
    cents = ad.cents("value")
    views = (
        ad.table(spark, sf, "events")
        .groupBy(
            F.date_trunc("day", F.col("ts").cast("timestamp")).alias("as_of"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity_id"),
            F.when(F.col("event_type") == "error", "risk").otherwise(F.col("event_type")).alias("role"),
        )
        .agg(
            (F.avg(cents % 201 - 100) / 100.0).alias("score"),
            (F.avg(cents % 101) / 100.0).alias("confidence"),
        )
    )
    out = gr.panel_view(materialize(views))
    return out.select("as_of", "entity_id", r("score").alias("score"), r("confidence").alias("confidence"))


# --- forecasting -------------------------------------------------------------------------------

cte("train", ["icm", "featall", "sched", "regime"], """SELECT *, (fwd > med)::INT::DOUBLE AS label, as_of AS t0,
 as_of + INTERVAL 10 DAY AS t1 FROM (SELECT f.event_time AS as_of, f.entity_id, f.mom_60, f.meanrev_5, f.vol_20,
 q.risk_on::INT::DOUBLE AS regime_risk_on, fwd, quantile_cont(fwd, 0.5) OVER (PARTITION BY f.event_time) AS med,
 count(*) OVER (PARTITION BY f.event_time) AS n FROM (SELECT *, CASE WHEN n_dates - 1 - t >= 1 THEN coalesce(coalesce(lead(ff, 5) OVER
 (PARTITION BY entity_id ORDER BY t), CASE WHEN n_dates - 1 - t < 5 THEN last_value(ff) OVER (PARTITION BY entity_id
 ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END) / coalesce(ff, first_value(ff IGNORE NULLS) OVER
 (PARTITION BY entity_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - 1, 0) END AS fwd FROM featall) f
 JOIN regime q ON q.as_of = f.event_time WHERE fwd IS NOT NULL) WHERE n >= 2""")
cte("numbered", ["train"], """SELECT *, row_number() OVER (ORDER BY t0, entity_id) - 1 AS pos, count(*) OVER () AS ns FROM train""")


def _training(spark, sf):
    def build():
        s = Setup(spark, sf)
        fwd = pn.with_forward_returns(ft.price_features(s.panel, IC_NAMES), 5, partial=True)
        at = st.at_decisions(fwd, s.slots.schedule)
        regimes = ft.macro_regime(ad.macro_series(spark, sf), s.slots)
        rows = fc.training_set(at, regimes, 5)
        cols = ["as_of", "entity_id", *IC_NAMES, fc.REGIME, "fwd", "label", "t0", "t1"]
        return materialize(rows.select(*cols))

    return shared(spark, sf, "training", build)


@query("train", """SELECT as_of, entity_id, round(mom_60, 6) + 0.0 AS mom_60, regime_risk_on, label, t1 FROM train""")
def training_set(spark, sf):
    return _training(spark, sf).select("as_of", "entity_id", r("mom_60").alias("mom_60"), "regime_risk_on", "label", "t1")


@query("numbered", """SELECT fold, count_if(is_test)::BIGINT AS n_test, count_if(NOT is_test)::BIGINT AS n_train FROM (SELECT f.fold,
 n.fold = f.fold AS is_test FROM (SELECT *, ntile(5) OVER (ORDER BY pos) - 1 AS fold FROM numbered) n CROSS JOIN (SELECT fold,
 min(t0) AS a, max(t1) AS b, max(pos) AS last, round(any_value(ns) * 0.02) AS gap FROM (SELECT *, ntile(5) OVER
 (ORDER BY pos) - 1 AS fold FROM numbered) GROUP BY 1) f WHERE n.fold = f.fold OR (NOT (n.t1 >= a AND n.t0 <= b) AND NOT
 (n.pos > last AND n.pos <= last + gap))) GROUP BY 1""")
def purged_folds(spark, sf):
    folds = fc.purged_folds(fc.numbered(_training(spark, sf)), 5, 0.02)
    return folds.groupBy(F.col("fold").cast("long").alias("fold")).agg(
        F.count(F.when(F.col("is_test"), 1)).alias("n_test"),
        F.count(F.when(~F.col("is_test"), 1)).alias("n_train"),
    )


@query("scal", """SELECT fold, fold * 20 AS train_from, fold * 20 + 100 AS train_to, count(*) AS n_test FROM (SELECT
 unnest(range((max(n_dates)::BIGINT - 120) // 20 + 1)) AS fold FROM scal) JOIN scal ON t >= fold * 20 + 100 AND
 t < fold * 20 + 120 GROUP BY 1, 2, 3""")
def walk_forward_folds(spark, sf):
    from pitline.functions.timeline import calendar_of

    calendar = materialize(calendar_of(bars(spark, sf)))
    folds = fc.walk_forward(spark, calendar.count(), 100, 20)
    at = folds.withColumn("t", F.explode(F.sequence("test_from", F.col("test_to") - 1)))
    return at.join(calendar, "t").groupBy(
        F.col("fold").cast("long").alias("fold"), "train_from", "train_to"
    ).agg(F.count(F.lit(1)).alias("n_test"))


@query("numbered", """SELECT count(*) AS n, round((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2) /
 (sum(label) * (count(*) - sum(label))), 6) + 0.0 AS auc FROM (SELECT label, row_number() OVER (ORDER BY coalesce(mom_60,
 (SELECT min(mom_60) FROM numbered)), strftime(as_of, '%Y%m%d%H%M%S') || '|' || entity_id) AS rk FROM numbered)""")
def baseline_auc(spark, sf):
    scored = fc.momentum_baseline(_training(spark, sf), "mom_60")
    return fc.auc(scored).select("n", r("auc").alias("auc"))


@query()
def forecast_auc(spark, sf):
    samples = _training(spark, sf)
    names = [*IC_NAMES, fc.REGIME]
    return fc.purged_cv_auc(samples, lambda: fc.Plain(lambda: fc.logistic(names)))


@query()
def forecast_comparison(spark, sf):
    """AUC of the model and of the untrained momentum rank on the same purged test folds."""
    samples = _training(spark, sf)
    folds = materialize(fc.purged_folds(fc.numbered(samples), 5, 0.02))
    ranked = fc.momentum_baseline(folds.where("is_test"), "mom_60")
    baseline = fc.auc(ranked, ["fold"]).withColumnRenamed("auc", "baseline_auc")
    model = forecast_auc(spark, sf).select("fold", F.col("auc").alias("model_auc"))
    return baseline.join(model, "fold", "left").select(
        "fold", "n", "model_auc", "baseline_auc",
        (F.col("model_auc") - F.col("baseline_auc")).alias("gain"),
    )


@query()
def forecast_book(spark, sf):
    samples = _training(spark, sf)
    split = samples.agg(F.percentile(F.col("as_of").cast("double"), F.lit(0.6))).scalar()
    marked = samples.withColumn("_late", F.col("as_of").cast("double") > split)
    names = [*IC_NAMES, fc.REGIME]
    # 40 of the default 200 rounds: the trees take a fixed time per round, whatever the size.
    model = fc.Stacked(names, rounds=40).fit(marked.where(~F.col("_late")))
    return st.top_quantile(materialize(model.score(marked.where(F.col("_late")))), 0.3)


# --- orders ------------------------------------------------------------------------------------

cte("fills", [], """SELECT 'A' || l_linenumber AS account, 'S' || l_suppkey AS entity_id, l_shipdate AS event_time,
 l_orderkey || '|' || l_partkey || '|' || l_quantity || '|' || l_tax || '|' || l_discount AS seq,
 CASE WHEN l_returnflag = 'N' THEN -l_quantity ELSE l_quantity END AS signed_qty, l_extendedprice / l_quantity AS price
 FROM lineitem""")
cte("fillno", ["fills"], """SELECT *, row_number() OVER (PARTITION BY account, entity_id ORDER BY event_time, seq) AS i FROM fills""")


def _fills(spark, sf):
    return ad.table(spark, sf, "lineitem").select(
        F.concat(F.lit("A"), F.col("l_linenumber").cast("string")).alias("account"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity_id"),
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_quantity", "l_tax", "l_discount").alias("seq"),
        F.when(F.col("l_returnflag") == "N", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("signed_qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


LEDGER = """WITH RECURSIVE fl AS (SELECT 'A' || l_linenumber AS account, 'S' || l_suppkey AS entity_id, row_number() OVER
 (PARTITION BY l_linenumber, l_suppkey ORDER BY l_shipdate, l_orderkey || '|' || l_partkey || '|' || l_quantity || '|' ||
 l_tax || '|' || l_discount) AS i, CASE WHEN l_returnflag = 'N' THEN -l_quantity ELSE l_quantity END AS q,
 l_extendedprice / l_quantity AS p FROM lineitem),
 walk AS (SELECT account, entity_id, i, q AS qty, p AS avg FROM fl WHERE i = 1 UNION ALL SELECT w.account, w.entity_id, f.i,
 w.qty + f.q, CASE WHEN w.qty = 0 THEN f.p WHEN (w.qty > 0) = (f.q > 0) THEN (w.avg * w.qty + f.p * f.q) / (w.qty + f.q)
 WHEN (w.qty + f.q > 0) <> (w.qty > 0) THEN f.p ELSE w.avg END FROM walk w JOIN fl f ON f.account = w.account AND
 f.entity_id = w.entity_id AND f.i = w.i + 1)
 SELECT account, entity_id, qty, round(avg, 4) + 0.0 AS avg_price FROM walk WHERE qty <> 0
 QUALIFY row_number() OVER (PARTITION BY account, entity_id ORDER BY i DESC) = 1 AND (account, entity_id, i) IN
 (SELECT account, entity_id, max(i) FROM fl GROUP BY 1, 2)"""


@query(None, LEDGER)
def fill_ledger(spark, sf):
    out = od.ledger(_fills(spark, sf), chunk="quarter")
    return out.select("account", "entity_id", "qty", r("avg_price", 4).alias("avg_price"))


@query("fills", """SELECT account, round(1e6 - sum(signed_qty * price), 2) + 0.0 AS cash FROM fills GROUP BY 1""")
def account_cash(spark, sf):
    return od.cash(_fills(spark, sf), 1e6).select("account", r("cash", 2).alias("cash"))


@query("fills", """SELECT account, entity_id, intended, actual, intended - actual AS diff FROM (SELECT account, entity_id,
 sum(signed_qty) AS intended, coalesce(sum(signed_qty) FILTER (event_time < TIMESTAMP '2001-06-01'), 0) AS actual FROM fills
 GROUP BY 1, 2) WHERE abs(intended - actual) > 1e-6""")
def reconcile_positions(spark, sf):
    """Positions of all fills against those a broker knew of before its last months were booked."""
    def held(rows):
        return rows.groupBy("account", "entity_id").agg(F.sum("signed_qty").alias("qty"))

    fills = _fills(spark, sf)
    early = F.col("event_time") < F.lit("2001-06-01").cast("timestamp")
    return od.reconcile(held(fills), held(fills.where(early)))


cte("pos", ["fills", "sched"], """SELECT account, as_of, entity_id, sum(signed_qty) AS qty FROM sched JOIN fills
 ON event_time <= as_of GROUP BY 1, 2, 3""")
cte("openo", ["fills", "sched"], """SELECT account, as_of, entity_id, sum(signed_qty) AS qty FROM sched JOIN fills
 ON event_time > as_of AND event_time <= as_of + INTERVAL 7 DAY GROUP BY 1, 2, 3""")
cte("accts", ["fills", "sched"], """SELECT account, as_of, CASE WHEN account = 'A1' THEN 300000.0 ELSE 800000.0 END AS equity
 FROM (SELECT DISTINCT account FROM fills) CROSS JOIN sched""")


def _positions(fills, slots):
    never = F.lit(None).cast("timestamp")
    placed = slots.spans(fills.withColumn("_never", never), "event_time", "_never")
    sums = slots.rolling_sums(placed, ["account", "entity_id"], {"qty": F.col("signed_qty")})
    return slots.with_as_of(sums).select("account", "as_of", "entity_id", "qty")


def _open_orders(fills, slots):
    shifted = fills.withColumn("_from", F.col("event_time") - F.expr("interval 7 days"))
    placed = slots.spans(shifted, "_from", "event_time")
    out = slots.with_as_of(
        placed.withColumn("k", F.explode(F.sequence(F.col("k_from"), F.col("k_to") - 1)))
    )
    return out.select(
        "account", "as_of", "entity_id",
        F.when(F.col("signed_qty") > 0, "buy").otherwise("sell").alias("side"),
        F.abs("signed_qty").alias("qty"), F.lit(0.0).alias("filled_qty"),
    )


def _accounts(spark, sf, slots):
    """The accounts with fills at every decision time; the first one is small."""
    names = _fills(spark, sf).select("account").distinct().agg(F.collect_set("account")).scalar()
    equity = F.when(F.col("account") == "A1", 300_000.0).otherwise(800_000.0)
    every = slots.schedule.select("as_of", F.explode(names).alias("account"))
    return every.withColumn("equity", equity)


@query(["books", "feat", "pos", "openo", "accts"], """SELECT account, as_of, entity_id, CASE WHEN delta > 0 THEN 'buy' ELSE
 'sell' END AS side, floor(abs(delta)) AS qty FROM (SELECT a.account, b.as_of, b.entity_id, f.ff AS px,
 b.weight * least(equity, 500000) / f.ff AS target, coalesce(p.qty, 0) + coalesce(o.qty, 0) AS cur,
 b.weight * least(equity, 500000) / f.ff - (coalesce(p.qty, 0) + coalesce(o.qty, 0)) AS delta
 FROM books b JOIN feat f ON f.as_of = b.as_of AND f.entity_id = b.entity_id JOIN accts a ON a.as_of = b.as_of
 LEFT JOIN pos p ON p.account = a.account AND p.as_of = b.as_of AND p.entity_id = b.entity_id LEFT JOIN openo o
 ON o.account = a.account AND o.as_of = b.as_of AND o.entity_id = b.entity_id WHERE b.strategy = 'stacked')
 WHERE NOT (cur <> 0 AND target <> 0 AND abs(delta) < 0.1 * abs(target)) AND floor(abs(delta)) * px >= 1""")
def order_plan(spark, sf):
    s = Setup(spark, sf)
    targets = materialize(st.top_scores(s.at, s.score(), 10))
    # What is held of other names plays no part, so fills are reduced to the book's before they are summed.
    names = targets.select("entity_id").distinct()
    fills = materialize(
        _fills(spark, sf).select("account", "entity_id", "event_time", "signed_qty")
        .join(names, "entity_id", "left_semi")
    )
    prices = s.at.select("as_of", "entity_id", F.col("ff").alias("price"))
    plan = od.order_plan(
        targets, prices, _positions(fills, s.slots), _open_orders(fills, s.slots),
        _accounts(spark, sf, s.slots), od.PlanRules(capital_ceiling=500_000.0, rebalance_band=0.1),
    )
    return plan.where(F.col("problem").isNull()).select("account", "as_of", "entity_id", "side", "qty")


@query(["pos", "feat", "spanel", "sched"], """SELECT account, as_of, entity_id, reason FROM (SELECT p.account, p.as_of,
 p.entity_id, f.ff AS px, h.peak, unnest([CASE WHEN f.ff / 115 - 1 <= -0.02 THEN 'stop_loss' END,
 CASE WHEN f.ff / h.peak - 1 <= -0.1 THEN 'trailing_stop' END, CASE WHEN p.qty % 5 - 2 <= -1 THEN 'thesis_break' END])
 AS reason FROM pos p JOIN feat f ON f.as_of = p.as_of AND f.entity_id = p.entity_id JOIN (SELECT event_time, entity_id,
 max(px) OVER (PARTITION BY entity_id ORDER BY t ROWS 59 PRECEDING) AS peak FROM spanel) h ON h.event_time = p.as_of
 AND h.entity_id = p.entity_id WHERE p.qty > 0) WHERE reason IS NOT NULL""")
def exit_rules(spark, sf):
    s = Setup(spark, sf)
    held = _positions(_fills(spark, sf), s.slots).withColumns(
        {"avg_price": F.lit(115.0), "sentiment": F.col("qty") % 5 - 2}
    )
    high = st.at_decisions(s.panel.withColumn("peak", pn.trailing_high(60)), s.slots.schedule)
    prices = high.select("as_of", "entity_id", F.col("ff").alias("price"), "peak")
    known = held.join(prices.select("as_of", "entity_id"), ["as_of", "entity_id"], "left_semi")
    return od.exits(known, prices, stop_loss=0.02, trailing_stop=0.1, thesis_threshold=1.0)


@query("pos", """SELECT account, as_of, entity_id, CASE WHEN qty > 0 THEN 'sell' ELSE 'buy' END AS side, abs(qty) AS qty
 FROM pos WHERE qty <> 0""")
def flatten_plan(spark, sf):
    out = od.flatten_plan(_positions(_fills(spark, sf), weekly_slots(spark, sf)))
    return out.select("account", "as_of", "entity_id", "side", "qty")


# --- whole jobs --------------------------------------------------------------------------------


@query()
def learning_replay(spark, sf):
    return jobs.learning_replay(
        bars(spark, sf), IC_NAMES, warmup=60, every=20, horizon=5
    )[0]


def _comparison(spark, sf):
    """Summary and resampled paths; the books' returns behind them are written, each query adds its own part."""
    return shared(
        spark, sf, "comparison",
        lambda: jobs.compare_strategies(
            bars(spark, sf), filings(spark, sf), warmup=60, every=20, n_sims=2000
        ),
    )


@query()
def strategy_comparison(spark, sf):
    return _comparison(spark, sf)[0]


@query()
def strategy_simulation(spark, sf):
    """Resampled paths of every compared strategy, 2,000 each."""
    return _comparison(spark, sf)[1]


# The journal: graded decisions with their regime and the rebalance at which they had resolved.
cte("jour", ["graded", "regime", "sched"], """SELECT g.entity_id || '@' || strftime(g.as_of, '%Y-%m-%d') AS key, g.ret AS outcome,
 CASE WHEN risk_on THEN 'risk_on' ELSE 'risk_off' END AS regime, m.k AS matured, [coalesce(mom_60, 0), coalesce(meanrev_5, 0),
 coalesce(vol_20, 0), coalesce(insider_net_buys_90d, 0)]::DOUBLE[] AS v FROM graded g JOIN regime q ON q.as_of = g.as_of JOIN sched s
 ON s.as_of = g.as_of JOIN (SELECT s.k AS made, min(r.k) AS k FROM sched s JOIN sched r ON r.t >= s.t + 5 GROUP BY 1) m ON m.made = s.k""")
cte("jscale", ["jour", "sched"], """SELECT k, list(CASE WHEN n > 0 AND sd > 1e-9 THEN sd ELSE 1.0 END ORDER BY i) AS scale FROM (SELECT s.k, r.i,
 stddev_pop(j.x) AS sd, count(j.x) AS n FROM sched s CROSS JOIN range(1, 5) r(i) LEFT JOIN (SELECT matured, unnest(v) AS x,
 generate_subscripts(v, 1) AS i FROM jour) j ON j.matured <= s.k AND j.i = r.i GROUP BY 1, 2) GROUP BY 1""")
cte("asked", ["score", "matrix", "regime", "jscale"], """SELECT s.as_of, s.entity_id, s.k, CASE WHEN risk_on THEN 'risk_on' ELSE
 'risk_off' END AS regime, scale, [coalesce(mom_60, 0), coalesce(meanrev_5, 0), coalesce(vol_20, 0),
 coalesce(insider_net_buys_90d, 0)]::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY score DESC,
 entity_id) AS rank FROM score) s JOIN matrix m ON m.as_of = s.as_of AND m.entity_id = s.entity_id JOIN regime q
 ON q.as_of = s.as_of JOIN jscale c ON c.k = s.k WHERE rank <= 5""")
cte("recalled", ["asked", "jour"], """SELECT * FROM (SELECT as_of, entity_id, key, outcome, row_number() OVER (PARTITION BY as_of,
 entity_id ORDER BY d, key) AS rank FROM (SELECT a.as_of, a.entity_id, j.key, j.outcome, sqrt(((j.v[1] - a.v[1]) / scale[1]) ** 2 +
 ((j.v[2] - a.v[2]) / scale[2]) ** 2 + ((j.v[3] - a.v[3]) / scale[3]) ** 2 + ((j.v[4] - a.v[4]) / scale[4]) ** 2) AS d FROM asked a
 JOIN jour j ON j.matured <= a.k AND j.regime = a.regime)) WHERE rank <= 8""")
cte("analog", ["recalled"], """SELECT as_of, entity_id, count(*) AS n, avg(outcome) AS mean, quantile_cont(outcome, 0.5) AS median,
 quantile_cont(outcome, 0.1) AS q10, quantile_cont(outcome, 0.9) AS q90, avg((outcome > 0)::INT::DOUBLE) AS share
 FROM recalled GROUP BY 1, 2""")


def _analogs(spark, sf):
    """Outcomes of the eight nearest resolved decisions of each name that leads at a decision time."""
    graded, s = _graded(spark, sf)

    def build():
        regimes = ft.macro_regime(ad.macro_series(spark, sf), s.slots)
        ready = jobs.grading_slots(s.panel, s.slots, 5)
        entries = gr.journal(graded, regimes).join(ready, "as_of")
        feature = lambda n: F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0))
        journal = materialize(entries.select(
            an.episode_key().alias("key"), F.col("realized_return").alias("outcome"), "regime",
            F.col("matured_k").cast("long").alias("matured"), *(feature(n).alias(n) for n in NAMES),
        ))
        values = F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in NAMES))
        scales = rc.known_scales(journal, NAMES, s.slots.schedule)
        top = cs.top_k(s.score(), ["as_of"], 5, F.desc("score"), F.col("entity_id"), out="place")
        asked = (
            top.select("as_of", "entity_id").join(s.matrix(), ["as_of", "entity_id"])
            .join(regimes.select("as_of", F.col("label").alias("regime")), "as_of")
            .join(s.slots.schedule.select("as_of", "k"), "as_of").join(scales, "k")
            .select(an.episode_key().alias("query"), "as_of", "entity_id", values.alias("vector"),
                    F.col("k").cast("long").alias("seen"), "scale", "regime")
        )
        asked = materialize(asked)
        near = rc.matured_nearest(journal.withColumn("vector", values), asked, 8, ["regime"])
        return materialize(
            an.outcomes(near).join(asked.select("query", "as_of", "entity_id"), "query")
        )

    return shared(spark, sf, "analogs", build), s


@query("analog", """SELECT as_of, entity_id, n, round(mean, 6) + 0.0 AS mean, round(median, 6) + 0.0 AS median, round(q10, 6) + 0.0 AS q10,
 round(q90, 6) + 0.0 AS q90, round(share, 6) + 0.0 AS share_positive FROM analog""")
def journal_analogs(spark, sf):
    """How the nearest decisions known to have resolved turned out, per leading name and time."""
    out, _ = _analogs(spark, sf)
    return out.select("as_of", "entity_id", "n", *[r(c).alias(c) for c in ("mean", "median", "q10", "q90", "share_positive")])


@query(["score", "clusters", "leads", "analog"], """SELECT as_of, entity_id, rank, n_types, coalesce(n, 0) AS analog_n,
 round(least(1, abs(score) / 2) * CASE WHEN n IS NULL THEN 1 WHEN score > 0 THEN share ELSE 1 - share END, 3) AS confidence,
 CASE WHEN parts = '' THEN 'no major disconfirming evidence found' ELSE parts END AS case_against FROM (SELECT *, concat_ws('; ',
 CASE WHEN n IS NOT NULL AND ((score > 0 AND share < 0.6) OR (score < 0 AND share > 0.4)) THEN 'analogs disagree (' ||
 floor(share * 100)::INT || '% resolved positive)' END, CASE WHEN q10 < 0 THEN 'downside tail q10=' || round(q10, 3) END,
 CASE WHEN n_types = 0 THEN 'no corroborating events' END, CASE WHEN abs(score) < 0.5 THEN 'weak signal magnitude' END) AS parts
 FROM (SELECT s.as_of, s.entity_id, score, rank, count(DISTINCT e.event_type) AS n_types FROM (SELECT *, row_number() OVER
 (PARTITION BY as_of ORDER BY score DESC, entity_id) AS rank FROM score) s LEFT JOIN (SELECT as_of, entity_id, 'c' AS event_type
 FROM clusters UNION ALL SELECT as_of, entity_id, 'l' FROM leads) e ON e.as_of = s.as_of AND e.entity_id = s.entity_id
 WHERE rank <= 5 GROUP BY 1, 2, 3, 4) LEFT JOIN analog USING (as_of, entity_id))""")
def recommendations(spark, sf):
    from pitline.operators import events as ev

    analogs, s = _analogs(spark, sf)
    events = ev.detect_events(filings(spark, sf), office_trades(spark, sf), s.slots)
    out = an.recommend(s.score(), events, analogs)
    return out.select("as_of", "entity_id", "rank", F.size("events").cast("long").alias("n_types"),
                      "analog_n", "confidence", "case_against")
