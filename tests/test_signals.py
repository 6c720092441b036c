"""Planted signals, event studies, leakage, forecasts and grading on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitline.functions.timeline import Slots, make_schedule
from pitline.operators import events as ev
from pitline.operators import features as ft
from pitline.operators import forecast as fc
from pitline.operators import grading as gr
from pitline.operators import panel as pn
from pitline.operators import signal_ic as si
from pitline.operators import study as sd
from pitline.operators.sizing import RiskLimits
from pitline.plans import jobs

DAY0 = dt.datetime(2020, 1, 1, 21)


def day(i):
    return DAY0 + dt.timedelta(days=int(i))


def bars(spark, prices):
    rows = [(name, day(i), float(p)) for name, path in prices.items() for i, p in enumerate(path)]
    return spark.createDataFrame(rows, "entity_id string, event_time timestamp, close double")


def paths(returns):
    return {n: 100 * np.cumprod(1 + r) for n, r in returns.items()}


def test_panel_fills_gaps_on_the_global_grid(spark):
    rows = [("A", day(0), 10.0), ("A", day(3), 20.0), ("B", day(1), 5.0), ("B", day(2), 6.0)]
    df = spark.createDataFrame(rows, "entity_id string, event_time timestamp, close double")
    out = {(r.entity_id, r.t): r for r in pn.dense_panel(df).collect()}
    assert len(out) == 8
    assert [out["A", t].ff for t in range(4)] == [10, 10, 10, 20]
    assert [out["A", t].ret for t in range(4)] == [None, 0.0, 0.0, 1.0]
    assert out["B", 0].ff is None and out["B", 1].ret is None and out["B", 3].ret == 0.0


def test_trending_panel_has_ic_near_one(spark):
    rng = np.random.default_rng(0)
    drift = np.linspace(-0.003, 0.003, 12)
    frame = bars(spark, paths({f"N{j:02d}": drift[j] + rng.normal(0, 0.0003, 160) for j in range(12)}))
    out = jobs.signal_report(frame, ["mom_60"], warmup=65).first()
    assert out.mean_ic > 0.9 and out.bonferroni and out.n_dates > 10


def test_noise_has_no_ic_and_flat_signals_give_no_row(spark):
    rng = np.random.default_rng(1)
    frame = bars(spark, paths({f"N{j:02d}": rng.normal(0, 0.01, 300) for j in range(20)}))
    out = {r.signal: r for r in jobs.signal_report(frame, ["mom_60", "vol_20"]).collect()}
    assert abs(out["mom_60"].mean_ic) < 0.2
    flat = frame.withColumn("as_of", F.col("event_time")).select(
        "as_of", "entity_id", F.lit(1.0).alias("x"), F.col("close").alias("fwd"))
    assert si.date_ics(flat, ["x"]).count() == 0


def test_future_rows_do_not_change_past_features(spark):
    rng = np.random.default_rng(2)
    full = paths({f"N{j}": rng.normal(0, 0.01, 120) for j in range(6)})
    names = ["mom_60", "meanrev_5", "vol_20"]

    def upto(n):
        panel = ft.price_features(pn.dense_panel(bars(spark, {k: v[:n] for k, v in full.items()})), names)
        rows = panel.where(F.col("t") < 100).orderBy("entity_id", "t").select(*names).toPandas()
        return rows.to_numpy(dtype=float)

    np.testing.assert_array_equal(upto(100), upto(120))


def planted(seed=3, drift=0.02):
    rng = np.random.default_rng(seed)
    r = {n: rng.normal(0, 0.005, 420) for n in ("EVT", "CTRL", "C2", "C3")}
    at = list(range(90, 371, 40))
    for p in at:
        r["EVT"][p + 1 : p + 4] += drift
    return paths(r), at


@pytest.mark.parametrize("drift,found", [(0.02, True), (0.0, False)])
def test_event_study_and_placebo(spark, drift, found):
    prices, at = planted(drift=drift)
    frame = bars(spark, prices)
    anchors = spark.createDataFrame([("e", "EVT", day(p)) for p in at],
                                    "event_type string, entity_id string, anchor timestamp")
    dates = Slots(make_schedule(frame.select("event_time")))
    dist, null = sd.run_study(anchors, pn.dense_panel(frame), dates, 60)
    d, p = dist.first(), null.first()
    assert d.n == len(at) and (d.mean_car > 0.02) == found
    assert (p.p_value <= 0.05) == found
    assert (sd.gate(null).count() == 1) == found


def test_market_model_equals_least_squares(spark):
    prices, _ = planted()
    out = sd.abnormal_returns(pn.dense_panel(bars(spark, prices))).where("entity_id = 'EVT' and t = 200").first()
    r = {n: p[1:] / p[:-1] - 1 for n, p in prices.items()}
    m = np.mean(list(r.values()), axis=0)
    s, pos = r["EVT"], 199
    beta, alpha = np.polyfit(m[pos - 65 : pos - 5], s[pos - 65 : pos - 5], 1)
    car = (s[pos : pos + 6] - alpha - beta * m[pos : pos + 6]).sum()
    assert (out.alpha, out.beta, out.car) == pytest.approx((alpha, beta, car), abs=1e-9)


FILING = ("source string, dataset string, entity_id string, ref string, event_time timestamp, "
          "knowledge_time timestamp, revision int, insider_name string, is_purchase boolean, observation_id string")


def filing(i, entity, at, name="n", buy=True):
    return ("edgar", "filing.form4", entity, f"{name}{i}", at, at, 0, name, buy, str(i))


def slots_at(spark, *times):
    return Slots(make_schedule(spark.createDataFrame([(t,) for t in times], "as_of timestamp"), "as_of"))


def test_clusters_need_three_buys_inside_the_window(spark):
    rows = [filing(i, "A", day(i)) for i in range(3)] + [filing(9, "B", day(0)), filing(10, "B", day(1))]
    df = spark.createDataFrame(rows, FILING)
    out = ev.insider_clusters(df, slots_at(spark, day(1), day(2), day(29), day(30))).collect()
    assert sorted((r.entity_id, r.as_of, r.n_buys) for r in out) == [("A", day(2), 3), ("A", day(29), 3)]
    gate = spark.createDataFrame([(ev.CLUSTER, 0.02)], "event_type string, mean_car double")
    clusters = ev.insider_clusters(df, slots_at(spark, day(2), day(29)))
    assert [r.as_of for r in ev.cluster_entries(clusters, gate).collect()] == [day(2)]
    held = spark.createDataFrame([("A",)], "entity_id string")
    assert ev.cluster_entries(clusters, gate, held).count() == 0
    assert ev.cluster_entries(clusters, gate.where("false")).count() == 0


def test_routine_insiders_are_left_out(spark):
    jan = [dt.datetime(y, 1, 10) for y in (2021, 2022, 2023, 2024)]
    rows = [filing(i, "A", t, "routine") for i, t in enumerate(jan)]
    rows.append(filing(9, "A", dt.datetime(2023, 12, 20), "other"))
    df = spark.createDataFrame(rows, FILING)
    slots = slots_at(spark, dt.datetime(2022, 1, 15), dt.datetime(2024, 1, 15))
    raw = {r.as_of.year: r.insider_net_buys_90d for r in ft.insider_net_buys(df, slots).collect()}
    opp = {r.as_of.year: r.insider_net_buys_90d_opp for r in ft.insider_net_buys(df, slots, 90, True).collect()}
    assert raw == {2022: 1, 2024: 2} and opp == {2022: 1, 2024: 1}


def test_earnings_surprise_and_yield(spark):
    ends = [dt.datetime(2020 + (3 * q) // 12, 1 + (3 * q) % 12, 1) for q in range(8)]
    eps = [1.0, 1.0, 1.0, 1.0, 1.1, 0.9, 1.1, 2.0]
    rows = [("s", "d", "A", str(i), e, e + dt.timedelta(days=20), 0, x, str(i))
            for i, (e, x) in enumerate(zip(ends, eps, strict=True))]
    df = spark.createDataFrame(rows, "source string, dataset string, entity_id string, ref string, "
                               "event_time timestamp, knowledge_time timestamp, revision int, eps double, observation_id string")
    at = ends[-1] + dt.timedelta(days=30)
    slots = slots_at(spark, at, at + dt.timedelta(days=200))
    price = spark.createDataFrame([(at, "A", 102.0)], "as_of timestamp, entity_id string, price double")
    out = {r.as_of: r for r in ft.earnings_features(df, slots, price).collect()}
    prior = np.array([0.1, -0.1, 0.1])
    assert out[at].earnings_surprise == pytest.approx(1.0 / prior.std(ddof=1))
    assert out[at].earnings_yield == pytest.approx(5.1 / 102.0)
    assert out[at + dt.timedelta(days=200)].earnings_surprise is None


def test_holdout_gives_the_first_look_back(spark):
    cols = "signal string, decided_at timestamp, n_dates int, mean_ic double, t_stat double, passed boolean"
    ledger = spark.createDataFrame([("a", day(1), 9, 0.1, 3.0, True)], cols)
    again = spark.createDataFrame([("a", day(5), 9, 0.9, 9.0, True), ("b", day(5), 9, 0.2, 2.0, False)], cols)
    looks, fresh = si.confirm(ledger, again)
    out = {r.signal: r for r in looks.collect()}
    assert out["a"].mean_ic == 0.1 and out["a"].is_repeat and not out["b"].is_repeat
    assert [r.signal for r in fresh.collect()] == ["b"]


def test_family_correction(spark):
    t = {"a": 5.0, "b": 2.5, "c": 2.1, "d": 0.3}
    df = spark.createDataFrame(list(t.items()), "signal string, t_stat double")
    out = {r.signal: (r.bonferroni, r.fdr) for r in si.correct_family(df).collect()}
    assert out == {"a": (True, True), "b": (True, True), "c": (False, True), "d": (False, False)} or \
        out["a"] == (True, True) and out["d"] == (False, False)


def test_grading_finds_the_planted_feature(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    rows = [(day(i % 4), f"N{i}", float(1 / (1 + np.exp(-3 * x[i]))), {"good": float(x[i]), "flat": 1.0}, float(x[i] * 0.01))
            for i in range(400)]
    log = spark.createDataFrame(rows, "as_of timestamp, entity_id string, probability double, "
                                "features map<string,double>, fwd double")
    graded = gr.matured(log.drop("fwd"), log.select("as_of", "entity_id", "fwd"))
    ics = {r.signal: r.ic for r in gr.pooled_ic(graded).collect()}
    assert ics.keys() == {"good"} and ics["good"] == pytest.approx(1.0)
    s = gr.score(graded).first()
    assert s.n == 400 and s.hit_rate == 1.0 and s.brier < 0.1


def test_models_learn_a_separable_label_without_leakage(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2))
    rows = [(day(i // 20), f"N{i % 20:02d}", float(x[i, 0]), None if i % 50 == 0 else float(x[i, 1]),
             float(x[i, 0] + 0.3 * rng.normal() > 0), day(i // 20), day(i // 20 + 2)) for i in range(600)]
    samples = spark.createDataFrame(rows, "as_of timestamp, entity_id string, a double, b double, "
                                    "label double, t0 timestamp, t1 timestamp")
    folds = fc.purged_folds(fc.numbered(samples), 3, 0.05).toPandas()
    for _, g in folds.groupby("fold"):
        test, train = g[g.is_test], g[~g.is_test]
        assert not ((train.t1 >= test.t0.min()) & (train.t0 <= test.t1.max())).any()
    out = fc.purged_cv_auc(samples, lambda: fc.Plain(lambda: fc.logistic(["a", "b"])), 3).collect()
    assert len(out) == 3 and min(r.auc for r in out) > 0.9
    model = fc.Calibrated(lambda: fc.logistic(["a", "b"]), 2).fit(samples)
    assert fc.auc(model.score(samples)).first().auc > 0.9


def test_replay_learns_on_a_trending_market(spark):
    rng = np.random.default_rng(8)
    drift = np.linspace(-0.002, 0.002, 10)
    frame = bars(spark, paths({f"N{j}": drift[j] + rng.normal(0, 0.002, 240) for j in range(10)}))
    net, history = jobs.learning_replay(frame, ["mom_60", "vol_20"], warmup=70, every=20, horizon=10,
                                        limits=RiskLimits(0.5))
    ics = {(r.signal, r.as_of): r.ic for r in history.collect() if r.ic is not None}
    assert len({k for _, k in ics}) >= 5 and all(v > 0.5 for (s, _), v in ics.items() if s == "mom_60")
    assert net.agg(F.avg("net")).first()[0] > 0
