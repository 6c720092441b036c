"""Ranks, quantiles, totals and books against plain numpy/pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitline.functions import crosssection as cs
from pitline.operators import returns as rt
from pitline.operators import scoring as sc
from pitline.operators import sizing as sz
from pitline.operators import strategies as st

T0, T1 = dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1)


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(3000) < 0.4, 0.0, np.round(rng.normal(size=3000), 2))
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "name": [f"Item#{i:06d}" for i in range(3000)], "x": x})
    pdf.loc[::97, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return df, pdf


def test_average_rank(tied):
    df, pdf = tied
    got = cs.average_rank(df, ["g"], "x", pct=True).toPandas().set_index("name")["rank"].sort_index()
    want = pdf.set_index("name").groupby("g")["x"].rank(pct=True).sort_index()
    np.testing.assert_allclose(got, want)


@pytest.mark.parametrize("descending", [True, False])
def test_ordered_rank(tied, descending):
    df, pdf = tied
    got = cs.ordered_rank(df, ["g"], "x", "name", descending=descending).toPandas()
    want = pdf.dropna().sort_values(["x", "name"], ascending=[not descending, True])
    want["rank"] = want.groupby("g").cumcount() + 1
    both = got.merge(want, on="name")
    assert len(both) == len(want) and (both["rank_x"] == both["rank_y"]).all()
    assert (got.groupby("g")["rank_of"].first() == want.groupby("g").size()).all()


def test_quantiles(tied):
    df, pdf = tied
    got = cs.quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.93}).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["x"].quantile([0.1, 0.5, 0.93]).unstack()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy())


def test_zscore_flat_and_null(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, None), (2, 1.0), (2, 3.0)], "g int, x double")
    got = sorted(map(tuple, cs.zscore(df, ["g"], ["x"]).collect()), key=str)
    assert got == [(1, 0.0), (1, 0.0), (1, None), (2, -1.0), (2, 1.0)]


def test_running_total_in_pieces(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": "a", "i": range(500), "c": np.arange(500) // 37, "v": rng.integers(-5, 6, 500)})
    out = cs.running_total(spark.createDataFrame(pdf), ["k"], "c", ["i"], {"s": F.col("v")}).toPandas()
    assert (out.sort_values("i")["s"].to_numpy() == pdf["v"].cumsum().to_numpy()).all()


def test_compounding_keeps_signs(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", -3.0), ("b", -1.0), ("b", 5.0), ("c", None)], "g string, r double")
    got = {r.g: r.p for r in df.groupBy("g").agg(cs.compounded("r").alias("p")).collect()}
    assert got["a"] == pytest.approx(-3.0) and got["b"] == 0.0 and got["c"] == pytest.approx(1.0)


def test_metrics_known_values(spark):
    rows = [("d", i, r) for i, r in enumerate([0.10, -0.50, 0.0])]
    rows += [("h", i, r) for i, r in enumerate([1.0, -0.5, 2.0, -0.3, 0.0])]
    rows += [("w", 0, -1.0), ("w", 1, 0.1), ("f", 0, 0.0), ("f", 1, 0.0)]
    out = {r.strategy: r for r in rt.summarize(
        spark.createDataFrame(rows, "strategy string, event_time int, net double")).collect()}
    assert out["d"].max_drawdown == pytest.approx(-0.5)
    assert out["h"].hit_rate == pytest.approx(0.4)
    assert out["w"].ann_return == -1.0
    assert (out["f"].sharpe, out["f"].calmar, out["f"].ann_vol) == (0.0, 0.0, 0.0)


def test_reliability_lists_empty_bins(spark):
    df = spark.createDataFrame([(0.05, 0.0), (0.95, 1.0), (1.0, 1.0)], "probability double, outcome double")
    out = {r.bin: r for r in rt.reliability(df).collect()}
    assert len(out) == 10 and out[9].n == 2 and out[4].n == 0 and out[4].mean_pred is None


def ledoit_wolf(x):
    n, p = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / n**2 / p
    shrink = min(b2, d2) / d2
    return (1 - shrink) * s + shrink * mu * np.eye(p)


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 12)) * 0.01 + rng.normal(size=(60, 1)) * 0.01
    rows = [(T0, f"N{j:02d}", 60, [float(v) for v in x[:, j]]) for j in range(12)]
    df = spark.createDataFrame(rows, "as_of timestamp, entity_id string, n_obs int, xs array<double>")
    return df, x


def test_book_risk_equals_the_shrunk_covariance(spark, windows):
    df, x = windows
    w = np.linspace(0.01, 0.2, 12)
    book = spark.createDataFrame([("b", T0, f"N{j:02d}", float(w[j])) for j in range(12)],
                                 "strategy string, as_of timestamp, entity_id string, weight double")
    for salts in (1, 5):
        got = sz.book_risk(book, df, salts).first()
        assert got.variance == pytest.approx(w @ ledoit_wolf(x) @ w, rel=1e-9)


def test_size_book_hits_the_target_and_drops_short_history(spark, windows):
    df, x = windows
    names = spark.createDataFrame([(T0, f"N{j:02d}") for j in range(13)], "as_of timestamp, entity_id string")
    wide = sz.RiskLimits(10.0, 100.0, 100.0)
    book = sz.size_book(names, df, target_vol=0.1, limits=wide).toPandas().sort_values("entity_id")
    w = book["weight"].to_numpy()
    assert len(w) == 12
    assert np.sqrt(w @ ledoit_wolf(x) @ w * 252) == pytest.approx(0.1)
    capped = sz.size_book(names, df, target_vol=5.0).toPandas()["weight"]
    assert capped.max() <= 0.1 + 1e-12 and capped.sum() <= 1 + 1e-9
    cold = sz.size_book(names, df.where("false"), target_vol=0.1, limits=wide).toPandas()["weight"]
    assert len(cold) == 13 and np.allclose(cold, 1 / 13)


def limited(w, lim, sectors=None):
    w = {k: max(-lim.max_position_weight, min(lim.max_position_weight, v)) for k, v in w.items()}
    g = sum(map(abs, w.values()))
    if g > lim.max_gross_exposure:
        w = {k: v * lim.max_gross_exposure / g for k, v in w.items()}
    for s in set((sectors or {}).values()):
        e = sum(abs(w[k]) for k in w if sectors.get(k) == s)
        if e > lim.max_sector_weight:
            w = {k: v * lim.max_sector_weight / e if sectors.get(k) == s else v for k, v in w.items()}
    net = sum(w.values())
    if abs(net) > lim.max_net_exposure + 1e-12:
        side = [k for k in w if w[k] * net > 0]
        f = 1 - (abs(net) - lim.max_net_exposure) / sum(abs(w[k]) for k in side)
        w = {k: v * f if k in side else v for k, v in w.items()}
    return {k: v for k, v in w.items() if v != 0}


@pytest.mark.parametrize("seed", range(4))
def test_risk_limits(spark, seed):
    rng = np.random.default_rng(seed)
    w = {f"N{i}": float(v) for i, v in enumerate(rng.normal(0.02 * (seed % 2), 0.1, 30))}
    sectors = {f"N{i}": f"S{i % 4}" for i in range(24)}
    lim = sz.RiskLimits(0.08, 0.9, 0.1, 0.2)
    book = spark.createDataFrame([("b", T0, k, v) for k, v in w.items()],
                                 "strategy string, as_of timestamp, entity_id string, weight double")
    smap = spark.createDataFrame(list(sectors.items()), "entity_id string, sector string")
    for mapping, frame in ((None, None), (sectors, smap)):
        got = {r.entity_id: r.weight for r in sz.apply_risk_limits(book, lim, frame).collect()}
        want = limited(w, lim, mapping)
        assert set(got) == set(want)
        np.testing.assert_allclose([got[k] for k in want], list(want.values()))


def test_tilt_zero_is_equal_weight(spark):
    df = spark.createDataFrame([(T0, "a", 1.0), (T0, "b", -2.0), (T0, "c", None)],
                               "as_of timestamp, entity_id string, score double")
    assert {round(r.weight, 12) for r in sc.tilt_weights(df, 0.0).collect()} == {round(1 / 3, 12)}
    tilted = {r.entity_id: r.weight for r in sc.tilt_weights(df, 1.0).collect()}
    assert tilted["a"] > tilted["c"] > tilted["b"] > 0 and sum(tilted.values()) == pytest.approx(1)


def test_ic_weights_prune_cap_and_fall_back(spark):
    def weights(ics, **kw):
        df = spark.createDataFrame(list(ics.items()), "signal string, ic double")
        return {r.signal: r.weight for r in sc.ic_weights(df, **kw).collect()}

    assert weights({"a": 0.3, "b": -0.1}) == pytest.approx({"a": 0.5, "b": -0.25})
    assert weights({"a": 0.3, "b": 0.01}, min_abs=0.02) == {"a": 0.5, "b": 0.0}
    assert weights({"a": 0.0, "b": 0.0}) == {"a": 0.5, "b": 0.5}


def test_hysteresis_keeps_held_names(spark):
    def day(t, order):
        return [("s", t, n, float(-i)) for i, n in enumerate(order)]

    rows = day(T0, "abcdefghij") + day(T1, "cdeabfghij")
    scores = spark.createDataFrame(rows, "strategy string, as_of timestamp, entity_id string, score double")
    got = st.hysteresis_path(scores, 0.2, 2.0, 3).toPandas()
    assert set(got[got.as_of == T0].entity_id) == {"a", "b"}
    assert set(got[got.as_of == T1].entity_id) == {"a", "c", "d"}
    one = st.hysteresis_step(scores.where(F.col("as_of") == T1).select("as_of", "entity_id", "score"),
                             spark.createDataFrame([("a",), ("b",)], "entity_id string"), 2, 4, 3)
    assert {r.entity_id for r in one.collect()} == {"a", "c", "d"}


@pytest.mark.parametrize("cap, segment", [(3, 1), (3, 4), (5, 64), (None, 4)])
def test_hysteresis_equals_a_walk_over_all_days(spark, cap, segment):
    """Segments that have to be stitched, days without a strategy, ties and names that come and go."""
    rng = np.random.default_rng(7)
    rows, level = [], rng.normal(size=30)
    for d in range(40):
        level = level * 0.9 + rng.normal(size=30) * 0.5
        for s in ("s", "t"):
            if s == "t" and d % 7 == 3:
                continue
            there = rng.random(30) < 0.9
            rows += [(s, T0 + dt.timedelta(days=d), f"n{i:02}", float(round(level[i], 1))) for i in range(30) if there[i]]
    schema = "strategy string, as_of timestamp, entity_id string, score double"
    got = st.hysteresis_path(spark.createDataFrame(rows, schema), 0.2, 1.8, cap, segment=segment)
    want = []
    for s in ("s", "t"):
        held = set()
        for d in sorted({r[1] for r in rows if r[0] == s}):
            ranked = [n for _, n in sorted((-r[3], r[2]) for r in rows if r[0] == s and r[1] == d)]
            enter = max(1, int(len(ranked) * 0.2))
            enter = enter if cap is None else min(enter, cap)
            leave = min(len(ranked), max(enter, round(enter * 1.8)))
            band = ranked[:leave]
            held = [*[n for n in band if n in held], *[n for n in band[:enter] if n not in held]][:cap]
            want += [(s, d, n, ranked.index(n) + 1) for n in held]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pairwise_covariance(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5)) * np.array([1, 2, 3, 1, 2]) * 0.01
    rows = [("g", t, f"N{j}", float(x[t, j])) for t in range(200) for j in range(5)]
    returns = spark.createDataFrame(rows, "grp string, t int, entity_id string, ret double")
    for salts, tile in ((None, 512), (3, 2), (2, 1)):
        cov = sz.pairwise_covariance(returns, salts, tile)
        assert cov.count() == 25
        m = cov.toPandas().pivot(index="a", columns="b", values="cov").to_numpy()
        np.testing.assert_allclose(m, np.cov(x.T), rtol=1e-8)


def test_covariance_of_a_group_of_thousands(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6, 1200))
    names = [f"n{j:04}" for j in range(1200)]
    rows = [("big", t, names[j], float(x[t, j])) for t in range(6) for j in range(1200)]
    frame = pd.DataFrame(rows, columns=["grp", "t", "entity_id", "ret"])
    cov = sz.pairwise_covariance(spark.createDataFrame(frame), 2, 256)
    assert cov.count() == 1200 * 1200
    want = np.cov(x.T)
    for r in cov.where("a in ('n0003', 'n1100') and b > 'n1190'").collect():
        assert r["cov"] == pytest.approx(want[names.index(r.a), names.index(r.b)], abs=1e-9)


def test_ranks_with_nan_infinities_and_odd_names(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 1.0), ("b", nan), ("c", inf), ("d", -inf), ("e", 0.0), ("f", inf), ("g", None), ("zz" * 50, 1e-300)]
    df = spark.createDataFrame(rows, "name string, x double").withColumn("g", F.lit(1))
    got = {r.name: r["rank"] for r in cs.average_rank(df, ["g"], "x").collect()}
    assert got == {"d": 1.0, "e": 2.0, "zz" * 50: 3.0, "a": 4.0, "c": 5.5, "f": 5.5, "b": None, "g": None}
    strict = {r.name: r["rank"] for r in cs.ordered_rank(df, ["g"], "x", "name").collect()}
    assert strict == {"c": 1, "f": 2, "a": 3, "zz" * 50: 4, "e": 5, "d": 6}
    z = {r.name: r.x for r in cs.zscore(df.where("name in ('a', 'b', 'e')"), ["g"], ["x"]).collect()}
    assert z == {"a": 1.0, "e": -1.0, "b": None}


def test_ordered_rank_of_one_large_tie(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.lit(0.0).alias("x"), F.format_string("N%09d", "id").alias("name"))
    odd = spark.createDataFrame([(1, 0.0, "A-name-unlike-the-others")], "g int, x double, name string")
    out = cs.ordered_rank(df.unionByName(odd), ["g"], "x", "name")
    bad = out.where(F.col("rank") != F.when(F.col("name") < "N", 1).otherwise(F.substring("name", 2, 9).cast("long") + 2))
    assert bad.count() == 0 and out.count() == n + 1


def test_bootstrap_paths_equal_summaries(spark):
    rng = np.random.default_rng(7)
    rows = [("s", i, float(v)) for i, v in enumerate(rng.normal(0.001, 0.02, 57))] + [("t", 0, 0.1), ("t", 1, -1.0)]
    df = spark.createDataFrame(rows, "strategy string, event_time int, net double")
    paths = rt.resample(df, 5, 10, seed=3)
    per = {(r.strategy, r.sim): r for r in rt._per_path(paths, "strategy", 252).collect()}
    flat = paths.select("strategy", "sim", F.posexplode("path").alias("event_time", "net"))
    for sim in range(5):
        for r in rt.summarize(flat.where(F.col("sim") == sim)).collect():
            got = per[r.strategy, sim]
            for c in ("n_periods", "ann_return", "ann_vol", "sharpe", "sortino", "calmar", "max_drawdown", "hit_rate"):
                assert got[c] == pytest.approx(r[c], abs=1e-12), c
    assert len(per) == 10 and all(len(r.path) == (57 if r.strategy == "s" else 2) for r in paths.collect())
