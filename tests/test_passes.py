"""Features of recent bars however ticks are cut into batches; passes over all names of a sleeve."""

import datetime as dt
import random

import numpy as np
import pytest

from pitline.operators import scoring as sc
from pitline.sources import ledger as lg
from pitline.sources.store import Store
from pitline.streaming import jobs as sj
from pitline.streaming import passes as sp

T0 = dt.datetime(2024, 1, 1)
RULES = sp.Intraday(step=60, span=20, momentum=5, mean_reversion=2, volatility=6)


def brute(steps, closes, rules):
    out = []
    for i, s in enumerate(steps):
        held = {t: c for t, c in zip(steps[: i + 1], closes) if t > s - rules.span}
        price = lambda at: next((held[t] for t in sorted(held, reverse=True) if t <= at), None)
        change = lambda back: closes[i] / price(s - back) - 1 if price(s - back) else None
        moves = [
            price(j) / price(j - 1) - 1 for j in range(s - rules.volatility + 1, s + 1) if price(j - 1) is not None
        ]
        back = change(rules.mean_reversion)
        out.append((change(rules.momentum), None if back is None else -back, float(np.std(moves)) if moves else None))
    return out


def same(got, want):
    for g, w in zip(got, want, strict=True):
        assert (g is None or g != g) if w is None else g == pytest.approx(w, abs=1e-7)


def test_bar_features_equal_a_walk():
    rng = random.Random(3)
    steps, s = [], 0
    for _ in range(120):
        s += rng.choice([1, 1, 1, 2, 3, 9, 30])
        steps.append(s)
    closes = [round(rng.uniform(1, 50), 2) for _ in steps]
    got = sp.bar_features(np.array(steps), np.array(closes), RULES)
    for i, want in enumerate(brute(steps, closes, RULES)):
        same([got[n][i] for n in ("momentum", "mean_reversion", "volatility")], want)


@pytest.mark.parametrize("cuts", [1, 5])
def test_features_do_not_depend_on_batches(spark, tmp_path, cuts):
    rng = random.Random(4)
    ticks = [("a", T0 + dt.timedelta(seconds=20 * i), i, round(rng.uniform(1, 9), 2)) for i in range(150) if i % 7]
    ticks += [("b", T0 + dt.timedelta(minutes=200 + i), i, 2.0) for i in range(3)]
    cols, folder = "entity_id string, event_time timestamp, seq long, price double", str(tmp_path / "in")
    size = -(-len(ticks) // cuts)
    for i in range(cuts):
        spark.createDataFrame(ticks[i * size : (i + 1) * size], cols).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(folder)
    got = sj.final_state(sp.minute_features(stream, RULES, "1 day"), "entity_id", "event_time").collect()
    last = {}
    for name, at, _, price in ticks:
        last[name, int((at - T0).total_seconds()) // 60] = price
    for name in "ab":
        steps = sorted(s for n, s in last if n == name)
        rows = sorted((r for r in got if r.entity_id == name), key=lambda r: r.event_time)
        assert [int((r.event_time - T0).total_seconds()) // 60 for r in rows] == steps
        for r, want in zip(rows, brute(steps, [last[name, s] for s in steps], RULES), strict=True):
            same([r.momentum, r.mean_reversion, r.volatility], want)


MESSAGES = "entity_id string, event_time timestamp, price double, story_hash string, direction int, confidence double"


def test_passes_of_a_capped_sleeve(spark, tmp_path):
    store = Store(spark, str(tmp_path / "ledger"))
    rules = sj.SleeveRules(hold_days=5, stop=0.1, cooldown_days=2, min_confidence=0.3)

    def one(day, number, *rows):
        at = T0 + dt.timedelta(days=day)
        batch = spark.createDataFrame([(n, at, p, s, d, c) for n, p, s, d, c in rows], MESSAGES)
        actions = sp.sleeve_pass(batch, store.read(), rules, 2)
        told = sorted((r.entity_id, r.status, r.reason) for r in actions.collect())
        store.commit(lg.sleeve_facts(actions), applied=("s", number))
        return told

    first = [("a", 10.0, "s1", 1, 0.9), ("b", 10.0, "s2", 1, 0.8), ("c", 10.0, "s3", 1, 0.7),
             ("d", 10.0, "s4", -1, 1.0), ("e", 10.0, "s5", 1, 0.1), ("f", 10.0, None, 1, 0.9)]
    assert one(0, 0, *first) == [("a", "open", None), ("b", "open", None)]  # the cap leaves c out
    version = store.snapshot()["version"]
    store.commit(lg.sleeve_facts(sp.sleeve_pass(
        spark.createDataFrame([("z", T0, 1.0, "s9", 1, 0.9)], MESSAGES), None, rules, 2)), applied=("s", 0))
    assert store.snapshot()["version"] == version  # a replayed pass does nothing
    assert one(1, 1, ("a", 8.0, None, 0, 0.0), ("c", 10.0, "s1", 1, 0.9), ("g", 5.0, "s6", 1, 0.4)) == [
        ("a", "closed", "stop"), ("g", "open", None)]  # s1 was used
    assert one(2, 2, ("a", 8.0, "s7", 1, 0.9)) == []  # no slot is free
    assert one(5, 3, ("a", 8.0, "s8", 1, 0.9)) == [("a", "open", None), ("b", "closed", "horizon")]


def test_evidence_by_intervals(spark):
    history = spark.createDataFrame([(1, "x", 0.01), (2, "x", 0.3), (3, "x", 0.4), (3, "y", float("nan"))],
                                    "k int, signal string, ic double")
    states = sc.evidence(history, ["x", "y"], spark.createDataFrame([(k,) for k in range(4)], "k int"), 0.05)
    got = sorted((r.signal, r.k_from, r.k_to, r.state) for r in sc.evidence_intervals(states).collect())
    assert got == [("x", 0, 1, "cold"), ("x", 1, 2, "pruned"), ("x", 2, None, "measured"), ("y", 0, None, "cold")]
    weights = {(r.k, r.signal): r.weight for r in sc.scorer_weights(states).collect()}
    assert weights[0, "x"] == weights[1, "y"] == 0.5 and weights[3, "x"] == 0.5 and weights[3, "y"] == 0.0
