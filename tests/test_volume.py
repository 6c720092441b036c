"""What a job moves must grow with its input: bytes shuffled by small jobs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitline.operators import returns as rt
from pitline.operators import sizing as sz
from pitline.operators import study as sd


def shuffled(spark, run) -> int:
    """Bytes that ``run`` writes for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(
            spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_pairs_of_a_group_are_not_shuffled(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 12))
    frame = pd.DataFrame(
        [("g", t, f"n{j:03}", float(x[j, t])) for j in range(400) for t in range(12)],
        columns=["grp", "t", "entity_id", "ret"],
    )
    returns = spark.createDataFrame(frame)
    cov = sz.pairwise_covariance(returns, 4, 200)
    assert shuffled(spark, lambda: cov.write.format("noop").mode("overwrite").save()) < 1_000_000
    assert cov.count() == 400 * 400


def test_covariance_over_pieces_of_dates_with_gaps(spark):
    """Pairs use common dates only; a non-finite return spoils its own pairs alone."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9, 1300))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[3] = np.nan
    x[3, 5] = 1.0  # a single date: no covariance
    rows = [("g", t, f"n{j}", float(x[j, t])) for j in range(9) for t in range(1300) if np.isfinite(x[j, t])]
    rows += [("g", 7, "odd", float("inf")), ("g", 8, "odd", 0.5)]
    x = np.vstack([x, np.full(1300, np.nan)])
    cov = sz.pairwise_covariance(spark.createDataFrame(rows, "grp string, t int, entity_id string, ret double"), 3, 4)
    got = {(r.a, r.b): r["cov"] for r in cov.collect()}
    names = [f"n{j}" for j in range(9)]
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = np.isfinite(x[i]) & np.isfinite(x[j])
            if both.sum() > 1:
                assert got[a, b] == pytest.approx(np.cov(x[i][both], x[j][both])[0, 1], abs=1e-12)
            else:
                assert (a, b) not in got
    assert all(np.isnan(v) for k, v in got.items() if "odd" in k)


def test_placebo_does_not_repeat_a_path_for_every_anchor(spark):
    rng = np.random.default_rng(3)
    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=int(i))
    cars = spark.createDataFrame(
        [(f"E{e}", t, float(v)) for e in range(60) for t, v in enumerate(rng.normal(size=400))],
        "entity_id string, t int, car double",
    )
    rows = [("x", f"E{i % 60}", day(i // 60)) for i in range(4500)] + [("y", "none", day(1)), ("y", "none", day(2))]
    anchors = spark.createDataFrame(rows, "event_type string, entity_id string, anchor timestamp")
    seen = spark.createDataFrame([("x", 4500, 0.0), ("y", 2, 0.0)], "event_type string, n long, mean_car double")
    out = sd.placebo(anchors, cars, seen, 400, 5)
    found = {}
    assert shuffled(spark, lambda: found.update({r.event_type: r for r in out.collect()})) < 2_000_000
    assert found["x"].n_permutations == 5 and abs(found["x"].placebo_mean) < 0.1
    assert found["y"].n_permutations == 0 and found["y"].p_value == 1.0


def test_sortino_without_a_loss_is_undefined(spark):
    rows = [("up", i, 0.01 * (i + 1)) for i in range(4)] + [("mixed", i, v) for i, v in enumerate((0.02, -0.01, 0.03))]
    rows += [("single", 0, 0.1)]
    returns = spark.createDataFrame(rows, "strategy string, event_time int, net double")
    assert {r.sortino for r in rt.summarize(returns).where("strategy = 'up'").collect()} == {0.0}
    out = {r.strategy: r.sortino for r in rt.summarize(returns, no_loss=None).collect()}
    assert out["up"] is None and out["single"] == 0.0
    assert out["mixed"] == pytest.approx((0.04 / 3) / 0.01 * 252**0.5)


def test_versions_of_single_keys_are_not_shuffled(spark):
    """Facts whose key occurs once stay where they are; versions are found over chunks and null keys."""
    import hashlib

    from pitline.operators.bitemporal import with_validity

    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=int(i))
    key = ["entity_id", "event_time", "ref"]
    rows = [(f"E{i}", f"r{i}", day(i % 900), day(i % 900), 0, hashlib.sha256(b"%d" % i).hexdigest()) for i in range(20_000)]
    rows += [("A", None, day(0), day(n), 0, f"a{n}") for n in (1, 40, 400)] + [(None, "x", day(0), day(5), 0, "none")]
    schema = "entity_id string, ref string, event_time timestamp, knowledge_time timestamp, revision int, observation_id string"
    facts = spark.createDataFrame(rows, schema)
    found = {}
    moved = shuffled(spark, lambda: found.update({r.observation_id: r.known_until for r in with_validity(facts, key).collect()}))
    assert moved < 700_000
    assert len(found) == 20_004
    assert {k: v for k, v in found.items() if v} == {"a1": day(40), "a40": day(400)}


def test_lines_of_one_file_stay_spread(spark):
    """Headers go to the lines, so a large file is not read by one task."""
    from pitline.sources import feeds

    lines = spark.range(0, 600_000, 1, 8).select(
        F.lit("all").alias("file"),
        F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(".US,20240102,1.5")).alias("value"),
    )
    head = spark.createDataFrame([("all", "<TICKER>,<DATE>,<CLOSE>")], "file string, value string")
    sizes = []

    def run():
        bars = feeds.price_records(lines.unionByName(head))
        sizes.extend(bars.where("close = 1.5").groupBy(F.spark_partition_id()).count().collect())

    assert shuffled(spark, run) < 100_000
    assert sum(r[1] for r in sizes) == 600_000 and max(r[1] for r in sizes) <= 150_000


def test_scans_read_lines_and_orders_once(spark, sf):
    """Clusters, leadership trades and anchors read the joined disclosures back."""
    from pitline.plans import measures, reads

    found = measures._anchors(spark, sf, reads.weekly_slots(spark, sf))
    assert not [f for f in found.inputFiles() if "lineitem" in f or "orders" in f]


def test_abnormal_returns_of_entities_cut_by_batches(spark):
    """An entity's bars go over batches; every bar with full windows is measured once."""
    rng = np.random.default_rng(5)
    rets = {f"E{i}": rng.normal(0, 0.02, n) for i, n in enumerate((90, 10, 71, 150, 72, 300))}
    start = dt.datetime(2020, 1, 1)
    rows = [(e, t, start + dt.timedelta(days=t), float(r)) for e, v in rets.items() for t, r in enumerate(v, 1)]
    rows += [("E0", 0, start, 0.5), ("gap", 1, start, None)]
    panel = spark.createDataFrame(rows, "entity_id string, t int, event_time timestamp, ret double")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "37")
    try:
        found = {(r.entity_id, r.t): r for r in sd.abnormal_returns(panel).collect()}
    finally:
        spark.conf.set(size, before)
    mean = pd.DataFrame({e: pd.Series(v) for e, v in rets.items()}).mean(axis=1).to_numpy()
    want = {}
    for e, own in rets.items():
        for p in range(65, len(own) - 5):
            beta, alpha = np.polyfit(mean[p - 65:p - 5], own[p - 65:p - 5], 1)
            want[e, p + 1] = (own[p:p + 6] - alpha - beta * mean[p:p + 6]).sum()
    assert found.keys() == want.keys()
    assert all(found[k].car == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_order_plan_sums_the_fills_of_its_book_only(spark, sf, monkeypatch):
    from pitline.plans import decisions

    seen, plan = {}, decisions.od.order_plan

    def spy(targets, prices, positions, open_orders, accounts, rules):
        seen.update(book=targets, held=positions, pending=open_orders)
        return plan(targets, prices, positions, open_orders, accounts, rules)

    monkeypatch.setattr(decisions.od, "order_plan", spy)
    assert decisions.order_plan(spark, sf).count()
    book, held, pending = ({r.entity_id for r in seen[n].select("entity_id").distinct().collect()}
                           for n in ("book", "held", "pending"))
    assert held and held <= book and pending <= book
