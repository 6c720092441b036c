"""The steps behind strategy_simulation: series of names, risk of many books, returns by paths, routine insiders."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitline.functions import crosssection as cs
from pitline.functions.timeline import Slots, calendar_of, make_schedule
from pitline.operators import features as ft
from pitline.operators import panel as pn
from pitline.operators import returns as rt
from pitline.operators import sizing as sz
from pitline.operators import strategies as st
from pitline.plans import jobs

T0 = dt.datetime(2024, 1, 1)


def day(i):
    return T0 + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def bars(spark):
    """40 dates: gaps, a late start, a price of zero, a flat name and one that ends early."""
    rng = random.Random(3)
    rows = [(f"N{j}", day(i), 100.0 + rng.random() * 10) for j in range(6) for i in range(40) if rng.random() < 0.8]
    rows += [("late", day(i), 50.0 + i) for i in range(30, 40)]
    rows += [("zero", day(i), 0.0 if i == 12 else 10.0 + i % 3) for i in range(40)]
    rows += [("flat", day(i), 7.0) for i in range(20)]
    rows += [("none", day(5), None), ("odd", day(3), 3.0), ("odd", day(9), float("nan")), ("odd", day(11), 4.0)]
    return spark.createDataFrame(rows, "entity_id string, event_time timestamp, close double").repartition(3)


def equal(a, b):
    return a == b or (a is not None and b is not None and np.isnan(a) and np.isnan(b))


def test_price_series_equals_the_dense_panel(spark, bars):
    calendar = calendar_of(bars.where("close IS NOT NULL"))
    at = [0, 1, 7, 21, 39]
    columns = {"ff": F.col("ff"), "ret": F.col("ret"), "mom": pn.momentum(10, 2), "rev": pn.mean_reversion(3),
               "vol": pn.rolling_vol(5, sample=True), "low": pn.rolling_vol(12)}
    panel = pn.dense_panel(bars).withColumns(columns).collect()
    want = {(r.entity_id, r.t): r for r in panel}
    series = pn.price_series(bars, calendar, at, {"vol": (5, True), "low": (12, False)})
    got = {r.entity_id: r for r in series.collect()}
    assert set(got) == {e for e, _ in want} and len(want) == 40 * len(got)
    for (e, t), r in want.items():
        assert equal(got[e].ff[t], r.ff) and equal(got[e].ret[t], r.ret), (e, t)
        if t in at:
            assert equal(got[e].vol[at.index(t)], r.vol) and equal(got[e].low[at.index(t)], r.low), (e, t)
    moves = series.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(39)))).select(
        "entity_id", "t", pn.momentum_at(10, 2).alias("mom"), pn.mean_reversion_at(3).alias("rev")
    )
    for r in moves.collect():
        w = want[r.entity_id, r.t]
        assert equal(r.mom, w.mom) and equal(r.rev, w.rev), r


def test_decision_rows_hold_windows_and_paths(spark, bars):
    calendar = calendar_of(bars.where("close IS NOT NULL"))
    slots = Slots(make_schedule(spark.createDataFrame([(day(i),) for i in (4, 14, 33)], "event_time timestamp")))
    panel = {(r.entity_id, r.t): r for r in pn.dense_panel(bars).collect()}
    got = {(r.entity_id, r.k): r for r in jobs._decision_rows(bars, calendar, slots).collect()}
    assert len(got) == 3 * len({e for e, _ in panel})
    for (e, k), r in got.items():
        t, end = (4, 14, 33)[k], (14, 33, 39)[k]
        xs = [panel[e, i].ret for i in range(max(1, t - 89), t + 1)]
        assert r.t == t and equal(r.ff, panel[e, t].ff)
        assert all(map(equal, r.path, [panel[e, i].ret for i in range(t + 1, end + 1)])) and len(r.path) == end - t
        assert (r.xs is None) == (None in xs) and (r.xs is None or all(map(equal, r.xs, xs)))
    # The general step gives the same windows.
    positions = spark.createDataFrame([(day(i), i) for i in (0, 4, 14, 33)], "as_of timestamp, t int")
    wide = {(r.entity_id, r.as_of): r for r in sz.return_windows(pn.dense_panel(bars), positions).collect()}
    assert set(wide) == {(e, day((4, 14, 33)[k])) for (e, k), r in got.items() if r.xs is not None}
    assert all(len(r.xs) == r.n_obs == (r.as_of - T0).days for r in wide.values())


def test_risk_reads_a_window_once_whatever_the_number_of_books(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 9)) * 0.01
    names = [f"N{j}" for j in range(9)]
    rows = [(T0, n, 30, [float(v) for v in x[:, j]]) for j, n in enumerate(names)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    schema = "as_of timestamp, entity_id string, n_obs int, xs array<double>"
    windows = spark.createDataFrame(rows, schema).mapInPandas(seen, schema)
    weights = [(b, T0, n, float(w)) for b, mine in (("all", names), ("same", names), ("few", names[:3]))
               for n, w in zip(mine, rng.random(9))]
    books = spark.createDataFrame(weights, "strategy string, as_of timestamp, entity_id string, weight double")
    together = {r.strategy: r for r in sz.book_risk(books, windows, 4).collect()}
    assert read.value == 9 and together["few"].n_names == 3 and together["all"].n_obs == 30
    for b in ("all", "same", "few"):
        alone = sz.book_risk(books.where(F.col("strategy") == b), windows, 1).first()
        assert together[b].variance == pytest.approx(alone.variance, rel=1e-12)


def test_path_returns_equal_the_return_table(spark, bars):
    panel = pn.dense_panel(bars)
    calendar = calendar_of(bars.where("close IS NOT NULL"))
    slots = Slots(make_schedule(spark.createDataFrame([(day(i),) for i in (4, 14, 33)], "event_time timestamp")))
    rows = jobs._decision_rows(bars, calendar, slots)
    at = st.at_decisions(panel, slots.schedule)
    books = st.equal_weight(at).unionByName(
        st.equal_weight(at.where("entity_id LIKE 'N%'"), "short").withColumn("weight", -F.col("weight"))
    ).where("entity_id <> 'odd'")
    cols = ["gross", "cost", "net", "turnover"]
    paths = rows.select("k", "entity_id", "path")
    got = rt.path_returns(books, paths, calendar, slots, rt.BORROW).orderBy("strategy", "event_time").collect()
    want = rt.return_table(books, panel, slots, rt.BORROW).orderBy("strategy", "event_time").collect()
    assert len(got) == len(want) == 2 * 35
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and [a[c] for c in cols] == pytest.approx([b[c] for c in cols], abs=1e-12)


def test_top_fraction_with_a_cap_ranks_no_more_rows_than_the_cap(spark):
    rng = random.Random(2)
    rows = [(i % 3, None if i % 17 == 0 else float(rng.randint(0, 5)), f"N{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows + [(9, 1.0, "one"), (9, float("nan"), "two")], "g int, x double, name string")
    got = cs.top_fraction(df, ["g"], "x", "name", 0.3, 20)
    whole = cs.ordered_rank(df, ["g"], "x", "name")
    want = whole.where("rank <= greatest(1, least(20, floor(rank_of * 0.3)))")
    cols = ["g", "name", "x", "rank", "rank_of"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def visible(rows, at):
    return [r for r in rows if r["kt"] <= at and (r["until"] is None or r["until"] > at)]


def test_opportunistic_buys_equal_brute_force(spark):
    """Filings that newer ones replace, insiders who turn routine and back, names that are missing."""
    rng = random.Random(11)
    rows = []
    for i in range(700):
        kt = dt.datetime(rng.randint(2018, 2023), rng.choice([1, 2, 3]), rng.randint(1, 28))
        until = kt + dt.timedelta(days=rng.choice([0, 20, 400, 800])) if rng.random() < 0.1 else None
        who = rng.choice(["a", "b", "c", "d", "", None, *(f"x{j}" for j in range(40))])
        rows.append({"entity_id": rng.choice("AB"), "insider_name": who, "kt": kt, "until": until,
                     "is_purchase": rng.choice([True, False, None]), "i": i})
    df = spark.createDataFrame(
        [(r["entity_id"], r["insider_name"], r["kt"], r["until"], r["is_purchase"]) for r in rows],
        "entity_id string, insider_name string, knowledge_time timestamp, known_until timestamp, is_purchase boolean",
    )
    times = sorted({dt.datetime(2018, 1, 1) + dt.timedelta(days=50 * i) for i in range(45)})
    # Two decision times of one day need the general look-up.
    for extra in ([], [times[20] + dt.timedelta(hours=5)]):
        stamps = [*times, *extra]
        slots = Slots(make_schedule(spark.createDataFrame([(t,) for t in stamps], "event_time timestamp")))
        assert slots.apart == (not extra)
        got = {(r.as_of, r.entity_id): r.insider_net_buys_90d_opp
               for r in ft.insider_net_buys(df, slots, 90, True).collect()}
        want = {}
        for t in stamps:
            known = visible(rows, t)
            key = lambda r: (r["insider_name"], r["kt"].month)
            named = sorted((r for r in known if r["insider_name"]), key=key)
            routine = {k[0] for k, g in itertools.groupby(named, key) if len({r["kt"].year for r in g}) >= 3}
            for r in known:
                if r["insider_name"] not in routine and r["kt"] > t - dt.timedelta(days=90):
                    at = t, r["entity_id"]
                    want[at] = want.get(at, 0) + (1 if r["is_purchase"] else -1)
        assert got == want and len(want) > 30


def test_lines_that_occur_again_are_known_from_the_join(spark, sf):
    """The flag of the joined lines finds the versions that counting the keys finds."""
    from pitline.operators.bitemporal import with_validity
    from pitline.sources import adapters as ad

    lines = ad.disclosure_lines(spark, sf)
    twice = lines.where("l_orderkey % 50 = 0").withColumn("l_shipdate", F.col("l_shipdate") + F.expr("interval 9 days"))
    lines = lines.unionByName(twice).withColumn("again", F.col("again") | (F.col("l_orderkey") % 50 == 0))
    marked = with_validity(ad.disclosures(spark, sf, lines), repeated="again")
    counted = with_validity(ad.disclosures(spark, sf, lines).drop("again"))
    assert marked.columns == counted.columns
    assert marked.exceptAll(counted).count() == 0 and counted.exceptAll(marked).count() == 0
    assert marked.where("known_until IS NOT NULL").count() >= twice.count() > 0
    few = ad.disclosure_lines(spark, "/root/testdata/sf0.01")
    key = ["l_orderkey", "l_linenumber", "l_suppkey", "o_orderdate"]
    assert few.where("again").count() == few.join(few.groupBy(key).count().where("count > 1"), key).count() > 0
