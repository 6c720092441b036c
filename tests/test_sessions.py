"""Trading days against a walk over a list, previous rows in chunks, looks that are had once."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pitline.functions import calendar as cl
from pitline.operators import events as ev
from pitline.operators import orders as od
from pitline.plans.measures import weekly_slots
from pitline.sources import adapters as ad
from pitline.sources.ledger import SealedLooks


def test_trading_days(spark):
    closed = [dt.date(2020, 1, 1), dt.date(2020, 12, 25), dt.date(2021, 1, 1), dt.date(2020, 7, 4)]
    days = cl.weekdays(spark, "2019-12-20", "2021-01-10")
    calendar = cl.TradingCalendar(cl.without(days, spark.createDataFrame([(d,) for d in closed], "day date")))
    every = [dt.date(2019, 12, 20) + dt.timedelta(days=i) for i in range(388)]
    sessions = [d for d in every if d.weekday() < 5 and d not in closed]
    random.seed(1)
    pairs = [(random.choice(every), random.choice(every), random.randint(-30, 30)) for _ in range(300)]
    pairs += [(d, d, n) for d in (closed[1], dt.date(2020, 2, 1), dt.date(2020, 2, 3)) for n in (-1, 0, 1)]
    pairs += [(dt.date(2030, 1, 1), every[0], 1), (None, every[0], 1)]
    df = spark.createDataFrame(pairs, "a date, b date, n int")
    df = calendar.between(calendar.add(df, "a", "n", "moved"), "a", "b", "gap")

    def moved(day, n):
        if day is None or day > every[-1]:
            return None
        later, earlier = [s for s in sessions if s > day], [s for s in sessions if s < day][::-1]
        if n == 0:
            return day if day in sessions else (later or [None])[0]
        side = later if n > 0 else earlier
        return side[abs(n) - 1] if len(side) >= abs(n) else None

    for r in df.collect():
        assert r.moved == moved(r.a, r.n), r
        if r.a and r.a <= every[-1]:
            after = len([s for s in sessions if r.a < s <= r.b]) - len([s for s in sessions if r.b < s <= r.a])
            assert r.gap == after, r
    assert calendar.add(df.select("a"), "a", 0, "x").where("a = '2020-12-25'").first().x == dt.date(2020, 12, 28)


def test_closing_edges_across_chunks(spark):
    random.seed(2)
    rows, want = [], []
    for market in ("x", "y"):
        was = None
        for i in range(200):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * i)
            state = random.random() < 0.5
            rows.append((market, at, i, state))
            if was and not state:
                want.append((market, i))
            was = state
    clock = spark.createDataFrame(rows, "market string, event_time timestamp, i int, is_open boolean")
    got = od.session_closes(clock.repartition(4), ["market"], ["event_time", "i"])
    assert sorted((r.market, r.i) for r in got.collect()) == want


def test_a_look_is_had_once(spark, tmp_path):
    ledger, asked = SealedLooks(spark, str(tmp_path / "looks")), []

    def measure(t):
        def run(signals):
            asked.append(signals)
            return spark.createDataFrame([(s, 10, 0.1, t, True) for s in signals],
                                         "signal string, n_dates long, mean_ic double, t_stat double, passed boolean")
        return run

    def told(df):
        return {r.signal: (r.t_stat, r.is_repeat) for r in df.collect()}

    day = dt.datetime(2024, 1, 1)
    assert told(ledger.look(["a/b", "c"], measure(1.0), day)) == {"a/b": (1.0, False), "c": (1.0, False)}
    assert told(ledger.look(["c", "d"], measure(9.0), day)) == {"c": (1.0, True), "d": (9.0, False)}
    assert asked == [["a/b", "c"], ["d"]]

    def slow(signals):  # another caller looks while this one measures
        ledger.look(["e"], measure(2.0), day)
        return measure(5.0)(signals)

    assert told(ledger.look(["e"], slow, day)) == {"e": (2.0, True)}


def test_account_totals(spark):
    held = spark.createDataFrame([("A", "x", 2.0, 10.0), ("A", "y", -1.0, 5.0), ("B", "z", 3.0, 1.0)],
                                 "account string, entity_id string, qty double, avg_price double")
    prices = spark.createDataFrame([("x", 11.0), ("y", 6.0)], "entity_id string, price double")
    got = {r.account: (r.market_value, r.deployed, r.unrealized_pnl) for r in od.account_totals(held, prices).collect()}
    assert got == {"A": (16.0, 28.0, 1.0), "B": (3.0, 3.0, 0.0)}


def test_counted_events_equal_repeated_ones(spark, sf):
    inputs = ad.disclosures(spark, sf), ad.congress_trades(spark, sf), weekly_slots(spark, sf)
    by = ["as_of", "event_type", "entity_id", "transaction_type", "n_buys"]
    repeated = ev.detect_events(*inputs).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    counted = ev.event_counts(*inputs).select(*by, "n")
    assert counted.count() and sorted(map(str, counted.collect())) == sorted(map(str, repeated.collect()))
