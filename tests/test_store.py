"""Versions of the store that survive failures, replays and other writers; landed files."""

import datetime as dt

import pytest

from pitline.sources import landing
from pitline.sources.store import Store, upsert_store
from pitline.streaming import jobs as sj

COLS = "observation_id string, dataset string, entity_id string, knowledge_time timestamp, v int"
AT = dt.datetime(2020, 1, 1)


def facts(spark, *rows):
    return spark.createDataFrame([(i, d, "x", at, v) for i, d, at, v in rows], COLS)


def held(store, version=None):
    rows = store.read(version)
    return {} if rows is None else {r.observation_id: r.v for r in rows.collect()}


def test_upserts_and_earlier_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read() is None and store.newest() is None
    may = AT.replace(month=5)
    store.commit(facts(spark, ("1", "a", AT, 1), ("2", "b", AT, 2)))
    upsert_store(spark, store.path, facts(spark, ("2", "b", AT, 9)))
    assert held(store) == {"1": 1, "2": 9}
    assert held(store, 1) == {"1": 1, "2": 2}
    copies = spark.createDataFrame(
        [("2", "b", "y", AT, 7, 1), ("2", "b", "y", AT, 8, 2), ("3", "b", "y", may, 1, 3)], COLS + ", seq int"
    )
    assert store.commit(copies, "seq")["added"] == 1
    assert held(store) == {"1": 1, "2": 8, "3": 1}
    assert "seq" not in store.read().columns
    assert store.newest() == int(may.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert store.commit(facts(spark))["version"] == 4  # an empty batch is a version, too
    assert held(store) == {"1": 1, "2": 8, "3": 1}
    assert store.vacuum(keep=1) and store.versions() == [4]
    assert held(store) == {"1": 1, "2": 8, "3": 1}


def test_a_failure_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    store.commit(facts(spark, ("1", "a", AT, 1)))
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda self, new: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit(facts(spark, ("1", "a", AT, 5), ("2", "a", AT, 6)))
    assert held(store) == {"1": 1} and store.versions() == [1]
    store.commit(facts(spark, ("1", "a", AT, 5), ("2", "a", AT, 6)))
    assert held(store) == {"1": 5, "2": 6}
    assert len(store.vacuum(keep=2)) == 1  # what the failed writer left


def test_the_second_of_two_writers_merges_again(spark, tmp_path, monkeypatch):
    store, other = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    store.commit(facts(spark, ("1", "a", AT, 1)))
    publish, tries = Store._publish, []

    def late(self, new):
        if self is store and not tries:
            tries.append(1)
            other.commit(facts(spark, ("2", "a", AT, 2)))
        return publish(self, new)

    monkeypatch.setattr(Store, "_publish", late)
    store.commit(facts(spark, ("3", "a", AT, 3)))
    assert held(store) == {"1": 1, "2": 2, "3": 3} and store.versions() == [1, 2, 3]


def test_facts_without_ids(spark, tmp_path):
    """Derived ids are neither moved nor stored, and the store reads as if they had been."""
    from pitline.functions.scalars import observation_id

    cols = ("source string, dataset string, entity_id string, ref string, event_time timestamp, "
            "knowledge_time timestamp, revision int, v int, seq long")
    row = lambda e, v, seq=0, ref=None, day=2, source="s": (
        source, "d", e, ref, AT, AT.replace(day=day), 0, v, seq)
    batches = [
        [row("a", 1), row("a", 2, 5), row("a", 3, 4), row("a", 4, ref="r"), row("b", 5), row("b", 6, day=3)],
        [row("a", 7, ref=""), row("b", 8, day=3), *(row("c", i, i) for i in range(20))],  # mostly copies
        [row("b|x", 9), row("x", 10, source="s|d"), row("b", 11), row("x", 12, source=None)],  # ids are needed
        [row("c", 13), row("b|x", 14)],
    ]
    plain, given = (Store(spark, str(tmp_path / n)) for n in ("plain", "given"))
    values = lambda s: sorted((r.observation_id, r.v) for r in s.read().collect())
    for i, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, cols)
        added = [plain.commit(batch, "seq")["added"],
                 given.commit(batch.withColumn("observation_id", observation_id()), "seq")["added"]]
        assert values(plain) == values(given) and added[0] == added[1]
        if i == 1:
            assert "observation_id" not in spark.read.parquet(f"{plain.path}/data").columns
    assert {v for _, v in values(plain)} == {4, 7, 8, 10, 11, 12, 13, 14}


def test_names_are_created_once(spark, tmp_path):
    files = Store(spark, str(tmp_path)).files
    assert files.create_once(f"{tmp_path}/x/look", "first")
    assert not files.create_once(f"{tmp_path}/x/look", "second")
    assert files.read(f"{tmp_path}/x/look") == "first"
    assert files.names(f"{tmp_path}/x") == ["look"]


def test_streams_resume_without_repeating(spark, tmp_path, monkeypatch):
    """A batch that fails before it is published starts again; late rows are listed once."""
    folder, late, marks = (str(tmp_path / n) for n in ("in", "late", "marks"))
    store = Store(spark, str(tmp_path / "store"))
    schema = spark.createDataFrame([], COLS).schema
    days = [AT.replace(day=20), AT.replace(day=2), AT.replace(day=21)]
    publish = Store._publish

    def run():
        stream = spark.readStream.schema(schema).parquet(folder)
        sj.ingest(stream, store.path, late=late, name="s", marks=marks)

    def fails(self, new):
        raise OSError("lost")

    facts(spark, ("a", "d", days[0], 1)).write.parquet(folder)
    run()
    facts(spark, ("b", "d", days[1], 2), ("c", "d", days[2], 3)).write.mode("append").parquet(folder)
    monkeypatch.setattr(Store, "_publish", fails)
    with pytest.raises(Exception):
        run()
    assert held(store) == {"a": 1}
    monkeypatch.setattr(Store, "_publish", publish)
    run()
    assert held(store) == {"a": 1, "b": 2, "c": 3}
    assert [r.observation_id for r in spark.read.parquet(late).collect()] == ["b"]
    base = store.snapshot()
    assert store.commit(facts(spark, ("c", "d", days[2], 9)), applied=("s", 1))["version"] == base["version"]
    assert held(store)["c"] == 3


def test_landed_files(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    (folder / "deep [x]").mkdir(parents=True)
    (folder / "aa.us.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,1,5,9\n2020-01-03,1,2,1,N/D,9\n")
    (folder / "deep [x]" / "b b.txt").write_text(
        "<TICKER>,<DATE>,<CLOSE>\nAA.US,20200102,7\nBB.US,soon,1\nBB.US,20200103,-4\n,20200104,4\n"
    )
    (folder / "headless.csv").write_text("2020-01-02,1\n")
    (folder / "empty.csv").write_text("")
    (folder / "notes.md").write_text("Date,Close\n2020-01-02,1\n")
    count = lambda run: tuple(run.first())  # noqa: E731  seen, taken, changed, rows, facts, rejected, added
    seen, some, *_ = count(landing.ingest_landed(store, str(folder), commits=1, group_files=1))
    assert seen == 3 and 0 < some < 3  # Spark's reader shows no empty files
    assert count(landing.ingest_landed(store, str(folder), group_files=2))[1] == 3 - some
    assert count(landing.ingest_landed(store, str(folder))) == (3, 0, 0, 0, 0, 0, 0)
    reasons = sorted(r.reason for r in store.table("quarantine").collect())
    assert reasons == ["no close", "no header", "no symbol", "positive:close", "unreadable date"]
    closes = lambda: {(r.entity_id, r.event_time.day): r.value_json for r in store.read().collect()}
    assert list(closes()) == [("AA", 2)] and '"close":7.0' in closes()["AA", 2]  # the later path
    (folder / "aa.us.csv").write_text("Date,Close\n2020-01-02,6\n2020-01-06,8\n")
    assert count(landing.ingest_landed(store, str(folder))) == (3, 1, 1, 2, 2, 0, 1)
    assert '"close":6.0' in closes()["AA", 2] and len(closes()) == 2
    assert store.table("landed").count() == 4
