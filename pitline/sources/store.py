"""A fact store with atomic versions.

Facts lie in Parquet folders ``data/commit=<id>/dataset=<d>/month=<m>`` that are never changed. A version is
one small file, ``versions/<number>``, which names the folder that holds each month. Writers fill new
folders first and then publish the next version by renaming a finished file to a name that must not exist
yet. Readers see a version or the one before, whatever fails in between, and of two writers that start
from one version the second merges again. That needs a file system whose rename fails on an existing
name, as HDFS does.

A version also names the folders of other tables that were written with it (landed files, quarantined
rows) and the last batch applied of each stream, so a replayed batch changes nothing. What a version
names is bounded by datasets times months.

Facts may come without ids. Theirs are derived from their coordinates, so none is moved or stored: copies are
found by the coordinates, and the id is worked out where it is read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitline.functions.scalars import COORDINATES, coordinates_are_plain, observation_id
from pitline.session import materialize
from pitline.sources.sink import upsert

#: Rows of a task that writes facts, about.
WRITE_ROWS = 2_000_000
#: Rows per distinct fact of a batch from which its copies are dropped before rows are dealt to writers.
COPIES = 1.25
#: Folders of an appended table before they are merged into one.
FOLDERS = 64
EMPTY = {"version": 0, "schema": None, "partitions": [], "tables": {}, "applied": {}}


class Files:
    """The few file operations Spark's readers and writers lack, on any Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_once(self, path: str, text: str) -> bool:
        """Write a whole file under a name that must not exist; False if it does."""
        fs, target = self._at(path)
        _, part = self._at(f"{path}.{uuid.uuid4().hex}.part")
        fs.mkdirs(target.getParent())
        out = fs.create(part, True)
        out.write(text.encode())
        out.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        no_options = self.jvm.java.lang.reflect.Array.newInstance(
            self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0
        )
        try:
            hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), self.conf).rename(
                fs.makeQualified(part), fs.makeQualified(target), no_options
            )
            return True
        except Exception as exc:  # py4j wraps the Java exception
            fs.delete(part, False)
            if "FileAlreadyExistsException" in str(exc):
                return False
            raise

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Store:
    """The store at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    # --- reading ---

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.path}/versions") if n.isdigit())

    def snapshot(self, version: int | None = None) -> dict:
        """What a version (the newest by default) is made of."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return json.loads(json.dumps(EMPTY))
        return json.loads(self.files.read(f"{self.path}/versions/{version:012d}"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The facts of a version with their month; None while there are none."""
        return self._facts(self.snapshot(version))

    def _facts(self, snapshot: dict, only: set | None = None) -> DataFrame | None:
        parts = [
            p for p in snapshot["partitions"] if only is None or (p["dataset"], p["month"]) in only
        ]
        if not parts:
            return None
        commits = sorted({p["commit"] for p in parts})
        schema = T.StructType.fromJson(json.loads(snapshot["schema"]))
        live = ["|".join((p["commit"], p["dataset"], p["month"])) for p in parts]
        rows = (
            self.spark.read.schema(schema.add("commit", "string"))
            .option("basePath", f"{self.path}/data")
            .parquet(*(f"{self.path}/data/commit={c}" for c in commits))
            .where(F.concat_ws("|", "commit", "dataset", "month").isin(live))
        )
        derived = sorted({p["commit"] for p in parts if p.get("derived")})
        if derived:
            given = F.lit(False) if derived == commits else ~F.col("commit").isin(derived)
            rows = rows.withColumn(
                "observation_id", F.when(given, F.col("observation_id")).otherwise(observation_id())
            )
        return rows.drop("commit")

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """An appended table of a version; None while it has no rows."""
        return self._table(self.snapshot(version), name)

    def _table(self, snapshot: dict, name: str) -> DataFrame | None:
        folders = snapshot["tables"].get(name)
        return self.spark.read.parquet(*(f"{self.path}/{name}/{c}" for c in folders)) if folders else None

    def newest(self, snapshot: dict | None = None) -> int | None:
        """Microseconds of the newest knowledge time, from the version alone."""
        parts = (snapshot or self.snapshot())["partitions"]
        return max((p["newest"] for p in parts), default=None)

    # --- writing ---

    def commit(
        self,
        batch: DataFrame | None = None,
        sequence: str | None = None,
        applied: tuple[str, int] | None = None,
        tables: dict[str, DataFrame] | None = None,
    ) -> dict:
        """Publish the next version: facts of ``batch`` upserted, rows of ``tables`` appended.

        A batch without ``observation_id`` holds facts whose ids are derived. ``sequence`` says in which
        order copies of a fact arrived, the last wins. ``applied`` is the name
        of a stream and the number of the batch; one that was applied before changes nothing.
        Returns the version's content with ``added``, the facts it has more than the one before.
        """
        if batch is not None:
            batch = materialize(batch.withColumn("month", F.date_format("knowledge_time", "yyyyMM")))
        tables = {name: materialize(rows) for name, rows in (tables or {}).items()}
        while True:
            base = self.snapshot()
            if applied and base["applied"].get(applied[0], -1) >= applied[1]:
                return {**base, "added": 0}
            new = self._next(base, batch, sequence, tables)
            if applied:
                new["applied"][applied[0]] = applied[1]
            if self._publish(new):
                held = [sum(p["rows"] for p in s["partitions"]) for s in (base, new)]
                return {**new, "added": held[1] - held[0]}

    def _publish(self, new: dict) -> bool:
        return self.files.create_once(
            f"{self.path}/versions/{new['version']:012d}", json.dumps(new)
        )

    def _next(self, base: dict, batch: DataFrame | None, sequence, tables: dict) -> dict:
        commit = f"c{uuid.uuid4().hex}"
        new = {**base, "version": base["version"] + 1, "applied": dict(base["applied"]),
               "tables": dict(base["tables"])}
        if batch is not None:
            new |= self._merged(base, batch, sequence, commit)
        for name, rows in tables.items():
            folders = new["tables"].get(name, [])
            if len(folders) >= FOLDERS:
                rows, folders = rows.unionByName(self._table(base, name)), []
            rows.write.mode("errorifexists").parquet(f"{self.path}/{name}/{commit}")
            new["tables"][name] = [*folders, commit]
        return new

    def _merged(self, base: dict, batch: DataFrame, sequence: str | None, commit: str) -> dict:
        """Partitions and schema after the months the batch touches were merged into new folders."""
        seen = {"n": F.count(F.lit(1))}
        derived = "observation_id" not in batch.columns
        if derived:
            seen["plain"] = F.min(coordinates_are_plain())
            seen["facts"] = F.approx_count_distinct(F.xxhash64(*COORDINATES))
        counts = batch.groupBy("dataset", "month").agg(*[v.alias(c) for c, v in seen.items()]).collect()
        touched = {(r["dataset"], r["month"]) for r in counts}
        if not touched:
            return {}
        parts = [p for p in base["partitions"] if (p["dataset"], p["month"]) in touched]
        if derived and not (all(r["plain"] for r in counts) and all(p.get("derived") for p in parts)):
            batch, derived = batch.withColumn("observation_id", observation_id()), False
        columns = [c for c in batch.columns if c != sequence]
        stored = self._facts(base, touched)
        old = batch.select(*columns).limit(0) if stored is None else stored.select(*columns)
        tasks = max(1, (sum(r["n"] for r in counts) + sum(p["rows"] for p in parts)) // WRITE_ROWS)
        cell = ["dataset", "month", F.pmod(F.xxhash64("entity_id", "month"), F.lit(tasks))]
        order = ["dataset", "month", "entity_id", "knowledge_time"]
        out = f"{self.path}/data/commit={commit}"
        if derived:
            # One shuffle for both: copies of a fact lie in one cell.
            rest = [c for c in COORDINATES[:-1] if c not in order]
            key = [*order, *rest, F.coalesce("ref", F.lit("")), cell[-1]]
            few = all(r["n"] <= COPIES * r["facts"] for r in counts)
            rows = upsert(old, batch, sequence, key, cell if few else ())
            rows = rows if few else rows.repartition(*cell)
        else:
            rows = upsert(old, batch, sequence).repartition(*cell)
        (
            rows.sortWithinPartitions(*order)
            .write.mode("errorifexists").partitionBy("dataset", "month").parquet(out)
        )
        schema = T.StructType(
            ([T.StructField("observation_id", T.StringType())] if derived else [])
            + [f for f in batch.select(*columns).schema if f.name not in ("dataset", "month")]
            + [T.StructField("dataset", T.StringType()), T.StructField("month", T.StringType())]
        )
        written = self.spark.read.schema(schema).parquet(out).groupBy("dataset", "month").agg(
            F.count(F.lit(1)).alias("rows"), F.max(F.unix_micros("knowledge_time")).alias("newest")
        )
        mark = {"commit": commit} | ({"derived": True} if derived else {})
        fresh = [{**r.asDict(), **mark} for r in written.collect()]
        kept = [p for p in base["partitions"] if (p["dataset"], p["month"]) not in touched]
        return {"schema": schema.json(), "partitions": kept + fresh}

    def vacuum(self, keep: int = 10) -> list[str]:
        """Delete what none of the newest ``keep`` versions names; not while a writer is at work."""
        versions = self.versions()
        snapshots = [self.snapshot(v) for v in versions[-keep:]]
        for v in versions[:-keep]:
            self.files.delete(f"{self.path}/versions/{v:012d}")
        live = {p["commit"] for s in snapshots for p in s["partitions"]}
        gone = []
        for name in self.files.names(f"{self.path}/data"):
            if name.startswith("commit=") and name.removeprefix("commit=") not in live:
                gone.append(f"data/{name}")
        for table in {t for s in snapshots for t in s["tables"]}:
            used = {c for s in snapshots for c in s["tables"].get(table, [])}
            gone += [f"{table}/{n}" for n in self.files.names(f"{self.path}/{table}") if n not in used]
        for folder in gone:
            self.files.delete(f"{self.path}/{folder}")
        return gone


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The facts of the newest version with their month; None while nothing is stored."""
    return Store(spark, path).read()


def upsert_store(spark: SparkSession, path: str, batch: DataFrame, sequence: str | None = None) -> dict:
    """Upsert a batch as one version. A fact's id holds its dataset and knowledge time, so all copies
    of it are in one month; months the batch doesn't touch aren't read."""
    return Store(spark, path).commit(batch, sequence)
