"""Checks on incoming facts and on the freshness of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payload keys that must be finite, those that must be positive, and the dataset
# prefixes whose facts cannot be known before they happen.
NUMERIC_KEYS = ("close", "open", "high", "low", "value", "amount_low", "amount_high")
POSITIVE_KEYS = ("close", "open", "high", "low")
DISCLOSURE_PREFIXES = ("disclosure.", "filing.")

IDENTITY = ["source", "dataset", "entity_id", "event_time", "knowledge_time", "revision"]


def issues(observations: DataFrame) -> DataFrame:
    """One row per failed check: ``(level, check, key, entity_id, observation_id)``.

    Numeric payload keys are read from typed columns; keys the frame lacks are skipped.
    """
    checks = []
    for key in [k for k in NUMERIC_KEYS if k in observations.columns]:
        c = F.col(key).cast("double")
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        checks.append(_issue("error", "finite", key, bad))
        if key in POSITIVE_KEYS:
            checks.append(_issue("error", "positive", key, ~bad & (c <= 0)))
    disclosed = F.lit(False)
    for prefix in DISCLOSURE_PREFIXES:
        disclosed = disclosed | F.col("dataset").startswith(prefix)
    early = disclosed & (F.col("knowledge_time") < F.col("event_time"))
    checks.append(_issue("error", "lag", None, early))
    found = observations.select(
        "entity_id", "observation_id", F.explode(F.array_compact(F.array(*checks))).alias("_i")
    )
    columns = ["_i.level", "_i.check", "_i.key", "entity_id", "observation_id"]
    return found.select(*columns).unionByName(duplicates(observations))


def _issue(level: str, check: str, key: str | None, bad):
    what = F.struct(
        F.lit(level).alias("level"),
        F.lit(check).alias("check"),
        F.lit(key).cast("string").alias("key"),
    )
    return F.when(bad, what)


def failed_check(keys) -> Column:
    """The first of the keys' checks a row fails, such as ``positive:close``; null if none."""
    checks = [F.lit(None).cast("string")]
    for key in keys:
        c = F.col(key).cast("double")
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        checks.append(F.when(bad, f"finite:{key}").when(c <= 0, f"positive:{key}"))
    return F.coalesce(*checks)


def duplicates(observations: DataFrame) -> DataFrame:
    """Every repeat of an identity after its lowest id (a warning each).

    Copies are counted per id first, so a mass of copies of one fact is a number, not rows in
    one task.
    """
    copies = observations.groupBy(*IDENTITY, "observation_id").agg(
        F.count(F.lit(1)).alias("_copies")
    )
    firsts = copies.groupBy(*IDENTITY).agg(
        F.min("observation_id").alias("_first"), F.sum("_copies").alias("_all")
    )
    repeated = firsts.where(F.col("_all") > 1).select(
        *[F.col(c).alias(f"_k_{c}") for c in IDENTITY], "_first"
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in IDENTITY]
    is_first = F.when(F.col("observation_id") == F.col("_first"), 1).otherwise(0)
    extra = copies.join(repeated, same).select(
        "entity_id", "observation_id", (F.col("_copies") - is_first).alias("_repeats")
    )
    return extra.where(F.col("_repeats") > 0).select(
        F.lit("warning").alias("level"),
        F.lit("duplicate").alias("check"),
        F.lit(None).cast("string").alias("key"),
        "entity_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(1).cast("long"), F.col("_repeats")),
                lambda _: F.col("observation_id"),
            )
        ).alias("observation_id"),
    )


def report(observations: DataFrame) -> DataFrame:
    """Issue counts by level and check."""
    return issues(observations).groupBy("level", "check").agg(F.count(F.lit(1)).alias("n_issues"))


def split_good_bad(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts without errors, facts with errors) for lenient ingestion with a quarantine."""
    bad_ids = (
        issues(observations).where(F.col("level") == "error").select("observation_id").distinct()
    )
    return (
        observations.join(bad_ids, "observation_id", "left_anti"),
        observations.join(bad_ids, "observation_id", "left_semi"),
    )


def require_clean(observations: DataFrame) -> DataFrame:
    """Strict mode: raise when any fact fails an error-level check."""
    n = issues(observations).where(F.col("level") == "error").count()
    if n:
        raise ValueError(f"data quality failed: {n} error(s)")
    return observations


def freshness(
    observations: DataFrame, sources: list[str], now, max_age_hours: float = 24.0
) -> DataFrame:
    """Hours since each source last delivered; a source never seen is stale."""
    spark = observations.sparkSession
    asked = spark.createDataFrame([(s,) for s in sources], "source string")
    at = F.lit(now).cast("timestamp")
    last = (
        observations.where(F.col("knowledge_time") <= at)
        .where(F.col("source").isin(sources))
        .groupBy("source")
        .agg(F.max("knowledge_time").alias("last_knowledge_time"))
    )
    hours = (F.unix_micros(at) - F.unix_micros("last_knowledge_time")) / 3.6e9
    return asked.join(last, "source", "left").select(
        "source",
        "last_knowledge_time",
        hours.alias("hours_stale"),
        F.coalesce(hours > max_age_hours, F.lit(True)).alias("stale"),
    )
