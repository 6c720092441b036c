"""Append-only ledgers kept as facts: predictions, audit, holdout looks, sleeves, drawdown."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline import schema as sm
from pitline.functions.scalars import iso_utc
from pitline.operators.bitemporal import as_of
from pitline.sources.feeds import to_observations
from pitline.sources.store import Files


def prediction_facts(log: DataFrame) -> DataFrame:
    """Prediction rows ``(as_of, entity_id, probability, horizon_days, model_version, features)``."""
    return to_observations(
        log, source="forecast", dataset=sm.PREDICTION, entity=F.col("entity_id"),
        ref=F.col("model_version"), event_time=F.col("as_of"), knowledge_time=F.col("as_of"),
        value={c: F.col(c) for c in ("probability", "horizon_days", "model_version")},
        metadata={"features": F.col("features")},
    )


def load_predictions(facts: DataFrame, knowledge_time, model: str | None = None) -> DataFrame:
    """Predictions knowable by a time, typed, of one model if asked."""
    rows = sm.typed_view(as_of(facts, knowledge_time, dataset=sm.PREDICTION), sm.PREDICTION)
    rows = rows.withColumn("as_of", F.col("event_time"))
    return rows if model is None else rows.where(F.col("model_version") == model)


def audit_facts(log: DataFrame) -> DataFrame:
    """Execution events ``(as_of, entity_id, event, detail map)``."""
    order_id = F.coalesce(F.try_element_at("detail", F.lit("client_order_id")), F.lit(""))
    return to_observations(
        log, source="execution", dataset=sm.AUDIT, entity=F.col("entity_id"),
        ref=F.concat_ws(":", F.col("event"), order_id),
        event_time=F.col("as_of"), knowledge_time=F.col("as_of"),
        value={"event": F.col("event"), "detail": F.col("detail")},
    )


def holdout_facts(looks: DataFrame) -> DataFrame:
    """Looks at the sealed holdout ``(signal, decided_at, n_dates, mean_ic, t_stat, passed)``."""
    return to_observations(
        looks, source="validation", dataset=sm.HOLDOUT, entity_type="signal",
        entity=F.col("signal"),
        ref=F.concat(F.lit("holdout:"), F.date_format("decided_at", "yyyy-MM-dd")),
        event_time=F.col("decided_at"), knowledge_time=F.col("decided_at"),
        value={c: F.col(c) for c in ("n_dates", "mean_ic", "t_stat", "passed")},
    )


def load_looks(facts: DataFrame, knowledge_time) -> DataFrame:
    """Holdout looks knowable by a time."""
    rows = sm.typed_view(as_of(facts, knowledge_time, dataset=sm.HOLDOUT), sm.HOLDOUT)
    return rows.select(
        F.col("entity_id").alias("signal"), F.col("event_time").alias("decided_at"),
        "n_dates", "mean_ic", "t_stat", "passed",
    )


class SealedLooks:
    """The write-once ledger of looks at the sealed holdout: a file per signal that is created once.

    Whoever creates a signal's file has had the one look; everybody else, also one who measured at the
    same time, gets that look back. Signals are a family of tests, so their rows fit the driver.
    """

    LOOK = "signal string, n_dates long, mean_ic double, t_stat double, passed boolean, decided_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def look(
        self, signals: list[str], measure: Callable[[list[str]], DataFrame], decided_at: dt.datetime
    ) -> DataFrame:
        """The look that counts of each signal, and whether it is an earlier one (``is_repeat``).

        ``measure`` is asked for signals nobody has looked at only; it returns the columns of ``LOOK``
        up to ``passed``.
        """
        taken = set(self.files.names(self.path))
        fresh = [s for s in signals if quote(s, safe="") not in taken]
        mine = set()
        for row in measure(fresh).collect() if fresh else []:
            look = row.asDict() | {"decided_at": decided_at.isoformat()}
            if self.files.create_once(f"{self.path}/{quote(row['signal'], safe='')}", json.dumps(look)):
                mine.add(row["signal"])
        return self.spark.createDataFrame(
            [(*self._read(s), s not in mine) for s in signals if self._known(s)],
            self.LOOK + ", is_repeat boolean",
        )

    def _known(self, signal: str) -> bool:
        return quote(signal, safe="") in self.files.names(self.path)

    def _read(self, signal: str) -> tuple:
        look = json.loads(self.files.read(f"{self.path}/{quote(signal, safe='')}"))
        look["decided_at"] = dt.datetime.fromisoformat(look["decided_at"])
        return tuple(look[c.split()[0]] for c in self.LOOK.split(", "))


def sleeve_facts(actions: DataFrame, dataset: str = sm.NEWS_SLEEVE) -> DataFrame:
    """Sleeve openings and closings ``(as_of, entity_id, status, entry_price, exit_by, reason,
    story_hash or n_buys)`` as facts. The reference tells openings from closings."""
    news = dataset == sm.NEWS_SLEEVE
    tag = F.col("story_hash") if news else F.lit("cluster")
    ref = F.when(F.col("status") == "open", tag).otherwise(
        F.concat_ws(":", tag, F.lit("close"), F.col("reason"))
    )
    value = {
        "status": F.col("status"), "entry_price": F.col("entry_price"),
        "exit_by": iso_utc("exit_by"), "reason": F.col("reason"),
    }
    value["story_hash" if news else "n_buys"] = F.col("story_hash" if news else "n_buys")
    return to_observations(
        actions, source="sleeve", dataset=dataset, entity=F.col("entity_id"), ref=ref,
        event_time=F.col("as_of"), knowledge_time=F.col("as_of"), value=value,
    )


def load_sleeve(facts: DataFrame, knowledge_time, dataset: str = sm.NEWS_SLEEVE) -> DataFrame:
    """Sleeve records knowable by a time, typed."""
    rows = sm.typed_view(as_of(facts, knowledge_time, dataset=dataset), dataset)
    return rows.withColumn("exit_by", F.try_to_timestamp("exit_by"))


def drawdown_facts(states: DataFrame) -> DataFrame:
    """High-water marks ``(as_of, peak, tripped)``."""
    return to_observations(
        states, source="execution", dataset=sm.DRAWDOWN, entity_type="portfolio",
        entity=F.lit("PORTFOLIO"), ref=F.lit("drawdown"), event_time=F.col("as_of"),
        knowledge_time=F.col("as_of"), value={"peak": F.col("peak"), "tripped": F.col("tripped")},
    )
