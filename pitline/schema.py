"""The one fact table and the payload of each dataset.

A fact row carries two clocks: when it was true (``event_time``) and when it could first be
known (``knowledge_time``). Corrections are new rows with a higher ``revision``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBSERVATION_DDL = (
    "observation_id string, source string, dataset string, entity_type string, "
    "entity_id string, ref string, event_time timestamp, knowledge_time timestamp, "
    "revision int, value_json string, metadata_json string, ingested_at timestamp"
)

LOGICAL_KEY = ["source", "dataset", "entity_id", "event_time", "ref"]
READ_ORDER = ["knowledge_time", "event_time", "source", "dataset", "entity_id", "revision"]

# Dataset names and the keys of their payloads.
PRICE = "price.ohlcv"
PRICE_INTRADAY = "price.ohlcv.intraday"
INSIDER = "filing.form4"
FUNDAMENTAL = "fundamental.quarterly"
MACRO = "macro.series"
CONGRESS = "disclosure.congress_trade"
NEWS = "news.article"
TEXT_SIGNAL = "llm.signal"
PREDICTION = "forecast.prediction"
HOLDOUT = "validation.holdout_ledger"
NEWS_SLEEVE = "sleeve.news_position"
INSIDER_SLEEVE = "sleeve.insider_position"
DRAWDOWN = "risk.drawdown_state"
AUDIT = "execution.audit"

PAYLOADS = {
    PRICE: "close double, open double, high double, low double, volume double, adj_close double",
    PRICE_INTRADAY: "close double, open double, high double, low double, volume double",
    INSIDER: "transaction_code string, is_purchase boolean, shares double, "
    "price_per_share double, insider_name string, insider_title string",
    FUNDAMENTAL: "eps double, fiscal_period string",
    MACRO: "value double, series_id string",
    CONGRESS: "transaction_type string, amount_low double, amount_high double, "
    "representative string, chamber string, party string",
    NEWS: "title string, url string, source string, tone double",
    TEXT_SIGNAL: "score double, confidence double, rationale string",
    PREDICTION: "probability double, horizon_days int, model_version string",
    HOLDOUT: "n_dates int, mean_ic double, t_stat double, passed boolean",
    NEWS_SLEEVE: "status string, entry_price double, exit_by string, story_hash string, "
    "reason string",
    INSIDER_SLEEVE: "status string, entry_price double, exit_by string, n_buys int, "
    "reason string",
    DRAWDOWN: "peak double, tripped boolean",
    AUDIT: "event string, detail map<string,string>",
}

METADATA = {
    INSIDER: "filing_lag_days int, parser_version int",
    CONGRESS: "role string, owner string, high_signal_role boolean, disclosure_lag_days int, "
    "parser_version int",
    PREDICTION: "features map<string,double>",
}


def typed_view(observations: DataFrame, dataset: str) -> DataFrame:
    """Rows of one dataset with the JSON payload parsed once into typed columns."""
    rows = observations.where(F.col("dataset") == dataset)
    rows = rows.withColumn("_v", F.from_json("value_json", PAYLOADS[dataset]))
    keep = [c for c in rows.columns if c not in ("_v", "value_json", "metadata_json")]
    # ``source`` names a fact column and, for news, a payload key: the payload one is renamed.
    fields = [f.split()[0] for f in _top_level(PAYLOADS[dataset])]
    payload = [F.col(f"_v.{f}").alias(f"article_{f}" if f == "source" else f) for f in fields]
    if dataset in METADATA:
        rows = rows.withColumn("_m", F.from_json("metadata_json", METADATA[dataset]))
        payload += [F.col(f"_m.{f.split()[0]}") for f in _top_level(METADATA[dataset])]
    return rows.select(*keep, *payload)


def _top_level(ddl: str) -> list[str]:
    """Split a DDL string at commas that are not inside angle brackets."""
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]
