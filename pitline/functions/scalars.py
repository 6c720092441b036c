"""Row-level expressions: clocks, identities, bounded parsers, labels and predicates."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed value: the namespace under which every fact id is derived.
ID_NAMESPACE = "d5a7e3c2-1b4f-4e8a-9c6d-2f0b8a1e7c34"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_close(day, hour: int = 21, minute: int = 0) -> Column:
    """End-of-day stamp of a date (21:00 UTC unless told otherwise)."""
    d = _c(day)
    return F.make_timestamp(
        F.year(d), F.month(d), F.day(d), F.lit(hour), F.lit(minute), F.lit(0)
    )


def utc_timestamp(text) -> Column:
    """Parse a timestamp text that names its offset; text without one gives null."""
    t = F.trim(_c(text))
    return F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(t))


def iso_utc(ts) -> Column:
    """ISO-8601 text of a UTC timestamp; the microseconds appear only when they are not zero."""
    text = F.replace(_c(ts).cast("string"), F.lit(" "), F.lit("T"))
    # The cast drops trailing zeros of the fraction; the ISO text has all six digits or none.
    width = F.when(F.length(text) == 19, 19).otherwise(26)
    return F.concat(F.rpad(text, width, F.lit("0")), F.lit("+00:00"))


def uuid5(name, namespace: str = ID_NAMESPACE) -> Column:
    """Name-based (SHA-1) UUID of a text column, as RFC 4122 lays it out."""
    ns = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(ns, F.encode(_c(name), "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(F.lit("89ab").substr(nibble + 1, F.lit(1)), F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


#: What an id is derived from, in the order of its text; the reference, which may be missing, ends it.
COORDINATES = ("source", "dataset", "entity_id", "event_time", "knowledge_time", "revision", "ref")


def observation_id() -> Column:
    """Id of a fact from its coordinates (not its payload): same fact, same id."""
    return uuid5(
        F.concat_ws(
            "|",
            "source",
            "dataset",
            "entity_id",
            iso_utc("event_time"),
            iso_utc("knowledge_time"),
            F.col("revision").cast("string"),
            F.coalesce(F.col("ref"), F.lit("")),
        )
    )


def coordinates_are_plain() -> Column:
    """Whether no other coordinates spell the same id text: none missing, no separator before the reference."""
    texts = [F.col(c) for c in COORDINATES[:3]]
    present = [F.col(c).isNotNull() for c in COORDINATES[:-1]]
    return reduce(and_, present + [~F.contains(t, F.lit("|")) for t in texts])


def whole_days(later, earlier) -> Column:
    """Whole days between two timestamps, rounded down."""
    gap = F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))
    return F.floor(gap / F.lit(86_400_000_000)).cast("int")


def clip(x, lo: float, hi: float) -> Column:
    """Bound a column; null stays null (``least``/``greatest`` alone would skip it)."""
    c = _c(x)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def number_or_null(text) -> Column:
    """Optional numeric cell: blank and ``N/D`` are gaps, so is anything unparseable."""
    t = F.trim(_c(text).cast("string"))
    return F.when(F.upper(t) != "N/D", t.try_cast("double"))


def high_signal_role(role) -> Column:
    """Leadership or committee roles are informative; an unknown role is not."""
    return F.coalesce(F.lower(_c(role)).rlike("^(leadership|committee)"), F.lit(False))


def story_key(url, title) -> Column:
    """First 16 hex digits of SHA-1 over the article url, or its title without one."""
    text = F.coalesce(F.nullif(_c(url), F.lit("")), F.nullif(_c(title), F.lit("")), F.lit(""))
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def news_confidence(surge, tone, count_surge: float, tone_min: float) -> Column:
    """Half attention surge, half tone; each saturates at twice its threshold."""
    a = F.least(F.lit(1.0), _c(surge) / (2.0 * count_surge)) if count_surge > 0 else F.lit(0.0)
    b = F.least(F.lit(1.0), F.abs(_c(tone)) / (2.0 * tone_min)) if tone_min > 0 else F.lit(0.0)
    return F.round(clip(0.5 * a + 0.5 * b, 0.0, 1.0), 4)


def surprise(actual, consensus, dispersion=None) -> Column:
    """Struct(surprise, standardized, direction) of a print against what was expected."""
    delta = _c(actual) - _c(consensus)
    disp = F.lit(None).cast("double") if dispersion is None else _c(dispersion)
    return F.struct(
        delta.alias("surprise"),
        F.when(disp > 0, delta / disp).alias("standardized"),
        F.signum(delta).cast("int").alias("direction"),
    )


def parse_signal(text) -> Column:
    """Struct(score, confidence, rationale) read from free text, or null when it is malformed.

    The widest ``{...}`` span is read as JSON; prose and code fences around it do not matter.
    """
    body = F.regexp_extract(_c(text), r"(?s)\{.*\}", 0)
    fields = F.from_json(body, "map<string,string>")
    score = F.try_element_at(fields, F.lit("score")).try_cast("double")
    stated = F.try_element_at(fields, F.lit("confidence"))
    has_confidence = F.array_contains(F.map_keys(fields), "confidence")
    confidence = F.when(has_confidence, stated.try_cast("double")).otherwise(F.lit(0.5))
    rationale = F.coalesce(F.try_element_at(fields, F.lit("rationale")), F.lit(""))
    return F.when(
        score.isNotNull() & confidence.isNotNull() & ~F.isnan(score) & ~F.isnan(confidence),
        F.struct(
            clip(score, -1.0, 1.0).alias("score"),
            clip(confidence, 0.0, 1.0).alias("confidence"),
            F.substring(rationale, 1, 300).alias("rationale"),
        ),
    )


def recommendation_confidence(score, analog_n, share_positive) -> Column:
    """Score magnitude (saturating at 2) damped by how often the analogs agreed."""
    s, share = _c(score), F.coalesce(_c(share_positive), F.lit(0.5))
    base = F.least(F.lit(1.0), F.abs(s) / 2.0)
    agree = F.when(s > 0, share).otherwise(1.0 - share)
    return F.round(F.when(F.coalesce(_c(analog_n), F.lit(0)) > 0, base * agree).otherwise(base), 3)


def case_against(score, analog_n, share_positive, q10, n_events) -> Column:
    """The disconfirming evidence for a name, as one text."""
    s, share = _c(score), F.coalesce(_c(share_positive), F.lit(0.5))
    has_analogs = F.coalesce(_c(analog_n), F.lit(0)) > 0
    disagree = ((s > 0) & (share < 0.6)) | ((s < 0) & (share > 0.4))
    percent = F.floor(share * 100).cast("int").cast("string")
    tail = F.round(_c(q10), 3).cast("string")
    parts = F.concat_ws(
        "; ",
        F.when(
            has_analogs & disagree,
            F.concat(F.lit("analogs disagree ("), percent, F.lit("% resolved positive)")),
        ),
        F.when(has_analogs & (_c(q10) < 0), F.concat(F.lit("downside tail q10="), tail)),
        F.when(F.coalesce(_c(n_events), F.lit(0)) == 0, F.lit("no corroborating events")),
        F.when(F.abs(s) < 0.5, F.lit("weak signal magnitude")),
    )
    return F.when(parts == "", F.lit("no major disconfirming evidence found")).otherwise(parts)


@F.pandas_udf(DoubleType())
def normal_two_sided_p(t: pd.Series) -> pd.Series:
    """Two-sided p-value of a t-like statistic under the normal approximation."""
    return t.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def bonferroni_bar(n_trials: pd.Series, alpha: pd.Series) -> pd.Series:
    """The absolute t a single signal must reach when ``n_trials`` were tried."""
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    pairs = zip(n_trials, alpha, strict=True)
    return pd.Series([inv(1.0 - a / (2.0 * max(1, int(m)))) for m, a in pairs])


# The verdict labels of a measured signal, strictest first.
IC_VERDICTS = (
    "[PASS family-wise (Bonferroni+FDR)]",
    "[pass FDR only]",
    "[raw |t|>=2 ONLY — fails correction]",
    "[n.s.]",
)


def ic_verdict(t_stat, bonferroni, fdr) -> Column:
    """Label a measured signal by the strictest correction it survives."""
    family, fdr_only, raw_only, none = (F.lit(v) for v in IC_VERDICTS)
    return (
        F.when(_c(bonferroni), family)
        .when(_c(fdr), fdr_only)
        .when(F.abs(_c(t_stat)) >= 2.0, raw_only)
        .otherwise(none)
    )


def order_problem(qty, order_type, limit_price, ref_price, max_qty=1e7, max_dev=0.2) -> Column:
    """Why an order must not be sent, or null when it looks sane."""
    q, lim, ref = _c(qty), _c(limit_price), _c(ref_price)
    far = (_c(order_type) == "limit") & (ref > 0) & (F.abs(lim - ref) / ref > max_dev)
    return (
        F.when(q.isNull() | F.isnan(q), F.lit("quantity is NaN"))
        .when(q <= 0, F.lit("non-positive quantity"))
        .when(q > max_qty, F.lit("absurd quantity"))
        .when(far, F.lit("limit price far from market"))
    )
