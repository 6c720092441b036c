"""Landed raw feeds (CSV, JSON, XML text) to fact rows.

Parsers take a DataFrame with the raw text and give typed records; ``*_facts`` turn records into
rows of the fact table. Malformed input gives no rows instead of an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline import schema as sm
from pitline.functions.scalars import (
    day_close,
    high_signal_role,
    number_or_null,
    observation_id,
    utc_timestamp,
)
from pitline.session import materialize


def to_observations(
    records: DataFrame,
    *,
    source: str,
    dataset: str,
    entity: Column,
    event_time: Column,
    knowledge_time: Column,
    value: dict[str, Column],
    entity_type: Column | str = "equity",
    ref: Column | None = None,
    revision: Column | None = None,
    metadata: dict[str, Column] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows of the fact table with derived ids; null payload keys are left out of the JSON.

    ``keep`` names columns of the records that are carried along behind those of the fact table.
    """
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    body = F.to_json(F.struct(*[c.alias(k) for k, c in value.items()]))
    extra = metadata or {}
    meta = F.to_json(F.struct(*[c.alias(k) for k, c in extra.items()])) if extra else F.lit("{}")
    rows = records.select(
        F.lit(source).alias("source"),
        F.lit(dataset).alias("dataset"),
        kind.alias("entity_type"),
        entity.alias("entity_id"),
        (F.lit(None).cast("string") if ref is None else ref).alias("ref"),
        event_time.alias("event_time"),
        knowledge_time.alias("knowledge_time"),
        (F.lit(0) if revision is None else revision.cast("int")).alias("revision"),
        body.alias("value_json"),
        meta.alias("metadata_json"),
        F.current_timestamp().alias("ingested_at"),
        *keep,
    )
    names = [part.split()[0] for part in sm.OBSERVATION_DDL.split(", ")]
    return rows.withColumn("observation_id", observation_id()).select(*names, *keep)


def _version() -> dict[str, Column]:
    return {"parser_version": F.lit(1)}


# --- price files -------------------------------------------------------------------------------


def symbol_from_filename(name: str) -> Column:
    """Ticker from a file name: no extension, no ``.us`` part, no ``_us_d`` style suffix."""
    stem = F.regexp_extract(F.col(name), r"([^/]*)$", 1)
    return F.upper(F.regexp_replace(F.split(stem, r"\.")[0], r"(?i)(_us_d|_us|_d)$", ""))


def read_price_files(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Daily bars from the CSV/TXT files directly under ``path`` (or one file).

    Files with a ticker column carry their own symbols; the others are named after theirs.
    ``symbol`` overrides the name and is meant for a single file.
    """
    lines = (
        spark.read.option("ignoreCorruptFiles", "true")
        .option("pathGlobFilter", "*.{csv,txt,CSV,TXT}")
        .text(path)
        .select(F.col("_metadata.file_name").alias("file"), "value")
    )
    return parse_price_lines(lines, symbol)


def parse_price_lines(lines: DataFrame, symbol: str | None = None) -> DataFrame:
    """``(file, value)`` text lines of either price layout to ``(symbol, date, open..volume)``."""
    return price_records(lines, symbol).where("reason is null").drop("file", "line", "reason")


#: The names a price file may give its columns.
PRICE_COLUMNS = [
    "<TICKER>", "<DATE>", "Date",
    *(n for c in ("Open", "High", "Low", "Close") for n in (f"<{c.upper()}>", c)), "<VOL>", "Volume",
]


def price_records(lines: DataFrame, symbol: str | None = None) -> DataFrame:
    """Every data line of price files: its bar and, if it can't be used, the ``reason``.

    The header of each file is the line that names its date column; rows are read by its names.
    The headers are written first, so that Spark knows they are few and sends them to the rows: a
    join by file would put all rows of a file into one task.
    """
    text = F.trim(F.regexp_replace("value", "\r$", ""))
    rows = lines.select("file", text.alias("line")).where(text != "")
    header = F.col("line").rlike(r"(?i)(^|,)(<DATE>|Date)(,|$)")
    names = F.split(F.min("line"), ",")
    places = {n: F.array_position("_names", n) - 1 for n in PRICE_COLUMNS}
    heads = materialize(
        rows.where(header).groupBy("file").agg(names.alias("_names")).select(
            "file",
            (F.array_contains("_names", "<TICKER>") | F.array_contains("_names", "<DATE>")).alias("_bulk"),
            *[place.cast("int").alias(f"_at_{n}") for n, place in places.items()],
        )
    )
    cells = rows.where(~header).join(heads, "file", "left").withColumn("_cells", F.split("line", ","))

    def cell(*names: str) -> Column:
        return F.coalesce(*[F.get("_cells", F.col(f"_at_{n}")) for n in names])

    bulk = F.coalesce(F.col("_bulk"), F.lit(False))
    own = F.upper(F.split(F.trim(cell("<TICKER>")), r"\.")[0])
    named = symbol_from_filename("file") if symbol is None else F.lit(symbol.upper())
    raw_date = F.trim(cell("<DATE>", "Date"))
    date = F.when(
        bulk, F.when(raw_date.rlike(r"^\d{8}$"), F.try_to_timestamp(raw_date, F.lit("yyyyMMdd")))
    ).otherwise(F.try_to_timestamp(raw_date, F.lit("yyyy-MM-dd")))
    bars = cells.select(
        "file", "line", F.col("_bulk").isNull().alias("_headless"),
        F.when(bulk, own).otherwise(named).alias("symbol"),
        date.cast("date").alias("date"),
        *[
            number_or_null(cell(f"<{short}>", long)).alias(long.lower())
            for short, long in (
                ("OPEN", "Open"), ("HIGH", "High"), ("LOW", "Low"), ("CLOSE", "Close"),
                ("VOL", "Volume"),
            )
        ],
    )
    reason = (
        F.when(F.col("_headless"), "no header").when(F.col("date").isNull(), "unreadable date")
        .when(F.col("close").isNull(), "no close")
        .when(F.coalesce("symbol", F.lit("")) == "", "no symbol")
    )
    return bars.withColumn("reason", reason).drop("_headless")


def price_facts(bars: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Daily bars ``(symbol, date, close, ...)``; both clocks read the close of the day."""
    stamp = day_close("date")
    keys = [k for k in ("close", "open", "high", "low", "volume", "adj_close") if k in bars.columns]
    return to_observations(
        bars.where(F.col("close").isNotNull()),
        source="price", dataset=sm.PRICE, entity=F.upper("symbol"),
        event_time=stamp, knowledge_time=stamp,
        value={k: F.col(k).cast("double") for k in keys}, metadata=_version(), keep=keep,
    )


def intraday_facts(bars: DataFrame, source: str = "price") -> DataFrame:
    """Minute bars ``(symbol, timestamp text, close, ...)`` at their exact time."""
    keys = [k for k in ("close", "open", "high", "low", "volume") if k in bars.columns]
    stamped = bars.withColumn("_ts", utc_timestamp("timestamp"))
    return to_observations(
        stamped.where(F.col("close").isNotNull() & F.col("_ts").isNotNull()),
        source=source, dataset=sm.PRICE_INTRADAY, entity=F.upper("symbol"),
        event_time=F.col("_ts"), knowledge_time=F.col("_ts"),
        value={k: F.col(k).cast("double") for k in keys}, metadata={"timeframe": F.lit("intraday")},
    )


_BAR = "struct<t:string,o:double,h:double,l:double,c:double,v:double>"


def parse_bars_payload(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Pages of ``{"bars": {symbol: [bar, ...]}}`` to one row per bar."""
    parsed = F.from_json(text, f"bars map<string, array<{_BAR}>>")
    each = payloads.select(F.explode(parsed["bars"]).alias("symbol", "_bars"))
    bar = each.select("symbol", F.explode("_bars").alias("b"))
    return bar.select(
        "symbol",
        F.col("b.t").alias("timestamp"),
        F.substring("b.t", 1, 10).try_cast("date").alias("date"),
        *[F.col(f"b.{k}").alias(n) for k, n in
          (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))],
    )


def parse_grouped_daily(
    payloads: DataFrame, wanted: DataFrame, text: str = "payload", day: str = "date"
) -> DataFrame:
    """``(date, payload)`` with all tickers of a day, kept for the ``wanted`` symbols."""
    parsed = F.from_json(
        text,
        "results array<struct<T:string,o:double,h:double,l:double,c:double,v:double>>",
        {"caseSensitive": "true"},
    )
    rows = payloads.select(F.col(day).alias("date"), F.explode(parsed["results"]).alias("r"))
    bars = rows.select(
        F.upper("r.T").alias("symbol"), "date",
        *[F.col(f"r.{k}").alias(n) for k, n in
          (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))],
    ).where(F.col("close").isNotNull())
    keep = wanted.select(F.upper("symbol").alias("symbol")).distinct()
    return bars.join(keep, "symbol", "left_semi")


# --- filings -----------------------------------------------------------------------------------


def parse_cik_map(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """``{n: {ticker, cik_str}}`` to ``(symbol, cik)`` with a 10-digit key."""
    rows = payloads.select(
        F.explode(F.map_values(F.from_json(text, "map<string, struct<cik_str:long,ticker:string>>")))
        .alias("r")
    )
    return rows.select(
        F.upper("r.ticker").alias("symbol"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0")
        .alias("cik"),
    ).distinct()


_BLOCK = (
    "struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,"
    "primaryDocument:array<string>>"
)


def parse_submissions(
    payloads: DataFrame, cutoff, max_filings: int = 60, text: str = "payload"
) -> DataFrame:
    """Filing index pages ``(symbol, payload)`` to the newest form-4 filings since ``cutoff``.

    A page is the main index (``filings.recent``) or a shard with the same parallel arrays.
    """
    parsed = payloads.select(
        "symbol",
        F.from_json(text, f"filings struct<recent:{_BLOCK}>")["filings"]["recent"].alias("_main"),
        F.from_json(text, _BLOCK).alias("_shard"),
    )
    block = F.when(F.col("_main.form").isNotNull(), F.col("_main")).otherwise(F.col("_shard"))
    rows = parsed.select("symbol", block.alias("b")).select(
        "symbol",
        F.explode(
            F.arrays_zip("b.form", "b.accessionNumber", "b.filingDate", "b.primaryDocument")
        ).alias("f"),
    )
    filings = rows.select(
        "symbol",
        F.col("f.accessionNumber").alias("accession"),
        F.to_date(F.try_to_timestamp(F.col("f.filingDate"), F.lit("yyyy-MM-dd"))).alias("filing_date"),
        F.regexp_extract("f.primaryDocument", r"([^/]*)$", 1).alias("document"),
        F.col("f.form").alias("form"),
    ).where((F.col("form") == "4") & (F.col("filing_date") >= F.lit(cutoff).cast("date")))
    newest = W.partitionBy("symbol").orderBy(F.col("filing_date").desc(), "accession")
    ranked = filings.withColumn("_rn", F.row_number().over(newest))
    return ranked.where(F.col("_rn") <= max_filings).drop("_rn", "form")


_VALUE = "struct<value:string>"
_OWNERSHIP = (
    "issuer struct<issuerTradingSymbol:string>, "
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerName:string>,"
    "reportingOwnerRelationship:struct<officerTitle:string>>>, "
    "nonDerivativeTable struct<nonDerivativeTransaction:array<struct<"
    f"transactionDate:{_VALUE},transactionCoding:struct<transactionCode:string>,"
    f"transactionAmounts:struct<transactionShares:{_VALUE},transactionPricePerShare:{_VALUE}>>>>"
)


def parse_ownership(documents: DataFrame, text: str = "xml") -> DataFrame:
    """Ownership XML ``(xml, filing_date[, fallback_ticker])`` to one row per transaction."""
    fallback = (
        F.col("fallback_ticker") if "fallback_ticker" in documents.columns
        else F.lit(None).cast("string")
    )
    doc = documents.select(
        F.col("filing_date").cast("date").alias("filing_date"),
        fallback.alias("_fallback"),
        F.from_xml(text, _OWNERSHIP, {"mode": "PERMISSIVE"}).alias("d"),
    )
    rows = doc.select(
        "filing_date", "_fallback", "d.issuer", F.get("d.reportingOwner", F.lit(0)).alias("o"),
        F.explode("d.nonDerivativeTable.nonDerivativeTransaction").alias("t"),
    )

    def clean(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    out = rows.select(
        F.upper(F.coalesce(clean(F.col("issuer.issuerTradingSymbol")), F.col("_fallback")))
        .alias("symbol"),
        F.coalesce(clean(F.col("o.reportingOwnerId.rptOwnerName")), F.lit("unknown"))
        .alias("insider_name"),
        clean(F.col("o.reportingOwnerRelationship.officerTitle")).alias("insider_title"),
        clean(F.col("t.transactionCoding.transactionCode")).alias("transaction_code"),
        F.to_date(F.try_to_timestamp(clean(F.col("t.transactionDate.value")), F.lit("yyyy-MM-dd")))
        .alias("transaction_date"),
        "filing_date",
        F.col("t.transactionAmounts.transactionShares.value").try_cast("double").alias("shares"),
        F.col("t.transactionAmounts.transactionPricePerShare.value").try_cast("double")
        .alias("price_per_share"),
    )
    return out.where(
        (F.col("symbol") != "")
        & F.col("transaction_code").isNotNull()
        & F.col("transaction_date").isNotNull()
    )


def insider_facts(records: DataFrame) -> DataFrame:
    """Insider transactions; knowable at the close of the filing date."""
    return to_observations(
        records, source="edgar", dataset=sm.INSIDER, entity=F.upper("symbol"),
        ref=F.concat_ws("|", "insider_name", "transaction_code"),
        event_time=day_close("transaction_date"), knowledge_time=day_close("filing_date"),
        value={
            "transaction_code": F.col("transaction_code"),
            "is_purchase": F.upper("transaction_code") == "P",
            "shares": F.col("shares"),
            "price_per_share": F.col("price_per_share"),
            "insider_name": F.col("insider_name"),
            "insider_title": F.col("insider_title"),
        },
        metadata={
            "filing_lag_days": F.datediff("filing_date", "transaction_date"), **_version()
        },
    )


_EPS = (
    "struct<units:struct<`USD/shares`:array<struct<start:string,end:string,val:double,"
    "fp:string,filed:string>>>>"
)


def parse_company_facts(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Company facts ``(symbol, payload)`` to quarterly earnings per share.

    Diluted earnings if present, else basic; periods of 80 to 100 days; per quarter end the
    earliest filing.
    """
    parsed = F.from_json(
        text,
        "facts struct<`us-gaap`:struct<"
        f"EarningsPerShareDiluted:{_EPS},EarningsPerShareBasic:{_EPS}>>",
    )["facts"]["us-gaap"]
    units = F.coalesce(parsed["EarningsPerShareDiluted"], parsed["EarningsPerShareBasic"])
    rows = payloads.where(F.coalesce(F.col("symbol"), F.lit("")) != "").select(
        F.upper("symbol").alias("symbol"), F.explode(units["units"]["USD/shares"]).alias("e")
    )

    def date(c: str) -> Column:
        return F.to_date(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")))

    dated = rows.select(
        "symbol", date("e.start").alias("start"), date("e.end").alias("period_end"),
        date("e.filed").alias("filed_date"), F.col("e.val").alias("eps"),
        F.col("e.fp").alias("fiscal_period"),
    ).where(F.col("eps").isNotNull() & F.col("filed_date").isNotNull())
    quarters = dated.where(F.datediff("period_end", "start").between(80, 100))
    return quarters.groupBy("symbol", "period_end").agg(
        F.min_by(F.struct("filed_date", "eps", "fiscal_period"),
                 F.struct("filed_date", "eps")).alias("f")
    ).select("symbol", "period_end", "f.*")


def earnings_facts(records: DataFrame) -> DataFrame:
    """One fact per fiscal quarter, knowable when it was filed."""
    return to_observations(
        records, source="sec_xbrl", dataset=sm.FUNDAMENTAL, entity=F.upper("symbol"),
        ref=F.date_format("period_end", "yyyy-MM-dd"),
        event_time=day_close("period_end"), knowledge_time=day_close("filed_date"),
        value={"eps": F.col("eps"), "fiscal_period": F.col("fiscal_period")}, metadata=_version(),
    )


def macro_facts(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Vintages ``(series_id, payload)``; a dot or blank is missing; known at its vintage date."""
    rows = payloads.select(
        F.upper("series_id").alias("series_id"),
        F.explode(
            F.from_json(
                text, "observations array<struct<date:string,realtime_start:string,value:string>>"
            )["observations"]
        ).alias("o"),
    )
    known = rows.select(
        "series_id", F.col("o.date").try_cast("date").alias("date"),
        F.col("o.realtime_start").try_cast("date").alias("vintage"),
        F.col("o.value").try_cast("double").alias("value"),
    ).where(
        F.col("value").isNotNull() & F.col("date").isNotNull() & F.col("vintage").isNotNull()
    )
    return to_observations(
        known, source="fred", dataset=sm.MACRO, entity_type="macro_series",
        entity=F.col("series_id"), event_time=day_close("date"),
        knowledge_time=day_close("vintage"),
        value={"value": F.col("value"), "series_id": F.col("series_id")}, metadata=_version(),
    )


def congress_facts(records: DataFrame) -> DataFrame:
    """Trades of office holders, knowable when disclosed."""
    return to_observations(
        records, source="congress", dataset=sm.CONGRESS, entity=F.upper("ticker"),
        ref=F.concat_ws("|", "representative", "transaction_type"),
        event_time=day_close("transaction_date"), knowledge_time=day_close("disclosure_date"),
        value={
            c: F.col(c)
            for c in ("transaction_type", "amount_low", "amount_high", "representative",
                      "chamber", "party")
        },
        metadata={
            "role": F.col("role"),
            "owner": F.col("owner"),
            "high_signal_role": high_signal_role("role"),
            "disclosure_lag_days": F.datediff("disclosure_date", "transaction_date"),
            **_version(),
        },
    )


def parse_articles(payloads: DataFrame, text: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Article lists ``(symbol, payload)`` to (articles, rows whose seen-date is unreadable)."""
    rows = payloads.select(
        "symbol",
        F.explode(
            F.from_json(
                text,
                "articles array<struct<seendate:string,title:string,url:string,domain:string,"
                "tone:double>>",
            )["articles"]
        ).alias("a"),
    )
    digits = F.substring("a.seendate", 1, 8)
    seen = F.when(
        digits.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))
    )
    out = rows.select(
        "symbol", seen.alias("seendate"), F.coalesce("a.title", F.lit("")).alias("title"),
        F.col("a.url").alias("url"), F.col("a.domain").alias("source_name"),
        F.col("a.tone").alias("tone"),
    )
    return out.where(F.col("seendate").isNotNull()), out.where(F.col("seendate").isNull())


def news_facts(articles: DataFrame) -> DataFrame:
    """Articles as facts; one without a symbol belongs to the global entity."""
    linked = F.coalesce(F.trim("symbol"), F.lit("")) != ""
    stamp = day_close("seendate")
    return to_observations(
        articles, source="gdelt", dataset=sm.NEWS,
        entity_type=F.when(linked, "equity").otherwise("news_global"),
        entity=F.when(linked, F.upper("symbol")).otherwise("GLOBAL"),
        ref=F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("title")),
        event_time=stamp, knowledge_time=stamp,
        value={"title": F.col("title"), "url": F.col("url"), "source": F.col("source_name"),
               "tone": F.col("tone")},
        metadata=_version(),
    )


def text_signal_facts(signals: DataFrame) -> DataFrame:
    """Extracted reads ``(symbol, knowledge_time, score, confidence, rationale)`` as facts."""
    sym = F.upper("symbol")
    return to_observations(
        signals, source="llm", dataset=sm.TEXT_SIGNAL, entity=sym,
        ref=F.concat_ws(":", sym, F.date_format("knowledge_time", "yyyy-MM-dd")),
        event_time=F.col("knowledge_time"), knowledge_time=F.col("knowledge_time"),
        value={c: F.col(c) for c in ("score", "confidence", "rationale")}, metadata=_version(),
    )


def parse_constituents(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Constituent file to membership intervals ``(symbol, name, added, removed)``."""
    rows = payloads.select(
        F.explode(
            F.from_json(
                text,
                "constituents array<struct<symbol:string,name:string,added:string,removed:string>>",
            )["constituents"]
        ).alias("c")
    )
    return rows.select(
        F.upper("c.symbol").alias("symbol"), F.col("c.name").alias("name"),
        F.col("c.added").try_cast("date").alias("added"),
        F.col("c.removed").try_cast("date").alias("removed"),
    )


def synthetic_bars(
    spark: SparkSession, symbols: list[str], start: str, n_days: int, seed: int = 7,
    start_price: float = 100.0,
) -> DataFrame:
    """Seeded daily bars on weekdays: drift + beta x common factor + noise, compounded.

    Draws are hashes of (seed, what, where), so they do not depend on partitioning.
    """
    def uniform(*parts) -> Column:
        h = F.xxhash64(F.lit(seed), *[F.lit(p) if isinstance(p, str) else p for p in parts])
        return (F.pmod(h, F.lit(2**52)).cast("double") + 0.5) / float(2**52)

    def normal(*parts) -> Column:
        radius = F.sqrt(-2.0 * F.log(uniform("r", *parts)))
        return radius * F.cos(2.0 * F.pi() * uniform("a", *parts))

    days = spark.range(n_days * 7 // 5 + 7).select(
        F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date")
    ).where(F.weekday("date") < 5).orderBy("date").limit(n_days)
    grid = days.withColumn("symbol", F.explode(F.array(*[F.lit(s) for s in symbols])))
    sym, day = F.col("symbol"), F.col("date").cast("string")
    drift = 0.0003 + 0.0002 * normal("drift", sym)
    vol = 0.010 + 0.010 * uniform("vol", sym)
    beta = -1.0 + 2.0 * uniform("beta", sym)
    ret = drift + beta * 0.005 * normal("factor", day) + vol * normal("noise", sym, day)
    path = W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return grid.withColumn("ret", ret).withColumn(
        "close", start_price * F.exp(F.sum(F.log1p("ret")).over(path))
    )
