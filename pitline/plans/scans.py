"""Queries that parse raw feed text built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitline import schema as sm
from pitline.operators import bitemporal as bt
from pitline.plans.decisions import _predictions
from pitline.plans.books import Setup
from pitline.plans.reads import bars
from pitline.plans.registry import query, r, shared
from pitline.session import scratch_path
from pitline.sources import adapters as ad
from pitline.sources import feeds as fd
from pitline.sources import landing as ld
from pitline.sources import ledger as lg
from pitline.sources.store import Store


def _day(name="l_shipdate"):
    return F.col(name).cast("date")


def _plain_dates(df):
    """Dates as text: the two engines hand dates to pandas as different types."""
    dates = [f.name for f in df.schema if f.dataType.typeName() == "date"]
    return df.withColumns({c: F.col(c).cast("string") for c in dates})


@query(None, """SELECT 'S' || l_suppkey AS symbol, l_shipdate::DATE::VARCHAR AS date, l_extendedprice AS close, l_quantity AS volume
 FROM lineitem WHERE l_linenumber <> 3""")
def price_csv_scan(spark, sf):
    """One per-symbol file per supplier; line 3 of each order has no close."""
    lines = ad.table(spark, sf, "lineitem")
    file = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".us.csv"))
    close = F.when(F.col("l_linenumber") == 3, "N/D").otherwise(F.col("l_extendedprice").cast("string"))
    rows = lines.select(
        file.alias("file"),
        F.concat_ws(",", _day().cast("string"), F.lit(""), F.lit("1"), F.lit("x"), close,
                    F.col("l_quantity").cast("string")).alias("value"),
    )
    heads = lines.select(file.alias("file")).distinct().withColumn(
        "value", F.lit("Date,Open,High,Low,Close,Volume")
    )
    out = fd.parse_price_lines(rows.unionByName(heads))
    return _plain_dates(out.select("symbol", "date", "close", "volume"))


@query(None, """SELECT 'P' || l_partkey AS symbol, l_shipdate::DATE::VARCHAR AS date, l_extendedprice AS close FROM lineitem
 WHERE l_linenumber <> 2""")
def price_bulk_scan(spark, sf):
    """Bulk files with the ticker in each row; line 2 of each order has a broken date."""
    lines = ad.table(spark, sf, "lineitem")
    date = F.when(F.col("l_linenumber") == 2, "2001-1").otherwise(F.date_format(_day(), "yyyyMMdd"))
    rows = lines.select(
        F.col("l_linestatus").alias("file"),
        F.concat_ws(",", F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".US")),
                    F.lit("D"), date, F.lit("000000"), F.lit("1"), F.lit("1"), F.lit("1"),
                    F.col("l_extendedprice").cast("string"), F.lit("5"), F.lit("0")).alias("value"),
    )
    heads = lines.select(F.col("l_linestatus").alias("file")).distinct().withColumn(
        "value", F.lit("<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>")
    )
    return _plain_dates(fd.parse_price_lines(rows.unionByName(heads)).select("symbol", "date", "close"))


@query("sbars", """SELECT entity_id AS symbol, event_time::DATE::VARCHAR AS date, close FROM sbars""")
def bars_payload_scan(spark, sf):
    page = bars(spark, sf).groupBy("entity_id", F.year("event_time")).agg(
        F.collect_list(
            F.struct(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"),
                     F.col("close").alias("c"), F.col("volume").alias("v"))
        ).alias("b")
    )
    text = F.to_json(F.struct(F.create_map("entity_id", "b").alias("bars")))
    out = fd.parse_bars_payload(page.select(text.alias("payload")))
    return _plain_dates(out.select("symbol", "date", "close"))


@query("sbars", """SELECT entity_id AS symbol, event_time::DATE::VARCHAR AS date, close FROM sbars JOIN supplier ON entity_id =
 'S' || s_suppkey WHERE s_nationkey < 5""")
def grouped_daily_scan(spark, sf):
    page = bars(spark, sf).groupBy(F.to_date("event_time").alias("date")).agg(
        F.to_json(F.struct(F.collect_list(
            F.struct(F.lower("entity_id").alias("T"), F.col("close").alias("c"))
        ).alias("results"))).alias("payload")
    )
    wanted = ad.table(spark, sf, "supplier").where("s_nationkey < 5").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("symbol")
    )
    return _plain_dates(fd.parse_grouped_daily(page, wanted).select("symbol", "date", "close"))


@query("disc", """SELECT entity_id AS symbol, insider_name, CASE WHEN is_purchase THEN 'P' ELSE 'S' END AS transaction_code,
 event_time::DATE::VARCHAR AS transaction_date, knowledge_time::DATE::VARCHAR AS filing_date, date_diff('day', event_time, knowledge_time)
 AS filing_lag_days, is_purchase FROM disc""")
def ownership_xml_scan(spark, sf):
    """Every order line as an ownership document, parsed and turned into facts."""
    rows = ad.disclosures(spark, sf)
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    xml = tag(
        "ownershipDocument",
        tag("issuer", tag("issuerTradingSymbol", F.lower("entity_id"))),
        tag("reportingOwner", tag("reportingOwnerId", tag("rptOwnerName", F.col("insider_name")))),
        tag("nonDerivativeTable", tag(
            "nonDerivativeTransaction",
            tag("transactionDate", tag("value", F.date_format("event_time", "yyyy-MM-dd"))),
            tag("transactionCoding", tag("transactionCode", F.when(F.col("is_purchase"), "P").otherwise("S"))),
            tag("transactionAmounts", tag("transactionShares", tag("value", F.col("shares").cast("string")))),
        )),
    )
    records = fd.parse_ownership(
        rows.select(xml.alias("xml"), F.to_date("knowledge_time").alias("filing_date"))
    )
    view = sm.typed_view(fd.insider_facts(records), sm.INSIDER)
    return view.select(
        F.col("entity_id").alias("symbol"), "insider_name", "transaction_code",
        F.to_date("event_time").alias("transaction_date"), F.to_date("knowledge_time").alias("filing_date"),
        F.col("filing_lag_days").cast("long"), "is_purchase",
    ).transform(_plain_dates)


@query(None, """SELECT symbol, accession, filing_date FROM (SELECT 'C' || o_custkey AS symbol, CAST(o_orderkey AS VARCHAR) AS
 accession, o_orderdate::DATE::VARCHAR AS filing_date, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC,
 CAST(o_orderkey AS VARCHAR)) AS rn FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01')
 WHERE rn <= 3""")
def submissions_scan(spark, sf):
    page = ad.table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate")).agg(
        F.collect_list(F.when(F.col("o_orderstatus") == "F", "4").otherwise("8-K")).alias("form"),
        F.collect_list(F.col("o_orderkey").cast("string")).alias("accessionNumber"),
        F.collect_list(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("filingDate"),
        F.collect_list(F.lit("xsl/doc.xml")).alias("primaryDocument"),
    )
    block = F.struct("form", "accessionNumber", "filingDate", "primaryDocument")
    text = F.to_json(F.struct(F.struct(block.alias("recent")).alias("filings")))
    rows = page.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), text.alias("payload")
    )
    out = fd.parse_submissions(rows, "1997-01-01", 3)
    return _plain_dates(out.select("symbol", "accession", "filing_date"))


@query("earn", """SELECT entity_id AS symbol, event_time::DATE::VARCHAR AS period_end, eps, knowledge_time::DATE::VARCHAR AS filed_date FROM earn""")
def company_facts_scan(spark, sf):
    """Quarterly earnings with a re-report a year later and a full-year row to leave out."""
    rows = ad.earnings(spark, sf)
    end, filed = F.to_date("event_time"), F.to_date("knowledge_time")

    def entry(start, filing, val):
        return F.struct(
            F.date_format(start, "yyyy-MM-dd").alias("start"), F.date_format(end, "yyyy-MM-dd").alias("end"),
            val.alias("val"), F.lit("Q1").alias("fp"), F.date_format(filing, "yyyy-MM-dd").alias("filed"),
        )

    entries = F.array(
        entry(F.date_sub(end, 90), F.date_add(filed, 365), F.col("eps") + 1),
        entry(F.date_sub(end, 90), filed, F.col("eps")),
        entry(F.date_sub(end, 365), F.date_sub(filed, 5), F.col("eps") * 4),
    )
    listed = rows.groupBy("entity_id").agg(F.flatten(F.collect_list(entries)).alias("e"))
    text = F.to_json(
        F.struct(F.struct(F.struct(F.struct(F.struct(F.col("e").alias("USD/shares")).alias("units"))
                 .alias("EarningsPerShareBasic")).alias("us-gaap")).alias("facts"))
    )
    out = fd.parse_company_facts(listed.select(F.col("entity_id").alias("symbol"), text.alias("payload")))
    return _plain_dates(out.select("symbol", "period_end", "eps", "filed_date"))


@query("macro", """SELECT entity_id, event_time + INTERVAL 21 HOUR AS event_time, knowledge_time + INTERVAL 21 HOUR AS
 knowledge_time, value FROM macro WHERE month(event_time) <> 2""")
def macro_scan(spark, sf):
    """Vintage payloads; February is missing."""
    value = F.when(F.month("event_time") == 2, ".").otherwise(F.col("value").cast("string"))
    page = ad.macro_series(spark, sf).groupBy("entity_id").agg(
        F.to_json(F.struct(F.collect_list(F.struct(
            F.date_format("event_time", "yyyy-MM-dd").alias("date"),
            F.date_format("knowledge_time", "yyyy-MM-dd").alias("realtime_start"), value.alias("value"),
        )).alias("observations"))).alias("payload")
    )
    facts = fd.macro_facts(page.select(F.lower("entity_id").alias("series_id"), "payload"))
    view = sm.typed_view(facts, sm.MACRO)
    return view.select("entity_id", "event_time", "knowledge_time", "value")


@query("disc", """SELECT entity_id, count(*) AS n, count_if(high_signal_role)::BIGINT AS high_signal,
 sum(date_diff('day', event_time, knowledge_time))::BIGINT AS lag_days FROM disc GROUP BY 1""")
def congress_scan(spark, sf):
    rows = ad.disclosures(spark, sf)
    records = rows.select(
        F.lower("entity_id").alias("ticker"), "transaction_type", "role",
        F.col("insider_name").alias("representative"), F.lit("house").alias("chamber"),
        F.lit(None).cast("string").alias("party"), F.lit("self").alias("owner"),
        F.lit(1.0).alias("amount_low"), F.col("shares").alias("amount_high"),
        F.to_date("event_time").alias("transaction_date"), F.to_date("knowledge_time").alias("disclosure_date"),
    )
    view = sm.typed_view(fd.congress_facts(records), sm.CONGRESS)
    return view.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("high_signal_role"), 1)).alias("high_signal"),
        F.sum("disclosure_lag_days").alias("lag_days"),
    )


@query("news", """SELECT CASE WHEN event_id % 4 = 0 THEN 'GLOBAL' ELSE 'U' || user_id END AS entity_id, CASE WHEN
 event_id % 4 = 0 THEN 'news_global' ELSE 'equity' END AS entity_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)
 % 21 - 10)::DOUBLE AS tone FROM events WHERE event_id % 9 <> 0 GROUP BY 1, 2""")
def news_scan(spark, sf):
    """Article payloads; every fourth has no symbol, every ninth no readable date."""
    events = ad.table(spark, sf, "events").join(
        ad.news(spark, sf).select("ref", "url", "tone", "title"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")) == F.col("ref"),
    )
    seen = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    article = F.struct(seen.alias("seendate"), "title", "url", F.lit("n").alias("domain"), "tone")
    page = events.select(
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("symbol"),
        F.to_json(F.struct(F.array(article).alias("articles"))).alias("payload"),
    )
    good, _ = fd.parse_articles(page)
    view = sm.typed_view(fd.news_facts(good), sm.NEWS)
    return view.groupBy("entity_id", "entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tone").alias("tone")
    )


@query(None, """SELECT upper(c_name) AS symbol, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer""")
def cik_map_scan(spark, sf):
    rows = ad.table(spark, sf, "customer").groupBy(F.pmod("c_custkey", F.lit(16))).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(
            F.col("c_custkey").cast("string"),
            F.struct(F.col("c_custkey").alias("cik_str"), F.lower("c_name").alias("ticker")),
        )))).alias("payload")
    )
    return fd.parse_cik_map(rows.select("payload"))


@query("members", "SELECT symbol, added::VARCHAR AS added, removed::VARCHAR AS removed FROM members")
def constituents_scan(spark, sf):
    rows = ad.members(spark, sf).groupBy(F.year("added")).agg(
        F.to_json(F.struct(F.collect_list(F.struct(
            F.lower("symbol").alias("symbol"), F.lit("n").alias("name"),
            F.col("added").cast("string").alias("added"), F.col("removed").cast("string").alias("removed"),
        )).alias("constituents"))).alias("payload")
    )
    return _plain_dates(fd.parse_constituents(rows).select("symbol", "added", "removed"))


@query("news", """SELECT 'U' || user_id AS entity_id, ts AS event_time, value AS close FROM events""")
def intraday_facts_scan(spark, sf):
    rows = ad.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("value").alias("close"),
    )
    view = sm.typed_view(fd.intraday_facts(rows), sm.PRICE_INTRADAY)
    return view.select("entity_id", "event_time", "close")


@query("preds", """SELECT as_of, entity_id, round(probability, 6) + 0.0 AS probability, round(meanrev_5, 6) + 0.0 AS meanrev_5
 FROM preds WHERE as_of <= TIMESTAMP '1999-01-01'""")
def prediction_ledger(spark, sf):
    """Predictions written as facts and read back as of a time."""
    facts = lg.prediction_facts(_predictions(Setup(spark, sf)))
    out = lg.load_predictions(facts, "1999-01-01", "composite")
    return out.select("as_of", "entity_id", r("probability").alias("probability"),
                      r(F.try_element_at("features", F.lit("meanrev_5"))).alias("meanrev_5"))


@query("disc", """SELECT entity_id FROM (SELECT entity_id, is_purchase, row_number() OVER (PARTITION BY entity_id
 ORDER BY knowledge_time DESC, observation_id) AS rn FROM (SELECT entity_id, knowledge_time, max(is_purchase) AS is_purchase,
 '' AS observation_id FROM disc WHERE knowledge_time <= TIMESTAMP '2000-01-01' GROUP BY 1, 2)) WHERE rn = 1 AND is_purchase""")
def open_sleeve_positions(spark, sf):
    """Sleeve state from days with a purchase (open) and days without (closed)."""
    days = ad.disclosures(spark, sf).groupBy("entity_id", F.col("knowledge_time").alias("as_of")).agg(
        F.max("is_purchase").alias("_buy")
    )
    actions = days.select(
        "as_of", "entity_id", F.when(F.col("_buy"), "open").otherwise("closed").alias("status"),
        F.lit(1.0).alias("entry_price"), (F.col("as_of") + F.expr("interval 5 days")).alias("exit_by"),
        F.lit("horizon").alias("reason"), F.date_format("as_of", "yyyyMMdd").alias("story_hash"),
    )
    states = lg.load_sleeve(lg.sleeve_facts(actions), "2000-01-01")
    return bt.open_positions(states).select("entity_id")


# Files of one month each: the best price of a part and day. Three in eleven lines can't be used.
LANDED = """WITH b AS (SELECT l_partkey AS p, l_shipdate::DATE AS d, max(l_extendedprice) AS close, (l_partkey +
 day(l_shipdate)) % 11 AS code FROM lineitem GROUP BY ALL)"""


def _deliver(spark, sf, folder, year=None):
    """Write a delivery: all months, or the corrections of one year."""
    lines = ad.table(spark, sf, "lineitem").groupBy("l_partkey", _day().alias("d")).agg(
        F.max("l_extendedprice").alias("close")
    )
    if year:
        lines = lines.where(F.year("d") == year).withColumn("close", F.col("close") + 1)
    code = (F.col("l_partkey") + F.dayofmonth("d")) % 11
    date = F.when(code == 0, "soon").otherwise(F.date_format("d", "yyyyMMdd"))
    close = F.when(code == 1, "N/D").when(code == 2, (-F.col("close")).cast("string")).otherwise(
        F.col("close").cast("string")
    )
    drop = F.date_format("d", "yyyy-MM").alias("drop")
    rows = lines.select(drop, F.concat_ws(
        ",", F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".US")), date, close
    ).alias("value"))
    heads = lines.select(drop).distinct().withColumn("value", F.lit("<TICKER>,<DATE>,<CLOSE>"))
    rows.unionByName(heads).repartition("drop").write.partitionBy("drop").text(folder)


def _landed(spark, sf):
    """(counts per run, store): a run that stops after a group, the rest, nothing new, corrections."""

    def build():
        folder, store = scratch_path(spark), Store(spark, scratch_path(spark))
        _deliver(spark, sf, f"{folder}/first")
        runs = []
        for name, commits in (("first", 1), ("first", None), ("again", None)):
            runs.append((name, ld.ingest_landed(store, folder, commits=commits, group_files=40)))
        _deliver(spark, sf, f"{folder}/second", 1995)
        runs.append(("corrections", ld.ingest_landed(store, folder, group_files=40)))
        counts = [(name, *run.first()) for name, run in runs]  # a row of counts per run
        columns = "run string, " + ", ".join(f"{c} long" for c in runs[0][1].columns)
        return spark.createDataFrame(counts, columns), store

    return shared(spark, sf, "landed", build)


@query(None, f"""{LANDED}, r AS (SELECT 'first' AS run, * FROM b UNION ALL SELECT 'corrections', * FROM b WHERE year(d) = 1995)
 SELECT run, count(DISTINCT date_trunc('month', d)) AS files_taken, count(*) AS n_rows, count_if(code > 2)::BIGINT AS n_facts,
 count_if(code <= 2)::BIGINT AS n_rejected, (CASE run WHEN 'first' THEN count_if(code > 2) ELSE 0 END)::BIGINT AS n_added
 FROM r GROUP BY 1 UNION ALL SELECT 'again', 0, 0, 0, 0, 0""")
def landed_ingest(spark, sf):
    """What each run over the landed files took, the half-done and the resumed one together."""
    runs, _ = _landed(spark, sf)
    counts = ["files_taken", "n_rows", "n_facts", "n_rejected", "n_added"]
    return runs.groupBy("run").agg(*(F.sum(c).alias(c) for c in counts))


@query(None, f"""{LANDED} SELECT 'P' || p AS symbol, d::VARCHAR AS date, close + CASE WHEN year(d) = 1995 THEN 1 ELSE 0 END
 AS close FROM b WHERE code > 2""")
def landed_facts(spark, sf):
    """The stored prices after all runs: corrections replace, other rows are there once."""
    view = sm.typed_view(_landed(spark, sf)[1].read(), sm.PRICE)
    return _plain_dates(
        view.select(F.col("entity_id").alias("symbol"), F.to_date("event_time").alias("date"), "close")
    )


@query(None, f"""{LANDED}, r AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE year(d) = 1995) SELECT CASE code WHEN 0 THEN
 'unreadable date' WHEN 1 THEN 'no close' ELSE 'positive:close' END AS reason, count(*) AS n_rows FROM r WHERE code <= 2 GROUP BY 1""")
def landed_quarantine(spark, sf):
    return _landed(spark, sf)[1].table("quarantine").groupBy("reason").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
