"""Universes: membership intervals, liquidity screens, named lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def members_at(members: DataFrame, dates: DataFrame) -> DataFrame:
    """Members on each date: ``added <= date < removed``, a null removal is open-ended.

    ``dates`` is ``(as_of)``. The interval is matched by year first, so the join is an equi-join
    with a residual filter instead of comparing every member with every date.
    """
    day = F.col("as_of").cast("date")
    asked = dates.select("as_of", F.year("as_of").alias("_y"))
    last_year = dates.agg(F.max(F.year("as_of"))).scalar()
    first_year = dates.agg(F.min(F.year("as_of"))).scalar()
    low = F.greatest(F.year("added"), first_year)
    high = F.least(F.coalesce(F.year("removed"), last_year), last_year)
    spread = members.where(low <= high).withColumn("_y", F.explode(F.sequence(low, high)))
    return spread.join(asked, "_y").where(
        (F.col("added") <= day) & (F.col("removed").isNull() | (day < F.col("removed")))
    ).select("as_of", "symbol")


def delisted(members: DataFrame) -> DataFrame:
    """Symbols that left the universe."""
    return members.where(F.col("removed").isNotNull()).select("symbol")


def liquidity_screen(
    bars: DataFrame,
    exclude: DataFrame | None = None,
    min_price: float = 5.0,
    min_dollar_volume: float = 2e5,
    max_dollar_volume: float = 1e7,
    min_days: int = 15,
    top_n: int = 400,
) -> DataFrame:
    """The most traded symbols inside the dollar-volume band: ``(symbol, adv)``, best first.

    ``bars`` is ``(symbol, event_time, close, volume)``; zero closes or volumes do not count.
    """
    sym = F.upper("symbol")
    rows = bars.withColumn("symbol", sym)
    if exclude is not None:
        rows = rows.join(exclude.select(F.upper("symbol").alias("symbol")).distinct(), "symbol",
                         "left_anti")
    priced = F.col("close").isNotNull() & (F.col("close") != 0)
    traded = priced & F.col("volume").isNotNull() & (F.col("volume") != 0)
    stats = rows.groupBy("symbol").agg(
        F.avg(F.when(traded, F.col("close") * F.col("volume"))).alias("adv"),
        F.count(F.when(traded, 1)).alias("_n"),
        F.max_by("close", F.when(priced, F.col("event_time"))).alias("_last"),
    )
    kept = stats.where(
        (F.col("_n") >= min_days)
        & (F.col("_last") >= min_price)
        & F.col("adv").between(min_dollar_volume, max_dollar_volume)
    )
    return kept.select("symbol", "adv").orderBy(F.col("adv").desc(), "symbol").limit(top_n)


def filers_only(symbols: DataFrame, filers: DataFrame) -> DataFrame:
    """Tradable symbols that also file."""
    return symbols.join(filers.select("symbol").distinct(), "symbol", "left_semi")


# The named symbol lists and the settings that ask for them.
WATCHLIST = "AAPL MSFT NVDA AMZN GOOGL META JPM XOM".split()
LIQUID = """
AAPL MSFT NVDA AVGO ORCL CRM ADBE AMD INTC CSCO ACN IBM QCOM TXN NOW INTU AMAT MU LRCX ADI
GOOGL META NFLX DIS CMCSA T VZ TMUS CHTR
AMZN TSLA HD MCD NKE LOW SBUX BKNG TJX GM F
PG KO PEP COST WMT PM MO CL MDLZ KMB
UNH JNJ LLY PFE MRK ABBV TMO ABT DHR BMY AMGN CVS MDT GILD ISRG
JPM BAC WFC GS MS C AXP BLK SPGI SCHW USB PNC
CAT HON UPS BA GE RTX UNP LMT DE MMM EMR CSX
XOM CVX COP SLB EOG MPC PSX
LIN APD SHW FCX NEM DOW
NEE DUK SO D AEP
AMT PLD EQIX SPG O
""".split()
EUROPEAN_ADRS = """
ASML SAP STM ERIC NOK NVO AZN NVS GSK SNY UL DEO BTI BUD SHEL BP TTE E EQNR UBS HSBC ING DB RIO
STLA SPOT PHG
""".split()
EUROPE_ETFS = "VGK EZU IEUR FEZ".split()
WATCHLIST_NAMES = ("watchlist", "megacap", "mega")
GLOBAL_NAMES = ("global", "world", "liquid_global")


def resolve_universe(spark: SparkSession, setting: str) -> DataFrame:
    """``(symbol)`` for a universe setting: a named list or a comma-separated one.

    An unknown name means the liquid list.
    """
    if "," in setting:
        text = spark.createDataFrame([(setting,)], "s string")
        each = text.select(F.explode(F.split(F.upper("s"), ",")).alias("symbol"))
        return each.select(F.trim("symbol").alias("symbol")).where(F.col("symbol") != "")
    key = setting.strip().lower()
    symbols = LIQUID
    if key in WATCHLIST_NAMES:
        symbols = WATCHLIST
    elif key in GLOBAL_NAMES:
        symbols = [*LIQUID, *EUROPEAN_ADRS, *EUROPE_ETFS]
    return spark.createDataFrame([(s,) for s in symbols], "symbol string")


def recent_rows(facts: DataFrame, limit: int = 25) -> DataFrame:
    """Newest ``limit`` rows of each dataset in read order."""
    w = W.partitionBy("dataset").orderBy(
        *[F.col(c).desc() for c in ("knowledge_time", "event_time", "source", "entity_id",
                                    "revision", "observation_id")]
    )
    return facts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
