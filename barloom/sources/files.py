"""Exchange and index files: typed rows from delimited text.

Each parser takes a DataFrame of string columns named as in the file (what
``spark.read.csv(header=True)`` or ``from_csv`` gives) and returns typed rows;
nothing is inferred. A row of another day than the file's fails the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import as_double, as_text, base_symbol

# Column names of the file formats.
EQUITY_COLS = ("SYMBOL", "SERIES", "DATE1", "PREV_CLOSE", "OPEN_PRICE", "HIGH_PRICE", "LOW_PRICE", "LAST_PRICE", "CLOSE_PRICE",
               "AVG_PRICE", "TTL_TRD_QNTY", "TURNOVER_LACS", "NO_OF_TRADES", "DELIV_QTY", "DELIV_PER")
SECOND_COLS = ("TradDt", "FinInstrmTp", "ISIN", "TckrSymb", "SctySrs", "OpnPric", "HghPric", "LwPric", "ClsPric", "PrvsClsgPric",
               "TtlTradgVol", "TtlTrfVal", "TtlNbOfTxsExctd")
FO_COLS = ("TradDt", "TckrSymb", "FinInstrmTp", "XpryDt", "StrkPric", "OptnTp", "OpnPric", "HghPric", "LwPric", "ClsPric", "LastPric",
           "SttlmPric", "PrvsClsgPric", "UndrlygPric", "OpnIntrst", "ChngInOpnIntrst", "TtlTradgVol", "TtlTrfVal", "TtlNbOfTxsExctd",
           "NewBrdLotQty", "FinInstrmNm")
ISIN_PATTERN = r"^IN[A-Z0-9]{10}$"
EQUITY_TYPE = "STK"


def split_lines(lines: DataFrame, text: str, names) -> DataFrame:
    """One string column per field of a delimited line; other columns stay."""
    schema = ", ".join(f"`{n}` string" for n in names)
    keep = [c for c in lines.columns if c != text]
    return lines.select(*keep, F.from_csv(text, schema, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r")).select(*keep, "r.*")


def trimmed_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def _day(c: str, *formats) -> Column:
    return F.to_date(F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats]))


def one_day(df: DataFrame, day, col: str = "session") -> DataFrame:
    """The same rows; reading them fails if any carries another day."""
    bad = F.assert_true(F.col(col) == F.lit(day).cast("date"), F.lit(f"file of {day} holds rows of another day"))
    return df.where(bad.isNull())


def equity_bars(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.concat(F.upper(F.trim("SYMBOL")), F.lit(".NS")).alias("symbol"), F.trim("SERIES").alias("series"),
        _day("DATE1", "dd-MMM-yyyy").alias("session"),
        *[as_double(c).alias(n) for c, n in (("PREV_CLOSE", "prev_close"), ("OPEN_PRICE", "open"), ("HIGH_PRICE", "high"), ("LOW_PRICE", "low"),
                                             ("CLOSE_PRICE", "close"), ("LAST_PRICE", "last"), ("TTL_TRD_QNTY", "volume"), ("TURNOVER_LACS", "turnover_lacs"),
                                             ("NO_OF_TRADES", "trades"), ("DELIV_QTY", "delivery_qty"), ("DELIV_PER", "delivery_pct"))])


def second_bars(raw: DataFrame) -> DataFrame:
    """Second exchange: equity rows only, keyed by ISIN."""
    e = raw.where(F.trim("FinInstrmTp") == EQUITY_TYPE)
    return e.select(F.upper(F.trim("TckrSymb")).alias("symbol"), F.trim("ISIN").alias("isin"), F.trim("SctySrs").alias("grp"),
                    _day("TradDt", "yyyy-MM-dd").alias("session"),
                    *[as_double(c).alias(n) for c, n in (("OpnPric", "open"), ("HghPric", "high"), ("LwPric", "low"), ("ClsPric", "close"),
                                                         ("PrvsClsgPric", "prev_close"), ("TtlTradgVol", "volume"), ("TtlTrfVal", "turnover"),
                                                         ("TtlNbOfTxsExctd", "trades"))])


def contracts(raw: DataFrame) -> DataFrame:
    num = dict(StrkPric="strike", OpnPric="open", HghPric="high", LwPric="low", ClsPric="close", LastPric="last", SttlmPric="settle",
               PrvsClsgPric="prev_close", UndrlygPric="underlying", OpnIntrst="open_interest", ChngInOpnIntrst="oi_change", TtlTradgVol="volume",
               TtlTrfVal="turnover", TtlNbOfTxsExctd="trades", NewBrdLotQty="lot_size")
    return raw.select(_day("TradDt", "yyyy-MM-dd").alias("trade_date"), F.upper(F.trim("TckrSymb")).alias("symbol"), F.upper(F.trim("FinInstrmTp")).alias("instrument"),
                      _day("XpryDt", "yyyy-MM-dd").alias("expiry"), F.upper(as_text("OptnTp")).alias("option_type"),
                      F.trim("FinInstrmNm").alias("contract"), *[as_double(c).alias(n) for c, n in num.items()])


def contract_reason(tradeable_only: bool = True, min_oi: float = 0.0, drop_incoherent: bool = False) -> Column:
    """Why a contract row is left out; NULL when it is kept."""
    r = F.when(F.col("trade_date").isNull() | (F.length(F.coalesce("symbol", F.lit(""))) == 0), "malformed")
    if tradeable_only:
        r = r.when(F.coalesce("volume", F.lit(0.0)) <= 0, "untraded")
    if min_oi > 0:
        r = r.when(F.coalesce("open_interest", F.lit(0.0)) < min_oi, "open interest")
    if drop_incoherent:
        under = F.greatest(F.col("underlying") - F.col("strike"), F.lit(0.0)) - 0.05
        r = r.when((F.col("option_type") == "CE") & (F.col("close") < under), "below intrinsic")
    return r


def isin_master(raw: DataFrame, order: str = "line") -> DataFrame:
    """base, isin, valid, ambiguous; the last line of a symbol wins.

    An identifier claimed by more than one symbol is ambiguous for all of them.
    """
    r = raw.select(base_symbol("SYMBOL").alias("base"), F.trim("ISIN").alias("isin"), order)
    one = r.groupBy("base").agg(F.max_by("isin", order).alias("isin")).withColumn("valid", F.col("isin").rlike(ISIN_PATTERN))
    claims = one.where("valid").groupBy("isin").agg(F.count(F.lit(1)).alias("claims"))
    return one.join(claims, "isin", "left").select("base", "isin", "valid", (F.coalesce("claims", F.lit(0)) > 1).alias("ambiguous"))


def constituents(raw: DataFrame) -> DataFrame:
    """index, base, industry; blank rows skipped."""
    return (raw.select("index", base_symbol("Symbol").alias("base"), as_text("Industry").alias("industry"), "priority")
            .where((F.length("base") > 0) & F.col("industry").isNotNull()))


def sector_map(rows: DataFrame) -> DataFrame:
    """First industry by file priority; memberships in that order without repeats."""
    return rows.groupBy("base").agg(
        F.min_by("industry", F.struct("priority", "industry")).alias("industry"),
        F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("priority", "index"))), lambda x: x["index"])).alias("indices"))


def sector_coverage(asked: DataFrame, sectors: DataFrame) -> DataFrame:
    a = asked.select(base_symbol("symbol").alias("base"))
    return a.join(sectors.select("base", "industry"), "base", "left").agg(F.count("industry").alias("classified"), F.count(F.lit(1)).alias("asked"))


def daily_bars(raw: DataFrame) -> DataFrame:
    """Plain bar files: lower-case trimmed headers, required columns, typed."""
    d = raw.toDF(*[c.strip().lower() for c in raw.columns])
    missing = sorted({"date", "open", "high", "low", "close"} - set(d.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    rest = [c for c in d.columns if c not in ("date", "open", "high", "low", "close", "volume")]
    nums = [c for c in ("open", "high", "low", "close", "volume") if c in d.columns]
    return d.select(*rest, _day("date", "yyyy-MM-dd", "dd-MMM-yyyy").alias("session"), *[as_double(c).alias(c) for c in nums])


def chart_block(blocks: DataFrame) -> DataFrame:
    """Parallel arrays of one response to bar rows; broken bars are dropped.

    ``blocks``: symbol, gmtoffset, ts (epoch seconds) and the five price arrays.
    """
    z = F.arrays_zip("ts", "open", "high", "low", "close", "volume")
    r = blocks.select("symbol", "gmtoffset", F.explode(z).alias("b")).select("symbol", "gmtoffset", "b.*")
    r = r.where(F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull() & (F.col("high") >= F.col("low")))
    local = F.timestamp_seconds(F.col("ts") + F.col("gmtoffset"))
    return r.select("symbol", F.timestamp_seconds("ts").alias("bar_ts"), "open", "high", "low", "close", "volume", F.to_date(local).alias("session"))


def upsert_session(stored: DataFrame, fetched: DataFrame, keys=("session", "symbol")) -> DataFrame:
    """Rows of re-fetched (session, symbol) are replaced, others stay."""
    return stored.join(fetched.select(*keys).distinct(), list(keys), "left_anti").unionByName(fetched)
