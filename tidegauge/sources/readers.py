"""Text sources, read as distributed CSV or JSON and cleaned column by column.

Every file is read as strings first and cast with ``try_cast`` semantics, so one bad
field is a NULL and never a failed job. Directories and lists of paths work
throughout. ``keys`` names columns that tell series apart in files of many.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.functions.scalars import date_text, grouped_number, month_end, percent_text, quarter_label
from tidegauge.operators.vintage import REF, REL, first_release, keep_first, one_per_release


def _csv(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def gamma_csv(spark, path, keys=()):
    """``date, gex`` -> date, gex_value; unreadable rows dropped."""
    df = _csv(spark, path)
    return df.select(*keys, date_text("date").alias("date"), F.col("gex").try_cast("double").alias("gex_value")) \
             .dropna(subset=["date", "gex_value"])


def freight_csvs(spark, paths):
    """``Date`` (M/D/YYYY) and ``Price`` of many files -> one row per date.

    A date found twice keeps the row of the first file by name.
    """
    df = _csv(spark, paths).select(
        date_text("Date", "M/d/yyyy").alias("date"), grouped_number("Price").alias("value"),
        F.col("_metadata.file_path").alias("file"))
    return keep_first(df.dropna(), ["date"], ["file", "value"]).drop("file")


PUT_CALL = ["date", "equity_call_volume", "equity_put_volume", "equity_total_volume", "equity_pc_ratio"]


def put_call_csv(spark, path, pattern="M/d/yyyy", keys=()):
    """Preamble, header, then DATE, CALL, PUT, TOTAL, P/C Ratio, and the keys if any.

    Whatever has no date in the first field is preamble or header, so files need not
    be scanned for where their table begins and may be split anywhere.
    """
    raw = spark.read.schema(", ".join(f"{c} string" for c in [*PUT_CALL, *keys])).csv(path)
    numbers = [grouped_number(c).alias(c) for c in PUT_CALL[1:]]
    return raw.select(*keys, date_text("date", pattern).alias("date"), *numbers).dropna(subset=["date"])


def fear_greed_json(spark, path, keys=()):
    """``[{"date": ..., "value": ...}]`` -> reference_date, release_date, value.

    ``keys`` are folder names, as in ``series_id=x/``.
    """
    raw = spark.read.schema("date string, value string").option("multiLine", True).json(path)
    day = F.to_date(F.try_to_timestamp("date"))
    return raw.select(*keys, day.alias(REF), day.alias(REL), F.col("value").try_cast("double").cast("long").alias("value")) \
              .dropna(subset=[REF, "value"])


# fixed values: the three arrays of a confidence file, in file order
CONFIDENCE = ("smci_pct_dmci_ratio", "smci_value", "dmci_value")


def confidence_json(spark, path, keys=()):
    """``[[[date, value], ...] x 3]`` -> three columns side by side by date (and ``keys``, folders of the path)."""
    text = spark.read.option("wholetext", True).text(path)
    arrays = F.from_json("value", "array<array<array<string>>>")
    rows = (text.select(*keys, arrays.alias("a")).where(F.size("a") == 3)
                .select(*keys, F.posexplode("a").alias("which", "points"))
                .select(*keys, "which", F.explode("points").alias("p"))
                .select(*keys, "which", F.to_date(F.try_to_timestamp(F.get("p", F.lit(0)))).alias("date"),
                        F.get("p", F.lit(1)).try_cast("double").alias("v")))
    return rows.dropna(subset=["date"]).groupBy(*keys, "date").agg(*[
        F.max(F.when(F.col("which") == i, F.col("v"))).alias(n) for i, n in enumerate(CONFIDENCE)])


# fixed values: survey headings and their names
SURVEY = {"Bullish": "bullish_pct", "Neutral": "neutral_pct", "Bearish": "bearish_pct", "Total": "total_pct",
          "Bullish 8 Week MA": "bullish_8wk_ma_pct", "Bull-Bear Spread": "bull_bear_spread_pct"}


def survey_csv(spark, path, pattern="M/d/yyyy"):
    """Percent survey; released at the next month end. Absent columns become NULL."""
    df = _csv(spark, path)
    day = date_text("Date", pattern)
    cols = [percent_text(F.col(f"`{h}`")).alias(n) if h in df.columns else F.lit(None).cast("double").alias(n)
            for h, n in SURVEY.items()]
    return df.select(day.alias(REF), month_end(day, 1).alias(REL), *cols).dropna(subset=[REF])


# fixed values: margin headings and their names
MARGIN = {"Debit Balances in Customers' Securities Margin Accounts": "debit_balances_margin_accounts",
          "Free Credit Balances in Customers' Cash Accounts": "free_credit_cash_accounts",
          "Free Credit Balances in Customers' Securities Margin Accounts": "free_credit_margin_accounts"}


def margin_csv(spark, path, keys=()):
    """Monthly balances keyed ``YYYY-MM``, dated at the month end, released a month later."""
    df = _csv(spark, path)
    day = month_end(date_text("Year-Month", "yyyy-MM"))
    cols = [grouped_number(F.col(f"`{h}`"), "bigint").alias(n) if h in df.columns else F.lit(None).cast("bigint").alias(n)
            for h, n in MARGIN.items()]
    return df.select(*keys, day.alias(REF), month_end(day, 1).alias(REL), *cols).dropna(subset=[REF])


# fixed values: names a provider may give to the columns of a bar
BAR_ALIASES = {
    "date": ("Date", "Timestamp", "datetime"), "open": ("Open", "1. open"), "high": ("High", "2. high"),
    "low": ("Low", "3. low"), "close": ("Close", "4. close"),
    "adjusted_close": ("Adj Close", "Adjusted Close", "5. adjusted close"), "volume": ("Volume", "6. volume")}
BAR_TYPES = {"date": "date", "volume": "bigint"}


def _key(name):
    return name if isinstance(name, Column) else F.lit(name)


def normalise_bars(df: DataFrame, ticker):
    """Any provider's bars as date, prices, volume, ticker (a name, or a column of names).

    The first matching name of a column wins; adjusted_close falls back to close, as a
    whole column when absent and row by row when missing. Other absences are errors.
    """
    found = {}
    for name, aliases in BAR_ALIASES.items():
        hits = [c for c in (name, *aliases) if c in df.columns]
        if hits:
            found[name] = F.col(f"`{hits[0]}`").try_cast(BAR_TYPES.get(name, "double"))
    missing = [n for n in BAR_ALIASES if n not in found and n != "adjusted_close"]
    if missing:
        raise ValueError(f"bars of {ticker} lack {missing}; found {df.columns}")
    found["adjusted_close"] = F.coalesce(found["adjusted_close"], found["close"]) if "adjusted_close" in found else found["close"]
    return df.select(*[found[n].alias(n) for n in BAR_ALIASES], _key(ticker).alias("ticker"))


def normalise_vintages(df: DataFrame, series_id):
    """``date, realtime_start, value`` -> distinct reference/release/value rows.

    ``series_id``: a name, or a column of names.
    """
    return df.select(
        F.col("date").try_cast("date").alias(REF), F.col("realtime_start").try_cast("date").alias(REL),
        F.col("value").try_cast("double").alias("value"), _key(series_id).alias("series_id")) \
        .dropna(subset=[REF, REL]).dropDuplicates([REF, REL, "value", "series_id"])


# fixed values: series -> (table, cleaned to first releases, extra column, its value)
SERIES = {
    "PAYEMS": ("non_farm_payrolls", False, None, None),
    "ICSA": ("initial_jobless_claims", False, None, None),
    "CPIAUCSL": ("cpi", False, None, None),
    "RGDPQOQFOR": ("gdp_forecasts", False, "forecast_period", None),
    "RSAFS": ("retail_sales", False, None, None),
    "M2SL": ("m2_money_supply", False, None, None),
    "HOUST": ("housing_starts", False, None, None),
    "CSUSHPINSA": ("housing_prices", False, None, None),
    "UMCSENT": ("consumer_confidence", False, None, None),
    "BAMLC0A0CM": ("corporate_bond_oas", True, None, None),
    "T10Y2Y": ("treasury_yield_spreads", True, "spread_type", "10Y-2Y"),
    "T10Y3M": ("treasury_yield_spreads", True, "spread_type", "10Y-3M"),
    "DTWEXBGS": ("dxy_raw_fred", True, None, None),
    "DTWEXM": ("dxy_raw_fred", True, None, None),
    "DCOILWTICO": ("oil_raw_fred", True, None, None),
    "DCOILBRENTEU": ("oil_raw_fred", True, None, None),
}


def ingest_series(vintages: DataFrame, config: dict = SERIES):
    """All configured series in one pass, each with its table and derived columns.

    ``vintages``: series_id, reference_date, release_date, value. The configuration is
    a handful of rows, written into the plan as a broadcast table.
    """
    need = {"series_id", REF, REL, "value"} - set(vintages.columns)
    if need:
        raise ValueError(f"vintages lack {sorted(need)}")
    rows = [(s, t, c, v if e == "spread_type" else None, e == "forecast_period") for s, (t, c, e, v) in config.items()]
    table = vintages.sparkSession.createDataFrame(
        rows, "series_id string, table_name string, first_only boolean, spread_type string, by_quarter boolean")
    df = vintages.join(F.broadcast(table), "series_id")
    keys = ["series_id", "table_name", "spread_type", "by_quarter"]
    dated = one_per_release(df.where("first_only").dropna(subset=[REF, REL]), ["value"], keys)
    cleaned = first_release(dated, ["value"], keys, suffix="")
    whole = df.where("not first_only").select(*keys, REF, REL, "value")
    both = whole.unionByName(cleaned)
    return both.select("table_name", "series_id", REF, REL, "value", "spread_type",
                       F.when(F.col("by_quarter"), quarter_label(REF)).alias("forecast_period"))


def union_all(frames):
    return reduce(DataFrame.unionByName, frames)
