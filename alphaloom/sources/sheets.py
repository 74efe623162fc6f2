"""Tables without a trusted header: exported sheets as csv, whose header row or columns have to be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nulls import log_ratio, number
from .tables import normalise_headers, parse_date

#: Header names of the sector sheet and what they are called here: fixed values.
SECTOR_HEADERS = {"ticker": "ticker", "name": "company_name", "gics_sector": "sector", "gics_ind_name": "industry", "gics_subind_name": "sub_industry"}


def headerless(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a csv as text, with `row`, their place in the file. One sheet is small, so its lines are read as one partition."""
    df = spark.read.option("header", "false").csv(path).coalesce(1)
    return df.withColumn("row", F.monotonically_increasing_id())


def find_header(sheet: DataFrame, label: str = "ticker") -> DataFrame:
    """The rows below the first one with a cell `label`, under that row's names; columns without a name are left out."""
    cells = [c for c in sheet.columns if c != "row"]
    match = F.exists(F.array(*cells), lambda x: F.lower(F.trim(x)) == label)
    head = sheet.filter(match).orderBy("row").first()
    if head is None:
        raise ValueError(f"no header row with {label}")
    named = [c for c in cells if head[c] and head[c].strip()]
    body = sheet.filter(F.col("row") > head["row"])
    return normalise_headers(body.select(*(F.col(c).alias(head[c]) for c in named)))


def sector_map(sheet: DataFrame) -> DataFrame:
    """ticker, company_name, sector, industry, sub_industry as text, for `tables.universe`; summary rows without a plain ticker go there."""
    df = find_header(sheet)
    return df.select(*(F.col(c).alias(SECTOR_HEADERS[c]) for c in df.columns if c in SECTOR_HEADERS))


def date_and_price(sheet: DataFrame) -> DataFrame:
    """date, price from the column with the most dates and, of the others, the one with the most positive numbers.

    Rows without both are left out. Prices that are not positive and dates with two prices fail; of equal counts the first
    column stays.
    """
    cells = [c for c in sheet.columns if c != "row"]
    dates = {c: parse_date(F.trim(c)) for c in cells}
    row = sheet.agg(*(F.count(dates[c]).alias(f"d_{c}") for c in cells), *(F.count_if(number(F.col(c)) > 0).alias(f"p_{c}") for c in cells)).first()
    on = max(cells, key=lambda c: row[f"d_{c}"])
    rest = [c for c in cells if c != on]
    price = max(rest, key=lambda c: row[f"p_{c}"], default=None)
    if not row[f"d_{on}"] or price is None or not row[f"p_{price}"]:
        raise ValueError("no date or no price column")
    out = sheet.select(dates[on].alias("date"), number(F.col(price)).alias("price")).dropna()
    by_date = out.groupBy("date").agg(F.min("price").alias("price"), F.max("price").alias("_high"))
    bad = by_date.agg(F.count_if(F.col("price") <= 0).alias("low"), F.count_if(F.col("price") < F.col("_high")).alias("twice")).first()
    if bad["low"] or bad["twice"]:
        raise ValueError(f"{bad['low']} dates with prices that are not positive, {bad['twice']} with two prices")
    return by_date.drop("_high")


def sector_indices(prices: DataFrame, n: int = 126) -> DataFrame:
    """(sector, date, price) with index_return, the log return, and index_momentum, its sum over n full rows."""
    w = Window.partitionBy("sector").orderBy("date")
    out = prices.withColumn("index_return", log_ratio(F.col("price"), F.lag("price").over(w)))
    frame = w.rowsBetween(1 - n, 0)
    return out.withColumn("index_momentum", F.when(F.count("index_return").over(frame) >= n, F.sum("index_return").over(frame)))


def same_index(prices: DataFrame, a: str, b: str) -> bool | None:
    """Whether two sectors have the same prices on all dates that both have, to 1e-5; None where one has none, False without a common date."""
    one = lambda s, c: prices.filter(F.col("sector") == s).select("date", F.col("price").alias(c))
    x, y = one(a, "x"), one(b, "y")
    if x.isEmpty() or y.isEmpty():
        return None
    got = x.join(y, "date").agg(F.bool_and(F.abs(F.col("x") - F.col("y")) <= 1e-8 + 1e-5 * F.abs("y"))).first()
    return bool(got[0])
