"""Readers and writers: explicit layouts, NULL for what does not parse."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nulls import log_ratio, number

#: Share-class aliases: fixed values.
ALIASES = {"BRK-B": "BRK.B", "BRK/B": "BRK.B", "BRK B": "BRK.B", "BF-B": "BF.B", "BF/B": "BF.B", "BF B": "BF.B"}


def read_table(spark: SparkSession, path: str, recursive: bool = False, sep: str | None = None) -> DataFrame:
    """csv, tsv, txt or parquet by suffix; a folder is read as one scan."""
    kind = re.search(r"\.(csv|tsv|txt|parquet)/?$", path)
    if not kind:
        raise ValueError(f"unknown layout: {path}")
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if kind[1] == "parquet":
        return reader.parquet(path)
    return normalise_headers(reader.option("header", "true").option("sep", sep or {"csv": ",", "tsv": "\t"}.get(kind[1], ",")).csv(path))


def preview(spark: SparkSession, path: str, rows: int = 5) -> DataFrame:
    return read_table(spark, path).limit(rows)


def write_table(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if path.endswith(".csv") else writer.parquet(path)


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """A short text, such as a report or a list of columns, as one part file of a folder."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown(title: str, df: DataFrame, rows: int = 20) -> list[str]:
    """A heading and the first rows of a table: a report."""
    shown = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return [*lines, *("| " + " | ".join(map(shown, r)) + " |" for r in df.limit(rows).collect()), ""]


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(re.sub(r"_+", "_", re.sub(r"[\s\-/.]+", "_", c.strip().lower())).strip("_") for c in df.columns))


def first_present(df: DataFrame, names: list[str]) -> Column | None:
    return next((F.col(n) for n in names if n in df.columns), None)


def ticker(raw: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Upper case, vendor suffix and extra blanks gone, share-class aliases applied."""
    plain = F.regexp_replace(F.upper(F.trim(F.regexp_replace(raw, r"\s+", " "))), r" (US )?EQUITY$", "")
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(table[plain], F.regexp_replace(plain, "/", "."))


def ticker_from_file(spark_df: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of many files with the ticker of their file name: the stem, or what precedes `_` or a blank, if in the universe."""
    stem = F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))
    rows = spark_df.withColumn("_stem", stem).withColumn("_head", F.regexp_extract("_stem", r"^([^_ ]+)", 1))
    known = universe.select(F.col("ticker").alias("_t")).distinct()
    exact = rows.join(known, F.col("_stem") == F.col("_t"), "left").withColumnRenamed("_t", "_exact")
    both = exact.join(known, F.col("_head") == F.col("_t"), "left")
    return both.withColumn("ticker", F.coalesce("_exact", "_t")).filter("ticker IS NOT NULL").drop("_stem", "_head", "_exact", "_t")


def parse_timestamp(raw: Column) -> Column:
    """The four layouts of price files, then whatever Spark's own cast reads; NULL for the rest, which callers count."""
    known = (F.try_to_timestamp(raw, F.lit(f)) for f in ("MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"))
    return F.coalesce(*known, F.try_to_timestamp(raw))


def parse_date(raw: Column) -> Column:
    return F.coalesce(*(F.to_date(F.try_to_timestamp(raw, F.lit(f))) for f in ("MM/dd/yyyy", "yyyy-MM-dd")))


def universe(df: DataFrame) -> DataFrame:
    """One row a ticker, metadata blanks filled; the first by company name stays."""
    meta = ["company_name", "sector", "industry", "sub_industry"]
    out = df.select(ticker(F.col("ticker")).alias("ticker"), *(F.coalesce(F.trim(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in meta))
    w = Window.partitionBy("ticker").orderBy(*meta)
    return out.filter(F.col("ticker").rlike(r"^[A-Z0-9.]+$")).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def market_returns(prices: DataFrame, price: str = "level") -> DataFrame:
    return prices.withColumn("market_return", log_ratio(F.col(price), F.lag(price).over(Window.orderBy("date"))))


def wide_to_long(df: DataFrame, key: str, name: str, value: str, scale: float = 1.0, positive: bool = False) -> DataFrame:
    """One column a group to rows; text becomes numbers."""
    groups = [c for c in df.columns if c != key]
    rows = df.select(key, *(number(F.col(c).cast("string")).alias(c) for c in groups)).unpivot([key], groups, name, value)
    rows = rows.withColumn(value, F.col(value) * scale)
    return rows.filter(F.col(value) > 0) if positive else rows


def factor_checks(factors: DataFrame, names: list[str]) -> DataFrame:
    """duplicates, and per factor missing and out-of-scale counts, in one aggregation."""
    return factors.agg((F.count("date") - F.count_distinct("date")).alias("duplicates"), *(F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in names), *(F.count_if(F.abs(c) >= 1).alias(f"{c}_scale") for c in names), *(F.count_if(F.abs(c) == float("inf")).alias(f"{c}_inf") for c in names))


def best_date_column(df: DataFrame) -> str:
    """The text column with the most parseable dates."""
    row = df.agg(*(F.count(parse_date(F.col(c).cast("string"))).alias(c) for c in df.columns)).first()
    return max(df.columns, key=lambda c: (row[c], -df.columns.index(c)))


def report_rows(lines: DataFrame) -> DataFrame:
    """Rows of a text report (no, line): `Cluster n` heads and `name: key=value` members, heads carried down."""
    w = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^Cluster (\d+)", 1)
    rows = lines.withColumn("cluster", F.last(F.when(head != "", head), ignorenulls=True).over(w).cast("int"))
    return rows.select("no", "cluster", F.regexp_extract("line", r"^\s*(alpha_\d+)", 1).alias("alpha"), number(F.regexp_extract("line", r"icir=(-?[0-9.]+)", 1)).alias("icir")).filter("alpha <> ''")


def table_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("n_dates"), F.count_distinct("ticker").alias("n_tickers"), (F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).alias("n_duplicates"))
