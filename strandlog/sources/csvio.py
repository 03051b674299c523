"""CSV files of measurements. Numbers that can't be read are null, not errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.scalars import size_label
from strandlog.operators.ordered import numbered

#: Fixed value: rows that the counts reader takes, the header among them.
COUNT_ROWS = 1000


def in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files with headers, as texts, with ``rn``: the place of the line in the order of files and lines."""
    lines = spark.read.csv(path, header=True).withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})
    return numbered(lines, ["_file", "_start", "_line"]).drop("_file", "_start", "_line")


def read_series(spark: SparkSession, path: str, columns: tuple[str, ...] = ("time", "low"), rows: int = 300_000) -> DataFrame:
    """The named columns of the first rows, as doubles, with their order ``idx``."""
    return in_file_order(spark, path).filter(F.col("rn") < rows).select(*(F.col(c).try_cast("double").alias(c) for c in columns), F.col("rn").alias("idx"))


def read_counts(spark: SparkSession, path: str, column: int = 1, rows: int = COUNT_ROWS - 1) -> DataFrame:
    """(idx, value): a column, by its place from 0, of the first rows as a double."""
    whole = in_file_order(spark, path)
    return whole.filter(F.col("rn") < rows).select(F.col("rn").alias("idx"), F.col(whole.columns[column]).try_cast("double").alias("value"))


def first_in_order(df: DataFrame, order: list[str], value: Column, rows: int = COUNT_ROWS - 1) -> DataFrame:
    """(rn, value) of the first rows of a total order."""
    return df.orderBy(*order).limit(rows).transform(lambda x: numbered(x, order)).select((F.col("rn") + 1).alias("rn"), value.try_cast("double").alias("value"))


def request_times(df: DataFrame, client: Column, key_length: Column, nbytes: Column, micros: Column) -> DataFrame:
    """(label, duration): one line per request, the label naming client, key length and size."""
    return df.select(F.concat_ws("-", client.cast("string"), key_length.cast("string"), size_label(nbytes)).alias("label"), F.concat(micros.cast("string"), F.lit("us")).alias("duration"))


def append(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("append").csv(path, header=header)


def write(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)
