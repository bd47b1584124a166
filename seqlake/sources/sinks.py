"""Sinks: FASTA, delimited files, columnar tables, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta_lines(description: Column, seq: Column) -> Column:
    """A record without its last line end."""
    return F.concat(F.lit(">"), description, F.lit("\n"), seq)


def write_fasta(df: DataFrame, path: str, description: str = "description", seq: str = "seq", by: str | None = None, compression: str | None = None) -> None:
    """FASTA files; with by, a folder for each value of that column."""
    out = df.select(fasta_lines(F.col(description), F.col(seq)).alias("value"), *([by] if by else []))
    writer = out.write.mode("overwrite").option("compression", compression or "none")
    (writer.partitionBy(by) if by else writer).text(path)


def write_table(df: DataFrame, path: str, sep: str = ",", decimals: int | None = None, quote_all: bool = False, compression: str | None = None) -> None:
    """Delimited files with a header (an empty table gives the header only); doubles with so many decimals."""
    if decimals is not None:
        df = df.withColumns({c: F.format_string(f"%.{decimals}f", c) for c, kind in df.dtypes if kind in ("double", "float")})
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("quoteAll", quote_all).option("escape", '"').option("compression", compression or "none").csv(path)


def write_columnar(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_indexed(df: DataFrame, path: str, columns: list[str], files: int | None = None) -> None:
    """A table that is quick to search by columns: ranges of them in files, sorted, so that scans skip row groups."""
    spread = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    spread.sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, columns: list[str], buckets: int) -> None:
    """A catalogue table whose later joins and aggregations on columns need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(table)


def write_trees(df: DataFrame, path: str) -> None:
    df.select(F.col("tree").alias("value")).write.mode("overwrite").text(path)


def length_density(df: DataFrame, column: str, points: list[float], bandwidth: float = 1.0) -> DataFrame:
    """value, density: a kernel density estimate at so many points, from the distinct values' counts."""
    spark = df.sparkSession
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    at = spark.createDataFrame([(float(p),) for p in points], "value double")
    weights = F.exp(-F.pow((F.col("value") - F.col("v")) / bandwidth, F.lit(2)) / 2) * F.col("n")
    each = counts.select(F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("value"), "v", "n")
    found = each.groupBy("value").agg((F.sum(weights) / (total * bandwidth * (2 * 3.141592653589793) ** 0.5)).alias("density"))
    return at.join(F.broadcast(found), "value", "left").fillna(0.0)
