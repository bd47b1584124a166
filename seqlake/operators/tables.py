"""Relational table commands: projection, constants, splitting, joining, de-duplicating, reshaping."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """`name` or `name:new` for each column to keep."""
    return df.select(*[F.col(c.partition(":")[0]).alias(c.partition(":")[2] or c.partition(":")[0]) for c in columns])


def two_columns(df: DataFrame, columns: str = "1,2") -> DataFrame:
    """description, seq from two columns, by name or by number from 0; one number serves for both."""
    names = [c.strip() for c in columns.split(",")]
    if all(c.isdigit() for c in names):
        names = [df.columns[int(c)] for c in names]
        names = [names[i % len(names)] for i in range(2)]
    return df.select(F.col(names[0]).alias("description"), F.col(names[1]).alias("seq"))


def add_constants(df: DataFrame, values: dict) -> DataFrame:
    """Columns of one value each; a column of that name is overwritten."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()}) if values else df


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def concatenate(frames: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """All rows of all tables; columns that a table lacks are null there."""
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.toDF(*names) if names else out


def split_column(df: DataFrame, column: str, delimiter: str, names: list[str]) -> DataFrame:
    """New columns right after `column`, with its stripped pieces; empty unless there are as many pieces as names. Existing columns win."""
    parts = F.split(F.col(column), re.escape(delimiter), -1)
    fresh = [n for n in names if n not in df.columns]
    made = {n: F.when(F.size(parts) == len(names), F.trim(F.get(parts, F.lit(i)))).otherwise(F.lit("")) for i, n in enumerate(names) if n in fresh}
    at = df.columns.index(column) + 1
    return df.withColumns(made).select(*df.columns[:at], *fresh, *df.columns[at:])


def replace_text(column: Column, replacements: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in replacements:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def join_tables(frames: list[DataFrame], how: str = "inner", on: list[str] | None = None) -> DataFrame:
    """Joins from left to right, on the common columns unless given; other columns that both have get _x and _y."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        keys = on or [c for c in a.columns if c in b.columns]
        if not keys:
            raise ValueError("no common columns to join on")
        both = [c for c in a.columns if c in b.columns and c not in keys]
        return a.withColumnsRenamed({c: f"{c}_x" for c in both}).join(b.withColumnsRenamed({c: f"{c}_y" for c in both}), keys, how)

    return functools.reduce(two, frames)


def deduplicate(df: DataFrame, on: list[str] | None = None, order: list[Column | str] | None = None, last: bool = False) -> DataFrame:
    """The first (or last) row in order for each value of `on`; whole rows without `on`.

    With `on` and no order any row of a value may stay. The choice is an aggregation, so a value with very many rows is
    combined before the shuffle.
    """
    if not on:
        return df.distinct()
    if not order:
        return df.dropDuplicates(on)
    rest = [c for c in df.columns if c not in on]
    if not rest:
        return df.select(*on).distinct()
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    keys = df.groupBy(*on).agg(pick.alias("__row"))
    return keys.select(*[F.col(c) if c in on else F.col("__row")[c].alias(c) for c in df.columns])


def best_ranked(df: DataFrame, by: list[str], measure: str, n: int) -> DataFrame:
    """Rows whose measure is not above the n-th smallest of its group (ties stay, nulls go)."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(measure))
    return df.where(F.col(measure).isNotNull()).withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def largest_per_group(df: DataFrame, by: list[str], measure: str, ties: list[str]) -> DataFrame:
    """One row of each group: the largest measure, then the smallest of ties."""
    order = Window.partitionBy(*by).orderBy(F.desc(measure), *ties)
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def pivot_sum(df: DataFrame, rows: list[str], column: str, value: str, values: list | None = None, fill: float | None = 0) -> DataFrame:
    out = df.groupBy(*rows).pivot(column, values).agg(F.sum(value))
    return out if fill is None else out.fillna(fill, [c for c in out.columns if c not in rows])


def percent_of(df: DataFrame, value: str, by: list[str], name: str, least: float | None = None) -> DataFrame:
    """value in percent of its group's sum, at least `least`. The sums are aggregated first, so a large group isn't sorted."""
    total = df.groupBy(*by).agg(F.sum(value).alias("__total"))
    share = F.col(value) / F.col("__total") * 100
    return df.join(total, by).withColumn(name, F.greatest(F.lit(least), share) if least is not None else share).drop("__total")


def without(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), on, "left_anti")


def with_missing(hits: DataFrame, queries: DataFrame, on: str) -> DataFrame:
    """hits and a row of nulls for each query that has none."""
    return hits.unionByName(without(queries.select(on).distinct(), hits, [on]), allowMissingColumns=True)


def chunks(df: DataFrame, size: int, by: list[str], seed: int = 0, key: str = "id", merge_below: float = 0.5) -> DataFrame:
    """chunk: number of the part of at most `size` rows that a row falls in, in an order by hash; a last part under
    merge_below of the size joins the one before."""
    n = F.count("*").over(Window.partitionBy(*by))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)) - 1
    last = F.floor((n - 1) / size)
    small = (n - last * size) < merge_below * size
    part = F.floor(at / size)
    return df.withColumn("chunk", F.when((part == last) & small & (last > 0), last - 1).otherwise(part).cast("int"))


def sample_per_group(df: DataFrame, by: list[str], n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """At most n rows of each group, the same ones every time."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def within(column: Column, least=None, most=None) -> Column:
    """Bounds, each of them optional."""
    out = F.lit(True)
    if least is not None:
        out = out & (column >= least)
    if most is not None:
        out = out & (column <= most)
    return out
