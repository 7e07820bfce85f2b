"""Small collection helpers as columns and DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_mean_max(value: str) -> list[Column]:
    """min, mean, max; 0, NaN, 0 of nothing."""
    return [F.coalesce(F.min(value), F.lit(0.0)).alias("min"), F.coalesce(F.avg(value), F.lit(float("nan"))).alias("mean"), F.coalesce(F.max(value), F.lit(0.0)).alias("max")]


def _short(value: Column, digits: int) -> Column:
    return F.regexp_replace(F.format_string(f"%.{digits}f", F.bround(value, digits)), r"\.?0+$", "")


def min_mean_max_text(value: str, digits: int = 2, skip_min: bool = False) -> Column:
    parts = [("avg", F.avg(value)), ("max", F.max(value))]
    parts = parts if skip_min else [("min", F.min(value)), *parts]
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{n}: "), _short(v.cast("double"), digits)) for n, v in parts])
    return F.when(F.count(value) == 0, "none").otherwise(text)


def first_where_max(x: str, value: str, order: str) -> Column:
    """The x of the greatest value; the first in order of equal ones."""
    return F.max_by(x, F.struct(value, -F.col(order)))


def first_where_min(x: str, value: str, order: str) -> Column:
    return F.min_by(x, F.struct(value, order))


def product(value: str) -> Column:
    """The product, 1 of nothing."""
    return F.coalesce(F.product(value), F.lit(1.0))


def packs(df: DataFrame, size: int, key: str, order: str, value: str) -> DataFrame:
    """(key, pack, items): each key's values in order, ``size`` at a time."""
    row = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return _gathered(df.withColumn("r", row).withColumn("pack", F.floor(F.col("r") / size)), key, value)


def packs_even_odd(df: DataFrame, even: int, odd: int, key: str, order: str, value: str) -> DataFrame:
    """As ``packs``, with packs of ``even`` and ``odd`` values by turns."""
    both = even + odd
    row = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    pack = F.floor(F.col("r") / both) * 2 + F.when(F.col("r") % both >= even, 1).otherwise(0)
    return _gathered(df.withColumn("r", row).withColumn("pack", pack), key, value)


def _gathered(df: DataFrame, key: str, value: str) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda x: x["v"])
    return df.groupBy(key, F.col("pack").cast("bigint").alias("pack")).agg(items.alias("items"))


def zip_groups(flows: DataFrame, flow: str, order: str, value: str, n: int) -> DataFrame:
    """(place, items): the flows' values by place; a flow that has ended leaves its slot out."""
    placed = flows.withColumn("place", (F.row_number().over(Window.partitionBy(flow).orderBy(order)) - 1).cast("bigint"))
    return placed.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct(flow, F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """The rows for which the predicate holds, and the others (nulls among them)."""
    held = F.coalesce(predicate, F.lit(False))
    return df.where(held), df.where(~held)


def without_nulls(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull())


def lookup(df: DataFrame, entries: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the value of their key, null without one; keys of ``entries`` are unique."""
    return df.join(entries.select(key, value), key, "left")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that the seed and the key fix."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)
