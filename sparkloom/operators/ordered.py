"""Numbers, last values and registers along an order within keys, of which one may hold any share of the rows.

A plain window sorts a whole key in one task. Here the order is cut into blocks by an expression that rises with it (a time's hour,
a place divided by a thousand): a window sees a block, a second one a row for each block, and what the blocks before hand on is
joined back. Null keys are one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cut(df: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """`df` with the key and block of a row as one column, so that nulls are equal in joins too."""
    return df.withColumn("_at", F.struct(F.struct(*keys, F.lit(0).alias("_")).alias("key"), block.alias("block")))


def _within(order: list[str]) -> Window:
    return Window.partitionBy("_at").orderBy(*order)


def _blocks() -> Window:
    return Window.partitionBy("_at.key").orderBy("_at.block")


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "place") -> DataFrame:
    """`df` with the number of each row within its key, from 1. Rows of equal order are numbered in any order."""
    cut = _cut(df, keys, block).withColumn("_n", F.row_number().over(_within(order)))
    counts = cut.groupBy("_at").agg(F.count("*").alias("_count"))
    before = F.coalesce(F.sum("_count").over(_blocks().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.join(counts.select("_at", before.alias("_before")), "_at").withColumn(name, F.col("_before") + F.col("_n")).drop("_at", "_n", "_before")


def carried(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, name: str, with_own: bool = True) -> DataFrame:
    """`df` with the last value that isn't null of the rows up to each row, its own included or not. `order` should tell all rows of a key apart."""
    cut = _cut(df, keys, block).withColumn("_v", value)
    up_to = Window.unboundedPreceding, 0 if with_own else -1
    here = F.last("_v", ignorenulls=True).over(_within(order).rowsBetween(*up_to))
    ends = cut.groupBy("_at").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(_blocks().rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("_here", here).join(ends.select("_at", before.alias("_before")), "_at").withColumn(name, F.coalesce("_here", "_before")).drop("_at", "_v", "_here", "_before")


def _last(items: Column, most: int) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - (most - 1)), most)


def _registers(df: DataFrame, part: str, order: list[str], items: str, most: int, name: str) -> DataFrame:
    """The last `most` of all items up to and with each row: the last `most` rows that have some hold them all."""
    own = F.when(F.size(items) > 0, _last(F.col(items), most))
    held = df.withColumn("_k", F.count(own).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    lists = F.collect_list(own).over(Window.partitionBy(part).orderBy("_k").rangeBetween(-(most - 1), 0))
    return held.withColumn(name, _last(F.flatten(lists), most)).drop("_k")


def recent(df: DataFrame, keys: list[str], order: list[str], block: Column, items: Column, most: int, name: str = "recent") -> DataFrame:
    """`df` with the last `most` items of the rows up to and with each row, the last one last; `items` is an array, which may be empty."""
    cut = _registers(_cut(df, keys, block).withColumn("_items", items), "_at", order, "_items", most, "_here")
    ends = cut.groupBy("_at").agg(F.max_by("_here", F.struct(*order)).alias("_end"))
    ends = _registers(ends, "_at.key", ["_at.block"], "_end", most, "_all").withColumn("_before", F.lag("_all").over(_blocks()))
    both = F.concat(F.coalesce("_before", F.array().cast(cut.schema["_here"].dataType)), "_here")
    return cut.join(ends.select("_at", "_before"), "_at").withColumn(name, _last(both, most)).drop("_at", "_items", "_here", "_before")
