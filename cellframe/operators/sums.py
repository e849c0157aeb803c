"""Sums of doubles that do not depend on the order or the partitioning of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits below the leading one that a value keeps as a whole number, and the smallest exponent; what lies below 2^LEAST is rounded off.
BITS, LEAST = 54, -1000


def _step(value: Column) -> Column:
    """The power of two that makes ``value`` a whole number of no more than 56 bits."""
    return F.when(value == 0, LEAST).otherwise(F.greatest(F.floor(F.log2(F.abs(value))) - BITS, F.lit(LEAST)))


def exact_sums(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys`` and the sums of ``columns``, the same bits however rows are dealt.

    A value is a whole number times a power of two; whole numbers are added as decimals, which is exact, by
    power, and the few sums of a group are added from the highest power down.  Null and values that are
    not finite take no part; a group without others has the sum 0.
    """
    value = F.col("_value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    long = rows.select(*keys, F.explode(pairs).alias("_p")).select(*keys, F.col("_p.name").alias("_name"), F.col("_p.value").alias("_value"))
    steps = long.withColumn("_value", F.when(finite, value).otherwise(0.0)).withColumn("_step", _step(value).cast("int"))
    whole = (value * F.pow(F.lit(2.0), -F.col("_step"))).cast("long").cast("decimal(38,0)")
    sums = steps.groupBy(*keys, "_name", "_step").agg(F.sum(whole).alias("_sum"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("_step")).alias("minus"), F.col("_sum").cast("double").alias("part"))))  # a few powers
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["part"] * F.pow(F.lit(2.0), -p["minus"]))
    found = sums.groupBy(*keys, "_name").agg(total.alias("_total"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col("_total"))).alias(c) for c in columns])
