"""Statistics of lengths and depths. Medians are whole numbers, cut towards zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def int_median(values: Column) -> Column:
    """Median of an array of whole numbers; the mean of the middle two is cut; 0 if empty."""
    a = F.array_sort(values)
    n = F.size(a)
    low, high = F.get(a, F.floor((n - 1) / 2).cast("int")), F.get(a, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (F.expr("0L") + low + high - F.pmod(low + high, F.lit(2))) / 2).otherwise(0).cast("bigint")


def int_mad(values: Column) -> Column:
    """Median absolute deviation from that median, by the same rule."""
    return F.element_at(
        F.transform(F.array(int_median(values)), lambda m: int_median(F.transform(values, lambda x: F.abs(x - m)))), 1
    )


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median and mad per group. A group's numbers are first counted by value, so what is
    gathered per group are its distinct values, and both medians are read off running counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("bigint").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    med = _counted_median(counts, keys, "x").withColumnRenamed("m", "median")
    away = counts.join(med, keys).select(*keys, F.abs(F.col("x") - F.col("median")).alias("x"), "c")
    away = away.groupBy(*keys, "x").agg(F.sum("c").alias("c"))
    return med.join(_counted_median(away, keys, "x").withColumnRenamed("m", "mad"), keys)


def _counted_median(counts: DataFrame, keys: list[str], x: str) -> DataFrame:
    whole = Window.partitionBy(*keys)
    run = whole.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("__n", F.sum("c").over(whole)).withColumn("__r", F.sum("c").over(run))
    low, high = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    picked = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("__r") >= low, F.col(x))).alias("__a"), F.min(F.when(F.col("__r") >= high, F.col(x))).alias("__b")
    )
    return picked.select(*keys, F.expr("(__a + __b) div 2").alias("m"))


def n50(df: DataFrame, keys: list[str], length: str) -> DataFrame:
    """bases, n, n50 and n50_desc per group. ``n50`` goes up from the shortest: the first length
    at which the running sum reaches half of the bases (whole-number half). ``n50_desc`` is the
    textbook value, down from the longest."""
    whole = Window.partitionBy(*keys)
    up = whole.orderBy(length).rowsBetween(Window.unboundedPreceding, 0)
    down = whole.orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0)
    # equal lengths first become one row, so a window holds distinct lengths only
    rows = df.groupBy(*keys, length).agg(F.count(F.lit(1)).alias("__c"))
    own = (F.col(length) * F.col("__c")).cast("bigint")
    rows = rows.withColumn("__up", F.sum(own).over(up)).withColumn("__down", F.sum(own).over(down)).withColumn("__all", F.sum(own).over(whole))
    # within equal lengths the half may be reached before the last of them: the answer is the same
    return rows.groupBy(*keys).agg(
        F.max("__all").alias("bases"), F.sum("__c").alias("n"),
        F.min(F.when(F.col("__up") >= F.expr("__all div 2"), F.col(length))).alias("n50"),
        F.max(F.when(F.col("__down") * 2 >= F.col("__all"), F.col(length))).alias("n50_desc"),
    )


def length_outliers(df: DataFrame, keys: list[str], length: str, threshold: float) -> DataFrame:
    """Adds ``kept``: round(median - t * mad) <= length <= round(median + t * mad), the lower
    bound not below 0. A threshold of 0 keeps everything."""
    if threshold < 0:
        raise ValueError("the threshold cannot be negative")
    if threshold == 0:
        return df.withColumn("kept", F.lit(True))
    bounds = median_mad(df, keys, length)
    low = F.greatest(F.round(F.col("median") - F.col("mad") * threshold), F.lit(0.0))
    high = F.round(F.col("median") + F.col("mad") * threshold)
    joined = df.join(bounds, keys)
    return joined.withColumn("kept", F.col(length).between(low, high)).drop("median", "mad")


def clipped_mean(df: DataFrame, keys: list[str], count: str, out: str = "clipped_mean") -> DataFrame:
    """Mean per group after counts are cut at max(m + 6 * sqrt(m), 2 * m), m the plain mean."""
    by_value = df.groupBy(*keys, F.col(count).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    n = F.sum("__c")
    means = by_value.groupBy(*keys).agg((F.sum(F.col("__x") * F.col("__c")) / n).alias("__m"))
    limit = F.greatest(F.col("__m") + 6 * F.sqrt("__m"), 2 * F.col("__m"))
    cut = by_value.join(means, keys).select(*keys, F.least("__x", limit).alias("__x"), "__c")
    return cut.groupBy(*keys).agg((F.sum(F.col("__x") * F.col("__c")) / n).alias(out))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Weighted mean of the rows that have a value; null for a group without any."""
    used = F.col(value).isNotNull()
    total = F.sum(F.when(used, F.col(weight)))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.when(used, F.col(value) * F.col(weight))), total).alias(out))


def automatic_min_assemblies(n: Column) -> Column:
    """1 for one assembly, else a quarter of them (halves up), 2 at least."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(2), F.floor((n + 2) / 4))).cast("bigint")


def subset_reads(total_bases: Column, n_reads: Column, genome_size: Column, min_depth: float) -> Column:
    """Reads per subset: the subset depth grows with log2 of the total depth."""
    depth = total_bases / genome_size
    wanted = min_depth * F.log2(4 * depth / min_depth) / 2
    return F.round(wanted / depth * n_reads).cast("bigint")
