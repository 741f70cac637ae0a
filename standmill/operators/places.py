"""Places of rows in an order, without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standmill.functions.keys import hash_order

#: Up to so many rows of a group Spark cuts a rank limit down within each partition (its default threshold).
RANK_LIMIT = 1_000
#: Bits of a hash order (31) that are left within one bucket of a group: 1,024 buckets.
BUCKET_BITS = 21


def placed(rows: DataFrame, by: list[str], bucket: Column, order: list[Column], limit: int | None = None, name: str = "place") -> DataFrame:
    """rows with their place (from 0) in the order of their group; with a limit only the places below it.

    bucket must not fall along the order: each bucket of a group is ranked on its own, and the counts of the buckets before
    it are added. With a limit, buckets that lie wholly behind it are left out before anything is ranked."""
    rows = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if limit is not None:
        counts = counts.filter(F.col("_before") < limit)
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    out = rows.join(counts, [*by, "_bucket"]).withColumn(name, F.col("_before") + inside).drop("_before", "_bucket")
    return out if limit is None else out.filter(F.col(name) < limit)


def lowest_hashes(rows: DataFrame, by: list[str], n: int, seed: int = 0, first: Column | None = None) -> DataFrame:
    """The n rows of each group whose pids hash lowest (ties: lowest pid), those with the smaller number first before the others."""
    number, order = F.lit(0) if first is None else first, hash_order(F.col("pid"), seed)
    if n <= RANK_LIMIT:
        ranked = Window.partitionBy(*by).orderBy(number, order, "pid")
        return rows.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= n).drop("_rank")
    bucket = number.cast("long") * (1 << (31 - BUCKET_BITS)) + F.shiftright(order, BUCKET_BITS)
    return placed(rows, by, bucket, [number, order, F.col("pid")], n, "_place").drop("_place")
