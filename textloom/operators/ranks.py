"""Global orders and exact quantiles without a window over the whole table.

Rows are dealt to tasks by ranges of the order, which Spark samples; any ranges give the same result. The ranges are written before
they are counted, so that a task that runs again can't deal them anew. Only their counts, one row per range and group, are summed up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.shared import written

#: A range is to hold about so many rows, so their number grows with the table.
RANGE_ROWS = 1_000_000


def _ranges(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with column `name`: the place, from 1, in the order of the columns given, which must tell rows apart and hold no nulls."""
    keyed = df.withColumn("__key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    # in a sorted partition the id is the partition's number, then the row's
    dealt = keyed.repartitionByRange(_ranges(df), "__key").sortWithinPartitions("__key").withColumn("__id", F.monotonically_increasing_id())
    table = written(dealt.drop("__key")).withColumns({"__b": F.shiftright("__id", 33), "__i": F.col("__id").bitwiseAND((1 << 33) - 1)})
    counts = table.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__b", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = table.join(F.broadcast(counts), "__b").withColumn(name, F.col("__before") + F.col("__i") + 1)  # a row per range
    return ranked.drop("__b", "__i", "__id", "__before")


def values_at(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Per group n, and for each share q the value of rank floor((n - 1) q) from 0 among the non-null values, exactly.

    Equal values are counted before anything else, so neither a hot value nor a hot group is ordered row by row.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(counted.repartitionByRange(ranges, *by, "__v").withColumn("__b", F.spark_partition_id()))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = dealt.groupBy(*by, "__b").agg(F.sum("__c").alias("__s"))  # a row per range and group that it holds
    ahead = F.sum("__s").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "__b", F.coalesce(ahead, F.lit(0)).alias("__before"), F.sum("__s").over(group).alias("__n"))
    x, y = dealt.alias("x"), sums.alias("y")
    same = F.col("x.__b") == F.col("y.__b")
    for c in by:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    both = x.join(y, same).select(*[F.col(f"x.{c}") for c in by], "x.__b", "__v", "__c", "__before", "__n")
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*by, "__b").orderBy("__v"))
    ranked = both.withColumn("__upto", upto)
    rank = lambda q: F.floor((F.col("__n") - 1) * F.lit(q)) + 1
    picks = [F.max(F.when((F.col("__upto") >= rank(q)) & (F.col("__upto") - F.col("__c") < rank(q)), F.col("__v"))).alias(k) for k, q in shares.items()]
    return ranked.groupBy(*by).agg(F.max("__n").alias("n"), *picks)
