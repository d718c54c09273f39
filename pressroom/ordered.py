"""Running sums over a whole table in a given order, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.lineage import cut, drop


def running(rows: DataFrame, by: list[str], **amounts: Column) -> DataFrame:
    """rows with a column for each amount: its sum over all rows before, in the order of `by`; stored twice on the way.

    Rows are range-partitioned by `by`; what each partition holds in all is summed over the partitions before it, one row for
    each, and added to the sums within the partition. Rows equal in `by` follow each other in the order they are stored in, and a
    very large number of them is split like any other rows. An empty table gives no rows. Columns of rows named _tie or _part are not allowed.
    """
    given = cut(rows)
    placed = cut(given.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by, "_tie").withColumn("_part", F.spark_partition_id()))
    drop(given)
    totals = placed.groupBy("_part").agg(*(F.sum(amount).alias(name) for name, amount in amounts.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in amounts))
    within = Window.partitionBy("_part").orderBy(*by, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of a shuffle.
    known = placed.join(F.broadcast(starts), "_part")
    return known.select(*rows.columns, *((F.col(f"_{name}") + F.coalesce(F.sum(amount).over(within), F.lit(0))).alias(name) for name, amount in amounts.items()))
