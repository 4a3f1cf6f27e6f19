"""Running sums and numbers in an order, where a group may be hot or the group is the whole table.

A window needs a group's rows in one task. Here rows are dealt into ranges of group and order, of even size whatever the groups are; each range adds up what
it holds of a group, those few sums are added up in the order of the ranges, and a window inside a range starts from what came before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.sources.scratch import written


def running_sum(rows: DataFrame, value: str, order: list[str], name: str, by: list[str] | None = None, ties: bool = False) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the rows of the same ``by`` up to each row in ``order``, itself included.

    Pass narrow rows and join the rest after. ``order`` should tell rows apart: rows equal in it stand in one range and in any order, or with ``ties``
    all have the sum up to the last of them. Nulls come first, null groups are one group, and null values count as 0.
    """
    by = by or []
    ranged = written(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    sums = ranged.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a group is in
    before = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("__part") == F.col("__p"))
    own = Window.partitionBy(*by, "__part").orderBy(*order)
    inside = own.rangeBetween(Window.unboundedPreceding, 0) if ties else own.rowsBetween(Window.unboundedPreceding, 0)
    both = ranged.hint("merge").join(before.hint("merge"), same)
    total = F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("__before")
    return both.withColumn(name, total).select(*rows.columns, name)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the number of each row in its group from 1."""
    return running_sum(rows.withColumn("__one", F.lit(1).cast("bigint")), "__one", order, name, by).drop("__one")
