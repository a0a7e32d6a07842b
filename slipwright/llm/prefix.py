"""Sums of all rows before a row, over groups of any size. DataFrame functions only.

A window over a large group would gather it in one task. Rows are therefore dealt by ranges of (group, order) and
written with the number of their part; sums are taken inside each part, sums of parts are added up along their group
(a row a part and group, so at most as many rows as parts for one group), and both are put together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_names, stored


def sums_before(df: DataFrame, group: list[str], order: list[str], values: list[str], what: str = "dealt") -> DataFrame:
    """``df`` with columns ``before_<value>`` and ``total_<value>`` more: the sum of a value over the rows of the same
    group that come before in ascending ``order`` (nulls first), and over the whole group.

    ``df`` must be a stored table: equal rows follow each other in an order of their own, by the place where they stand
    in it, and a lost task must see them there again. Null groups are groups, null values count 0; an empty table stays
    empty. Values are longs or doubles.
    """
    part, tie = free_names(df, "part", "tie")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *group, *order, tie)
    dealt = stored(dealt.withColumn(part, F.spark_partition_id()), what)
    zero = {v: F.coalesce(F.col(v), F.lit(0)) for v in values}
    parts = dealt.groupBy(part, *group).agg(*[F.sum(zero[v]).alias(f"total_{v}") for v in values])
    along, whole = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*group)
    sums = [c for v in values for c in (_or_zero(F.sum(f"total_{v}").over(along)).alias(f"before_{v}"), F.sum(f"total_{v}").over(whole).alias(f"total_{v}"))]
    parts = parts.select(F.col(part).alias("p_part"), *[F.col(g).alias(f"p_{g}") for g in group], *sums)
    inside = W.partitionBy(part, *group).orderBy(*order, tie).rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.withColumns({f"own_{v}": _or_zero(F.sum(zero[v]).over(inside)) for v in values})
    same = reduce(Column.__and__, [rows[part] == parts["p_part"], *[rows[g].eqNullSafe(parts[f"p_{g}"]) for g in group]])
    new = [c for v in values for c in ((F.col(f"own_{v}") + F.col(f"before_{v}")).alias(f"before_{v}"), F.col(f"total_{v}"))]
    return rows.join(parts, same).select(*[rows[c] for c in df.columns], *new)


def _or_zero(sum_: Column) -> Column:
    return F.coalesce(sum_, F.lit(0))
