"""Order within groups that may be far too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_in_groups(
    df: DataFrame, group: list[str], order: list[Column], bucket: list[Column], name: str = "rank"
) -> DataFrame:
    """Exact 1-based position of each row in its group.

    ``bucket`` must be a monotone function of ``order`` (a prefix of it, or a
    sequence number divided by a constant). Rows are numbered inside their
    bucket and shifted by the size of the buckets before it, so a group with a
    third of all rows is still sorted by many tasks.
    """
    names = [f"_bucket_{i}" for i in range(len(bucket))]
    marked = df
    for n, c in zip(names, bucket):
        marked = marked.withColumn(n, c)
    sizes = marked.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*group).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    local = F.row_number().over(W.partitionBy(*group, *names).orderBy(*order))
    numbered = marked.withColumn("_local", local).alias("l")
    right = offsets.alias("r")
    condition = None
    for c in [*group, *names]:
        same = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        condition = same if condition is None else condition & same
    return numbered.join(right, condition, "inner").select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._local") + F.col("r._offset")).cast("bigint").alias(name),
    )


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; map tasks already keep only ``k`` rows per group."""
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def nest_parts(
    df: DataFrame, group: list[str], row_key: list[str], item: Column, order: Column,
    name: str = "items", part_size: int = 1000,
) -> DataFrame:
    """Rows of a group nested in arrays of about ``part_size``.

    A group larger than that becomes several parts, numbered from 0, so no
    array grows with the group. Nothing is dropped.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"))
    parts = F.ceil(F.col("group_size") / F.lit(part_size))
    joined = df.join(sizes, group).withColumn(
        "part", F.pmod(F.xxhash64(*row_key), parts).cast("int")
    )
    return (
        joined.groupBy(*group, "part")
        .agg(
            F.first("group_size").alias("group_size"),
            F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("v")))).alias("_pairs"),
        )
        .select(*group, "part", "group_size", F.transform("_pairs", lambda p: p["v"]).alias(name))
    )
