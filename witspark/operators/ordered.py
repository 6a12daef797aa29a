"""Row number, lag, lead, first and carried values per group in event order.

Small groups use plain windows. When a count shows a group too large for one
task, rows are range-partitioned on (group, order) so that the group spans
several tasks; each piece is computed alone and joined with one summary row per
piece that carries over what the earlier and later pieces hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from witspark.plans.lineage import cut, has_hot_group

KINDS = ("row_number", "lag", "lead", "first", "carry_forward", "carry_back")


def _plain(kind: str, source, window) -> Column:
    whole = window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    if kind == "row_number":
        return F.row_number().over(window).cast("bigint")
    if kind == "lag":
        return F.lag(source).over(window)
    if kind == "lead":
        return F.lead(source).over(window)
    if kind == "first":
        return F.first(source).over(whole)
    if kind == "carry_forward":
        return F.last(source, ignorenulls=True).over(
            window.rowsBetween(W.unboundedPreceding, W.currentRow)
        )
    if kind == "carry_back":
        return F.first(source, ignorenulls=True).over(
            window.rowsBetween(W.currentRow, W.unboundedFollowing)
        )
    raise ValueError(f"unknown kind: {kind}")


def in_order(
    df: DataFrame, keys: list[str], order: list[str], wanted: dict, hot: bool | None = None
) -> DataFrame:
    """Add one column per entry of `wanted`: name -> (kind, source column or None).

    `order` names columns that together order the rows of a group strictly.
    `hot` says whether a group needs splitting; without it the groups are counted.
    """

    if not (has_hot_group(df, keys) if hot is None else hot):
        window = W.partitionBy(*keys).orderBy(*order)
        return df.select(
            "*",
            *[_plain(kind, source, window).alias(name) for name, (kind, source) in wanted.items()],
        )
    return _split(df, keys, order, wanted)


def _split(df: DataFrame, keys, order, wanted) -> DataFrame:
    # The piece is written into the rows, so that it means the same in every plan.
    pieces = cut(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__piece", F.spark_partition_id())
    )
    here = W.partitionBy("__piece", *keys).orderBy(*order)
    whole = here.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    local = pieces.select(
        "*",
        F.row_number().over(here).cast("bigint").alias("__rn"),
        F.count(F.lit(1)).over(whole).alias("__n"),
        *[
            _plain(kind, source, here).alias(f"__w_{name}")
            for name, (kind, source) in wanted.items()
            if kind != "row_number"
        ],
    )
    place = F.struct(*order)
    edges = []
    for name, (kind, source) in wanted.items():
        if kind == "lag":
            edges.append(F.max_by(F.struct(source), place).alias(f"__e_{name}"))
        elif kind in ("lead", "first"):
            edges.append(F.min_by(F.struct(source), place).alias(f"__e_{name}"))
        elif kind == "carry_forward":
            edges.append(
                F.max_by(source, F.when(F.col(source).isNotNull(), place)).alias(f"__e_{name}")
            )
        elif kind == "carry_back":
            edges.append(
                F.min_by(source, F.when(F.col(source).isNotNull(), place)).alias(f"__e_{name}")
            )
    summary = pieces.groupBy("__piece", *keys).agg(F.count(F.lit(1)).alias("__rows"), *edges)
    # One row per piece of a group: at most the number of partitions per key.
    before = W.partitionBy(*keys).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy("__piece").rowsBetween(1, W.unboundedFollowing)
    step = W.partitionBy(*keys).orderBy("__piece")
    carried = [F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")]
    for name, (kind, source) in wanted.items():
        edge = f"__e_{name}"
        if kind == "lag":
            carried.append(F.lag(edge).over(step).alias(f"__c_{name}"))
        elif kind == "lead":
            carried.append(F.lead(edge).over(step).alias(f"__c_{name}"))
        elif kind == "first":
            whole_key = step.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            carried.append(F.first(edge).over(whole_key).alias(f"__c_{name}"))
        elif kind == "carry_forward":
            carried.append(F.last(edge, ignorenulls=True).over(before).alias(f"__c_{name}"))
        elif kind == "carry_back":
            carried.append(F.first(edge, ignorenulls=True).over(after).alias(f"__c_{name}"))
    summary = summary.select("__piece", *keys, *carried)
    left, right = local.alias("l"), summary.alias("s")
    same = F.col("l.__piece") == F.col("s.__piece")
    for key in keys:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"s.{key}"))
    joined = left.join(right, same)
    columns = []
    for name, (kind, source) in wanted.items():
        value, carry = F.col(f"l.__w_{name}"), F.col(f"s.__c_{name}")
        if kind == "row_number":
            columns.append((F.col("l.__rn") + F.col("s.__offset")).alias(name))
        elif kind == "lag":
            columns.append(
                F.when(F.col("l.__rn") == 1, carry.getField(source)).otherwise(value).alias(name)
            )
        elif kind == "lead":
            columns.append(
                F.when(F.col("l.__rn") == F.col("l.__n"), carry.getField(source))
                .otherwise(value)
                .alias(name)
            )
        elif kind == "first":
            columns.append(carry.getField(source).alias(name))
        else:
            columns.append(F.coalesce(value, carry).alias(name))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *columns)
