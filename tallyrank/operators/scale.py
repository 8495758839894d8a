"""Ordered numbering and running sums that hold when one group is huge.

A Spark window sends each group to one task. That is the right plan while groups
stay small. When a group has more than `hot_rows` rows, its rows are cut into ranges
of the sort order instead: every range is numbered on its own task, the per-range
totals (at most one per range and group) are summed, and each row adds its range's
offset. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrank.session import materialize, scratch_of

HOT_ROWS = 1_000_000


def key_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def hot_groups(df: DataFrame, group: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Groups above the limit, or None. Counting combines before the shuffle."""
    if not group:
        n = df.agg(F.count(F.lit(1))).first()[0]
        return df.sparkSession.range(1).select("id") if n > hot_rows else None
    hot = (
        df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows).select(*group)
    )
    hot = materialize(hot, "hot")  # few rows: with their size known, the rows they pick stay in place
    return None if hot.isEmpty() else hot


def _ranges(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in total order, tagged with their range `_part` and position `_mid`.

    The result is checkpointed: the ranges come from a sample, so they must be drawn
    once and then stay fixed for everything computed from them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + list(order)
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    return materialize(placed).withColumn("_part", F.shiftright("_mid", 33))


def _stored(df: DataFrame) -> DataFrame:
    """`df` where it can be read again at no more than the cost of reading: ranges are sampled first."""
    return df if scratch_of(df) else materialize(df, "numbered")


def _split(df, group, hot):
    if not group:
        return None, df
    return df.join(hot, list(group), "left_anti"), df.join(hot, list(group), "left_semi")


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str,
                hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """`row_number()` from 1 in each group. `order` must leave no ties.

    `sizes` may name a cheaper table with the same groups and at least as many rows
    per group; only its counts are read.
    """
    hot = hot_groups(sizes if sizes is not None else df, group, hot_rows)
    by_group = Window.partitionBy(*group).orderBy(*order)
    windowed = F.row_number().over(by_group).cast("bigint")
    if hot is None:
        return df.withColumn(name, windowed)
    cold, big = _split(_stored(df), group, hot)
    placed = _ranges(big, group, order)
    slices = placed.groupBy("_part", *group).agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "_part", *group, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    slices = materialize(slices, "slices")
    numbered = placed.join(slices, ["_part", *group]).withColumn(
        name, F.col("_mid") - F.col("_first") + F.col("_off") + 1
    ).select(*df.columns, name)
    return numbered if cold is None else numbered.unionByName(cold.withColumn(name, windowed))


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                 sums: dict[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each `new: source` pair, the sum of `source` up to and including the row."""
    hot = hot_groups(df, group, hot_rows)
    upto = (
        Window.partitionBy(*group).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    plain = {new: F.sum(src).over(upto) for new, src in sums.items()}
    if hot is None:
        return df.withColumns(plain)
    cold, big = _split(_stored(df), group, hot)
    placed = _ranges(big, group, order)
    slices = placed.groupBy("_part", *group).agg(
        *[F.sum(src).alias(f"_s_{new}") for new, src in sums.items()]
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "_part", *group,
        *[F.coalesce(F.sum(f"_s_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in sums],
    )
    slices = materialize(slices, "slices")
    inside = (
        Window.partitionBy("_part", *group).orderBy("_mid")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = placed.withColumns(
        {f"_w_{new}": F.sum(src).over(inside) for new, src in sums.items()}
    ).join(slices, ["_part", *group])
    summed = summed.select(
        *df.columns, *[(F.col(f"_w_{new}") + F.col(f"_o_{new}")).alias(new) for new in sums]
    )
    return summed if cold is None else summed.unionByName(cold.withColumns(plain))


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str,
                    probs: dict[str, float], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact interpolated quantiles per group.

    Equal values are counted before the shuffle, and no task holds a whole group the
    way `percentile` would.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    )
    return quantiles_of_counts(counts, group, value, probs, hot_rows)


def quantiles_of_counts(counts: DataFrame, group: Sequence[str], value: str,
                        probs: dict[str, float], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact interpolated quantiles per group, from distinct values with their counts `_c`."""
    cum = running_sums(counts, group, [F.col(value)], {"_cum": "_c"}, hot_rows)
    total = counts.groupBy(*group).agg(F.sum("_c").alias("_total"))
    cum = cum.join(total, list(group)) if group else cum.crossJoin(F.broadcast(total))
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda i: F.min(F.when(F.col("_cum") > i, F.col(value)))
        frac = F.max(pos - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).cast("double").alias(name))
    return cum.groupBy(*group).agg(*aggs)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, _c): how often each value, null included, is in each column. One grouping for
    all columns, combined before the shuffle."""
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(F.explode(items).alias("i")).select("i.*")
    return rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_c"))
