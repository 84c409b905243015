"""Ordered operators that survive a group holding a large share of all rows.

A window partitioned by such a group would run in one task. Groups up to
``hot_rows`` rows use the plain window. Larger ones are laid out by range over
(group, order), so they spread over many tasks; what a slice needs from the
slices before it is one small row per slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from emberlog.operators.selection import first_rows
from emberlog.session import cut_lineage, shuffle_width, written

HOT_ROWS = 2_000_000
ALL = "_everything"


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn(ALL, F.lit(0)), [ALL])


def _same_key(by: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in by])


def hot_limit(df: DataFrame, hot_rows: int | None) -> int | None:
    """None when the whole input is too small to hold a hot group, which spares the checks."""
    return None if hot_rows is None or df.count() <= hot_rows else hot_rows


def split_hot(df: DataFrame, by: list[str], hot_rows: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups or None).

    The check is one map-side combined count over the key columns only. The list
    of hot keys has at most rows / hot_rows entries; Spark picks the join.
    """
    if hot_rows is None:
        return df, None
    hot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*by)
    if hot.isEmpty():
        return df, None
    hot = written(hot)  # a file's size is known, so rows are not laid out by key to meet it
    on = _same_key(by, "l", "r")
    rows = df.alias("l")
    return rows.join(hot.alias("r"), on, "left_anti"), rows.join(hot.alias("r"), on, "left_semi")


def _spread_totals(df: DataFrame, by: list[str], order: list, totals: dict[str, Column]) -> DataFrame:
    amounts = {f"_amount_{n}": c for n, c in totals.items()}
    laid = cut_lineage(
        df.withColumns(amounts)
        .repartitionByRange(shuffle_width(df.sparkSession), *[F.col(k) for k in by], *order)
        .sortWithinPartitions(*by, *order)
        .withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        laid.groupBy(*by, "_slice")
        .agg(*[F.sum(a).alias(a) for a in amounts])
        .select(*by, "_slice", *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"_before{a}") for a in amounts])
    )
    inside = Window.partitionBy(*by, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = laid.withColumns({f"_inside{a}": F.sum(a).over(inside) for a in amounts})
    joined = summed.alias("l").join(
        before.alias("r"), _same_key(by, "l", "r") & (F.col("l._slice") == F.col("r._slice")))
    return joined.select(*[f"l.{c}" for c in df.columns], *[
        (F.col(f"_inside_amount_{n}") + F.col(f"_before_amount_{n}")).alias(n) for n in totals])


def running_totals(df: DataFrame, by: list[str], order: list, totals: dict[str, Column],
                   hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Exact prefix sums per group; ``order`` must be unique within a group."""
    rows, keys = _keyed(df, by)
    plain, hot = split_hot(rows, keys, hot_rows)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = plain.withColumns({n: F.sum(c).over(upto) for n, c in totals.items()})
    if hot is not None:
        out = out.unionByName(_spread_totals(hot, keys, order, totals))
    return out.drop(ALL)


def number_rows(df: DataFrame, by: list[str], order: list, name: str = "line_no",
                hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """1-based position of every row in its group."""
    return running_totals(df, by, order, {name: F.lit(1).cast("long")}, hot_limit(df, hot_rows))


def beside(df: DataFrame, by: list[str], order: list, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None,
           hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add values of the row ``before`` and of the row ``after`` in the group (null at its ends); ``order`` must be unique within a group.

    Rows of hot groups are laid out by range. A slice finds its rows' neighbours itself but for the ones across its edges: these come
    from a table with the first and last values of every slice.
    """
    before, after = before or {}, after or {}
    rows, keys = _keyed(df, by)
    plain, hot = split_hot(rows, keys, hot_rows)
    frame = Window.partitionBy(*keys).orderBy(*order)
    out = plain.withColumns({**{n: F.lag(c).over(frame) for n, c in before.items()}, **{n: F.lead(c).over(frame) for n, c in after.items()}})
    return (out if hot is None else out.unionByName(_spread_beside(hot, keys, order, before, after))).drop(ALL)


def _spread_beside(df: DataFrame, by: list[str], order: list, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    given = F.struct(F.lit(1).alias("_there"), *(c.alias(n) for n, c in {**before, **after}.items()))
    laid = cut_lineage(
        df.withColumn("_given", given)
        .repartitionByRange(shuffle_width(df.sparkSession), *[F.col(k) for k in by], *order)
        .sortWithinPartitions(*by, *order)
        .withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    slices = Window.partitionBy(*by).orderBy("_slice")
    edges = (
        laid.groupBy(*by, "_slice").agg(F.min_by("_given", "_at").alias("_first"), F.max_by("_given", "_at").alias("_last"))
        .select(*by, "_slice", F.lag("_last").over(slices).alias("_left"), F.lead("_first").over(slices).alias("_right"))
    )
    inside = Window.partitionBy(*by, "_slice").orderBy("_at")
    near = laid.withColumns({"_lag": F.lag("_given").over(inside), "_lead": F.lead("_given").over(inside)})
    joined = near.alias("l").join(edges.alias("r"), _same_key(by, "l", "r") & (F.col("l._slice") == F.col("r._slice")))
    lag, lead = F.coalesce("l._lag", "r._left"), F.coalesce("l._lead", "r._right")
    return joined.select(*[f"l.{c}" for c in df.columns], *[lag[n].alias(n) for n in before], *[lead[n].alias(n) for n in after])


def top_rows(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of every group, exactly. Spark cuts each map task to ``n`` rows per group before the shuffle; for a
    large ``n`` see ``first_by_score``."""
    rows, keys = _keyed(df, by)
    rank = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= n).drop("_rank", ALL)


def falling(score: Column) -> Column:
    """``score`` turned round, as a double: NaN first, null last, as in a falling order."""
    return F.when(score.isNull(), F.lit(float("inf"))).when(F.isnan(score), F.lit(float("-inf"))).otherwise(-score).cast("double")


def top_share(df: DataFrame, by: list[str], score: str, tie: str, fraction: float, flag: str,
              hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Flag (0/1) the first ``floor(fraction * rows)`` rows of every group, at least one, by falling ``score``, then ``tie`` (whole
    numbers, different in a group). A large input is not ordered: the cut is found by counting (``selection``)."""
    if hot_limit(df, hot_rows) is None:
        group = Window.partitionBy(*by)
        cut = F.greatest(F.floor(F.lit(fraction) * F.count(F.lit(1)).over(group)), F.lit(1))
        return df.withColumn(flag, (F.row_number().over(group.orderBy(F.desc(score), tie)) <= cut).cast("int"))
    sizes = df.groupBy(*by).agg(F.greatest(F.floor(F.lit(fraction) * F.count(F.lit(1))), F.lit(1)).cast("long").alias("rank"))
    return first_rows(df, by, falling(F.col(score)), tie, written(sizes), flag)


def first_by_score(df: DataFrame, by: list[str], score: str, tie: str, n: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The first ``n`` rows of every group by falling ``score``, then ``tie``."""
    if n <= 100 or hot_limit(df, hot_rows) is None:
        return top_rows(df, by, [F.desc(score), F.asc(tie)], n)
    wanted = written(df.select(*by).distinct().withColumn("rank", F.lit(n).cast("long")))
    return first_rows(df, by, falling(F.col(score)), tie, wanted, "_first").filter("_first = 1").drop("_first")


def around(df: DataFrame, by: list[str], line_no: str, value: Column, name: str,
           before: int, after: int, with_self: bool = True, block: int = 50_000) -> DataFrame:
    """Array of ``value`` over the rows from ``before`` to ``after`` lines away.

    Works on numbered rows: a group is cut into blocks of consecutive lines and
    each block also receives the few border lines of its neighbours, so no task
    holds more than one block whatever the size of the group.
    """
    own = F.floor((F.col(line_no) - 1) / block)
    reach = F.sequence(F.floor((F.col(line_no) - 1 - after) / block), F.floor((F.col(line_no) - 1 + before) / block))
    spread = df.withColumns({"_own": own, "_block": F.explode(reach)})
    frame = Window.partitionBy(*by, "_block").orderBy(line_no)
    if with_self:
        lines = F.collect_list(value).over(frame.rowsBetween(-before, after))
    else:
        lines = F.concat(F.collect_list(value).over(frame.rowsBetween(-before, -1)),
                         F.collect_list(value).over(frame.rowsBetween(1, after)))
    return spread.withColumn(name, lines).filter(F.col("_own") == F.col("_block")).drop("_own", "_block")
