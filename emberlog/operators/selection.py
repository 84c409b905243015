"""The first rows of a group, and values at a rank, without ordering the group.

A cut is narrowed down by counting: the values between two bounds are counted in ``BINS`` bins, the bin in which the wanted rank
lies gives the next bounds, and so on until a bin holds few rows, or rows of one value only; then the tie-breaking identifier is
narrowed down in the same way. A pass is one map-side combined count; only the few rows that are left are ranked.

The tables of cuts have one row a group and are written as files, whose size Spark knows: rows meet them without being laid
out by group, which would bring a large group into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from emberlog.session import written

BINS = 1024
FEW = 20_000


def _on(by: list[str], left: str = "l", right: str = "r") -> Column:
    out = F.lit(True)
    for k in by:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _joined(rows: DataFrame, table: DataFrame, by: list[str], names: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns ``names`` of ``table`` (one row a group, null groups too)."""
    return rows.alias("l").join(table.alias("r"), _on(by), how).select("l.*", *[F.col(f"r.{n}").alias(n) for n in names])


def narrowed(rows: DataFrame, by: list[str], value: str, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """(by, rank, below, inside, low, high): the row of 1-based ``rank`` (ascending ``value``, a double) lies between ``low`` and ``high``, both
    values of rows; ``below`` rows are smaller, ``inside`` rows between the two: at most ``few``, or of one value.

    ``wanted``: (by, rank), one row a group; groups of fewer rows are left out. Null values count as minus infinity.
    """
    at = rows.select(*by, F.coalesce(F.col(value), F.lit(float("-inf"))).alias("_v"))
    found = at.groupBy(*by).agg(F.count(F.lit(1)).alias("inside"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    state = written(_joined(found, wanted, by, ["rank"]).filter("rank BETWEEN 1 AND inside").withColumn("below", F.lit(0).cast("long")))
    small, large = float("-1.7e308"), float("1.7e308")
    while True:
        more = state.filter((F.col("inside") > few) & (F.col("low") < F.col("high")))
        if more.isEmpty():
            return state
        # Halves keep the distance finite; an end without a finite value is a bin of its own.
        low, high = (F.greatest(F.lit(small), F.least(F.lit(large), F.col(c))) / 2 for c in ("low", "high"))
        place = F.when(F.col("_v") <= F.col("low"), -1).when(F.col("_v") >= F.col("high"), BINS).otherwise(
            F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - low) / (high - low) * BINS))).cast("int")
        inside = _joined(at, more, by, ["low", "high"]).filter("_v BETWEEN low AND high").withColumn("bin", place)
        bins = inside.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = _joined(bins.withColumn("_upto", F.sum("n").over(upto)), more, by, ["rank", "below"])
        hit = bins.filter((F.col("below") + F.col("_upto") - F.col("n") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("_upto")))
        hit = hit.select(*by, F.col("n").alias("inside"), "low", "high", "rank", (F.col("below") + F.col("_upto") - F.col("n")).alias("below"))
        done = state.filter((F.col("inside") <= few) | (F.col("low") >= F.col("high")))
        state = written(done.select(*hit.columns).unionByName(hit))


def first_rows(df: DataFrame, by: list[str], value: Column, tie: str, wanted: DataFrame, flag: str, few: int = FEW) -> DataFrame:
    """Add ``flag`` (0/1): whether a row is among the first ``rank`` of its group by ascending ``value``, then ``tie`` (whole numbers, different
    in a group). ``wanted``: (by, rank); groups without an entry have no first row."""
    rows = df.withColumn("_value", F.coalesce(value.cast("double"), F.lit(float("-inf"))))
    cut = narrowed(rows, by, "_value", wanted, few)
    names = ["rank", "below", "low", "high"]
    placed = _joined(rows, cut, by, names, "left")
    # Groups smaller than the rank asked for are wanted whole; groups without an entry not at all.
    sized = _joined(placed, wanted.withColumnRenamed("rank", "_all"), by, ["_all"], "left").withColumn(
        flag, F.when(F.col("_all").isNull() | (F.col("_all") < 1), 0).when(F.col("rank").isNull() | (F.col("_value") < F.col("low")), 1)
        .when(F.col("_value") > F.col("high"), 0))
    clear = sized.filter(F.col(flag).isNotNull())
    open_rows = sized.filter(F.col(flag).isNull())
    crowd = written(open_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.first("rank").alias("rank"), F.first("below").alias("below")))
    tied = crowd.filter(F.col("_n") > few).select(*by, (F.col("rank") - F.col("below")).alias("rank"))
    order = Window.partitionBy(*by).orderBy("_value", tie)
    out = [*df.columns, flag]
    ranked = _joined(open_rows, crowd, by, ["_n"])
    short = ranked.filter(F.col("_n") <= few).withColumn(flag, (F.row_number().over(order) + F.col("below") <= F.col("rank")).cast("int")).select(*out)
    parts = clear.select(*out).unionByName(short)
    if tied.isEmpty():
        return parts
    # All these rows have one value: the identifiers are narrowed down. Above 2 ** 53 they are told apart in two steps.
    rest = ranked.filter(F.col("_n") > few).select(*df.columns)
    return parts.unionByName(_first_by_id(rest, by, tie, written(tied), flag, few).select(*out))


def _first_by_id(df: DataFrame, by: list[str], tie: str, wanted: DataFrame, flag: str, few: int) -> DataFrame:
    high, low = F.shiftright(F.col(tie), 32).cast("double"), F.col(tie).bitwiseAND(0xFFFFFFFF).cast("double")
    rows = df.withColumns({"_high": high, "_low": low})
    cut = narrowed(rows, by, "_high", wanted, 0)
    placed = _joined(rows, cut.withColumnRenamed("low", "_cut"), by, ["rank", "below", "_cut"])
    sure = placed.filter(F.col("_high") != F.col("_cut")).withColumn(flag, (F.col("_high") < F.col("_cut")).cast("int"))
    open_rows = placed.filter(F.col("_high") == F.col("_cut"))
    inner = written(open_rows.groupBy(*by).agg((F.first("rank") - F.first("below")).alias("rank")))
    fine = narrowed(open_rows.drop("rank", "below"), by, "_low", inner, 0)
    last = _joined(open_rows.drop("rank", "below", "_cut"), fine.withColumnRenamed("low", "_cut"), by, ["_cut"])
    return sure.select(*df.columns, flag).unionByName(last.withColumn(flag, (F.col("_low") <= F.col("_cut")).cast("int")).select(*df.columns, flag))


def values_at(df: DataFrame, by: list[str], value: str, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """(by, rank, value, next): the value at a rank (ascending) and the one behind it (null at the end)."""
    cut = narrowed(df, by, value, wanted, few)
    rows = _joined(df.select(*by, F.col(value).alias("_v")), cut, by, ["rank", "below", "low", "high"])
    above = rows.filter("_v > high").groupBy(*by).agg(F.min("_v").alias("_above"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_v")) + F.col("below")
    inside = rows.filter("_v BETWEEN low AND high AND low < high").withColumn("_place", place)
    picked = inside.groupBy(*by).agg(*[F.max(F.when(F.col("_place") == F.col("rank") + i, F.col("_v"))).alias(n) for i, n in enumerate(("_at", "_then"))])
    out = _joined(_joined(cut, above, by, ["_above"], "left"), picked, by, ["_at", "_then"], "left")
    one = F.col("low") == F.col("high")
    then = F.when(one & (F.col("rank") < F.col("below") + F.col("inside")), F.col("low")).otherwise(F.coalesce("_then", "_above"))
    return out.select(*by, "rank", F.when(one, F.col("low")).otherwise(F.col("_at")).alias("value"), then.alias("next"))
