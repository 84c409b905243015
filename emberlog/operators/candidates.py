"""Which rows go to a verdict, and the lines around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import catalogs as c
from emberlog.functions.text import clean_line, strip, words
from emberlog.operators.ordering import around, first_by_score


def select_candidates(df: DataFrame) -> DataFrame:
    return df.filter((F.col("is_anomaly") == 1) & ~F.col("is_rule_based"))


def max_score(df: DataFrame, by: str = "source_file") -> DataFrame:
    return df.groupBy(by).agg(F.max("anomaly_score").alias("max_score"))


def score_gate(candidates: DataFrame, scored: DataFrame, threshold: float | DataFrame = 0.0, by: str = "source_file") -> DataFrame:
    """Keep candidates of files whose highest score reaches the threshold: a number, or a table of one row with a column ``threshold``."""
    limit = threshold if isinstance(threshold, DataFrame) else scored.sparkSession.range(1).select(F.lit(threshold).alias("threshold"))
    best = max_score(scored, by)
    open_files = best.join(limit.select("threshold"), F.col("max_score") >= F.col("threshold"), "left_semi").select(by)
    return candidates.join(open_files, by, "left_semi")


def candidate_cap(df: DataFrame, n: int = 10_000, by: str = "source_file") -> DataFrame:
    """The reference size limit per file: the first ``n`` in score order."""
    return first_by_score(df, [by], "anomaly_score", "row_id", n)


def _cleaned(df: DataFrame, source: str) -> DataFrame:
    return df.select(F.col(source), clean_line("log").alias("_clean")).distinct()


def drop_allowlisted(df: DataFrame, allow: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows whose cleaned line is not on the allow-list of their file."""
    rows = df.withColumn("_clean", clean_line("log"))
    return rows.join(_cleaned(allow, source), [source, "_clean"], "left_anti").drop("_clean")


def allowlisted_counts(df: DataFrame, allow: DataFrame, source: str = "source_file") -> DataFrame:
    rows = df.withColumn("_clean", clean_line("log"))
    return (rows.join(_cleaned(allow, source), [source, "_clean"], "left_semi")
            .groupBy(source).agg(F.count(F.lit(1)).alias("allowlisted")))


def demote_normal(df: DataFrame, ignore_case: bool = False) -> DataFrame:
    label = F.lower("classification") if ignore_case else F.col("classification")
    normal = ["routine", "normal", "unknown"] if ignore_case else ["Routine", "Normal", "unknown"]
    return df.withColumn("is_anomaly", F.when(label.isin(normal), 0).otherwise(F.col("is_anomaly")))


def dependent_filter(df: DataFrame) -> DataFrame:
    """Stack frames without a verdict of their own are not anomalies."""
    frame = F.coalesce((F.col("classification") == "Unknown") & strip("log").startswith("at "), F.lit(False))
    return df.withColumns({
        "reason": F.when(frame, c.STACK_FRAME_REASON).otherwise(F.col("reason")),
        "is_anomaly": F.when(frame, 0).otherwise(F.col("is_anomaly")),
        "classification": F.when(frame, "Dependent Anomaly").otherwise(F.col("classification")),
    })


def context_row_valid(ts_raw: Column, log: Column) -> Column:
    """False for fragments: too short, quoted, bracketed, path-like, cut, or with a broken time."""
    text, ts = strip(log), strip(F.coalesce(ts_raw, F.lit("")))
    size = F.length(text)
    slashes = size - F.length(F.replace(text, F.lit("/"), F.lit("")))
    fragment = (
        (text.startswith("'") & text.endswith("'") & (size < 50))
        | ((slashes > 3) & (size < 100))
        | F.contains(text, F.lit("..."))
        | (text.startswith("(") & text.endswith(")") & (size < 100))
    )
    bad_time = (F.length(ts) > 0) & (
        (F.length(ts) < 3) | ts.startswith("(") | ts.startswith("'") | ts.startswith("+") | ~ts.rlike("[0-9]"))
    return (size >= 5) & (F.size(words(text)) >= 2) & ~fragment & ~bad_time


def _day(ts_raw: Column) -> Column:
    """The first ten characters of a time, null when it has fewer: such a time goes with every day."""
    ts = strip(F.coalesce(ts_raw, F.lit("")))
    return F.when(F.length(ts) >= 10, F.substring(ts, 1, 10))


def with_context(candidates: DataFrame, logs: DataFrame, window: int = 5, by: str = "source_file", block: int = 32,
                 mask: Callable[[Column], Column] | None = None, masked: str | None = None) -> DataFrame:
    """``context_logs``: valid lines from ``window`` before to ``window`` after, target included.

    Lines are put together in blocks of ``block`` consecutive lines and the few around them, one row a block, and only the
    blocks that hold a candidate. A candidate meets its block in an equi-join on (file, block), so a line travels once, or
    twice near a border, however many candidates ask for it; no window runs over a file. ``mask`` is applied to the texts
    of a line before it is handed out, once instead of in every context. With a name in ``masked`` the lines as ``mask`` leaves
    them are a second context of that name, and ``context_logs`` has them as they are.
    """
    line, at = F.col("line_no"), F.floor(F.col("line_no") / block)
    asked = candidates.groupBy(by, at.alias("_block")).agg(F.collect_list("line_no").alias("_targets"))
    # Candidates on one line get its context once for each of them; such lines are rare.
    asked = asked.select(by, "_block", F.when(F.size(F.array_distinct("_targets")) < F.size("_targets"), F.col("_targets")).alias("_again"))
    reach = F.sequence(F.floor((line - window) / block), F.floor((line + window) / block))
    shown = mask if mask and not masked else (lambda text: text)
    valid = context_row_valid(F.col("ts_raw"), F.col("log"))
    other = [_unless_same(mask(F.col(n)), F.col(n)).alias(f"masked_{n}") for n in ("ts_raw", "log")] if masked else []
    held = F.struct("line_no", shown(F.col("ts_raw")).alias("timestamp"), shown(F.col("log")).alias("log"), valid.alias("ok"), _day(F.col("ts_raw")).alias("day"), *other)
    lines = logs.select(by, F.explode(reach).alias("_block"), "line_no", "ts_raw", "log").join(asked, [by, "_block"])
    blocks = lines.select(by, "_block", "_again", held.alias("_line")).groupBy(by, "_block").agg(
        F.array_sort(F.collect_list("_line")).alias("_lines"), F.first("_again").alias("_again"))
    met = candidates.withColumns({"_block": at, "_day": _day(F.col("ts_raw"))}).join(blocks, [by, "_block"], "left")
    day = F.col("_day")

    def near(r: Column) -> Column:
        return r["line_no"].between(line - window, line + window)
    kept = F.filter("_lines", lambda r: near(r) & r["ok"] & (day.isNull() | r["day"].isNull() | (r["day"] == day)))
    copies = F.size(F.filter("_again", lambda t: t == line))

    def context(entry: Callable[[Column], Column]) -> Column:
        given = F.transform("_kept", entry)
        repeated = F.flatten(F.transform(given, lambda r: F.array_repeat(r, copies)))
        return F.when(F.col("_near"), F.when(F.col("_again").isNull(), given).otherwise(repeated))
    contexts = {"context_logs": context(lambda r: F.struct(r["timestamp"].alias("timestamp"), r["log"].alias("log")))}
    if masked:
        contexts[masked] = context(lambda r: F.struct(
            F.coalesce(r["masked_ts_raw"], r["timestamp"]).alias("timestamp"), F.coalesce(r["masked_log"], r["log"]).alias("log")))
    first = [by, "line_no"]
    return met.withColumns({"_kept": kept, "_near": F.exists("_lines", near)}).withColumns(contexts).select(
        *first, *[n for n in candidates.columns if n not in first], *contexts)


def _unless_same(changed: Column, text: Column) -> Column:
    return F.when(changed != text, changed)


def context_of_all(df: DataFrame, by: list[str], line_no: str = "line_no", window: int = 5,
                   with_self: bool = False, name: str = "context") -> DataFrame:
    """Neighbour lines of every row, with or without the row itself."""
    return around(df, by, line_no, F.col("log"), name, window, window, with_self)


def skip_blank(df: DataFrame, log: str = "log") -> DataFrame:
    return df.filter(strip(log) != "")


def browse_text(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.col("log").rlike("(?i)" + text)) if text else df


def browse_class(df: DataFrame, label: str = "All") -> DataFrame:
    rows = df if label == "All" else df.filter(F.col("classification") == label)
    return rows.select("timestamp", "classification", "reason", "tag", "log")


def class_choices(df: DataFrame) -> DataFrame:
    return df.select("classification").distinct().orderBy("classification")
