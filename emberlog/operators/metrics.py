"""Per-file statistics. All are two-stage aggregates; none needs a window over log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import catalogs as c
from emberlog.functions import enrich as e
from emberlog.functions.text import col
from emberlog.operators.ordering import top_rows

SOURCE = "source_file"
ERROR_LINE = "(?i)error|exception|fail"


def template_counts(df: DataFrame, template: str = "log_template") -> DataFrame:
    """count, ratio and file total per (file, template)."""
    per = df.groupBy(SOURCE, F.col(template).alias("template")).agg(F.count(F.lit(1)).alias("count"))
    totals = per.groupBy(SOURCE).agg(F.sum("count").alias("total"))
    return per.join(totals, SOURCE).withColumn("ratio", F.col("count") / F.col("total"))


def template_volume(counts: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent templates of every file."""
    top = top_rows(counts, [SOURCE], [F.col("count").desc(), F.col("template").asc()], n)
    return top.select(SOURCE, "template", "count", F.round("ratio", 2).alias("ratio"))


def flood_templates(counts: DataFrame, threshold: float = 0.75) -> DataFrame:
    flooded = counts.filter(F.col("ratio") >= threshold)
    return flooded.select(SOURCE, "template", "count", F.round("ratio", 2).alias("ratio"))


def template_diversity(counts: DataFrame) -> DataFrame:
    """Distinct templates, entropy in bits and share of the largest template."""
    return counts.groupBy(SOURCE).agg(
        F.count(F.lit(1)).alias("unique_templates"),
        F.round(F.sum(-F.col("ratio") * F.log2("ratio")) + F.lit(0.0), 2).alias("template_entropy"),
        F.round(F.max("ratio"), 3).alias("top_template_ratio"),
    )


def level_counts(df: DataFrame, log: str = "log") -> DataFrame:
    """Each row counts for the first of debug, info, warn, error found in it."""
    x = F.lower(F.col(log))
    level = (F.when(F.contains(x, F.lit("debug")), "debug").when(F.contains(x, F.lit("info")), "info")
             .when(F.contains(x, F.lit("warn")), "warn").when(F.contains(x, F.lit("error")), "error"))
    return df.select(SOURCE, level.alias("_level")).groupBy(SOURCE).agg(
        *[F.count_if(F.col("_level") == n).alias(n) for n in ("debug", "info", "warn", "error")])


def tag_counts(df: DataFrame) -> DataFrame:
    """Occurrences per tag. Equal tag lists are counted first, so few rows are exploded."""
    lists = df.groupBy(SOURCE, "tag").agg(F.count(F.lit(1)).alias("n"))
    # explode_outer: the filter Spark derives for explode would be pushed below the
    # aggregate and evaluate the tag expression a second time on every row.
    return (lists.select(SOURCE, F.explode_outer("tag").alias("tag"), "n").filter("tag IS NOT NULL")
            .groupBy(SOURCE, "tag").agg(F.sum("n").alias("count")))


def tags_ranked(df: DataFrame) -> DataFrame:
    """All tags over all files, most frequent first."""
    total = tag_counts(df).groupBy("tag").agg(F.sum("count").alias("count"))
    return total.orderBy(F.col("count").desc(), "tag")


def leak_counts(leaks: DataFrame) -> DataFrame:
    return leaks.groupBy(SOURCE, "reason").agg(F.count(F.lit(1)).alias("count"))


def time_metrics(df: DataFrame, log: str = "log") -> DataFrame:
    """Span, rates, busiest minute and error share over rows with a valid time.

    Rows are first counted per (file, minute), so even one huge file is spread
    over the map tasks and only one row per minute is shuffled.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    minutes = (
        df.filter(F.col("ts").isNotNull())
        .groupBy(SOURCE, F.floor(micros / 60_000_000).alias("_minute"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
             F.count_if(F.col(log).rlike(ERROR_LINE)).alias("errors"))
    )
    span = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6
    rate = F.col("_n") / F.col("_span")
    measured = minutes.groupBy(SOURCE).agg(
        F.min("first").alias("start_time"), F.max("last").alias("end_time"), F.sum("n").alias("_n"),
        F.max("n").alias("_peak"), F.sum("errors").alias("_errors")).withColumn("_span", span)
    return measured.withColumn("available", F.col("_span") > 0).select(
        SOURCE, "available",
        *[F.when(F.col("available"), v).alias(n) for n, v in {
            "start_time": F.col("start_time"),
            "end_time": F.col("end_time"),
            "time_span_seconds": F.round("_span", 2),
            "logs_per_second": F.round(rate, 2),
            "logs_per_minute": F.round(rate * 60, 2),
            "logs_per_hour": F.round(rate * 3600, 2),
            "peak_rate_per_minute": F.col("_peak"),
            "error_rate": F.round(F.col("_errors") / F.col("_n"), 4),
        }.items()])


def component_mentions(df: DataFrame, log: str = "log") -> DataFrame:
    """Every ``[name]`` or ``name:`` of a line, names under 30 characters."""
    raw = F.explode(F.regexp_extract_all(F.col(log), F.lit(r"\[[^\]]+\]|[\p{L}\p{N}_]+:"), F.lit(0)))
    return (df.select(SOURCE, raw.alias("_m")).select(SOURCE, F.when(F.col("_m").startswith("["), F.expr(
        "substring(_m, 2, length(_m) - 2)")).otherwise(F.expr("substring(_m, 1, length(_m) - 1)")).alias("component"))
        .filter((F.length("component") < 30) & (F.length("component") > 0)))


def component_counts(df: DataFrame, log: str = "log") -> DataFrame:
    return component_mentions(df, log).groupBy(SOURCE, "component").agg(F.count(F.lit(1)).alias("count"))


def component_metrics(df: DataFrame, log: str = "log", n: int = 5) -> DataFrame:
    """Distinct components and the ``n`` most frequent ones as an array, one row per file."""
    counts = component_counts(df, log)
    top = (top_components(counts, n).groupBy(SOURCE).agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "component"))),
        lambda r: F.struct(r["component"].alias("name"), (-r["c"]).alias("count"))).alias("top_components")))
    unique = counts.groupBy(SOURCE).agg(F.count(F.lit(1)).alias("unique_components"))
    return unique.join(top, SOURCE)


def top_components(counts: DataFrame, n: int = 5) -> DataFrame:
    return top_rows(counts, [SOURCE], [F.col("count").desc(), F.col("component").asc()], n)


def leak_examples(leaks: DataFrame, n: int = 3) -> DataFrame:
    """Per file: number of leaks, leak types, and the first ``n`` redacted lines."""
    first = (top_rows(leaks.select(SOURCE, "row_id", "log"), [SOURCE], ["row_id"], n)
             .groupBy(SOURCE).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "log"))),
                                              lambda r: r["log"]).alias("examples")))
    types = leaks.groupBy(SOURCE).agg(F.count(F.lit(1)).alias("leak_count"),
                                      F.array_sort(F.collect_set("leak_type")).alias("types_detected"))
    return types.join(first, SOURCE)


def incident_counts(logs: DataFrame, leaks: DataFrame, final: DataFrame, allowlisted: DataFrame | None = None) -> DataFrame:
    """Per file: leaks + rule rows, flagged rows, verified threats, rows the allow-list removed."""
    rules = logs.groupBy(SOURCE).agg(F.count_if("is_rule_based").alias("rule_rows"))
    leaked = leaks.groupBy(SOURCE).agg(F.count(F.lit(1)).alias("leak_count"))
    flagged = final.groupBy(SOURCE).agg(
        F.count_if(F.col("is_anomaly") == 1).alias("critical_anomalies"),
        F.count_if((F.col("is_anomaly") == 1) & (F.col("classification") == "Anomaly")).alias("ai_verified_threats"))
    out = rules.join(leaked, SOURCE, "left").join(flagged, SOURCE, "left")
    if allowlisted is not None:
        out = out.join(allowlisted.withColumnRenamed("allowlisted", "false_positives_filtered"), SOURCE, "left")
    else:
        out = out.withColumn("false_positives_filtered", F.lit(0).cast("long"))
    return out.fillna(0).withColumn("security_incidents", F.col("leak_count") + F.col("rule_rows"))


def risk_level(incidents: Column | str, critical: Column | str) -> Column:
    i, a = col(incidents), col(critical)
    return F.when((i > 5) | (a > 10), "HIGH").when((i > 2) | (a > 5), "MEDIUM").otherwise("LOW")


def rule_severity(rule_rows: Column | str) -> Column:
    n = col(rule_rows)
    return F.when(n > 3, "HIGH").when(n > 0, "MEDIUM").otherwise("LOW")


def threat_indicators(flood: Column, leaks: Column, rule_rows: Column, error_rate: Column) -> Column:
    return F.array_compact(F.array(
        F.when(flood, F.lit(c.THREATS["flood"])),
        F.when(leaks > 0, F.lit(c.THREATS["leaks"])),
        F.when(rule_rows > 0, F.lit(c.THREATS["rules"])),
        F.when(F.coalesce(error_rate, F.lit(0.0)) > 0.1, F.lit(c.THREATS["errors"])),
    ))


def source_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy(SOURCE, "anomaly_source").agg(F.count(F.lit(1)).alias("count"))


def with_call_columns(verdicts: DataFrame) -> DataFrame:
    """``status`` and ``latency_s`` where a reply table brought none: every reply is a call that went well."""
    missing = {"status": F.when(F.col("reply").isNotNull(), F.lit("ok")), "latency_s": F.lit(None).cast("double")}
    return verdicts.withColumns({n: x for n, x in missing.items() if n not in verdicts.columns})


def verdict_stats(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, errors and time of the verdict phase from ``status`` and ``latency_s``, in all or per ``by``."""
    calls = F.count_if(F.col("status") != "error")
    return verdicts.groupBy(*(by or [])).agg(
        calls.alias("total_calls"), F.count_if(F.col("status") == "error").alias("errors"),
        F.round(F.coalesce(F.sum("latency_s"), F.lit(0.0)), 2).alias("total_time"),
        F.round(F.coalesce(F.sum("latency_s"), F.lit(0.0)) / F.greatest(calls, F.lit(1)), 2).alias("average_time"))


def context_analysis(df: DataFrame, context: str = "context_logs", key: str = "row_id") -> DataFrame:
    """Repetition, severities, components and pattern names over each row's context lines.

    The context array has a fixed small length, so this stays inside the row: no shuffle.
    """
    lines = F.transform(F.col(context), lambda r: r["log"])
    levels = F.transform(lines, e.level_word)
    def how_many(level: str) -> Column:
        return F.size(F.filter(levels, lambda v: v == level))
    repeats = F.transform(lines, lambda a: F.size(F.filter(lines, lambda b: a == b)))
    named = F.filter(F.transform(lines, e.leading_component), lambda v: v != "unknown")
    return df.withColumn("context_analysis", F.struct(
        F.coalesce(F.array_max(repeats), F.lit(0)).alias("repetition_count"),
        F.struct(*[how_many(n).alias(n) for n in ("error", "warning", "info", "debug", "unknown")]).alias("severity_distribution"),
        F.array_sort(F.array_distinct(named)).alias("related_components"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(lines, e.token_patterns)))).alias("patterns"),
    ))
