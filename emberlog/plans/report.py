"""The per-file security and operations report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators import metrics as m

SOURCE = m.SOURCE


def report(volume: DataFrame, counts: DataFrame, incidents: DataFrame, times: DataFrame, levels: DataFrame,
           components: DataFrame, leaks: DataFrame, tags: DataFrame, flood_threshold: float = 0.75,
           verdicts: DataFrame | None = None, limits: DataFrame | None = None, max_lines: int | None = None) -> DataFrame:
    """Join the per-file aggregates into one nested row per file.

    ``verdicts``: the judged candidates, with ``status`` and ``latency_s`` if known; ``limits``: ``large_file_flag``.
    Every other input has one row per file (``counts`` and ``tags`` a few), so the
    joins are small whatever the size of the logs.
    """
    floods = m.flood_templates(counts, flood_threshold).groupBy(SOURCE).agg(F.count(F.lit(1)).alias("flooded"))
    patterns = m.template_volume(counts).groupBy(SOURCE).agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "template", "ratio"))),
        lambda r: F.struct(r["template"].alias("template"), (-r["c"]).alias("count"), r["ratio"].alias("ratio"))).alias("patterns"))
    tagged = tags.groupBy(SOURCE).agg(F.map_from_entries(F.collect_list(F.struct("tag", "count"))).alias("tag_summary"))
    joined = volume
    if verdicts is not None:
        joined = joined.join(m.verdict_stats(m.with_call_columns(verdicts), [SOURCE]), SOURCE, "left")
    if limits is not None:
        joined = joined.join(limits.select(SOURCE, "is_large"), SOURCE, "left")
    for part in (m.template_diversity(counts), floods, patterns, incidents.drop("leak_count"), times, levels, components, leaks, tagged):
        joined = joined.join(part, SOURCE, "left")

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))
    flood = n("flooded") > 0
    calls = {name: n(name) if verdicts is not None else F.lit(0) for name in ("total_calls", "errors", "average_time")}
    ai = F.struct(F.lit(verdicts is not None).alias("enabled"), calls["total_calls"].cast("long").alias("total_calls"),
                  calls["average_time"].cast("double").alias("average_response_time"), calls["errors"].cast("long").alias("classification_errors"))
    error_rate = F.coalesce(F.col("error_rate"), F.lit(0.0))
    return joined.select(
        SOURCE,
        F.struct(
            m.risk_level(n("security_incidents"), n("critical_anomalies")).alias("risk_level"),
            n("security_incidents").alias("security_incidents"),
            n("critical_anomalies").alias("critical_anomalies"),
            m.threat_indicators(flood, n("leak_count"), n("rule_rows"), error_rate).alias("threat_indicators"),
            "start_time", "end_time",
            F.round(F.coalesce("time_span_seconds", F.lit(0.0)) / 3600, 2).alias("duration_hours"),
        ).alias("siem_report"),
        F.struct(
            n("leak_count").alias("leak_count"), "examples", "types_detected", n("rule_rows").alias("rule_violations"),
            m.rule_severity(n("rule_rows")).alias("rule_severity"),
            n("critical_anomalies").alias("statistical_anomalies"), n("ai_verified_threats").alias("ai_verified_threats"),
            n("false_positives_filtered").alias("false_positives_filtered"),
        ).alias("security_assessment"),
        F.struct(
            "original_count", "processed_count", F.coalesce("logs_per_hour", F.lit(0.0)).alias("events_per_hour"),
            n("peak_rate_per_minute").alias("peak_rate_per_minute"), F.round(error_rate * 100, 2).alias("error_rate"),
            F.struct("debug", "info", "warn", "error").alias("levels"), flood.alias("flood_detected"),
            n("flooded").alias("affected_templates"), F.coalesce("available", F.lit(False)).alias("time_available"),
            "logs_per_second", "logs_per_minute",
            n("unique_components").alias("unique_components"), "top_components",
        ).alias("operational_metrics"),
        F.struct("unique_templates", "template_entropy", "top_template_ratio", F.col("patterns").alias("top_log_patterns"),
                 "tag_summary", ai.alias("ai_analysis")).alias("technical_analysis"),
        F.struct(F.lit(max_lines).cast("long").alias("max_logs_analyzed"), F.lit(max_lines is not None).alias("compliance_mode"),
                 (F.coalesce("is_large", F.lit(False)) if limits is not None else F.lit(False)).alias("large_file")).alias("processing_limits"),
    )
