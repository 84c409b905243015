"""Per-file statistics, top-k reports and the summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import candidates as cand
from emberlog.operators import metrics as m
from emberlog.operators import rules as r
from emberlog.operators.ordering import top_rows, top_share
from emberlog.operators.templates import signature_templates
from emberlog.plans.report import report
from emberlog.session import cut_lineage
from emberlog.sources import cap_rows_per_file, large_file_flag
from registry.common import (
    clean_sql, first_match_sql, joined, logs, matches, numbered, redact_sql, registrar, signature_sql, table, with_ctes,
)
from registry.text_queries import RULES, SECURITY

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

COUNTS_SQL = f"""counts AS (SELECT source_file, template, count, count / sum(count) OVER (PARTITION BY source_file) AS ratio FROM (
 SELECT source_file, {signature_sql('log')} AS template, count(*) AS count FROM logs GROUP BY ALL))"""
RULE_NAME = first_match_sql("log", RULES, lambda p: p.name)
LEAK_TYPE = first_match_sql("log", SECURITY, lambda p: p.name)
LEAKS_SQL = f"""leaks AS (SELECT row_id, source_file, leak_type, 'Possible ' || leak_type || ' leakage.' AS reason, shown AS log FROM (
 SELECT row_id, source_file, {LEAK_TYPE} AS leak_type, {redact_sql('log')} AS shown FROM logs) WHERE leak_type IS NOT NULL)"""
RULED_SQL = f"ruled AS (SELECT *, {RULE_NAME} AS rule_name FROM logs)"


def _counts(spark, sf):
    return m.template_counts(signature_templates(logs(spark, sf)))


def _ruled(spark, sf):
    return r.classify_by_rules(logs(spark, sf), RULES, SECURITY)


def _leaks(spark, sf):
    return r.find_leaks(logs(spark, sf), SECURITY)


def _scored(spark, sf):
    values = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("anomaly_score"))
    return logs(spark, sf).join(values, "row_id")


SCORED_SQL = "scored AS (SELECT l.*, e.value AS anomaly_score FROM logs l JOIN events e ON l.row_id = e.event_id)"


@query("s5_cap_rows_per_file", with_ctes("SELECT row_id, source_file, line_no FROM numbered WHERE line_no <= 700", base="numbered"))
def _(spark, sf):
    return cap_rows_per_file(numbered(spark, sf), 700).select("row_id", "source_file", "line_no")


@query("s6_large_file_flag", with_ctes("SELECT source_file, n AS original_count, least(n, 2500) AS kept_count, least(n, 2500) > 2450 AS is_large FROM (SELECT source_file, count(*) AS n FROM logs GROUP BY 1)"))
def _(spark, sf):
    return large_file_flag(logs(spark, sf), 2450, 2500)


@query("a1_template_volume", with_ctes("""SELECT source_file, template, count, round(ratio, 2) AS ratio FROM counts
 QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY count DESC, template) <= 5""", COUNTS_SQL))
def _(spark, sf):
    return m.template_volume(_counts(spark, sf))


@query("t3_top_templates", with_ctes("""SELECT source_file, template, count FROM counts
 QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY count DESC, template) <= 5""", COUNTS_SQL))
def _(spark, sf):
    return m.template_volume(_counts(spark, sf)).drop("ratio")


@query("a2_flood_templates", with_ctes("SELECT source_file, template, count, round(ratio, 2) AS ratio FROM counts WHERE ratio >= 0.19", COUNTS_SQL))
def _(spark, sf):
    return m.flood_templates(_counts(spark, sf), 0.19)


@query("a3_template_diversity", with_ctes("""SELECT source_file, count(*) AS unique_templates, round(sum(-ratio * log2(ratio)), 2) AS template_entropy,
 round(max(ratio), 3) AS top_template_ratio FROM counts GROUP BY 1""", COUNTS_SQL))
def _(spark, sf):
    return m.template_diversity(_counts(spark, sf))


@query("a4_level_counts", with_ctes("""SELECT source_file, count(*) FILTER (l = 'debug') AS debug, count(*) FILTER (l = 'info') AS info, count(*) FILTER (l = 'warn') AS warn,
 count(*) FILTER (l = 'error') AS error FROM (SELECT source_file, CASE WHEN contains(lower(log), 'debug') THEN 'debug' WHEN contains(lower(log), 'info') THEN 'info'
 WHEN contains(lower(log), 'warn') THEN 'warn' WHEN contains(lower(log), 'error') THEN 'error' END AS l FROM logs) GROUP BY 1"""))
def _(spark, sf):
    return m.level_counts(logs(spark, sf))


@query("a5_tag_counts", with_ctes("SELECT source_file, rule_name AS tag, count(*) AS count FROM ruled WHERE rule_name IS NOT NULL GROUP BY ALL", RULED_SQL))
def _(spark, sf):
    return m.tag_counts(_ruled(spark, sf))


@query("t8_tags_ranked", with_ctes("SELECT rule_name AS tag, count(*) AS count FROM ruled WHERE rule_name IS NOT NULL GROUP BY ALL", RULED_SQL))
def _(spark, sf):
    return m.tags_ranked(_ruled(spark, sf))


@query("a6_leak_counts", with_ctes("SELECT source_file, reason, count(*) AS count FROM leaks GROUP BY ALL", LEAKS_SQL))
def _(spark, sf):
    return m.leak_counts(_leaks(spark, sf))


TIME_SQL = """times AS (SELECT source_file, min(ts) AS t0, max(ts) AS t1, count(*) AS n,
 (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span, avg(CASE WHEN regexp_matches(log, 'error|exception|fail', 'i') THEN 1.0 ELSE 0.0 END) AS error_rate FROM logs GROUP BY 1)"""


@query("a7_time_span_rates", with_ctes("""SELECT source_file, span > 0 AS available, strftime(t0, '%Y-%m-%d %H:%M:%S.%f') AS start_time, strftime(t1, '%Y-%m-%d %H:%M:%S.%f') AS end_time,
 round(span, 2) AS time_span_seconds, round(n / span, 2) AS logs_per_second, round(n / span * 60, 2) AS logs_per_minute, round(n / span * 3600, 2) AS logs_per_hour FROM times""", TIME_SQL))
def _(spark, sf):
    out = m.time_metrics(logs(spark, sf)).drop("peak_rate_per_minute", "error_rate")
    return out.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss.SSSSSS") for n in ("start_time", "end_time")})


@query("a8_peak_per_minute", with_ctes("SELECT source_file, max(n) AS peak_rate_per_minute FROM (SELECT source_file, date_trunc('minute', ts), count(*) AS n FROM logs GROUP BY ALL) GROUP BY 1"))
def _(spark, sf):
    return m.time_metrics(logs(spark, sf)).select("source_file", "peak_rate_per_minute")


@query("a9_error_rate", with_ctes("SELECT source_file, round(error_rate, 4) AS error_rate FROM times", TIME_SQL))
def _(spark, sf):
    return m.time_metrics(logs(spark, sf)).select("source_file", "error_rate")


COMPONENTS_SQL = r"""mentions AS (SELECT source_file, CASE WHEN m LIKE '[%' THEN substr(m, 2, length(m) - 2) ELSE substr(m, 1, length(m) - 1) END AS component
 FROM (SELECT source_file, unnest(regexp_extract_all(log, '\[[^\]]+\]|[\p{L}\p{N}_]+:')) AS m FROM logs)),
 components AS (SELECT source_file, component, count(*) AS count FROM mentions WHERE length(component) < 30 GROUP BY ALL)"""


@query("a10_component_counts", with_ctes("SELECT * FROM components", COMPONENTS_SQL))
def _(spark, sf):
    return m.component_counts(logs(spark, sf))


@query("t4_top_components", with_ctes("SELECT * FROM components QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY count DESC, component) <= 5", COMPONENTS_SQL))
def _(spark, sf):
    return m.top_components(m.component_counts(logs(spark, sf)))


def _final(spark, sf):
    """Rule rows, and purchases as candidates with a verdict."""
    return _judged(_ruled(spark, sf))


def _judged(rows):
    judged = rows.filter((F.col("event_type") == "purchase")).withColumns({
        "classification": F.when(F.length("log") % 2 == 0, "Anomaly").otherwise("Normal"),
        "is_anomaly": (F.length("log") % 2 == 0).cast("int"), "anomaly_source": F.lit("LLM")})
    return rows.filter("is_rule_based").unionByName(judged)


def _allow(spark, sf):
    return _known_fine(logs(spark, sf))


def _known_fine(rows):
    """Every slow checkout that costs a round amount is known to be fine."""
    return rows.filter("event_type = 'purchase' AND log LIKE '%00'").select("source_file", "log")


FINAL_SQL = f"""{RULED_SQL}, final AS (SELECT row_id, source_file, 'Operational Error' AS classification, 1 AS is_anomaly, 'Rule-Based' AS anomaly_source FROM ruled WHERE rule_name IS NOT NULL
 UNION ALL SELECT row_id, source_file, CASE WHEN length(log) % 2 = 0 THEN 'Anomaly' ELSE 'Normal' END, CASE WHEN length(log) % 2 = 0 THEN 1 ELSE 0 END, 'LLM' FROM logs WHERE event_type = 'purchase'),
 allow AS (SELECT DISTINCT source_file, {clean_sql('log')} AS clean FROM logs WHERE event_type = 'purchase' AND log LIKE '%00'),
 dropped AS (SELECT source_file, count(*) AS allowlisted FROM (SELECT source_file, {clean_sql('log')} AS clean FROM logs WHERE event_type = 'purchase') JOIN allow USING (source_file, clean) GROUP BY 1),
 incidents AS (SELECT source_file, coalesce(l, 0) + ru AS security_incidents, coalesce(c, 0) AS critical_anomalies, coalesce(v, 0) AS ai_verified_threats, coalesce(allowlisted, 0) AS false_positives_filtered,
  coalesce(l, 0) AS leak_count, ru AS rule_rows
  FROM (SELECT source_file, count(rule_name) AS ru FROM ruled GROUP BY 1) LEFT JOIN (SELECT source_file, count(*) AS l FROM leaks GROUP BY 1) USING (source_file)
  LEFT JOIN (SELECT source_file, count(*) FILTER (is_anomaly = 1) AS c, count(*) FILTER (is_anomaly = 1 AND classification = 'Anomaly') AS v FROM final GROUP BY 1) USING (source_file)
  LEFT JOIN dropped USING (source_file))"""


def _incidents(spark, sf):
    counts = cand.allowlisted_counts(logs(spark, sf).filter("event_type = 'purchase'"), _allow(spark, sf))
    return m.incident_counts(_ruled(spark, sf), _leaks(spark, sf), _final(spark, sf), counts)


@query("a11_siem_counts", with_ctes("SELECT * FROM incidents", LEAKS_SQL, FINAL_SQL))
def _(spark, sf):
    return _incidents(spark, sf)


# Per user, so that all three levels occur.
BY_USER_SQL = f"""per AS (SELECT user_id, count({RULE_NAME}) + count({LEAK_TYPE}) AS incidents, count({RULE_NAME}) AS rule_rows, count(*) FILTER (event_type = 'purchase') AS critical,
 avg(CASE WHEN regexp_matches(log, 'error|exception|fail', 'i') THEN 1.0 ELSE 0.0 END) AS error_rate, count({LEAK_TYPE}) AS leaks FROM (SELECT user_id, CAST(ts AS DATE) AS day, * EXCLUDE (user_id) FROM logs) GROUP BY user_id, day)"""


def _per_user_day(spark, sf):
    rows = _ruled(spark, sf).withColumn("leak", r.first_match("log", SECURITY))
    return rows.groupBy("user_id", F.to_date("ts")).agg(
        (F.count_if("is_rule_based") + F.count("leak")).alias("incidents"), F.count_if("is_rule_based").alias("rule_rows"),
        F.count_if(F.col("event_type") == "purchase").alias("critical"), F.avg(F.col("log").rlike(m.ERROR_LINE).cast("int")).alias("error_rate"),
        F.count("leak").alias("leaks"))


@query("a12_risk_level", with_ctes("""SELECT user_id, incidents, critical, CASE WHEN incidents > 5 OR critical > 10 THEN 'HIGH' WHEN incidents > 2 OR critical > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM per""", BY_USER_SQL))
def _(spark, sf):
    return _per_user_day(spark, sf).select("user_id", "incidents", "critical", m.risk_level("incidents", "critical").alias("risk_level"))


@query("a13_threat_indicators", with_ctes("""SELECT user_id, array_to_string(list_filter([CASE WHEN critical > 1 THEN 'LOG_FLOODING' END, CASE WHEN leaks > 0 THEN 'DATA_EXPOSURE' END,
 CASE WHEN rule_rows > 0 THEN 'RULE_VIOLATIONS' END, CASE WHEN error_rate > 0.1 THEN 'HIGH_ERROR_RATE' END], lambda x: x IS NOT NULL), '|') AS indicators FROM per""", BY_USER_SQL))
def _(spark, sf):
    return _per_user_day(spark, sf).select("user_id", joined(m.threat_indicators(
        F.col("critical") > 1, F.col("leaks"), F.col("rule_rows"), F.col("error_rate"))).alias("indicators"))


@query("a14_rule_severity", with_ctes("SELECT user_id, rule_rows, CASE WHEN rule_rows > 3 THEN 'HIGH' WHEN rule_rows > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM per", BY_USER_SQL))
def _(spark, sf):
    return _per_user_day(spark, sf).select("user_id", "rule_rows", m.rule_severity("rule_rows").alias("severity"))


def _report(spark, sf):
    """As in a whole run: the classified log table is written once and every part reads it."""
    rows = cut_lineage(_ruled(spark, sf))
    leaks = cut_lineage(r.find_leaks(rows, SECURITY))
    final, counts = cut_lineage(_judged(rows)), cut_lineage(m.template_counts(signature_templates(rows)))
    allowed = cand.allowlisted_counts(rows.filter("event_type = 'purchase'"), _known_fine(rows))
    volume = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("original_count"), F.count(F.lit(1)).alias("processed_count"))
    return report(volume, counts, m.incident_counts(rows, leaks, final, allowed), m.time_metrics(rows), m.level_counts(rows), m.component_metrics(rows),
                  m.leak_examples(leaks), m.tag_counts(final), 0.19)


@query("a15_siem_summary", with_ctes("""SELECT source_file, CASE WHEN security_incidents > 5 OR critical_anomalies > 10 THEN 'HIGH' WHEN security_incidents > 2 OR critical_anomalies > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 security_incidents, critical_anomalies, array_to_string(list_filter([CASE WHEN flooded > 0 THEN 'LOG_FLOODING' END, CASE WHEN leak_count > 0 THEN 'DATA_EXPOSURE' END, CASE WHEN rule_rows > 0 THEN 'RULE_VIOLATIONS' END,
 CASE WHEN round(error_rate, 4) > 0.1 THEN 'HIGH_ERROR_RATE' END], lambda x: x IS NOT NULL), '|') AS threat_indicators, round(round(span, 2) / 3600, 2) AS duration_hours, leak_count, rule_rows AS rule_violations, ai_verified_threats, false_positives_filtered,
 n AS original_count, round(n / span * 3600, 2) AS events_per_hour, round(round(error_rate, 4) * 100, 2) AS error_rate, flooded AS affected_templates, unique_templates, template_entropy, top_template_ratio, unique_components, top_template
 FROM incidents JOIN times USING (source_file) JOIN (SELECT source_file, count(*) AS unique_templates, round(sum(-ratio * log2(ratio)), 2) AS template_entropy, round(max(ratio), 3) AS top_template_ratio,
  count(*) FILTER (ratio >= 0.19) AS flooded, arg_min(template, (-count, template)) AS top_template FROM counts GROUP BY 1) USING (source_file) JOIN (SELECT source_file, count(*) AS unique_components FROM components GROUP BY 1) USING (source_file)""",
    LEAKS_SQL, FINAL_SQL, TIME_SQL, COUNTS_SQL, COMPONENTS_SQL))
def _(spark, sf):
    s, a, o, t = "siem_report.", "security_assessment.", "operational_metrics.", "technical_analysis."
    return _report(spark, sf).select(
        "source_file", s + "risk_level", s + "security_incidents", s + "critical_anomalies", joined(s + "threat_indicators").alias("threat_indicators"),
        s + "duration_hours", a + "leak_count", a + "rule_violations", a + "ai_verified_threats", a + "false_positives_filtered", o + "original_count",
        o + "events_per_hour", o + "error_rate", o + "affected_templates", t + "unique_templates", t + "template_entropy", t + "top_template_ratio",
        o + "unique_components", F.col(t + "top_log_patterns")[0]["template"].alias("top_template"))


@query("a16_source_breakdown", with_ctes("SELECT source_file, anomaly_source, count(*) AS count FROM final GROUP BY ALL", LEAKS_SQL, FINAL_SQL))
def _(spark, sf):
    return m.source_breakdown(_final(spark, sf))


@query("a17_leak_types_examples", with_ctes("""SELECT source_file, count(*) AS leak_count, array_to_string(list_sort(list_distinct(list(leak_type))), '|') AS types_detected,
 array_to_string(list(log ORDER BY row_id)[1:3], '|') AS examples FROM leaks GROUP BY 1""", LEAKS_SQL))
def _(spark, sf):
    return m.leak_examples(_leaks(spark, sf)).withColumns({"types_detected": joined("types_detected"), "examples": joined("examples")})


@query("t5_first_examples", with_ctes("SELECT source_file, row_id, log FROM leaks QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY row_id) <= 3", LEAKS_SQL))
def _(spark, sf):
    return top_rows(_leaks(spark, sf).select("source_file", "row_id", "log"), ["source_file"], ["row_id"], 3)


@query("t7_first_match_dedupe", with_ctes("SELECT row_id, leak_type, 1 AS records FROM leaks", LEAKS_SQL))
def _(spark, sf):
    return _leaks(spark, sf).groupBy("row_id", "leak_type").agg(F.count(F.lit(1)).alias("records"))


@query("a22_max_score", with_ctes("SELECT source_file, max(anomaly_score) AS max_score FROM scored GROUP BY 1", SCORED_SQL))
def _(spark, sf):
    return cand.max_score(_scored(spark, sf))


@query("t1_top_percent_by_score", with_ctes("""SELECT row_id, CASE WHEN rn <= greatest(floor(0.05 * n), 1) THEN 1 ELSE 0 END AS is_knn FROM (
 SELECT row_id, row_number() OVER (PARTITION BY source_file ORDER BY anomaly_score DESC, row_id) AS rn, count(*) OVER (PARTITION BY source_file) AS n FROM scored)""", SCORED_SQL))
def _(spark, sf):
    return top_share(_scored(spark, sf), ["source_file"], "anomaly_score", "row_id", 0.05, "is_knn").select("row_id", "is_knn")


@query("t2_candidate_cap", with_ctes("SELECT row_id, anomaly_score FROM scored QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY anomaly_score DESC, row_id) <= 300", SCORED_SQL))
def _(spark, sf):
    return cand.candidate_cap(_scored(spark, sf), 300).select("row_id", "anomaly_score")


@query("t9_score_order", with_ctes("SELECT row_id, anomaly_score FROM scored", SCORED_SQL))
def _(spark, sf):
    return _scored(spark, sf).select("row_id", "anomaly_score").orderBy(F.col("anomaly_score").desc(), "row_id")


@query("u1_union_anomalies", with_ctes("SELECT row_id, source_file, anomaly_source, is_anomaly FROM final", LEAKS_SQL, FINAL_SQL))
def _(spark, sf):
    return _final(spark, sf).select("row_id", "source_file", "anomaly_source", "is_anomaly")


@query("risk_overview", with_ctes(f"""SELECT source_file, count(*) AS events, count({RULE_NAME}) AS rule_rows, count({LEAK_TYPE}) AS leaks,
 count(*) FILTER ({matches('log', 'error|exception|fail')}) AS error_lines,
 CASE WHEN count({RULE_NAME}) + count({LEAK_TYPE}) > 5 THEN 'HIGH' WHEN count({RULE_NAME}) + count({LEAK_TYPE}) > 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM logs GROUP BY 1"""))
def _(spark, sf):
    rows = logs(spark, sf).withColumns({"rule": r.first_match("log", RULES), "leak": r.first_match("log", SECURITY)})
    out = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("events"), F.count("rule").alias("rule_rows"), F.count("leak").alias("leaks"),
        F.count_if(F.col("log").rlike(m.ERROR_LINE)).alias("error_lines"))
    return out.withColumn("risk_level", m.risk_level(F.col("rule_rows") + F.col("leaks"), F.lit(0)))
