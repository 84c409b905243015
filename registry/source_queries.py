"""Readers and writers, on files that Spark writes from the given tables, and the whole run."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from emberlog import sources as src
from emberlog.catalogs import TIMESTAMP_FIELDS
from emberlog.operators import candidates as cand
from emberlog.operators import verdicts as v
from emberlog.plans.full_run import Settings, analyze
from emberlog.session import scratch_path
from emberlog.sources.readers import json_timestamp_pick
from registry.common import joined, logs, numbered, redact_sql, registrar, replies, table, with_ctes
from registry.text_queries import FIELDS, RULES, SECURITY
from registry.window_queries import ALL_RULES

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)



def _text_folder(spark, sf) -> str:
    path = scratch_path(spark, "text-logs")
    numbered(spark, sf).select(F.concat_ws(" ", "ts_raw", "log").alias("value")).write.text(path)
    return path


@query("s1_scan_text_logs", with_ctes("SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts_raw, log, epoch_us(ts) AS at FROM logs"))
def _(spark, sf):
    return src.scan_text_logs(spark, _text_folder(spark, sf), "*.txt").select("ts_raw", "log", F.unix_micros("ts").alias("at"))


@query("s1_scan_document_lines", r"""SELECT CASE WHEN contains(x, ' ') THEN substr(x, 1, instr(x, ' ') - 1) ELSE '' END AS ts_raw,
 CASE WHEN contains(x, ' ') THEN substr(x, instr(x, ' ') + 1) ELSE x END AS log FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS x FROM documents) WHERE x <> ''""")
def _(spark, sf):
    path = scratch_path(spark, "document-lines")
    table(spark, sf, "documents").select("text").write.text(path)
    return src.scan_text_logs(spark, path, "*.txt").select("ts_raw", "log")


# Records of every layout the reader accepts; written as one JSON array per file.
def _records(spark, sf):
    i = F.col("row_id") % 6
    rows = logs(spark, sf).withColumn("t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    none = F.lit(None).cast("string")
    return rows.select(
        "row_id", "source_file",
        F.when(i == 0, F.struct(F.col("log").alias("log"))).alias("nested"),
        F.when(i == 1, F.concat(F.lit(" "), "log", F.lit(" "))).otherwise(none).alias("message"), F.when(i.isin(2, 3), F.col("log")).alias("log"),
        F.when(i == 4, F.col("log")).alias("@message"), F.when(i == 0, F.col("t")).alias("@timestamp"), F.when(i.isin(1, 2), F.col("t")).alias("timestamp"),
        F.when(i == 3, F.lit("")).alias("time"), F.when(i.isin(3, 4), F.col("t")).alias("datetime"))


def _arrays(rows, label: str, spark) -> str:
    """JSON arrays, one per file, from a text column ``j``; ``row_id`` spreads them."""
    path = scratch_path(spark, label)
    arrays = rows.groupBy(F.floor(F.col("row_id") / 2000).alias("chunk")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    n = arrays.count()
    arrays.repartitionByRange(n, "chunk").select("value").write.mode("append").text(path)
    return path


JSON_SQL = "SELECT log, CASE WHEN row_id % 6 = 5 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_raw FROM logs WHERE row_id % 6 <> 5"


@query("s2_scan_json_logs", with_ctes(JSON_SQL))
def _(spark, sf):
    body = F.to_json(F.struct("message", "log", "@timestamp", "timestamp", "time", "datetime", "nested", "@message"))
    rows = _records(spark, sf).select("row_id", F.when(F.col("nested").isNotNull(), F.regexp_replace(body, '"nested":', '"@message":')).otherwise(body).alias("j"))
    return src.scan_json_logs(spark, _arrays(rows, "json-logs", spark), "*.txt").select("log", "ts_raw")


@query("s3_json_timestamp_pick", with_ctes("SELECT row_id, CASE WHEN row_id % 6 = 5 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_raw FROM logs"))
def _(spark, sf):
    picked = _records(spark, sf).withColumns({n: F.col(n) if n in ("@timestamp", "timestamp", "time", "datetime") else F.lit(None).cast("string")
                                              for n in TIMESTAMP_FIELDS})
    return picked.select("row_id", json_timestamp_pick().alias("ts_raw"))


@query("s4_discover_files", with_ctes("SELECT log FROM logs UNION ALL SELECT log FROM logs WHERE event_type = 'error'"))
def _(spark, sf):
    """A folder with text files, JSON files and others that must be left alone."""
    path = scratch_path(spark, "mixed-logs")
    rows = numbered(spark, sf)
    rows.select(F.concat_ws(" ", "ts_raw", "log").alias("value")).write.text(path)
    rows.filter("event_type = 'error'").select(F.col("ts_raw").alias("timestamp"), "log").write.mode("append").json(path)
    rows.select("log").write.mode("append").option("compression", "none").csv(path)
    return src.scan_logs(spark, path, json_layout="lines").select("log")


@query("s7_corrupt_file_skip", with_ctes("SELECT log FROM logs WHERE event_type = 'click'"))
def _(spark, sf):
    """Whole arrays next to files that stop in the middle of a record."""
    rows = logs(spark, sf).withColumn("j", F.to_json(F.struct("log")))
    path = _arrays(rows.filter("event_type = 'click'"), "corrupt-logs", spark)
    rows.select(F.concat(F.lit('{"log": "broken '), F.lit("row "), F.col("row_id").cast("string")).alias("value")).write.mode("append").text(path)
    return src.scan_json_logs(spark, path, "*.txt").select("log")


def _anomalies(spark, sf):
    from emberlog.operators.rules import classify_by_rules
    return classify_by_rules(numbered(spark, sf), RULES, SECURITY).filter("is_rule_based")


@query("s8_write_anomalies", with_ctes(
    f"SELECT row_id, source_file, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS timestamp, {redact_sql('log')} AS log FROM logs WHERE event_type = 'error'"))
def _(spark, sf):
    path = scratch_path(spark, "anomalies")
    src.write_anomalies(_anomalies(spark, sf), path)
    return src.read_results(spark, path).select("row_id", "source_file", "timestamp", "log")


@query("s9_write_summary", with_ctes("SELECT source_file, count(*) AS events, max(user_id) AS last_user FROM logs GROUP BY 1"))
def _(spark, sf):
    path = scratch_path(spark, "summary")
    src.write_summary(logs(spark, sf).groupBy("source_file").agg(F.count(F.lit(1)).alias("events"), F.max("user_id").alias("last_user")), path)
    return src.read_results(spark, path, "events bigint, last_user bigint, source_file string")


def _written_candidates(spark, sf) -> str:
    path = scratch_path(spark, "candidates")
    rows = numbered(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("anomaly_score")), "row_id")
    chosen = cand.with_context(rows.filter("event_type = 'purchase'"), rows)
    src.write_candidates(chosen, path)
    return path


CANDIDATES_SQL = "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, log, source_file, value AS anomaly_score FROM logs JOIN (SELECT event_id AS row_id, value FROM events) USING (row_id) WHERE event_type = 'purchase'"


@query("s10_write_candidates", with_ctes(CANDIDATES_SQL))
def _(spark, sf):
    return src.read_candidates(spark, _written_candidates(spark, sf)).select("timestamp", "log", "source_file", "anomaly_score")


@query("s11_read_candidates_write_results", with_ctes("SELECT log, CASE WHEN length(log) > 40 THEN 'Anomaly' ELSE 'Normal' END AS classification, 1 AS is_anomaly FROM logs WHERE event_type = 'purchase'"))
def _(spark, sf):
    rows = src.read_candidates(spark, _written_candidates(spark, sf)).withColumn(
        "reply", F.when(F.length("log") > 40, "CLASSIFICATION: anomaly").otherwise("CLASSIFICATION: normal"))
    path = scratch_path(spark, "verdicts")
    src.write_verdict_results(v.classify_lines(rows).withColumn("is_anomaly", F.lit(1)), path)
    return src.read_results(spark, path).select("log", "classification", "is_anomaly")


@query("s12_read_allowlist", with_ctes("SELECT log FROM logs WHERE event_type = 'view'"))
def _(spark, sf):
    rows = logs(spark, sf).filter("event_type = 'view'").select("row_id", F.to_json(F.struct("log")).alias("j"))
    return src.read_allowlist(spark, _arrays(rows, "allowlist", spark)).select("log")


@query("s13_read_results", with_ctes("SELECT row_id, 'Operational Error' AS classification FROM logs WHERE event_type = 'error'"))
def _(spark, sf):
    path = scratch_path(spark, "results")
    src.write_anomalies(_anomalies(spark, sf), path)
    return src.read_results(spark, path, "row_id bigint, classification string").select("row_id", "classification")


RUN = Settings(fields=FIELDS, rules=RULES, security=SECURITY, behavior=ALL_RULES, flood_window=200, flood_threshold=0.6, cluster_templates=False, vector_size=64)


@query("whole_run_prepare")
def _(spark, sf):
    out = analyze(numbered(spark, sf), replace(RUN, prepare=True))
    return out.candidates.select("row_id", "source_file", F.round("anomaly_score", 6).alias("anomaly_score"), F.size("context_logs").alias("n_context"))


@query("v3_prepare_phase")
def _(spark, sf):
    out = analyze(numbered(spark, sf), replace(RUN, prepare=True))
    return out.anomalies.groupBy("source_file", "anomaly_source").agg(F.count(F.lit(1)).alias("rows"))


@query("whole_run_summary")
def _(spark, sf):
    out = analyze(numbered(spark, sf), RUN, replies=replies(spark, sf))
    s, o = "siem_report.", "operational_metrics."
    return out.summary.select("source_file", s + "risk_level", s + "security_incidents", s + "critical_anomalies",
                              joined(s + "threat_indicators").alias("indicators"), o + "original_count", o + "processed_count")


