import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from emberlog.operators.behavior import BehaviorRule
from emberlog.plans.full_run import Settings, analyze


@pytest.fixture(scope="module")
def logs(spark):
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(120):
        ts = start + dt.timedelta(seconds=20 * i)
        log = ["INFO [web] page {0} served", "WARN [shop] slow checkout of user ann", "ERROR [db] database error on node {0}", "INFO [auth] API_KEY=k{0} issued to user bob"][i % 4 if i < 60 else 0].format(i)
        rows.append(("a.log" if i % 3 else "b.log", ts.strftime("%Y-%m-%dT%H:%M:%S"), ts, log))
    df = spark.createDataFrame(rows, "source_file string, ts_raw string, ts timestamp, log string")
    from emberlog.operators.ordering import number_rows
    return number_rows(df, ["source_file"], ["ts"])


SETTINGS = Settings(flood_window=20, flood_threshold=0.75, vector_size=16,
                    behavior=[BehaviorRule("Key Burst", "count", "source_file", 10, 3, pattern="issued")])


def test_statistical_anomalies_are_final_without_verdicts(spark, logs):
    allow = logs.select("source_file", "log")
    out = analyze(logs, SETTINGS, allow)
    rows = out.anomalies.collect()
    statistical = [r for r in rows if not r.is_rule_based and not r.is_behavioral]
    want = out.logs.filter("(is_knn = 1 OR is_lof = 1 OR is_flood AND is_anomaly = 1) AND NOT is_rule_based").select("source_file", "line_no").collect()
    assert sorted((r.source_file, r.line_no) for r in statistical) == sorted(map(tuple, want)) and len(statistical) >= 3
    assert all(r.context_logs is not None and r.is_security_related is not None for r in statistical if not r.is_flood)
    assert all("API_KEY=k" not in r.log for r in rows)
    s = out.summary.filter("source_file = 'a.log'").first()
    assert not s.technical_analysis.ai_analysis.enabled and s.processing_limits.max_logs_analyzed is None and not s.processing_limits.large_file


def test_prepare_phase(logs):
    out = analyze(logs, replace(SETTINGS, prepare=True, large_file_rows=50))
    assert out.summary.filter("processing_limits.large_file").count() == 1
    assert out.logs.filter("is_flood").count() == 2
    sources = {(r.anomaly_source) for r in out.anomalies.select("anomaly_source").distinct().collect()}
    assert sources == {"Rule-Based", "Behavioral"}
    assert out.anomalies.filter(F.col("log").rlike("API_KEY=k")).count() == 0
    assert out.candidates.filter("is_rule_based").count() == 0
    got = {r.source_file: r for r in out.summary.collect()}
    assert set(got) == {"a.log", "b.log"}
    s = got["a.log"]
    assert s.operational_metrics.original_count == 80 and s.operational_metrics.processed_count < 80
    assert s.siem_report.risk_level == "HIGH" and "DATA_EXPOSURE" in s.siem_report.threat_indicators
    assert s.security_assessment.types_detected == ["API Key"] and len(s.security_assessment.examples) == 3


def test_full_phase_joins_verdicts_and_allowlist(spark, logs):
    first = analyze(logs, replace(SETTINGS, prepare=True))
    replies = first.candidates.select("source_file", "line_no", F.lit("CLASSIFICATION: anomaly\nREASON: odd\nTAGS: api, nonsense").alias("reply"))
    allow = first.candidates.limit(1).select("source_file", "log")
    second = analyze(logs.repartition(3), SETTINGS, allow, replies)
    assert second.candidates.count() < first.candidates.count()
    judged = second.anomalies.filter("anomaly_source = 'LLM'").collect()
    assert len(judged) == second.candidates.count() and all(r.tag == ["API"] and r.classification == "Anomaly" for r in judged)
    summary = second.summary.agg(F.sum("security_assessment.ai_verified_threats"), F.sum("security_assessment.false_positives_filtered")).first()
    assert summary[0] == len(judged) and summary[1] >= 1
    calls = second.summary.select("technical_analysis.ai_analysis.*").collect()
    assert all(r.enabled for r in calls) and sum(r.total_calls for r in calls) == second.candidates.count()


def test_given_vectors_caps_and_dedupe(logs):
    rows = logs.withColumn("vec", F.array((F.col("line_no") % 7 + 1).cast("double"), F.when(F.col("line_no") == 9, 50.0).otherwise(1.0)))
    settings = replace(SETTINGS, vector="vec", max_lines=70, dedupe=True, cluster_templates=False, score_threshold=1e-6, top_fraction=0.01)
    out = analyze(rows, settings)
    assert out.logs.groupBy("source_file").count().filter("count > 70").count() == 0
    assert out.logs.filter("is_flood").count() >= 1 and out.logs.filter("anomaly_score IS NULL OR is_knn IS NULL OR lof_label IS NULL").count() == 0
    assert {r.line_no for r in out.logs.filter("is_knn = 1").collect()} == {9}
    assert out.anomalies.count() == out.anomalies.select("row_id").distinct().count()
    assert out.summary.filter("operational_metrics.original_count = 80").count() == 1


def test_scores_of_the_run_equal_independent_answers(spark):
    """All stages on: the flags of kNN and outlier factor against plain models, for exact and for approximate search."""
    import numpy as np

    from tests.test_neighbors import knn_model, lof_model
    rng = np.random.default_rng(3)
    vectors = {f: rng.normal(size=(n, 6)) + 4 for f, n in (("x", 90), ("y", 60))}
    rows = [(f, i + 1, f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}", " ".join([f"w{chr(97 + i % 11)}"] * (i % 7 + 2)), n * 1000 + i, [float(v) for v in x])
            for n, (f, m) in enumerate(vectors.items()) for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "source_file string, line_no long, ts_raw string, log string, row_id long, vec array<double>").withColumn("ts", F.to_timestamp("ts_raw"))
    for approximate in (False, True):
        out = analyze(df, Settings(vector="vec", top_fraction=0.1, contamination=0.1, flood_window=20, approximate_neighbors=approximate)).logs
        got = {r.row_id: (round(r.anomaly_score, 9), r.is_knn, round(r.lof_score, 6), r.is_lof) for r in out.collect()}
        for n, m in enumerate(vectors.values()):
            knn, lof = knn_model(m, 5), np.array(lof_model(m, 5))
            first = set(sorted(range(len(m)), key=lambda i: (-knn[i], i))[:len(m) // 10])
            cut = np.percentile(lof, 10)
            assert [got[n * 1000 + i] for i in range(len(m))] == [
                (round(knn[i], 9), int(i in first), pytest.approx(abs(lof[i]), abs=2e-6), int(lof[i] < cut)) for i in range(len(m))]


def test_two_copies_of_the_log_at_most(spark, logs, monkeypatch):
    import os

    from emberlog import session
    folder, seen = session.shared_folder(spark).removeprefix("file:"), []
    plain = session.StageTable.put

    def copies():
        return sum(n.startswith("log-") for n in os.listdir(folder))

    def put(self, df):
        before = copies()
        out = plain(self, df)
        seen.append((before, copies()))
        return out
    monkeypatch.setattr(session.StageTable, "put", put)
    start = copies()
    with session.run_scope(spark):
        out = analyze(logs, SETTINGS)
        assert out.anomalies.count() > 0 and out.summary.count() == 2
        assert len(seen) == 5 and all(b - start <= 1 and a - start == 1 for b, a in seen)
    assert copies() == start


def test_registry_is_consistent():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 110


def test_entry_runs(spark):
    rows = contract.entry(spark).collect()
    assert {r.risk_level for r in rows} <= {"HIGH", "MEDIUM", "LOW"} and len(rows) == 4
