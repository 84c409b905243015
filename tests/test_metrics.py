import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberlog.operators import metrics as m
from tests.test_neighbors import LOGS


def counts_of(spark, counts):
    rows = [("f", f"template{i}") for i, n in enumerate(counts) for _ in range(n)]
    return m.template_counts(spark.createDataFrame(rows, "source_file string, log_template string"))


@pytest.mark.parametrize("counts,unique,entropy,top", [([10, 10, 10, 10], 4, 2.0, 0.25), ([20, 5, 3, 2], 4, 1.41, 0.667), ([10], 1, 0.0, 1.0)])
def test_template_diversity(spark, counts, unique, entropy, top):
    got = m.template_diversity(counts_of(spark, counts)).first()
    assert (got.unique_templates, got.template_entropy, got.top_template_ratio) == (unique, entropy, top)


def test_volume_and_floods(spark):
    counts = counts_of(spark, [20, 5, 3, 2, 1, 1])
    assert [r["count"] for r in m.template_volume(counts).orderBy(F.desc("count"), "template").collect()] == [20, 5, 3, 2, 1]
    assert [r["template"] for r in m.flood_templates(counts, 0.6).collect()] == ["template0"]
    assert m.flood_templates(counts, 0.75).count() == 0


@pytest.fixture
def logs(spark):
    start = dt.datetime(2024, 1, 1, 12, 0, 30)
    names = ["Ledger", "Depot", "Ledger", "Belt", "Plan", "Ledger", "Depot", "Spooler"]
    return spark.createDataFrame([("f", i, start + dt.timedelta(minutes=i), f"[{n}] {x}") for i, (n, x) in enumerate(zip(names, LOGS))],
                                 "source_file string, row_id int, ts timestamp, log string")


def test_time_metrics(logs):
    got = m.time_metrics(logs).first()
    assert got.available and got.time_span_seconds == 420 and got.peak_rate_per_minute == 1
    assert got.error_rate == 0.5
    assert (got.logs_per_second, got.logs_per_minute, got.logs_per_hour) == (0.02, 1.14, 68.57)


def test_time_metrics_unavailable(spark, logs):
    assert m.time_metrics(logs.filter("row_id < 0")).count() == 0
    single = m.time_metrics(logs.filter("row_id = 0")).first()
    assert not single.available and single.error_rate is None
    assert m.time_metrics(logs.withColumn("ts", F.lit(None).cast("timestamp"))).count() == 0


def test_components(logs):
    counts = {r.component: r["count"] for r in m.component_counts(logs).collect()}
    assert counts["Ledger"] == 3 and counts["ERROR"] == 4 and counts["INFO"] == 3
    got = m.component_metrics(logs).first()
    assert got.unique_components == len(counts) and len(got.top_components) == 5
    assert [tuple(x) for x in got.top_components][:2] == [("ERROR", 4), ("INFO", 3)]


def test_long_names_are_no_components(spark):
    df = spark.createDataFrame([("f", "[" + "x" * 30 + "] [ok] a: é:")], "source_file string, log string")
    assert {r.component for r in m.component_counts(df).collect()} == {"ok", "a", "é"}


def test_levels_count_once(spark):
    df = spark.createDataFrame([("f", x) for x in ("DEBUG error", "info warn", "Warning error", "error", "none")], "source_file string, log string")
    assert tuple(m.level_counts(df).first()) == ("f", 1, 1, 1, 1)


def test_tags(spark):
    df = spark.createDataFrame([("f", ["a", "b"]), ("f", ["a"]), ("g", []), ("g", None), ("g", ["b"])], "source_file string, tag array<string>")
    assert sorted(map(tuple, m.tag_counts(df).collect())) == [("f", "a", 2), ("f", "b", 1), ("g", "b", 1)]
    assert [tuple(r) for r in m.tags_ranked(df).collect()] == [("a", 2), ("b", 2)]


@pytest.mark.parametrize("incidents,critical,want", [(6, 0, "HIGH"), (0, 11, "HIGH"), (5, 10, "MEDIUM"), (3, 0, "MEDIUM"), (0, 6, "MEDIUM"), (2, 5, "LOW")])
def test_risk(spark, incidents, critical, want):
    assert spark.range(1).select(m.risk_level(F.lit(incidents), F.lit(critical))).first()[0] == want


def test_verdict_stats(spark):
    df = spark.createDataFrame([("ok", 1.0), ("ok", 2.0), ("error", 3.0)], "status string, latency_s double")
    assert tuple(m.verdict_stats(df).first()) == (2, 1, 6.0, 3.0)
    assert tuple(m.verdict_stats(df.filter("status = 'none'")).first()) == (0, 0, 0.0, 0.0)
