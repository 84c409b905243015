import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberlog import catalogs as c
from emberlog.catalogs import Pattern
from emberlog.functions import enrich as e
from emberlog.functions import text as t
from emberlog.operators import candidates as cand
from emberlog.operators import rules as r
from emberlog.operators import verdicts as v
from emberlog.operators.fields import FieldRule, extract_fields, extract_fields_by_source


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [row[0] for row in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_redaction_leaves_no_secret(spark):
    lines = ["Authorization: Bearer abc.def-1 end", "bearer zzz and token q.w", "id eyJab.cd_e.fg-h done", "API_KEY=abc api-key:xyz APIKEY q1", "plain", None, "Bearer clé-é9 x"]
    got = apply(spark, t.redact, lines)
    assert got[0] == "Authorization: Bearer <REDACTED> end"
    assert got[1] == "bearer <REDACTED> and token <REDACTED>"
    assert got[2] == "id <JWT_TOKEN> done"
    assert got[3] == "API_KEY=<REDACTED> api-key:<REDACTED> APIKEY <REDACTED>"
    assert got[4:6] == ["plain", None] and got[6] == "Bearer <REDACTED> x"


def test_clean_line(spark):
    got = apply(spark, t.clean_line, ["[x] 2024-01-01T10:00:00.123Z  user 10.1.2.3 id 0123456789abcdef0123456789abcdef secret hush  end "])
    assert got == ["user <IP> id <ID> <SECRET> end"]


@pytest.mark.parametrize("raw,want", [
    ("2024-01-01T10:00:00", "2024-01-01 10:00:00.000"), ("2024-01-01 10:00:00.123456", "2024-01-01 10:00:00.123"),
    ("2024-01-01 10:00:00.5", "2024-01-01 10:00:00.5"), ("1.2.3456", "1.2"), ("", ""), (None, "")])
def test_canonical_timestamp(spark, raw, want):
    assert apply(spark, t.canonical_timestamp, [raw]) == [want]


def test_cutting(spark):
    assert apply(spark, lambda x: t.short_reason(x, 5), ["abcd  efg", "abcde", None]) == ["abcd...", "abcde", None]
    assert apply(spark, t.short_reason, ["x" * 900]) == ["x" * 900]
    assert apply(spark, lambda x: t.truncate_log(x, 3), ["abc", "abcd"]) == ["abc", "abc..."]


def test_first_rule_wins_and_bad_patterns_are_skipped(spark):
    catalog = [Pattern("Broken", "(", "no"), Pattern("A", "alpha", "first"), Pattern("B", "alpha|beta")]
    df = spark.createDataFrame([(1, "ALPHA beta API_KEY=x"), (2, "beta"), (3, None), (4, "API_KEY=x")], "row_id int, log string")
    got = {x.row_id: x for x in r.classify_by_rules(df, catalog).collect()}
    assert (got[1].reason, got[1].tag, got[1].is_security_related) == ("first", ["A"], True)
    assert (got[2].reason, got[2].tag, got[2].is_anomaly) == ("Rule-based detection", ["B"], 1)
    assert not got[3].is_rule_based and got[3].tag == [] and got[3].is_anomaly == 0
    assert not got[4].is_security_related


def test_one_leak_per_row(spark):
    df = spark.createDataFrame([(1, "eyJa.b.c API_KEY=zz"), (2, "API_KEY=zz"), (3, "none"), (4, None)], "row_id int, log string")
    got = {x.row_id: x for x in r.find_leaks(df).collect()}
    assert set(got) == {1, 2}
    assert (got[1].leak_type, got[1].reason, got[1].log) == ("JWT Token", "Possible JWT Token leakage.", "<JWT_TOKEN> API_KEY=<REDACTED>")


def test_security_related_sources(spark):
    rows = [("x", "Security", None, None), ("x", None, "No ACCESS", None), ("x", None, None, ["Brute Force"]), ("failed admin login", None, None, []), ("x", None, None, ["fine"])]
    df = spark.createDataFrame(rows, "log string, classification string, reason string, tag array<string>")
    assert [x[0] for x in df.select(r.is_security_related()).collect()] == [True, True, True, True, False]


def test_field_extraction_order_and_empty_values(spark):
    rows = [
        (1, '{"user":"ann","n":5}', "col"), (2, '{"user":"","id":0,"n":false}', "col"), (3, '{"user":[],"id":{}}', ""), (4, '["user"]', None),
        (5, "user=bob x", None), (6, "USER=Bob", "col"), (7, None, None), (8, '{"user":"false","id":1.0}', None), (9, '{"user":{"a":1}}', None), (10, "{broken", "col")]
    df = spark.createDataFrame(rows, "i int, log string, id string")
    got = {x.i: x.who for x in extract_fields(df, [FieldRule("who", ["user", "id"], r"user=(\w+)")]).collect()}
    assert got == {1: "ann", 2: "col", 3: None, 4: None, 5: "bob", 6: "col", 7: None, 8: "false", 9: '{"a":1}', 10: "col"}
    whole = extract_fields(df, [FieldRule("who", [], r"user=[a-z]+")]).filter("i = 6").first()
    assert whole.who == "USER=Bob"


def test_field_rules_per_source(spark):
    df = spark.createDataFrame([("a", "u=1 v=2"), ("b", "u=1 v=2")], "source_file string, log string")
    got = extract_fields_by_source(df, {"a": [FieldRule("f", [], "u=([0-9])")]}, [FieldRule("f", [], "v=([0-9])"), FieldRule("g", [], "u=([0-9])")])
    assert [(x.source_file, x.f, x.g) for x in got.orderBy("source_file").collect()] == [("a", "1", None), ("b", "2", "1")]


def test_context_row_conditions(spark):
    good = "2024-01-01 service is up"
    bad = ["abc", "singleword", "'a quoted piece'", "/a/b/c/d short", "cut off ...", "(a bracketed piece)"]
    times = ["20", "(1)", "'1", "+1", "abc"]
    rows = [("2024-01-01", good, True), ("", good, True), (None, good, True)]
    rows += [("2024-01-01", x, False) for x in bad] + [(x, good, False) for x in times]
    df = spark.createDataFrame(rows, "ts string, log string, want boolean")
    assert [x.ok for x in df.select(cand.context_row_valid(F.col("ts"), F.col("log")).alias("ok")).collect()] == [x[2] for x in rows]


def test_context_keeps_to_the_day_of_the_target(spark):
    rows = [("f", i, f"2024-01-0{1 + i // 4}T00:00", f"line number {i}") for i in range(1, 12)]
    df = spark.createDataFrame(rows, "source_file string, line_no long, ts_raw string, log string")
    out = cand.with_context(df.filter("line_no IN (5, 11)"), df).orderBy("line_no").collect()
    assert [x.log for x in out[0].context_logs] == ["line number 4", "line number 5", "line number 6", "line number 7"]
    assert [x.log for x in out[1].context_logs] == [f"line number {i}" for i in (8, 9, 10, 11)]


def test_context_from_blocks(spark):
    """Blocks of any size give each line once; two candidates on one line get its context twice; masked texts are handed out masked."""
    rows = [("f", i, "2024-01-01", f"line number {i}") for i in range(1, 30)] + [("g", i, None, f"other line {i}") for i in (1, 2, 9)] + [(None, 1, None, "no file")]
    df = spark.createDataFrame(rows, "source_file string, line_no long, ts_raw string, log string")
    asked = df.filter("line_no % 7 < 3 OR source_file IS NULL")

    def logs(out):
        return {(x.source_file, x.line_no): x.context_logs and [c.log for c in x.context_logs] for x in out.collect()}
    want = {(f, n): None if f is None else [x for g, m, _, x in rows if g == f and abs(m - n) <= 2] for f, n, _, _ in rows if n % 7 < 3 or f is None}
    for block in (1, 4, 32):
        assert logs(cand.with_context(asked, df, 2, block=block)) == want
    masked = logs(cand.with_context(asked, df, 2, mask=lambda x: F.concat(x, F.lit("!"))))
    assert masked == {k: v and [x + "!" for x in v] for k, v in want.items()}
    twice = cand.with_context(asked.filter("line_no = 8").union(asked.filter("line_no = 8")), df, 1)
    assert [[c.log for c in x.context_logs] for x in twice.collect()] == [[f"line number {i}" for i in (7, 7, 8, 8, 9, 9)]] * 2
    away = spark.createDataFrame([("f", 500, "2024-01-01", "x")], df.schema)
    assert cand.with_context(away, df).first().context_logs is None


def test_dependent_and_demoted(spark):
    rows = [("Unknown", "  at com.X", 1), ("Anomaly", "at com.X", 1), ("Unknown", "attack", 1), (None, "at x", 1)]
    df = spark.createDataFrame(rows, "classification string, log string, is_anomaly int").withColumn("reason", F.lit("r"))
    assert [x.classification for x in cand.dependent_filter(df).collect()] == ["Dependent Anomaly", "Anomaly", "Unknown", None]
    labels = spark.createDataFrame([("Normal",), ("unknown",), ("Unknown",), ("Anomaly",)], "classification string").withColumn("is_anomaly", F.lit(1))
    assert [x.is_anomaly for x in cand.demote_normal(labels).collect()] == [0, 0, 1, 1]
    assert [x.is_anomaly for x in cand.demote_normal(labels, ignore_case=True).collect()] == [0, 0, 0, 1]


def test_allowlist_compares_cleaned_lines(spark):
    df = spark.createDataFrame([("f", 1, "[a] ping 10.0.0.1"), ("f", 2, "other"), ("g", 3, "ping 10.0.0.1")], "source_file string, row_id int, log string")
    allow = spark.createDataFrame([("f", "[zz]  ping 10.9.9.9"), ("f", "ping 1.1.1.1")], "source_file string, log string")
    assert {x.row_id for x in cand.drop_allowlisted(df, allow).collect()} == {2, 3}
    assert [tuple(x) for x in cand.allowlisted_counts(df, allow).collect()] == [("f", 1)]


@pytest.mark.parametrize("reply,want", [
    ('{"classification":"x","reason":"y","tags":["a"]}', ("x", "y", ["a"])), ("{}", ("Unknown", "Unknown", [])), ("[1]", ("Unknown", "[1]", ["Unknown"])),
    ("CLASSIFICATION: Anomalous\nREASON: too hot TAGS: cpu, , disk\nmore", ("Anomaly", "too hot", ["cpu", "disk"])),
    ("classification: error\nreason: tags: odd", ("Error", "tags: odd", ["odd"])), ("classification: maybe\ntags: Leak", ("Security", "classification: maybe\ntags: Leak", ["Leak"])),
    ("tags: routine, leak", ("Normal", "tags: routine, leak", ["routine", "leak"])), ("nothing", ("Unknown", "nothing", ["Unknown"]))])
def test_parse_reply(spark, reply, want):
    got = apply(spark, v.parse_reply, [reply])[0]
    assert (got.label, got.reason, got.tags) == want


@pytest.mark.parametrize("reply,want", [
    ("Error: no route: x", ("Error", "LLM Error: no route: x", ["Unknown"])), ("it timed out", ("Error", "LLM Error: ", ["Unknown"])),
    ("ANOMALY: disk is full", ("Anomaly", "disk is full", ["Unknown"])), ("This is anomalous because of load", ("Anomalous", "of load", ["Unknown"])),
    ("This is an anomaly", ("Unknown", "This is an anomaly", ["Unknown"])), ("classification: normal\nreason: ok\ntags: a,b", ("Normal", "ok", ["a", "b"])),
    ("", ("Error", "Error: empty reply", ["Unknown"]))])
def test_evaluate_reply(spark, reply, want):
    got = apply(spark, v.evaluate_reply, [reply])[0]
    assert (got.label, got.reason, got.tags) == want


def test_tags_keep_their_spelling(spark):
    df = spark.createDataFrame([([" api", "CPU", "nope", "error"],), ([],), (None,)], "t array<string>")
    assert [x[0] for x in df.select(v.normalize_tags("t")).collect()] == [["API", "CPU", "Error"], ["Unknown"], ["Unknown"]]


def test_enrichment_of_a_line(spark):
    line = "2024-01-01 ERROR [service.db] connection refused: retry attempt 3 from 10.0.0.1"
    df = spark.createDataFrame([(line, [("t", "start job"), ("t", "job complete")])], "log string, context_logs array<struct<timestamp string, log string>>")
    got = e.enrich_logs(df, context="context_logs").first()
    i, a = got.log_info, got.log_analysis
    assert (i.severity, i.component, i.action, i.error_indicators) == ("ERROR", "db", "retry", ["error", "refused"])
    assert i.patterns == ["retry_operation", "connection_operation", "start_complete_sequence"]
    assert (a.severity, a.component, a.error_type, a.patterns) == ("error", "2024-01-01", "connection", ["ip_address", "date"])


def test_empty_context_text(spark):
    df = spark.createDataFrame([([],), ([("", "a"), ("t1", "b")],)], "c array<struct<timestamp string, log string>>")
    assert [x[0] for x in df.select(v.context_lines("c")).collect()] == ["None", "- a\n- [t1] b"]


def test_merge_keeps_order():
    merged = c.merge_catalogs(c.RULE_PATTERNS, c.SAMPLE_RULE_PATTERNS)
    assert [p.name for p in merged][:1] == ["Database Error"] and merged[-1].name == "Disk Full"


def test_behavior_time_format(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 678901),), (None,)], "ts timestamp")
    assert [x[0] for x in df.select(t.format_behavior_timestamp("ts")).collect()] == ["2024-01-02 03:04:05.678", None]
