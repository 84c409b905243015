"""Behaviour rules, context windows, joins back to rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import behavior as b
from emberlog.operators import candidates as cand
from emberlog.operators.metrics import context_analysis
from emberlog.operators.ordering import number_rows
from emberlog.operators.verdicts import attach_verdicts, context_lines
from emberlog.schema import default_columns
from registry.common import REPLY_CASE, clean_sql, joined, logs, numbered, registrar, replies, table, with_ctes
from registry.text_queries import SQL_E

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

COUNT_RULES = [
    b.BehaviorRule("Repeated Errors", "count", "user_id", 1440, 3, pattern="^(?:ERROR|FATAL)", reason="Repeated errors."),
    b.BehaviorRule("Keys Issued", "count", "source_file", 60, 2, pattern="issued"),
    b.BehaviorRule("Payment Failures", "count", None, 60, 3, pattern="payment.*failed"),
]
DISTINCT_RULES = [
    b.BehaviorRule("Cross Organization", "distinct_count", "user_id", 1440, 3, field="organization_id", pattern="GET /item", reason="Many organizations."),
    b.BehaviorRule("Many Users", "distinct_count", "source_file", 120, 8, field="user_id"),
]
RATIO_RULES = [
    b.BehaviorRule("Error Spike", "ratio", "source_file", 300, threshold_ratio=0.4, pattern="^(?:ERROR|FATAL)", reason="Spike.", min_events=8),
    b.BehaviorRule("User Error Share", "ratio", "user_id", 1440, threshold_ratio=0.5, pattern="error|failed"),
]
ALL_RULES = COUNT_RULES + DISTINCT_RULES + RATIO_RULES


def _matched_sql(at: int, rule: b.BehaviorRule, ratio: bool = False) -> str:
    match = f"regexp_matches(log, '{rule.pattern}', 'i')" if rule.pattern else "true"
    return (f"SELECT {at} AS rule_at, {f'CAST({rule.group_by} AS VARCHAR)' if rule.group_by else chr(39) + '*' + chr(39)} AS group_key, row_id, ts, "
            f"CAST({rule.field or 'NULL'} AS VARCHAR) AS v, {match} AS m, to_minutes({int(rule.window_minutes)}) AS w, "
            f"{rule.threshold_ratio if ratio else rule.threshold} AS lim, {rule.min_events} AS least FROM logs" + ("" if ratio else f" WHERE {match}"))


def _window(minutes: float, body: str) -> str:
    return f"{body} OVER (PARTITION BY rule_at, group_key ORDER BY ts RANGE BETWEEN INTERVAL {int(minutes)} MINUTE PRECEDING AND CURRENT ROW)"


def _fired_sql(rules, offset: int, kind: str) -> str:
    """First firing event per (rule, group), written rule by rule with plain range windows."""
    parts = []
    for i, rule in enumerate(rules):
        rows = _matched_sql(offset + i, rule, kind == "ratio")
        w = rule.window_minutes
        ranked = f"SELECT *, row_number() OVER (PARTITION BY rule_at, group_key ORDER BY ts, row_id) AS rn FROM ({rows})"
        if kind == "count":
            step = f"SELECT *, rn - {_window(w, 'min(rn)')} + 1 AS value FROM ({ranked})"
            fires = "value >= lim"
        elif kind == "distinct":
            # The window ends at the event itself, so equal times are told apart by position.
            step = (f"SELECT a.rule_at, a.group_key, a.row_id, a.ts, a.w, a.lim, a.rn, count(DISTINCT p.v) AS value FROM ({ranked}) a JOIN ({ranked}) p "
                    f"ON a.group_key = p.group_key AND p.rn <= a.rn AND p.ts >= a.ts - a.w GROUP BY ALL")
            fires = "value >= lim"
        else:
            step = (f"SELECT *, {_window(w, 'sum(CASE WHEN m THEN 1 ELSE 0 END)')} / (rn - {_window(w, 'min(rn)')} + 1) AS value, "
                    f"rn - {_window(w, 'min(rn)')} + 1 AS total FROM ({ranked})")
            fires = "value >= lim AND total >= least"
        parts.append(f"SELECT rule_at, group_key, row_id AS fire_row, ts AS fire_ts, w, CAST(value AS DOUBLE) AS value FROM ({step}) WHERE {fires} "
                     f"QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY rn) = 1")
    return " UNION ALL ".join(parts)


FIRED = {"count": _fired_sql(COUNT_RULES, 0, "count"), "distinct": _fired_sql(DISTINCT_RULES, 3, "distinct"), "ratio": _fired_sql(RATIO_RULES, 5, "ratio")}
SHOW = "SELECT {0} AS rule_at, group_key, fire_row, epoch_us(fire_ts) AS fire_at, round(value, 6) AS value FROM fired"


def _show(hits):
    return hits.select("rule_at", "group_key", "fire_row", "fire_at", F.round("value", 6).alias("value"))


@query("w1_rule_count", with_ctes(SHOW.format("rule_at"), f"fired AS ({FIRED['count']})"))
def _(spark, sf):
    return _show(b.evaluate_rules(logs(spark, sf), COUNT_RULES))


@query("w2_rule_distinct", with_ctes(SHOW.format("rule_at - 3"), f"fired AS ({FIRED['distinct']})"))
def _(spark, sf):
    return _show(b.evaluate_rules(logs(spark, sf), DISTINCT_RULES))


@query("w3_rule_ratio", with_ctes(SHOW.format("rule_at - 5"), f"fired AS ({FIRED['ratio']})"))
def _(spark, sf):
    return _show(b.evaluate_rules(logs(spark, sf), RATIO_RULES))


@query("j7_ratio_alignment", with_ctes(
    "SELECT group_key, row_id, epoch_us(ts) AS at FROM entries JOIN fired USING (rule_at, group_key) WHERE m AND ts BETWEEN fire_ts - fired.w AND fire_ts",
    f"fired AS ({FIRED['ratio']})", "entries AS (" + " UNION ALL ".join(_matched_sql(5 + i, r, True) for i, r in enumerate(RATIO_RULES)) + ")"))
def _(spark, sf):
    rows = logs(spark, sf)
    hit = b.matched_rows(rows, RATIO_RULES, b.evaluate_rules(rows, RATIO_RULES))
    return hit.join(rows.select("row_id", F.unix_micros("ts").alias("at")), "row_id").select("group_key", "row_id", "at")


MEMBERS_SQL = (
    f"fired AS ({' UNION ALL '.join(FIRED.values())})",
    "entries AS (" + " UNION ALL ".join(
        [_matched_sql(i, r) for i, r in enumerate(COUNT_RULES + DISTINCT_RULES)] + [_matched_sql(5 + i, r, True) for i, r in enumerate(RATIO_RULES)]) + ")",
    """members AS (SELECT rule_at, group_key, row_id FROM entries JOIN fired USING (rule_at, group_key)
     WHERE m AND ts BETWEEN fire_ts - fired.w AND fire_ts AND (ts < fire_ts OR row_id <= fire_row OR rule_at >= 5))""")


@query("w4_first_trigger", with_ctes("SELECT * FROM members", *MEMBERS_SQL))
def _(spark, sf):
    rows = logs(spark, sf)
    return b.matched_rows(rows, ALL_RULES, b.evaluate_rules(rows, ALL_RULES)).select("rule_at", "group_key", "row_id")


_NAMES = "[" + ", ".join(f"'{r.name}'" for r in ALL_RULES) + "][CAST(rule_at AS INT) + 1]"
_REASONS = "[" + ", ".join(f"'{r.reason_text()}'" for r in ALL_RULES) + "][CAST(rule_at AS INT) + 1]"


@query("j3_apply_behavior_hits", with_ctes(f"""SELECT row_id, rules IS NOT NULL AS is_behavioral, last_rule AS behavioral_rule,
  CASE WHEN rules IS NOT NULL THEN 'Behavioral Anomaly' END AS classification, first_reason AS reason, coalesce(tags, '') AS tag,
  CASE WHEN rules IS NOT NULL THEN 1 ELSE 0 END AS is_anomaly, CASE WHEN rules IS NOT NULL THEN 'Behavioral' END AS anomaly_source
 FROM logs LEFT JOIN (SELECT row_id, count(*) AS rules, arg_max({_NAMES}, rule_at) AS last_rule, arg_min({_REASONS}, rule_at) AS first_reason,
  string_agg('behavioral_' || replace(lower({_NAMES}), ' ', '_'), '|' ORDER BY rule_at) AS tags FROM members GROUP BY 1) USING (row_id)""", *MEMBERS_SQL))
def _(spark, sf):
    rows = logs(spark, sf)
    hits = b.matched_rows(rows, ALL_RULES, b.evaluate_rules(rows, ALL_RULES))
    return b.apply_hits(default_columns(rows), hits).select(
        "row_id", "is_behavioral", "behavioral_rule", "classification", "reason", joined("tag").alias("tag"), "is_anomaly", "anomaly_source")


# ---- context

VALID_SQL = """valid AS (SELECT *, length(log) >= 5 AND regexp_matches(log, '\\S\\s+\\S') AND NOT (length(log) - length(replace(log, '/', '')) > 3 AND length(log) < 100)
 AND NOT contains(log, '...') AS ok FROM numbered)"""
CONTEXT_SQL = """context AS (SELECT c.row_id, c.source_file, c.line_no, list(l.log ORDER BY l.line_no) AS lines, list(l.ts_raw ORDER BY l.line_no) AS times
 FROM valid c JOIN valid l ON c.source_file = l.source_file AND l.line_no BETWEEN c.line_no - 5 AND c.line_no + 5 AND l.ok AND l.ts_raw[:10] = c.ts_raw[:10]
 WHERE c.event_type = 'purchase' GROUP BY ALL)"""


def _candidates_with_context(spark, sf):
    rows = numbered(spark, sf)
    return cand.with_context(rows.filter("event_type = 'purchase'"), rows)


@query("j5_context_band", with_ctes("SELECT row_id, array_to_string(lines, '|') AS context FROM context", VALID_SQL, CONTEXT_SQL, base="numbered"))
def _(spark, sf):
    out = _candidates_with_context(spark, sf).filter(F.size("context_logs") > 0)
    return out.select("row_id", joined(F.transform("context_logs", lambda r: r["log"])).alias("context"))


@query("w5_context_window", """SELECT conv_id, turn, list_aggregate(list(role) OVER w, 'string_agg', '|') AS context FROM conversations
 WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def _(spark, sf):
    turns = number_rows(table(spark, sf, "conversations").withColumn("log", F.col("role")), ["conv_id"], ["turn"])
    return cand.context_of_all(turns, ["conv_id"], with_self=True).select("conv_id", "turn", joined("context").alias("context"))


@query("j8_context_excluding_self", """SELECT conv_id, turn, md5(concat_ws('|', list_aggregate(before, 'string_agg', '|'), list_aggregate(after, 'string_agg', '|'))) AS context FROM (
 SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before,
 list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS after FROM conversations)""")
def _(spark, sf):
    turns = number_rows(table(spark, sf, "conversations").withColumn("log", F.col("text")), ["conv_id"], ["turn"])
    return cand.context_of_all(turns, ["conv_id"]).select("conv_id", "turn", F.md5(joined("context")).alias("context"))


@query("t6_context_limit", with_ctes("""SELECT row_id, CASE WHEN len(lines) = 0 THEN 'None' ELSE array_to_string(list_transform(range(1, least(len(lines), 5) + 1), lambda i: '- [' || times[i] || '] ' || lines[i]), chr(10)) END AS shown FROM context""",
    VALID_SQL, CONTEXT_SQL, base="numbered"))
def _(spark, sf):
    return _candidates_with_context(spark, sf).filter(F.size("context_logs") > 0).select("row_id", context_lines("context_logs").alias("shown"))


_PER_LINE = {n: SQL_E[n].replace("array_to_string(", "(").replace(", '|')", ")") if n == "token_patterns" else SQL_E[n] for n in ("level_word", "leading_component", "token_patterns")}


@query("a19_context_analysis", with_ctes(f"""SELECT row_id, max(repeats) AS repetition_count, count(*) FILTER (level_word = 'error') AS errors, count(*) FILTER (level_word = 'warning') AS warnings,
 count(*) FILTER (level_word = 'info') AS infos, coalesce(string_agg(DISTINCT nullif(leading_component, 'unknown'), '|' ORDER BY nullif(leading_component, 'unknown')), '') AS components,
 array_to_string(list_sort(list_distinct(flatten(list(token_patterns)))), '|') AS patterns
 FROM (SELECT row_id, count(*) OVER (PARTITION BY row_id, log) AS repeats, {', '.join(f'{v} AS {n}' for n, v in _PER_LINE.items())} FROM (SELECT row_id, unnest(lines) AS log FROM context)) GROUP BY 1""",
    VALID_SQL, CONTEXT_SQL, base="numbered"))
def _(spark, sf):
    a = "context_analysis."
    return context_analysis(_candidates_with_context(spark, sf).filter(F.size("context_logs") > 0)).select(
        "row_id", a + "repetition_count", F.col(a + "severity_distribution.error").alias("errors"), F.col(a + "severity_distribution.warning").alias("warnings"),
        F.col(a + "severity_distribution.info").alias("infos"), joined(a + "related_components").alias("components"), joined(a + "patterns").alias("patterns"))


# ---- joins

@query("j1_drop_allowlisted", with_ctes(f"""SELECT row_id FROM logs WHERE event_type <> 'view' AND (source_file, {clean_sql('log')}) NOT IN (
 SELECT (source_file, {clean_sql('log')}) FROM logs WHERE user_id % 10 = 3)"""))
def _(spark, sf):
    rows = logs(spark, sf)
    return cand.drop_allowlisted(rows.filter("event_type <> 'view'"), rows.filter("user_id % 10 = 3").select("source_file", "log")).select("row_id")


@query("j1_allowlisted_counts", with_ctes(f"""SELECT source_file, count(*) AS allowlisted FROM logs WHERE event_type <> 'view' AND (source_file, {clean_sql('log')}) IN (
 SELECT (source_file, {clean_sql('log')}) FROM logs WHERE user_id % 10 = 3) GROUP BY 1"""))
def _(spark, sf):
    rows = logs(spark, sf)
    return cand.allowlisted_counts(rows.filter("event_type <> 'view'"), rows.filter("user_id % 10 = 3").select("source_file", "log"))


@query("j6_attach_verdicts", with_ctes(f"SELECT row_id, source_file, reply FROM logs LEFT JOIN (SELECT event_id AS row_id, {REPLY_CASE} AS reply FROM events WHERE event_type <> 'click') USING (row_id)"))
def _(spark, sf):
    asked = table(spark, sf, "events").filter("event_type <> 'click'").select(F.col("event_id").alias("row_id"))
    return attach_verdicts(logs(spark, sf), replies(spark, sf).join(asked, "row_id", "left_semi")).select("row_id", "source_file", "reply")


