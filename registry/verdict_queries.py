"""Prompts, replies, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog import catalogs as c
from emberlog.functions.enrich import enrich_logs
from emberlog.operators import metrics as m
from emberlog.operators import verdicts as v
from registry.common import REPLY_CASE, clean_sql, joined, logs, quoted, registrar, replies, table, with_ctes
from registry.text_queries import SQL_E
from registry.window_queries import CONTEXT_SQL, VALID_SQL, _candidates_with_context

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

REPLIES = f"replies AS (SELECT event_id AS row_id, {REPLY_CASE} AS reply FROM events)"
# Reading a reply, step by step.
PARTS = r"""parts AS (SELECT row_id, reply, coalesce(json_valid(reply) AND reply LIKE '{%', false) AS is_json,
  coalesce(nullif(regexp_extract(reply, 'classification:\s*([\p{L}\p{N}_]+)', 1, 'i'), ''), 'Unknown') AS named,
  trim(regexp_replace(nullif(regexp_extract(reply, 'reason:\s*([^\n]+)', 1, 'i'), ''), '^(.+?)tags:.*$', '\1', 'i')) AS after_reason,
  trim(regexp_replace(nullif(regexp_extract(reply, 'because\s\s*([^\n]+)', 1, 'i'), ''), '^(.+?)tags:.*$', '\1', 'i')) AS after_because,
  trim(regexp_replace(nullif(regexp_extract(reply, ':\s*([^\n]+)', 1, 'i'), ''), '^(.+?)tags:.*$', '\1', 'i')) AS after_colon,
  CASE WHEN regexp_matches(reply, 'tags:\s*[^\n]+', 'i') THEN list_filter(list_transform(string_split(regexp_extract(reply, 'tags:\s*([^\n]+)', 1, 'i'), ','), lambda x: trim(x)), lambda x: x <> '') ELSE ['Unknown'] END AS tags
 FROM replies)"""
PARSED = """parsed AS (SELECT row_id, reply,
  CASE WHEN is_json THEN coalesce(json_extract_string(reply, '$.classification'), 'Unknown') WHEN list_has_any(low, ['routine', 'non-anomaly']) THEN 'Normal'
   WHEN list_has_any(low, ['security', 'sensitive', 'leak']) THEN 'Security' WHEN lower(named) = 'normal' THEN 'Normal' WHEN lower(named) IN ('anomaly', 'anomalous') THEN 'Anomaly'
   WHEN lower(named) = 'error' THEN 'Error' ELSE named END AS label,
  CASE WHEN is_json THEN coalesce(json_extract_string(reply, '$.reason'), 'Unknown') ELSE coalesce(after_reason, reply) END AS reason,
  CASE WHEN is_json THEN CAST(json_extract(reply, '$.tags') AS VARCHAR[]) ELSE tags END AS tags
 FROM (SELECT *, list_transform(tags, lambda x: lower(x)) AS low FROM parts))"""
CANONICAL = "[" + ", ".join(quoted(t) for t in c.VALID_TAGS) + "]"
_KEPT = f"list_filter(list_transform({{0}}, lambda x: list_filter({CANONICAL}, lambda y: lower(y) = lower(trim(x)))[1]), lambda x: x IS NOT NULL)"
NORMAL = f"CASE WHEN len({_KEPT}) > 0 THEN array_to_string({_KEPT}, '|') ELSE 'Unknown' END"
SECRET = " OR ".join(f"regexp_matches(log, {quoted(p)})" for p in c.SECRET_PATTERNS)


def _shown(struct="v"):
    return [F.col(f"{struct}.label").alias("label"), F.col(f"{struct}.reason").alias("reason"), joined(f"{struct}.tags").alias("tags")]


@query("v4_parse_reply", with_ctes("SELECT row_id, label, reason, array_to_string(tags, '|') AS tags FROM parsed WHERE reply <> ''", REPLIES, PARTS, PARSED))
def _(spark, sf):
    rows = replies(spark, sf).filter("reply <> ''")
    return rows.select("row_id", v.parse_reply("reply").alias("v")).select("row_id", *_shown())


@query("v5_evaluate_reply", with_ctes("""SELECT row_id, CASE WHEN reply = '' THEN 'Error' WHEN failed THEN 'Error' WHEN said IN ('normal', 'anomaly', 'anomalous') THEN upper(said[1]) || said[2:] WHEN said = 'error' THEN 'Error' ELSE 'Unknown' END AS label,
 CASE WHEN reply = '' THEN 'Error: empty reply' WHEN failed THEN 'LLM Error: ' || CASE WHEN contains(reply, ':') THEN trim(substr(reply, instr(reply, ':') + 1)) ELSE '' END ELSE coalesce(nullif(after_reason, ''), nullif(after_because, ''), nullif(after_colon, ''), reply) END AS reason,
 CASE WHEN reply = '' OR failed THEN 'Unknown' ELSE array_to_string(tags, '|') END AS tags
 FROM (SELECT *, regexp_matches(reply, 'Error processing|No response generated|Empty response|Error:|timed out|Invalid JSON') AS failed,
  lower(coalesce(nullif(regexp_extract(reply, 'classification:\\s*([\\p{L}\\p{N}_]+)', 1, 'i'), ''), nullif(regexp_extract(reply, '^(normal|anomaly|error)', 1, 'i'), ''), nullif(regexp_extract(reply, 'this is (normal|anomalous|an anomaly|an error)', 1, 'i'), ''))) AS said FROM parts)""", REPLIES, PARTS))
def _(spark, sf):
    return replies(spark, sf).select("row_id", v.evaluate_reply("reply").alias("v")).select("row_id", *_shown())


@query("v6_normalize_tags", with_ctes(f"SELECT row_id, {NORMAL.format('tags')} AS tags FROM parsed", REPLIES, PARTS, PARSED))
def _(spark, sf):
    rows = v.with_parsed(replies(spark, sf), v.reply_parts("reply"), "v")
    return rows.select("row_id", joined(v.normalize_tags("v.tags")).alias("tags"))


CLASSIFIED = f"""classified AS (SELECT row_id, log, source_file, CASE WHEN secret THEN 'Sensitive Information Leak' WHEN empty THEN 'Unknown' ELSE label END AS label,
 CASE WHEN secret THEN 'Contains possible secret/token.' WHEN empty THEN 'Empty reply from LLM' ELSE reason END AS reason,
 CASE WHEN secret THEN 'Sensitive|Security Threat' WHEN empty THEN 'Unknown' ELSE {NORMAL.format('tags')} END AS tags, {clean_sql('log')} AS cleaned_log
 FROM (SELECT l.row_id, l.source_file, l.log, p.label, p.reason, p.tags, {SECRET.replace('log', 'l.log')} AS secret, p.reply = '' AS empty FROM logs l JOIN parsed p USING (row_id)))"""


@query("v10_classify_lines", with_ctes("SELECT row_id, label AS classification, reason, tags AS tag, cleaned_log FROM classified", REPLIES, PARTS, PARSED, CLASSIFIED))
def _(spark, sf):
    out = v.classify_lines(logs(spark, sf).join(replies(spark, sf), "row_id"))
    return out.select("row_id", "classification", "reason", joined("tag").alias("tag"), "cleaned_log")


KEY = quoted(c.any_of(c.SECURITY_KEYWORDS))
SECURITY_ANY = " OR ".join(f"regexp_matches(log, {quoted(p.pattern)}, 'i')" for p in c.SECURITY_PATTERNS)


@query("v7_classify_phase", with_ctes(f"""SELECT row_id, label AS classification, reason, tags AS tag, cleaned_log, CASE WHEN label IN ('Routine', 'Normal', 'unknown') THEN 0 ELSE 1 END AS is_anomaly, true AS is_llm_anomaly,
 {SECURITY_ANY} OR regexp_matches(lower(label), {KEY}) OR regexp_matches(lower(reason), {KEY}) OR regexp_matches(lower(tags), {KEY}) OR regexp_matches(lower(log), {quoted('|'.join(c.SECURITY_LOG_PATTERNS))}) AS is_security_related FROM classified""",
    REPLIES, PARTS, PARSED, CLASSIFIED))
def _(spark, sf):
    out = v.classify_phase(logs(spark, sf), replies(spark, sf))
    return out.select("row_id", "classification", "reason", joined("tag").alias("tag"), "cleaned_log", "is_anomaly", "is_llm_anomaly", "is_security_related")


@query("v11_classify_list", with_ctes(f"""SELECT row_id, CASE WHEN reply = '' THEN 'unknown' ELSE label END AS classification, CASE WHEN reply = '' THEN 'Empty or invalid LLM response' ELSE reason END AS reason,
 CASE WHEN reply = '' THEN '' ELSE {NORMAL.format('tags')} END AS tag FROM parsed""", REPLIES, PARTS, PARSED))
def _(spark, sf):
    out = v.classify_list(logs(spark, sf).join(replies(spark, sf), "row_id"))
    return out.select("row_id", "classification", "reason", joined("tag").alias("tag"))


BODY = """CASE event_id % 12
 WHEN 0 THEN '{"choices":[{"message":{"content":" ok ' || event_type || ' "}}]}' WHEN 1 THEN '{"error":{"message":"quota","code":429}}' WHEN 2 THEN '{"choices":[]}'
 WHEN 3 THEN '{"completion":" done ' || CAST(user_id AS STRING) || '"}' WHEN 4 THEN '{"text":"x"}'
 WHEN 5 THEN '{"response":" fine ' || event_type || ' "}' WHEN 6 THEN '{"response":"  "}' WHEN 7 THEN '{"message":"' || event_type || '"}' WHEN 8 THEN '{"content":"c"}' WHEN 9 THEN '{"foo":1}' WHEN 10 THEN '{}'
 ELSE '{}' END"""
PROVIDER = "CASE WHEN event_id % 12 < 3 THEN 'OpenAI' WHEN event_id % 12 < 5 THEN 'anthropic' WHEN event_id % 12 < 11 THEN 'ollama' ELSE 'mistral' END"


@query("v8_reply_text", f"""SELECT event_id, CASE WHEN p IN ('ollama', 'mistral') AND body = '{{}}' THEN 'No response generated' WHEN p = 'ollama' AND trim(r) <> '' THEN trim(r) WHEN p = 'ollama' AND r IS NOT NULL THEN 'Empty response from model'
  WHEN p = 'ollama' THEN coalesce(json_extract_string(body, '$.message'), json_extract_string(body, '$.content'), 'No valid response format detected') WHEN e IS NOT NULL THEN 'Error: ' || e
  ELSE coalesce(trim(CASE WHEN p = 'anthropic' THEN json_extract_string(body, '$.completion') ELSE json_extract_string(body, '$.choices[0].message.content') END), 'Error: invalid response format') END AS reply,
 CASE WHEN p IN ('ollama', 'mistral') AND body = '{{}}' THEN 'empty' WHEN p = 'ollama' AND trim(r) = '' THEN 'empty' WHEN p = 'ollama' THEN 'ok' WHEN e IS NOT NULL OR event_id % 12 IN (2, 4) THEN 'error' ELSE 'ok' END AS status
 FROM (SELECT event_id, body, p, json_extract_string(body, '$.response') AS r, json_extract_string(body, '$.error.message') AS e FROM (SELECT event_id, {BODY} AS body, lower({PROVIDER}) AS p FROM events))""")
def _(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", f"{BODY} AS body", f"{PROVIDER} AS provider")
    return rows.select("event_id", v.reply_text("body", "provider").alias("v")).select("event_id", "v.reply", "v.status")


_I = {n: SQL_E[n] for n in ("severity", "component", "action", "is_startup", "is_sensitive", "has_number", "level_word", "leading_component", "action_word", "error_type")}
_LISTS = {n: SQL_E[n].rsplit(", '|')", 1)[0] + ", ', ')" for n in ("error_indicators", "patterns", "token_patterns")}
_ALL = ", ".join(f"{sql} AS {n}" for n, sql in {**_I, **_LISTS}.items())
SEQUENCES = """CASE WHEN len(list_filter(lines, lambda x: contains(lower(x), 'start'))) > 0 AND len(list_filter(lines, lambda x: contains(lower(x), 'complete'))) > 0 THEN 'start_complete_sequence' END,
 CASE WHEN len(list_filter(lines, lambda x: contains(lower(x), 'request'))) > 0 AND len(list_filter(lines, lambda x: contains(lower(x), 'response'))) > 0 THEN 'request_response_sequence' END"""


@query("v1_build_prompts", with_ctes(f"""SELECT row_id, md5(concat_ws(chr(10), 'Decide whether this log line is normal or an anomaly.', 'Line: ' || log, 'Severity: ' || severity, 'Component: ' || component, 'Action: ' || action,
 'Error words: ' || coalesce(nullif(error_indicators, ''), 'None'), 'Patterns: ' || coalesce(nullif(concat_ws(', ', nullif(patterns, ''), {SEQUENCES}), ''), 'None'), 'Start-up: ' || CAST(is_startup AS VARCHAR),
 'Sensitive: ' || CAST(is_sensitive AS VARCHAR), 'Numbers: ' || CAST(has_number AS VARCHAR), 'Nearby lines:', array_to_string(list_transform(range(1, least(len(lines), 5) + 1), lambda i: '- [' || times[i] || '] ' || lines[i]), chr(10)),
 'Answer with the lines CLASSIFICATION: normal or anomaly, REASON: one sentence, TAGS: comma separated.')) AS prompt
 FROM (SELECT c.*, l.log, {_ALL} FROM context c JOIN logs l USING (row_id))""", VALID_SQL, CONTEXT_SQL, base="numbered"))
def _(spark, sf):
    rows = enrich_logs(_candidates_with_context(spark, sf).filter(F.size("context_logs") > 0), context="context_logs")
    return v.build_prompts(rows).select("row_id", F.md5("prompt").alias("prompt"))


@query("v2_build_prompts_compact", with_ctes(f"""SELECT row_id, md5('Classify: ' || log || chr(10) || 'Severity: ' || level_word || ', component: ' || leading_component || ', action: ' || action_word || ', error type: ' || error_type || ', patterns: ' || coalesce(nullif(token_patterns, ''), 'none')
 || chr(10) || 'Repeats: ' || repetition_count || ', errors: ' || errors || ', warnings: ' || warnings || ', components: ' || components || chr(10) || 'Nearby (' || len(lines) || '):' || chr(10) || array_to_string(lines[1:5], chr(10)) || chr(10) || 'Classification | Reason | [Tags]:') AS prompt
 FROM (SELECT c.*, l.log, {_ALL} FROM context c JOIN logs l USING (row_id)) JOIN (SELECT row_id, max(repeats) AS repetition_count, count(*) FILTER (level_word = 'error') AS errors, count(*) FILTER (level_word = 'warning') AS warnings,
  coalesce(string_agg(DISTINCT nullif(leading_component, 'unknown'), ', ' ORDER BY nullif(leading_component, 'unknown')), '') AS components
  FROM (SELECT row_id, count(*) OVER (PARTITION BY row_id, log) AS repeats, {_I['level_word']} AS level_word, {_I['leading_component']} AS leading_component FROM (SELECT row_id, unnest(lines) AS log FROM context)) GROUP BY 1) USING (row_id)""",
    VALID_SQL, CONTEXT_SQL, base="numbered"))
def _(spark, sf):
    rows = _candidates_with_context(spark, sf).filter(F.size("context_logs") > 0)
    return v.build_prompts_compact(m.context_analysis(enrich_logs(rows))).select("row_id", F.md5("prompt").alias("prompt"))


def _length_judge():
    """Stand-in for a user's model: long lines are anomalies, and some calls fail."""
    def judge(text: str) -> str:
        if text.startswith("FATAL"):
            raise RuntimeError("refused")
        return "CLASSIFICATION: " + ("anomaly" if len(text) > 45 else "normal")
    return judge


def _asked(spark, sf):
    return v.classify_with(logs(spark, sf), _length_judge, prompt="log")


@query("v9_classify_with", with_ctes("""SELECT row_id, CASE WHEN log LIKE 'FATAL%' THEN 'refused' WHEN length(log) > 45 THEN 'CLASSIFICATION: anomaly' ELSE 'CLASSIFICATION: normal' END AS reply,
 CASE WHEN log LIKE 'FATAL%' THEN 'error' ELSE 'ok' END AS status FROM logs"""))
def _(spark, sf):
    return _asked(spark, sf).drop("latency_s")


@query("a21_verdict_stats", with_ctes("""SELECT count(*) FILTER (log NOT LIKE 'FATAL%') AS total_calls, count(*) FILTER (log LIKE 'FATAL%') AS errors, round(sum(length(log)) / 8.0, 2) AS total_time,
 round(sum(length(log)) / 8.0 / count(*) FILTER (log NOT LIKE 'FATAL%'), 2) AS average_time FROM logs"""))
def _(spark, sf):
    rows = logs(spark, sf).select(F.when(F.col("log").startswith("FATAL"), "error").otherwise("ok").alias("status"), (F.length("log") / 8.0).alias("latency_s"))
    return m.verdict_stats(rows)
