"""Projections, predicates and enrichment columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog import catalogs as c
from emberlog.functions import enrich as e
from emberlog.functions import text as t
from emberlog.operators import candidates as cand
from emberlog.operators import rules as r
from emberlog.operators.fields import FieldRule, extract_fields, extract_fields_by_source, field_coverage
from emberlog.schema import default_columns
from registry.common import (
    LINES_SQL, REPLY_CASE, clean_sql, doc_lines, first_match_sql, joined, logs, matches, quoted, redact_sql, registrar, replies, signature_sql,
    table, with_ctes,
)

QUERIES, ORACLES = {}, {}


query = registrar(QUERIES, ORACLES)


RULES = c.merge_catalogs(c.RULE_PATTERNS, c.SAMPLE_RULE_PATTERNS)
SECURITY = c.merge_catalogs(c.SECURITY_PATTERNS, c.SAMPLE_SECURITY_PATTERNS)
FIELDS = [
    FieldRule("user", ["user", "username"], r"user=([A-Za-z0-9_]+)"),
    FieldRule("organization_id", ["organization_id"]),
    FieldRule("status", ["status", "code"], r"status: ([0-9]+)"),
    FieldRule("application", [], r"\[[a-z]+\]"),
]
FIELDS_SHORT = [FieldRule("user", ["username"], r"user=([0-9])")]

# ---- projections

_json = "CASE WHEN log LIKE '{{%' THEN json_extract_string(log, '$.{0}') END".format
_reg = "nullif(regexp_extract(log, '{0}', {1}, 'i'), '')".format
FIELDS_SQL = f"""SELECT row_id,
 coalesce({_json('user')}, {_reg('user=([A-Za-z0-9_]+)', 1)}) AS "user",
 coalesce({_json('organization_id')}, CAST(organization_id AS VARCHAR)) AS organization_id,
 coalesce({_json('status')}, {_reg('status: ([0-9]+)', 1)}) AS status,
 {_reg('[[][a-z]+[]]', 0)} AS application FROM logs"""


@query("p1_extract_fields", with_ctes(FIELDS_SQL))
def _(spark, sf):
    return extract_fields(logs(spark, sf), FIELDS).select("row_id", "user", "organization_id", "status", "application")


@query("p2_field_coverage", with_ctes(
    "SELECT 'user' AS field, count(\"user\") AS n_values FROM f UNION ALL SELECT 'organization_id', count(organization_id) FROM f "
    "UNION ALL SELECT 'status', count(status) FROM f UNION ALL SELECT 'application', count(application) FROM f",
    f"f AS ({FIELDS_SQL})"))
def _(spark, sf):
    return field_coverage(extract_fields(logs(spark, sf), FIELDS), [f.name for f in FIELDS])


@query("j2_file_config_lookup", with_ctes(f"""SELECT row_id,
 CASE WHEN source_file = 'src1' THEN {_reg('user=([0-9])', 1)} ELSE coalesce({_json('user')}, {_reg('user=([A-Za-z0-9_]+)', 1)}) END AS "user",
 CASE WHEN source_file <> 'src1' THEN coalesce({_json('status')}, {_reg('status: ([0-9]+)', 1)}) END AS status FROM logs"""))
def _(spark, sf):
    rows = logs(spark, sf).drop("organization_id")
    return extract_fields_by_source(rows, {"src1": FIELDS_SHORT}, FIELDS).select("row_id", "user", "status")


@query("p3_redact", with_ctes(
    f"SELECT row_id, {redact_sql('log')} AS redacted FROM logs UNION ALL SELECT row_id, {redact_sql('log')} FROM lines",
    f"lines AS ({LINES_SQL})"))
def _(spark, sf):
    def part(df):
        return df.select("row_id", t.redact("log").alias("redacted"))
    return part(logs(spark, sf)).unionByName(part(doc_lines(spark, sf)))


@query("p4_clean_line", with_ctes(
    f"SELECT row_id, {clean_sql('log')} AS cleaned FROM logs"))
def _(spark, sf):
    return logs(spark, sf).select("row_id", t.clean_line("log").alias("cleaned"))


@query("p4_clean_document_lines", with_ctes(f"SELECT row_id, {clean_sql('log')} AS cleaned FROM lines", base="lines"))
def _(spark, sf):
    return doc_lines(spark, sf).select("row_id", t.clean_line("log").alias("cleaned"))


@query("p5_truncate_log", "SELECT doc_id, CASE WHEN length(text) > 512 THEN substr(text, 1, 512) || '...' ELSE text END AS cut FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.truncate_log("text").alias("cut"))


@query("p6_short_reason", "SELECT doc_id, CASE WHEN length(text) > 40 THEN regexp_replace(substr(text, 1, 40), '\\s+$', '') || '...' ELSE text END AS reason FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.short_reason("text", 40).alias("reason"))


RAW_TS = """CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
 WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') ELSE '' END"""
CANONICAL = """CASE WHEN raw = '' THEN '' WHEN contains(raw, '.') THEN split_part(replace(raw, 'T', ' '), '.', 1) || '.' ||
 substr(split_part(raw, '.', 2), 1, 3) ELSE replace(raw, 'T', ' ') || '.000' END"""


def _raw_times(spark, sf):
    ts = F.col("ts").cast("timestamp")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = (F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
           .when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
           .when(F.col("event_id") % 4 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")).otherwise(""))
    return table(spark, sf, "events").select("event_id", "props", raw.alias("raw"))


@query("p7_canonical_timestamp", f"SELECT event_id, {CANONICAL} AS canonical FROM (SELECT event_id, {RAW_TS} AS raw FROM events)")
def _(spark, sf):
    return _raw_times(spark, sf).select("event_id", t.canonical_timestamp("raw").alias("canonical"))


@query("p8_format_behavior_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS shown FROM events")
def _(spark, sf):
    return logs(spark, sf).select(F.col("row_id").alias("event_id"), t.format_behavior_timestamp("ts").alias("shown"))


@query("p9_record_id", f"""SELECT event_id, {CANONICAL} || '_' || right(md5(trim(props)), 8) AS record_id
 FROM (SELECT event_id, props, {RAW_TS} AS raw FROM events)""")
def _(spark, sf):
    return _raw_times(spark, sf).select("event_id", t.record_id("raw", "props").alias("record_id"))


LABEL_OF = "CASE row_id % 6 WHEN 0 THEN 'Operational Error' WHEN 1 THEN 'Routine' WHEN 2 THEN 'Error' WHEN 3 THEN 'Sensitive Information Leak' WHEN 4 THEN 'Possible Security Threat' ELSE event_type END"


@query("p10_label_map", with_ctes("SELECT row_id, CASE label " + " ".join(
    f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in c.LABELS.items()) + f" ELSE {quoted(c.LABELS['Unknown'])} END AS shown FROM (SELECT row_id, {LABEL_OF} AS label FROM logs)"))
def _(spark, sf):
    return logs(spark, sf).select("row_id", t.label_map(F.expr(LABEL_OF)).alias("shown"))


@query("p11_default_columns", with_ctes("""SELECT row_id, false AS is_behavioral, CAST(NULL AS VARCHAR) AS behavioral_rule, false AS is_rule_based,
 false AS is_security_related, 0 AS is_anomaly, CAST(NULL AS VARCHAR) AS classification, CAST(NULL AS VARCHAR) AS reason, '' AS tag,
 CAST(NULL AS VARCHAR) AS anomaly_source FROM logs"""))
def _(spark, sf):
    out = default_columns(logs(spark, sf).select("row_id"))
    return out.withColumn("tag", joined("tag"))


# ---- predicates

RULE_NAME, RULE_REASON = (first_match_sql("log", RULES, f) for f in (lambda p: p.name, lambda p: p.reason))
ANY_SECURITY = "(" + " OR ".join(matches("log", p.pattern) for p in SECURITY) + ")"


@query("f1_classify_by_rules", with_ctes(f"""SELECT row_id, name IS NOT NULL AS is_rule_based,
 CASE WHEN name IS NOT NULL THEN 'Operational Error' END AS classification, reason, coalesce(name, '') AS tag,
 CASE WHEN name IS NOT NULL THEN 1 ELSE 0 END AS is_anomaly, CASE WHEN name IS NOT NULL THEN 'Rule-Based' END AS anomaly_source
 FROM (SELECT row_id, {RULE_NAME} AS name, {RULE_REASON} AS reason FROM logs)"""))
def _(spark, sf):
    return r.classify_by_rules(logs(spark, sf), RULES, SECURITY).select(
        "row_id", "is_rule_based", "classification", "reason", joined("tag").alias("tag"), "is_anomaly", "anomaly_source")


@query("f2_flag_rule_security", with_ctes(
    f"SELECT row_id, ({RULE_NAME}) IS NOT NULL AND {ANY_SECURITY} AS is_security_related FROM "
    "(SELECT row_id, log || CASE WHEN row_id % 3 = 0 THEN ' Authorization: Bearer abc' ELSE '' END AS log FROM logs)"))
def _(spark, sf):
    rows = logs(spark, sf).withColumn("log", F.concat("log", F.when(F.col("row_id") % 3 == 0, " Authorization: Bearer abc").otherwise("")))
    return r.classify_by_rules(rows, RULES, SECURITY).select("row_id", "is_security_related")


@query("f3_classify_by_rules_scalar", with_ctes(f"""SELECT row_id, 'Operational Error' AS label, reason, name AS tags
 FROM (SELECT row_id, {RULE_NAME} AS name, {RULE_REASON} AS reason FROM logs) WHERE name IS NOT NULL"""))
def _(spark, sf):
    rows = logs(spark, sf).select("row_id", r.rule_verdict("log", RULES).alias("v")).filter("v IS NOT NULL")
    return rows.select("row_id", "v.label", "v.reason", joined("v.tags").alias("tags"))


@query("f4_find_leaks", with_ctes(f"""SELECT row_id, leak_type, 'Possible ' || leak_type || ' leakage.' AS reason, log FROM (
 SELECT row_id, {first_match_sql('log', c.SECURITY_PATTERNS, lambda p: p.name)} AS leak_type, {redact_sql('log')} AS log FROM logs) WHERE leak_type IS NOT NULL"""))
def _(spark, sf):
    return r.find_leaks(logs(spark, sf), c.SECURITY_PATTERNS).select("row_id", "leak_type", "reason", "log")


KEYWORDS = c.any_of(c.SECURITY_KEYWORDS)


@query("f5_is_security_related", with_ctes(f"""SELECT row_id, coalesce({ANY_SECURITY}, false)
 OR regexp_matches(lower(coalesce(classification, '')), {quoted(KEYWORDS)}) OR regexp_matches(lower(coalesce(reason, '')), {quoted(KEYWORDS)})
 OR regexp_matches(lower(tag), {quoted(KEYWORDS)}) OR regexp_matches(lower(log), {quoted('|'.join(c.SECURITY_LOG_PATTERNS))}) AS is_security_related
 FROM (SELECT row_id, log, CASE WHEN row_id % 11 = 0 THEN 'Security' END AS classification, CASE WHEN row_id % 7 = 0 THEN 'Access to shop ' || event_type END AS reason,
  CASE WHEN row_id % 5 = 0 THEN 'Audit' ELSE event_type END AS tag FROM logs)"""))
def _(spark, sf):
    i = F.col("row_id")
    rows = logs(spark, sf).withColumns({
        "classification": F.when(i % 11 == 0, "Security"), "reason": F.when(i % 7 == 0, F.concat(F.lit("Access to shop "), "event_type")),
        "tag": F.array(F.when(i % 5 == 0, F.lit("Audit")).otherwise(F.col("event_type")))})
    return rows.select("row_id", r.is_security_related(security=SECURITY).alias("is_security_related"))


@query("f6_select_candidates", with_ctes(
    f"SELECT row_id FROM logs WHERE event_type IN ('error', 'purchase') AND ({RULE_NAME}) IS NULL"))
def _(spark, sf):
    rows = logs(spark, sf).withColumn("is_anomaly", F.col("event_type").isin("error", "purchase").cast("int"))
    return cand.select_candidates(r.classify_by_rules(rows, RULES).withColumn(
        "is_anomaly", F.col("event_type").isin("error", "purchase").cast("int"))).select("row_id")


@query("f7_score_gate", with_ctes("""SELECT row_id, value AS anomaly_score FROM scored JOIN (
 SELECT source_file FROM scored GROUP BY source_file HAVING max(value) >= (SELECT avg(m) FROM (SELECT max(value) AS m FROM scored GROUP BY source_file)))
 USING (source_file) WHERE event_type = 'purchase'""",
    "scored AS (SELECT l.*, e.value FROM logs l JOIN events e ON l.row_id = e.event_id)"))
def _(spark, sf):
    scored = logs(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("anomaly_score")), "row_id")
    limit = cand.max_score(scored).agg(F.avg("max_score").alias("threshold"))
    return cand.score_gate(scored.filter("event_type = 'purchase'"), scored, limit).select("row_id", "anomaly_score")


@query("f8_demote_normal", with_ctes(
    "SELECT row_id, CASE WHEN row_id % 6 IN (0, 1, 2) THEN 0 ELSE 1 END AS is_anomaly FROM logs"))
def _(spark, sf):
    labels = F.element_at(F.array(*[F.lit(x) for x in ("Routine", "Normal", "unknown", "Anomaly", "Unknown", "Error")]),
                          (F.col("row_id") % 6 + 1).cast("int"))
    rows = logs(spark, sf).withColumns({"classification": labels, "is_anomaly": F.lit(1)})
    return cand.demote_normal(rows).select("row_id", "is_anomaly")


STACK = "CASE WHEN row_id % 4 < 2 THEN '  at com.acme.' || event_type ELSE log END"


@query("f9_dependent_filter", with_ctes(f"""SELECT row_id, CASE WHEN frame THEN 'Dependent Anomaly' ELSE label END AS classification,
 CASE WHEN frame THEN 'Stack trace line, follows an actual error.' ELSE event_type END AS reason, CASE WHEN frame THEN 0 ELSE 1 END AS is_anomaly
 FROM (SELECT row_id, event_type, label, label = 'Unknown' AND trim(line) LIKE 'at %' AS frame FROM (
  SELECT row_id, event_type, CASE WHEN row_id % 3 = 0 THEN 'Anomaly' ELSE 'Unknown' END AS label, {STACK} AS line FROM logs))"""))
def _(spark, sf):
    rows = logs(spark, sf).withColumns({
        "classification": F.when(F.col("row_id") % 3 == 0, "Anomaly").otherwise("Unknown"), "reason": F.col("event_type"),
        "is_anomaly": F.lit(1), "log": F.expr(STACK)})
    return cand.dependent_filter(rows).select("row_id", "classification", "reason", "is_anomaly")


@query("f10_context_row_valid", with_ctes("""SELECT row_id, length(x) >= 5 AND regexp_matches(x, '\\S\\s+\\S') AND NOT (
  (x LIKE '''%''' AND length(x) < 50) OR (length(x) - length(replace(x, '/', '')) > 3 AND length(x) < 100) OR contains(x, '...') OR (x LIKE '(%)' AND length(x) < 100))
  AND NOT (length(s) > 0 AND (length(s) < 3 OR regexp_matches(s, '^[(''+]') OR NOT regexp_matches(s, '[0-9]'))) AS valid
 FROM (SELECT row_id, CASE row_id % 8 WHEN 0 THEN '''' || event_type || ' x''' WHEN 1 THEN '(' || log || ')' WHEN 2 THEN '/a/b/c/d ' || event_type WHEN 3 THEN log || ' ...'
   WHEN 4 THEN event_type ELSE log END AS x, CASE row_id % 7 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '(' || event_type WHEN 3 THEN event_type ELSE CAST(row_id AS VARCHAR) || '-01-01' END AS s FROM logs)"""))
def _(spark, sf):
    x = F.expr("""CASE row_id % 8 WHEN 0 THEN chr(39) || event_type || ' x' || chr(39) WHEN 1 THEN '(' || log || ')' WHEN 2 THEN '/a/b/c/d ' || event_type
      WHEN 3 THEN log || ' ...' WHEN 4 THEN event_type ELSE log END""")
    s = F.expr("CASE row_id % 7 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '(' || event_type WHEN 3 THEN event_type ELSE CAST(row_id AS STRING) || '-01-01' END")
    return logs(spark, sf).select("row_id", cand.context_row_valid(s, x).alias("valid"))


SECRET_SQL = " OR ".join(f"regexp_matches(log, {quoted(p)})" for p in c.SECRET_PATTERNS)


@query("f11_has_secret", with_ctes(f"SELECT row_id, {SECRET_SQL} AS has_secret FROM lines", base="lines"))
def _(spark, sf):
    return doc_lines(spark, sf).select("row_id", t.has_secret("log").alias("has_secret"))


@query("f12_sensitive_verdict", with_ctes(
    f"SELECT row_id, 'Sensitive Information Leak' AS label, 'Contains possible secret/token.' AS reason, 'Sensitive|Security Threat' AS tags FROM lines WHERE {SECRET_SQL}", base="lines"))
def _(spark, sf):
    from emberlog.operators.verdicts import sensitive_verdict
    rows = doc_lines(spark, sf).select("row_id", F.when(t.has_secret("log"), sensitive_verdict()).alias("v")).filter("v IS NOT NULL")
    return rows.select("row_id", "v.label", "v.reason", joined("v.tags").alias("tags"))


@query("f13_browse_text", with_ctes("SELECT row_id, log FROM logs WHERE regexp_matches(log, 'REFUSED|payment', 'i')"))
def _(spark, sf):
    return cand.browse_text(logs(spark, sf), "REFUSED|payment").select("row_id", "log")


@query("f14_browse_class", with_ctes(f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'Operational Error' AS classification, {RULE_REASON} AS reason, {RULE_NAME} AS tag, log FROM logs WHERE ({RULE_NAME}) IS NOT NULL"))
def _(spark, sf):
    rows = r.classify_by_rules(logs(spark, sf), RULES).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return cand.browse_class(rows, "Operational Error").withColumn("tag", joined("tag"))


@query("f14_class_choices", with_ctes(f"SELECT DISTINCT CASE WHEN ({RULE_NAME}) IS NULL THEN 'Routine' ELSE 'Operational Error' END AS classification FROM logs"))
def _(spark, sf):
    rows = r.classify_by_rules(logs(spark, sf), RULES)
    return cand.class_choices(rows.withColumn("classification", F.coalesce("classification", F.lit("Routine"))))


@query("f15_skip_blank", with_ctes("SELECT row_id FROM lines WHERE trim(log) <> ''", base="lines"))
def _(spark, sf):
    return cand.skip_blank(doc_lines(spark, sf)).select("row_id")


# ---- set operators on words and tags

@query("u3_word_jaccard", with_ctes("""SELECT row_id, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS similarity
 FROM (SELECT row_id, list_filter(string_split_regex(log, '\\s+'), lambda x: x <> '') AS a, ['ERROR', '[db]', 'database', 'error:', 'user=7'] AS b FROM logs)"""))
def _(spark, sf):
    return logs(spark, sf).select("row_id", F.round(t.word_jaccard("log", F.lit("ERROR [db] database error: user=7")), 6).alias("similarity"))


TAGS_SQL = "list_filter(string_split(lower(event_type) || ',Error,' || source_file || ',API', ','), lambda x: x <> 'click')"


@query("u5_filter_valid_tags", with_ctes(f"""SELECT row_id, array_to_string(list_filter(tags, lambda x: x IN ('Error', 'API', 'view')), '|') AS kept,
 array_to_string(list_sort(list_distinct(list_filter(tags, lambda x: x NOT IN ('Error', 'API', 'view')))), '|') AS dropped FROM (SELECT row_id, {TAGS_SQL} AS tags FROM logs)"""))
def _(spark, sf):
    tags = F.filter(F.split(F.concat(F.lower("event_type"), F.lit(",Error,"), "source_file", F.lit(",API")), ","), lambda x: x != "click")
    valid = ["Error", "API", "view"]
    rows = logs(spark, sf).select("row_id", tags.alias("tags"))
    return rows.select("row_id", joined(t.filter_valid_tags("tags", valid)).alias("kept"),
                       joined(F.array_sort(t.dropped_tags("tags", valid))).alias("dropped"))


@query("u4_distinct_values", with_ctes(f"""SELECT DISTINCT kind, value FROM (
 SELECT 'leak' AS kind, {first_match_sql('log', c.SECURITY_PATTERNS, lambda p: p.name)} AS value FROM logs UNION ALL
 SELECT 'pattern', unnest(list_filter([{', '.join(f"CASE WHEN regexp_matches(log, {quoted(p)}) THEN {quoted(n)} END" for n, p in c.TOKEN_PATTERNS)}], lambda x: x IS NOT NULL)) FROM logs) WHERE value IS NOT NULL"""))
def _(spark, sf):
    rows = logs(spark, sf)
    kinds = r.find_leaks(rows).select(F.lit("leak").alias("kind"), F.col("leak_type").alias("value"))
    names = rows.select(F.lit("pattern").alias("kind"), F.explode(e.token_patterns("log")).alias("value"))
    return kinds.unionByName(names).distinct()


@query("m9_line_signature", with_ctes(f"SELECT row_id, {signature_sql('log')} AS signature FROM logs"))
def _(spark, sf):
    return logs(spark, sf).select("row_id", t.line_signature("log").alias("signature"))


# ---- enrichment

LEVEL = "(ERROR|WARN|INFO|DEBUG|TRACE|FATAL)"
NAME = "[A-Za-z0-9._-]+"


def _x(p, g=1, flags="c"):
    return f"nullif(regexp_extract(log, {quoted(p)}, {g}, '{flags}'), '')"


SQL_E = {
    "severity": f"""coalesce(upper({_x(r'\[' + LEVEL + r'\]', 1, 'i')}), upper({_x(LEVEL + ':', 1, 'i')}), upper({_x(LEVEL + ' -', 1, 'i')}),
      CASE WHEN regexp_matches(log, 'error|exception|fail|crash|fatal', 'i') THEN 'ERROR' WHEN regexp_matches(log, 'warn|caution|attention', 'i') THEN 'WARN' ELSE 'UNKNOWN' END)""",
    "component": f"""coalesce(regexp_replace(coalesce({_x(r'\[(' + NAME + r')\]')}, {_x('(' + NAME + r')\s*:')}, {_x('(' + NAME + r')\.(?:connect|init|start|config|process)')}),
      '^(?:service|module|component)\\.', ''), {_x(r'(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|\[(?:INFO|DEBUG|ERROR|WARN)\])[:\s]+(' + NAME + ')')}, 'unknown')""",
    "action": f"""coalesce(lower({_x(r':\s*(' + NAME + ')')}), lower({_x(r'\.\s*(' + NAME + r')\s*:')}),
      lower({_x('(initializing|starting|configuring|processing|connecting|loading|saving|updating|creating|deleting|sending|receiving)', 1, 'i')}),
      CASE WHEN regexp_matches(log, '\\b(init|start|stop|config|process|connect|disconnect|load|save|update|create|delete|send|receive)\\s+({NAME})', 'i') THEN
       lower(regexp_extract(log, '\\b(init|start|stop|config|process|connect|disconnect|load|save|update|create|delete|send|receive)\\s+({NAME})', 1, 'i')) || '_' ||
       lower(regexp_extract(log, '\\b(init|start|stop|config|process|connect|disconnect|load|save|update|create|delete|send|receive)\\s+({NAME})', 2, 'i')) END, 'unknown')""",
    "error_indicators": "array_to_string(list_filter([" + ", ".join(quoted(w) for w in c.ERROR_WORDS) + "], lambda w: contains(lower(log), w)), '|')",
    "is_startup": "regexp_matches(lower(log), " + quoted("|".join(c.STARTUP_WORDS)) + ")",
    "is_sensitive": "regexp_matches(log, " + quoted("|".join(c.SENSITIVE_PATTERNS)) + ", 'i')",
    "patterns": """array_to_string(list_filter([CASE WHEN regexp_matches(log, 'retry|retrying|attempt', 'i') THEN 'retry_operation' END,
      CASE WHEN regexp_matches(log, 'connect|connection', 'i') THEN 'connection_operation' END,
      CASE WHEN regexp_matches(log, 'config|configuration', 'i') THEN 'configuration_operation' END], lambda x: x IS NOT NULL), '|')""",
    "has_number": "regexp_matches(log, '[0-9]')",
    "level_word": """CASE WHEN regexp_matches(lower(log), '\\b(error|fail|exception|critical)\\b') THEN 'error' WHEN regexp_matches(lower(log), '\\b(warn|warning)\\b') THEN 'warning'
      WHEN regexp_matches(lower(log), '\\b(info|notice)\\b') THEN 'info' WHEN regexp_matches(lower(log), '\\b(debug|trace)\\b') THEN 'debug' ELSE 'unknown' END""",
    "leading_component": f"coalesce({_x(e.LEADING)}, 'unknown')",
    "action_word": "CASE " + " ".join(f"WHEN contains(lower(log), '{w}') THEN '{w}'" for w in c.ACTION_WORDS) + " ELSE 'unknown' END",
    "error_type": "CASE " + " ".join(f"WHEN regexp_matches(lower(log), {quoted(p)}) THEN '{n}'" for n, p in c.ERROR_TYPE_PATTERNS) + " ELSE 'none' END",
    "token_patterns": "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(log, {quoted(p)}) THEN '{n}' END" for n, p in c.TOKEN_PATTERNS) + "], lambda x: x IS NOT NULL), '|')",
}
_COLUMNS = {
    "severity": e.severity, "component": e.component, "action": e.action, "error_indicators": lambda x: joined(e.error_indicators(x)),
    "is_startup": e.is_startup, "is_sensitive": e.is_sensitive, "patterns": lambda x: joined(e.operation_patterns(x)), "has_number": e.has_number,
    "level_word": e.level_word, "leading_component": e.leading_component, "action_word": e.action_word, "error_type": e.error_type,
    "token_patterns": lambda x: joined(e.token_patterns(x)),
}
# The words of a log line in both views, so that every branch is met: log lines and replies.
BOTH_SQL = "both_texts AS (SELECT row_id, log FROM logs UNION ALL SELECT event_id + 1000000000, reply FROM (SELECT event_id, {0} AS reply FROM events))"


def _texts(spark, sf):
    more = replies(spark, sf).select((F.col("row_id") + 1000000000).alias("row_id"), F.col("reply").alias("log"))
    return logs(spark, sf).select("row_id", "log").unionByName(more)


def _register_enrichment():
    ids = {"e1": "severity", "e2": "component", "e3": "action", "e4": "error_indicators", "e5": "is_startup", "e6": "is_sensitive",
           "e7": "patterns", "e8": "has_number", "e9": "level_word", "e10": "leading_component", "e11": "action_word", "e12": "error_type", "e13": "token_patterns"}
    for key, name in ids.items():
        sql = with_ctes(f"SELECT row_id, {SQL_E[name]} AS {name} FROM both_texts", BOTH_SQL.format(REPLY_CASE))
        query(f"{key}_{'operation_patterns' if name == 'patterns' else name}", sql)(
            lambda spark, sf, name=name: _texts(spark, sf).select("row_id", _COLUMNS[name]("log").alias(name)))
    flat = ", ".join(f"{SQL_E[n]} AS {n}" for n in ids.values())

    @query("e14_enrich_logs", with_ctes(f"SELECT row_id, {flat} FROM both_texts", BOTH_SQL.format(REPLY_CASE)))
    def _(spark, sf):
        i, a = "log_info.", "log_analysis."
        return e.enrich_logs(_texts(spark, sf)).select(
            "row_id", i + "severity", i + "component", i + "action", joined(i + "error_indicators").alias("error_indicators"),
            F.col(i + "is_startup_related").alias("is_startup"), F.col(i + "contains_sensitive_info").alias("is_sensitive"),
            joined(i + "patterns").alias("patterns"), F.col(i + "has_numeric_values").alias("has_number"),
            F.col(a + "severity").alias("level_word"), F.col(a + "component").alias("leading_component"),
            F.col(a + "action").alias("action_word"), a + "error_type", joined(a + "patterns").alias("token_patterns"))


_register_enrichment()
