"""Floods and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import flood as fl
from emberlog.operators import templates as tp
from registry.common import doc_lines, joined, logs, numbered, registrar, table, signature_sql, with_ctes

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

WINDOW, SHARE = 40, 0.6
# A log with calm and flooded days: on every third day views and clicks are one message.
FLOOD_LOG = "CASE WHEN dayofmonth(ts) % 3 = 0 AND event_type IN ('view', 'click', 'signup', 'error') THEN 'ERROR [gw] upstream ' || CASE WHEN row_id % 5 = 0 THEN 'slow ' ELSE '' END || 'reply lost, warn ' || CAST(row_id AS STRING) ELSE log END"


def _flooded(spark, sf):
    rows = numbered(spark, sf).withColumn("log", F.expr(FLOOD_LOG))
    return tp.signature_templates(rows)


def _marked(spark, sf):
    rows = _flooded(spark, sf)
    return fl.mark_blocks(rows, fl.flood_blocks(rows, WINDOW, SHARE), WINDOW)


FLOODED_SQL = (
    f"flooded AS (SELECT * REPLACE ({FLOOD_LOG} AS log), {signature_sql(FLOOD_LOG)} AS log_template FROM numbered)",
    f"""steps AS (SELECT source_file, log_template, at, sum(s) AS s FROM (
     SELECT source_file, log_template, greatest(line_no - {WINDOW} + 1, 1) AS at, 1 AS s FROM flooded UNION ALL SELECT source_file, log_template, line_no + 1, -1 FROM flooded) GROUP BY ALL)""")
COUNTS_IN_WINDOW = """SELECT a.source_file, a.line_no, b.log_template, count(*) AS n FROM flooded a JOIN flooded b ON a.source_file = b.source_file AND b.line_no BETWEEN a.line_no AND a.line_no + {0} GROUP BY ALL""".format(WINDOW - 1)


@query("w6_flood_starts", with_ctes(f"SELECT source_file, line_no, log_template AS dominant FROM ({COUNTS_IN_WINDOW}) WHERE n / {WINDOW} >= {SHARE}", FLOODED_SQL[0], base="numbered"))
def _(spark, sf):
    starts = fl.flood_starts(_flooded(spark, sf), WINDOW, SHARE)
    return starts.select("source_file", "dominant", F.explode(F.sequence("low", "high")).alias("line_no"))


# The greedy scan itself, as a recursive walk from flood to flood.
BLOCKS_SQL = f"""starts AS (SELECT source_file, line_no, log_template AS dominant FROM ({COUNTS_IN_WINDOW}) WHERE n / {WINDOW} >= {SHARE}),
 sizes AS (SELECT source_file, max(line_no) AS n FROM flooded GROUP BY 1),
 doms AS (SELECT DISTINCT source_file, dominant FROM starts),
 bags AS (SELECT DISTINCT source_file, log_template, list_distinct(list_filter(string_split_regex(log_template, '\\s+'), lambda x: x <> '')) AS bag FROM flooded),
 alike AS (SELECT d.source_file, d.dominant, t.log_template FROM doms d JOIN bags b ON d.source_file = b.source_file AND d.dominant = b.log_template JOIN bags t ON t.source_file = d.source_file
  WHERE len(list_intersect(b.bag, t.bag)) / len(list_distinct(b.bag || t.bag)) > 0.8),
 breaks AS (SELECT d.source_file, d.dominant, f.line_no FROM doms d JOIN flooded f ON d.source_file = f.source_file LEFT JOIN alike a ON a.source_file = d.source_file AND a.dominant = d.dominant AND a.log_template = f.log_template WHERE a.dominant IS NULL),
 ends AS (SELECT s.source_file, s.dominant, s.line_no, coalesce((SELECT min(b.line_no) FROM breaks b WHERE b.source_file = s.source_file AND b.dominant = s.dominant AND b.line_no >= s.line_no + {WINDOW}), (SELECT n + 1 FROM sizes z WHERE z.source_file = s.source_file)) AS next_line FROM starts s),
 jumps AS (SELECT source_file, dominant, line_no, next_line, (SELECT min(s.line_no) FROM starts s WHERE s.source_file = e.source_file AND s.line_no >= e.next_line) AS after FROM ends e),
 walk AS (SELECT j.* FROM jumps j JOIN (SELECT source_file, min(line_no) AS line_no FROM starts GROUP BY 1) USING (source_file, line_no)
  UNION ALL SELECT j.* FROM walk w JOIN jumps j ON j.source_file = w.source_file AND j.line_no = w.after),
 blocks AS (SELECT source_file, dominant, line_no AS block_start, next_line - 1 AS block_end FROM walk),
 marked AS (SELECT f.*, b.block_start FROM flooded f LEFT JOIN blocks b ON f.source_file = b.source_file AND f.line_no BETWEEN b.block_start AND b.block_end)"""
BLOCK_STEPS = (FLOODED_SQL[0], BLOCKS_SQL)


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("w6_flood_chunking", _recursive(with_ctes("SELECT source_file, dominant, block_start, block_end FROM blocks", *BLOCK_STEPS, base="numbered")))
def _(spark, sf):
    return fl.flood_blocks(_flooded(spark, sf), WINDOW, SHARE)


PATTERN_SQL = """per_template AS (SELECT source_file, block_start, log_template, count(*) AS n FROM marked WHERE block_start IS NOT NULL GROUP BY 1, 2, 3),
 patterns AS (SELECT source_file, block_start, CAST(sum(n) AS BIGINT) AS count, arg_min(log_template, (-n, log_template)) AS template FROM per_template GROUP BY 1, 2),
 facts AS (SELECT source_file, block_start, max(CASE WHEN contains(lower(log), 'error') THEN 2 WHEN contains(lower(log), 'warn') THEN 1 ELSE 0 END) AS level,
  coalesce(string_agg(DISTINCT nullif(regexp_extract(log, '^\\[?([a-zA-Z0-9_.-]+)\\]?[:|\\s]', 1), ''), '|' ORDER BY nullif(regexp_extract(log, '^\\[?([a-zA-Z0-9_.-]+)\\]?[:|\\s]', 1), '')), '') AS components
  FROM marked WHERE block_start IS NOT NULL GROUP BY 1, 2),
 words AS (SELECT source_file, block_start, line_no, string_split_regex(p.template, '\\s+') AS t, string_split_regex(trim(log), '\\s+') AS l FROM marked JOIN patterns p USING (source_file, block_start)),
 differing AS (SELECT source_file, block_start, word, min(line_no * 1000 + i) AS seen FROM (
  SELECT source_file, block_start, line_no, unnest(range(1, len(t) + 1)) AS i, l[i] AS word, t[i] AS theirs FROM words WHERE len(t) = len(l)) WHERE word <> theirs GROUP BY 1, 2, 3)"""


@query("a18_flood_pattern", _recursive(with_ctes("""SELECT source_file, block_start, count, template, CASE level WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'unknown' END AS severity, components,
  coalesce((SELECT string_agg(word, '|' ORDER BY seen) FROM differing d WHERE d.source_file = p.source_file AND d.block_start = p.block_start), '') AS variable_parts
 FROM patterns p JOIN facts USING (source_file, block_start)""", *BLOCK_STEPS, PATTERN_SQL, base="numbered")))
def _(spark, sf):
    found = fl.flood_patterns(_marked(spark, sf).filter("block_start IS NOT NULL"))
    return found.select("source_file", "block_start", "count", "template", "severity", joined("components").alias("components"), joined("variable_parts").alias("variable_parts"))


@query("w7_flood_summary_row", _recursive(with_ctes("""SELECT source_file, line_no, log, is_anomaly, is_flood FROM (
 SELECT source_file, line_no, log, 0 AS is_anomaly, false AS is_flood FROM marked WHERE block_start IS NULL UNION ALL
 SELECT source_file, block_start, '[LOG FLOOD] ' || CAST(count AS VARCHAR) || ' occurrences of similar logs: ' || template, CASE WHEN level = 2 THEN 1 ELSE 0 END, true FROM patterns JOIN facts USING (source_file, block_start))""",
    *BLOCK_STEPS, PATTERN_SQL, base="numbered")))
def _(spark, sf):
    out = fl.collapse_floods(_flooded(spark, sf), WINDOW, SHARE)
    return out.select("source_file", "line_no", "log", F.coalesce("is_anomaly", F.lit(0)).alias("is_anomaly"), "is_flood")


def _masked(x: str) -> str:
    """No two kinds of line in the log table share length and first word, so each masked line is its own template."""
    return f"regexp_replace({x}, '(^|\\s)\\S*[0-9]\\S*', '\\1<*>', 'g')"


@query("m7_mine_templates", with_ctes(f"SELECT row_id, source_file, {_masked('log')} AS log_template FROM logs"))
def _(spark, sf):
    return tp.mine_templates(logs(spark, sf)).select("row_id", "source_file", "log_template")


# Three kinds of line in one leaf (same length, same first word), each of many variants that merge.
VARIANTS = """CASE event_id % 3 WHEN 0 THEN 'svc opened door for ' || event_type || ' at ' || {w} WHEN 1 THEN 'svc closed gate near ' || event_type || ' with ' || {w}
 ELSE 'svc lost link towards ' || event_type || ' via ' || {w} END""".format(w="CASE user_id % 5 WHEN 0 THEN 'ada' WHEN 1 THEN 'bob' WHEN 2 THEN 'cyd' WHEN 3 THEN 'dan' ELSE 'eve' END")


@query("m7_merge_variants", with_ctes("""SELECT row_id, source_file, CASE row_id % 3 WHEN 0 THEN 'svc opened door for <*> at <*>' WHEN 1 THEN 'svc closed gate near <*> with <*>'
 ELSE 'svc lost link towards <*> via <*>' END AS log_template FROM logs"""))
def _(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id AS row_id", "'src' || CAST(user_id % 4 AS STRING) AS source_file", f"{VARIANTS} AS log")
    return tp.mine_templates(rows).select("row_id", "source_file", "log_template")


@query("m7_mine_document_templates")
def _(spark, sf):
    mined = tp.mine_templates(doc_lines(spark, sf), light=False)
    return tp.template_stats(mined)


@query("m8_mine_templates_variant", with_ctes(f"""SELECT row_id, {_masked("regexp_replace(regexp_replace(log, '[=/]', ' ', 'g'), '[ ]+', ' ', 'g')")} AS log_template FROM logs"""))
def _(spark, sf):
    return tp.mine_templates_variant(logs(spark, sf), extra_delimiters=["=", "/"]).select("row_id", "log_template")


@query("a20_template_groups", with_ctes(f"SELECT source_file, {signature_sql('log')} AS template, row_id, log FROM logs"))
def _(spark, sf):
    return tp.template_groups(tp.signature_templates(logs(spark, sf)))


@query("a20_template_stats", with_ctes(f"SELECT source_file, {signature_sql('log')} AS template, count(*) AS count FROM logs GROUP BY ALL"))
def _(spark, sf):
    return tp.template_stats(tp.signature_templates(logs(spark, sf)))
