"""Views the queries share: the log table derived from ``events``, document lines, replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.catalogs import Pattern

# Valid unchanged in Spark SQL and in the check engine.
LOG_CASE = """CASE
 WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'ERROR [db] database error: connection refused for user=' || CAST(user_id AS STRING)
 WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'ERROR [api] request timed out after 30s, status: 500'
 WHEN event_type = 'error' AND event_id % 4 = 2 THEN 'FATAL service crashed, restarting pod-' || CAST(event_id % 9 AS STRING)
 WHEN event_type = 'error' THEN 'ERROR [billing] payment ' || CAST(event_id AS STRING) || ' failed'
 WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'INFO [auth] API_KEY=key' || CAST(event_id AS STRING) || ' issued'
 WHEN event_type = 'signup' THEN 'INFO [auth] Bearer tok.' || CAST(event_id AS STRING) || ' accepted for user=' || CAST(user_id AS STRING)
 WHEN event_type = 'click' THEN 'INFO [web] GET /item/' || CAST(event_id % 50 AS STRING) || ' from 10.0.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING)
 WHEN event_type = 'view' THEN '{"user":"u' || CAST(user_id AS STRING) || '","organization_id":"o' || CAST(event_id % 7 AS STRING) || '","status":200}'
 ELSE 'WARN [shop] checkout: slow, amount=' || CAST(CAST(value AS DECIMAL(18,2)) AS STRING)
END"""

REPLY_CASE = """CASE event_id % 10
 WHEN 0 THEN '{"classification":"anomaly","reason":"disk ' || CAST(event_id AS STRING) || '","tags":["error","disk"]}'
 WHEN 1 THEN 'CLASSIFICATION: normal' || chr(10) || 'REASON: fine for user ' || CAST(user_id AS STRING) || chr(10) || 'TAGS: info, startup'
 WHEN 2 THEN 'classification: anomalous reason: odd value tags: security, leak'
 WHEN 3 THEN 'Classification: Error' || chr(10) || 'Reason: call failed' || chr(10) || 'Tags: api, cpu ,bogus'
 WHEN 4 THEN 'anomaly: the queue is full'
 WHEN 5 THEN 'Error: request timed out'
 WHEN 6 THEN ''
 WHEN 7 THEN 'This is an error because disk ' || CAST(event_id AS STRING) || ' is slow'
 WHEN 8 THEN 'CLASSIFICATION: anomaly' || chr(10) || 'REASON: restart' || chr(10) || 'TAGS: routine, error'
 ELSE 'no idea about ' || event_type
END"""

LOGS_SQL = f"""SELECT event_id AS row_id, 'src' || CAST(user_id % 4 AS STRING) AS source_file,
 ts, user_id, event_type, event_id % 7 AS organization_id, {LOG_CASE} AS log FROM events"""

LINES_SQL = """SELECT doc_id * 100000 + i AS row_id, 'd_' || source AS source_file, i AS line_no, line AS log FROM (
 SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS i
 FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"""

NUMBERED_SQL = """SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ts, row_id) AS line_no,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts_raw FROM logs"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. One that has fewer splits than there are cores (a small file of a
    single row group) is spread over them; a large table has many splits and stays as it is."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def logs(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf, "events").selectExpr(
        "event_id AS row_id", "'src' || CAST(user_id % 4 AS STRING) AS source_file", "CAST(ts AS TIMESTAMP) AS ts",
        "user_id", "event_type", "event_id % 7 AS organization_id", f"{LOG_CASE} AS log")


def replies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id AS row_id", f"{REPLY_CASE} AS reply")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("d_"), "source").alias("source_file"), F.posexplode(F.split("text", "\n")).alias("i", "log"))
    return lines.select((F.col("doc_id") * 100000 + F.col("i") + 1).alias("row_id"), "source_file",
                        (F.col("i") + 1).cast("long").alias("line_no"), "log")


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    from emberlog.operators.ordering import number_rows
    return number_rows(logs(spark, sf), ["source_file"], ["ts", "row_id"]).withColumn(
        "ts_raw", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def with_ctes(body: str, *ctes: str, base: str = "logs") -> str:
    """SQL over the log view (or document lines), followed by more named steps."""
    first = {"logs": f"logs AS ({LOGS_SQL})", "lines": f"lines AS ({LINES_SQL})",
             "numbered": f"logs AS ({LOGS_SQL}), numbered AS ({NUMBERED_SQL})"}[base]
    return "WITH " + ", ".join([first, *ctes]) + " " + body


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)}, 'i')"


def first_match_sql(column: str, catalog: list[Pattern], value) -> str:
    """CASE giving ``value(entry)`` of the first matching catalog entry."""
    whens = " ".join(f"WHEN {matches(column, p.pattern)} THEN {quoted(value(p))}" for p in catalog)
    return f"CASE {whens} END"


def redact_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(Bearer|Token|Authorization)\\s+[\\p{{L}}\\p{{N}}_\\-.]+', '\\1 <REDACTED>', 'gi')"
    x = f"regexp_replace({x}, 'eyJ[a-zA-Z0-9\\-_]+\\.[a-zA-Z0-9\\-_]+\\.[a-zA-Z0-9\\-_]+', '<JWT_TOKEN>', 'g')"
    return f"regexp_replace({x}, '(API[_-]?KEY[:=\\s])[a-zA-Z0-9\\-_]+', '\\1<REDACTED>', 'gi')"


def clean_sql(x: str) -> str:
    for pattern, by, flags in (
        (r"\[.*?\]", "", "g"),
        (r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}.*?Z", "", "g"),
        (r"[a-f0-9\-]{32,}", "<ID>", "g"),
        (r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "<IP>", "g"),
        (r"(?:Bearer|Token|APIKey|Secret)\s+\S+", "<SECRET>", "gi"),
        (r"\s+", " ", "g"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{by}', '{flags}')"
    return f"trim({x})"


def signature_sql(x: str) -> str:
    return f"regexp_replace({clean_sql(x)}, '[0-9]+', '<*>', 'g')"


def joined(column):
    return F.array_join(column, "|")


def registrar(queries: dict, oracles: dict):
    """Decorator that files a query under a name, with its SQL when there is one."""
    def query(name: str, sql: str | None = None):
        def keep(fn):
            queries[name] = fn
            if sql:
                oracles[name] = sql
            return fn
        return keep
    return query
