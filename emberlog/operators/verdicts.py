"""The data side of an external verdict: prompts out, replies in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog import catalogs as c
from emberlog.functions.text import WORD, clean_line, col, found, has_secret, short_reason, strip
from emberlog.operators.candidates import demote_normal, dependent_filter
from emberlog.operators.once import once
from emberlog.operators.rules import is_security_related
from emberlog.session import scratch_path, written


def _unknown() -> Column:
    return F.array(F.lit("Unknown"))


def _listed(values: Column, none: str) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise(none)


def shown_context(context: Column | str, limit: int | None = 5, nearest: bool = False) -> Column:
    """At most ``limit`` entries (null: all): the first, or those in the middle, nearest to the line itself."""
    lines = col(context)
    if limit is None:
        return lines
    first = F.greatest(F.floor((F.size(lines) - limit) / 2), F.lit(0)).cast("int") + 1 if nearest else F.lit(1)
    return F.slice(lines, first, F.lit(limit))


def context_lines(context: Column | str, limit: int | None = 5, nearest: bool = False) -> Column:
    """At most ``limit`` context entries as text lines."""
    shown = F.transform(shown_context(context, limit, nearest), lambda r: F.when(
        F.coalesce(r["timestamp"], F.lit("")) != "", F.concat(F.lit("- ["), r["timestamp"], F.lit("] "), r["log"])
    ).otherwise(F.concat(F.lit("- "), r["log"])))
    return F.when(F.size(shown) > 0, F.array_join(shown, "\n")).otherwise("None")


def build_prompts(df: DataFrame, name: str = "prompt", limit: int | None = 5, nearest: bool = False) -> DataFrame:
    """Prompt from ``log``, ``log_info`` and ``context_logs``, asking for three headed lines."""
    i = F.col("log_info")
    return df.withColumn(name, F.concat_ws(
        "\n",
        F.lit("Decide whether this log line is normal or an anomaly."),
        F.concat(F.lit("Line: "), F.col("log")),
        F.concat(F.lit("Severity: "), i["severity"]),
        F.concat(F.lit("Component: "), i["component"]),
        F.concat(F.lit("Action: "), i["action"]),
        F.concat(F.lit("Error words: "), _listed(i["error_indicators"], "None")),
        F.concat(F.lit("Patterns: "), _listed(i["patterns"], "None")),
        F.concat(F.lit("Start-up: "), i["is_startup_related"].cast("string")),
        F.concat(F.lit("Sensitive: "), i["contains_sensitive_info"].cast("string")),
        F.concat(F.lit("Numbers: "), i["has_numeric_values"].cast("string")),
        F.lit("Nearby lines:"),
        context_lines("context_logs", limit, nearest),
        F.lit("Answer with the lines CLASSIFICATION: normal or anomaly, REASON: one sentence, TAGS: comma separated."),
    ))


def build_prompts_compact(df: DataFrame, name: str = "prompt", limit: int | None = 5, nearest: bool = False) -> DataFrame:
    """Shorter layout from ``log_analysis`` and ``context_analysis``."""
    a, x = F.col("log_analysis"), F.col("context_analysis")
    dist = x["severity_distribution"]
    lines = F.transform(shown_context("context_logs", limit, nearest), lambda r: r["log"])
    context = F.when(F.size("context_logs") > 0, F.concat(
        F.lit("\nNearby ("), F.size("context_logs").cast("string"), F.lit("):\n"), F.array_join(lines, "\n"))).otherwise("")
    return df.withColumn(name, F.concat(F.concat_ws(
        "\n",
        F.concat(F.lit("Classify: "), F.col("log")),
        F.concat(F.lit("Severity: "), a["severity"], F.lit(", component: "), a["component"], F.lit(", action: "), a["action"],
                 F.lit(", error type: "), a["error_type"], F.lit(", patterns: "), _listed(a["patterns"], "none")),
        F.concat(F.lit("Repeats: "), x["repetition_count"].cast("string"), F.lit(", errors: "), dist["error"].cast("string"),
                 F.lit(", warnings: "), dist["warning"].cast("string"), F.lit(", components: "), F.array_join(x["related_components"], ", ")),
    ), context, F.lit("\nClassification | Reason | [Tags]:")))


def _line_after(reply: Column, heading: str) -> Column:
    """Rest of the line after a heading, ended by a following "tags:"."""
    rest = found(reply, rf"(?i){heading}\s*([^\n]+)")
    return strip(F.regexp_replace(rest, r"(?i)^(.+?)tags:.*$", "$1"))


def _split_tags(reply: Column) -> Column:
    text = found(reply, r"(?i)tags:\s*([^\n]+)")
    return F.filter(F.transform(F.split(text, ","), strip), lambda t: t != "")


def _verdict(label: Column, reason: Column, tags: Column) -> Column:
    return F.struct(label.alias("label"), reason.alias("reason"), tags.alias("tags"))


def reply_parts(reply: Column | str) -> Column:
    """What a reply holds, read once: its JSON body, or its headed lines."""
    x = col(reply)
    return F.struct(
        x.alias("reply"), F.try_parse_json(x).alias("body"),
        F.coalesce(found(x, rf"(?i)classification:\s*([{WORD}]+)"), F.lit("Unknown")).alias("named"),
        F.coalesce(_line_after(x, "reason:"), x).alias("reason"),
        F.coalesce(_split_tags(x), _unknown()).alias("tags"))


def verdict_of(parts: Column, reason_limit: int | None = None) -> Column:
    """(label, reason, tags) from ``reply_parts``."""
    reply, body, named, tags = parts["reply"], parts["body"], parts["named"], parts["tags"]
    is_object = F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False))
    from_json = _verdict(
        F.coalesce(F.try_variant_get(body, "$.classification", "string"), F.lit("Unknown")),
        short_reason(F.coalesce(F.try_variant_get(body, "$.reason", "string"), F.lit("Unknown")), reason_limit),
        F.coalesce(F.try_variant_get(body, "$.tags", "array<string>"), F.array().cast("array<string>")))
    low = F.lower(named)
    standard = (F.when(low == "normal", "Normal").when(low.isin("anomaly", "anomalous"), "Anomaly")
                .when(low == "error", "Error").otherwise(named))

    def tagged(*names: str) -> Column:
        return F.exists(tags, lambda t: F.lower(t).isin(*names))
    label = F.when(tagged("routine", "non-anomaly"), "Normal").when(tagged("security", "sensitive", "leak"), "Security").otherwise(standard)
    from_text = _verdict(label, short_reason(parts["reason"], reason_limit), tags)
    other_json = _verdict(F.lit("Unknown"), reply, _unknown())
    return F.when(is_object, from_json).when(body.isNotNull(), other_json).otherwise(from_text)


def parse_reply(reply: Column | str, reason_limit: int | None = None) -> Column:
    """(label, reason, tags) of a reply: a JSON object, or headed lines of text."""
    return verdict_of(reply_parts(reply), reason_limit)


def evaluate_reply(reply: Column | str) -> Column:
    """(label, reason, tags) with error texts recognised and looser headings."""
    x = strip(F.coalesce(col(reply), F.lit("")))
    failed = x.rlike("Error processing|No response generated|Empty response|Error:|timed out|Invalid JSON")
    after = F.when(F.contains(x, F.lit(":")), strip(F.regexp_replace(x, r"^[^:]*:", ""))).otherwise("")
    said = F.lower(F.coalesce(
        found(x, rf"(?i)classification:\s*([{WORD}]+)"),
        found(x, r"(?i)^(normal|anomaly|error)"),
        found(x, r"(?i)this is (normal|anomalous|an anomaly|an error)")))
    label = F.when(said.isin("normal", "anomaly", "anomalous"), F.initcap(said)).when(said == "error", "Error").otherwise("Unknown")
    empty = F.lit("")
    reason = F.coalesce(F.nullif(_line_after(x, "reason:"), empty), F.nullif(_line_after(x, r"because\s"), empty),
                        F.nullif(_line_after(x, ":"), empty), x)
    return (
        F.when(x == "", _verdict(F.lit("Error"), F.lit("Error: empty reply"), _unknown()))
        .when(failed, _verdict(F.lit("Error"), F.concat(F.lit(c.REPLY_ERROR), after), _unknown()))
        .otherwise(_verdict(label, reason, F.coalesce(_split_tags(x), _unknown())))
    )


def normalize_tags(tags: Column | str) -> Column:
    """Valid tags in their canonical spelling, compared without case; ["Unknown"] if none is left."""
    canonical = F.create_map(*[F.lit(v) for t in c.VALID_TAGS for v in (t.lower(), t)])
    kept = F.array_compact(F.transform(col(tags), lambda t: F.try_element_at(canonical, F.lower(strip(t)))))
    return F.when(F.size(kept) > 0, kept).otherwise(_unknown())


def reply_text(body: Column | str, provider: Column | str = "provider") -> Column:
    """(reply, status) from the JSON answer of one of four providers."""
    x, who = col(body), F.lower(col(provider))
    parsed = F.try_parse_json(x)

    def at(path: str) -> Column:
        return F.try_variant_get(parsed, path, "string")

    def outcome(text: Column, status: str) -> Column:
        return F.struct(text.alias("reply"), F.lit(status).alias("status"))
    chat, text = strip(at("$.choices[0].message.content")), strip(at("$.completion"))
    error = F.coalesce(at("$.error.message"), at("$.error"))
    nothing = F.coalesce(x, F.lit("")).isin("", "null", "{}")
    plain = at("$.response")
    answer = F.when(who.isin("openai", "mistral"), chat).when(who == "anthropic", text)
    return (
        F.when((who == "ollama") & nothing, outcome(F.lit("No response generated"), "empty"))
        .when((who == "ollama") & (strip(plain) != ""), outcome(strip(plain), "ok"))
        .when((who == "ollama") & plain.isNotNull(), outcome(F.lit("Empty response from model"), "empty"))
        .when(who == "ollama", outcome(F.coalesce(at("$.message"), at("$.content"), F.lit("No valid response format detected")), "ok"))
        .when((who == "mistral") & nothing, outcome(F.lit("No response generated"), "empty"))
        .when(error.isNotNull(), outcome(F.concat(F.lit("Error: "), error), "error"))
        .when(answer.isNull(), outcome(F.lit("Error: invalid response format"), "error"))
        .otherwise(outcome(answer, "ok"))
    )


def sensitive_verdict() -> Column:
    return _verdict(F.lit("Sensitive Information Leak"), F.lit(c.SECRET_REASON),
                    F.array(F.lit("Sensitive"), F.lit("Security Threat")))


def attach_verdicts(candidates: DataFrame, verdicts: DataFrame, key: str | list[str] = "row_id") -> DataFrame:
    return candidates.join(verdicts, key, "left")


def with_parsed(df: DataFrame, parts: Column, name: str = "verdict", reason_limit: int | None = None) -> DataFrame:
    """Add (label, reason, tags) from ``reply_parts``, in two steps that each run once per row: read, judge."""
    read = once(df, "_parts", parts)
    return once(read, name, verdict_of(F.col("_parts"), reason_limit)).drop("_parts")


def _with_verdict(df: DataFrame, parts: Column, reason_limit: int | None, choose) -> DataFrame:
    """Verdict columns in three steps that each run once per row: read, judge, normalise tags."""
    judged = with_parsed(df, parts, "_v", reason_limit)
    clean = _verdict(F.col("_v.label"), F.col("_v.reason"), normalize_tags("_v.tags"))
    return once(judged, "_final", choose(clean)).withColumns({
        "classification": F.col("_final.label"), "reason": F.col("_final.reason"), "tag": F.col("_final.tags")}).drop("_v", "_final")


def classify_lines(df: DataFrame, reply: str = "reply", reason_limit: int | None = None) -> DataFrame:
    """Verdict columns for lines that have a ``reply`` (null or empty when there was none) and a ``status``.

    A line with a secret anywhere in it needs no reply. Saved candidates are masked; they say in ``has_secret`` what
    their line held before.
    """
    secret = has_secret("log")
    if "has_secret" in df.columns:
        secret = F.coalesce("has_secret", F.lit(False)) | secret
    status = F.col("status") if "status" in df.columns else F.lit("ok")
    text = strip(F.coalesce(F.col(reply), F.lit("")))

    def choose(parsed: Column) -> Column:
        return (
            F.when(secret, sensitive_verdict())
            .when(status == "error", _verdict(F.lit("Error"), F.concat(F.lit(c.REPLY_ERROR), F.coalesce(F.col(reply), F.lit(""))), _unknown()))
            .when(text == "", _verdict(F.lit("Unknown"), F.lit(c.EMPTY_REPLY_REASON), _unknown()))
            .otherwise(parsed))
    return _with_verdict(df, reply_parts(reply), reason_limit, choose).withColumn("cleaned_log", clean_line("log"))


def classify_phase(candidates: DataFrame, replies: DataFrame, key: str | list[str] = "row_id") -> DataFrame:
    """Candidates joined with their replies, with verdict, flags, and normal rows demoted."""
    rows = attach_verdicts(candidates.drop("classification", "reason", "tag"), replies, key)
    judged = classify_lines(rows).withColumns({"is_llm_anomaly": F.lit(True), "anomaly_source": F.lit("LLM"), "is_anomaly": F.lit(1)})
    judged = judged.withColumn("is_security_related", is_security_related())
    return demote_normal(dependent_filter(judged))


def classify_list(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Verdict per line of an ordered list; an empty reply is "unknown" with a fixed reason."""
    none = strip(F.coalesce(F.col(reply), F.lit(""))) == ""
    empty = _verdict(F.lit("unknown"), F.lit("Empty or invalid LLM response"), F.array().cast("array<string>"))
    return _with_verdict(df, reply_parts(strip(reply)), None, lambda parsed: F.when(none, empty).otherwise(parsed))


def classify_with(df: DataFrame, make_judge: Callable[[], Callable[[str], str]], key: str = "row_id",
                  prompt: str = "prompt", parallel: int = 8, calls_per_task: int = 2_000) -> DataFrame:
    """Replies from a user function, at most ``parallel`` calls at a time: (key, reply, status, latency_s).

    A failing call becomes an error row. Calls go out in turns of ``parallel`` tasks with about ``calls_per_task``
    calls each, and each turn's replies are written before the next: a lost task repeats its own calls only. The
    prompts are laid out by turn once, so a turn reads its own rows, however many turns there are.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make_judge()
        for pdf in batches:
            rows = []
            for name, text in zip(pdf[key], pdf[prompt]):
                begun = time.monotonic()
                try:
                    reply, status = judge(text), "ok"
                except Exception as problem:
                    reply, status = str(problem), "error"
                rows.append((name, reply, status, time.monotonic() - begun))
            yield pd.DataFrame(rows, columns=[key, "reply", "status", "latency_s"])
    rows = written(df.select(key, prompt))
    turns = max(1, -(-rows.count() // (parallel * calls_per_task)))
    path = scratch_path(df.sparkSession, "replies")
    fields = T.StructType([df.schema[key], T.StructField("reply", T.StringType()), T.StructField("status", T.StringType()), T.StructField("latency_s", T.DoubleType())])
    laid = laid_in_turns(rows, key, prompt, turns) if turns > 1 else None
    for turn in range(turns):
        asked = _turn(rows, laid, turn) if laid else rows
        if asked is None:
            continue
        dealt = asked.repartition(parallel, F.xxhash64(key, prompt, F.lit(1)))
        dealt.select(key, prompt).mapInPandas(run, fields).write.mode("append").parquet(path)
    return df.sparkSession.read.schema(fields).parquet(path)


def laid_in_turns(rows: DataFrame, key: str, prompt: str, turns: int) -> str:
    """Folder with the rows of each turn in a folder of its own, so that a turn reads nothing else."""
    path = scratch_path(rows.sparkSession, "turns")
    turn = F.pmod(F.xxhash64(key, prompt), F.lit(turns)).alias("turn")
    rows.select(key, prompt, turn).repartition("turn").write.partitionBy("turn").parquet(path)
    return path


def _turn(rows: DataFrame, laid: str, turn: int) -> DataFrame | None:
    """The rows of a turn, or None if it has none."""
    spark = rows.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{laid}/turn={turn}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(rows.schema).parquet(f"{laid}/turn={turn}")
