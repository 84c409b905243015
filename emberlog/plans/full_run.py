"""The whole batch run over a log table: one job for all files, keyed by ``source_file``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog import catalogs as c
from emberlog.catalogs import Pattern
from emberlog.functions.enrich import enrich_logs
from emberlog.functions.text import format_behavior_timestamp, redact
from emberlog.operators import behavior as b
from emberlog.operators import candidates as cand
from emberlog.operators import metrics as m
from emberlog.operators import rules as r
from emberlog.operators.fields import FieldRule, extract_fields_by_source
from emberlog.operators.flood import collapse_floods
from emberlog.operators.neighbors import Approximate, knn_score
from emberlog.operators.once import once
from emberlog.operators.ordering import top_share
from emberlog.operators.outlier import knn_and_lof, label_by_quantile, lof_factor
from emberlog.operators.templates import mine_templates, signature_templates
from emberlog.operators.vectors import tfidf_vectors
from emberlog.operators.verdicts import build_prompts, classify_phase
from emberlog.plans.report import report
from emberlog.schema import default_columns
from emberlog.session import StageTable, cut_lineage, prepare, written
from emberlog.sources import cap_rows_per_file
from emberlog.sources.readers import large_file_flag


@dataclass(frozen=True)
class Settings:
    """Defaults of a run. Fractions are fractions: 0.05 means five percent."""
    max_lines: int | None = None
    fields: list[FieldRule] = field(default_factory=list)
    fields_by_file: dict[str, list[FieldRule]] = field(default_factory=dict)
    cluster_templates: bool = True
    flood_template_share: float = 0.75
    collapse_floods: bool = True
    flood_window: int = 1000
    flood_threshold: float = 0.75
    top_fraction: float = 0.05
    knn_neighbors: int = 5
    lof: bool = True
    lof_neighbors: int = 5
    contamination: float = 0.05
    vector: str | None = None
    vector_size: int = 256
    rules: list[Pattern] = field(default_factory=lambda: list(c.RULE_PATTERNS))
    security: list[Pattern] = field(default_factory=lambda: list(c.SECURITY_PATTERNS))
    behavior: list[b.BehaviorRule] = field(default_factory=list)
    score_threshold: float = 0.0
    max_candidates: int | None = None
    prepare: bool = False
    approximate_neighbors: bool = False
    neighbor_recall: float = 0.95
    context_limit: int | None = None
    large_file_rows: int = 100_000
    dedupe: bool = False


@dataclass(frozen=True)
class Outcome:
    logs: DataFrame
    leaks: DataFrame
    candidates: DataFrame
    behavior_hits: DataFrame
    anomalies: DataFrame
    summary: DataFrame


def score_lines(rows: DataFrame, s: Settings) -> DataFrame:
    """(source_file, log, anomaly_score, _factor) for every different line of a file.

    Log lines repeat, so vectors exist only for different lines, with their number of copies.
    """
    lines = rows.groupBy("source_file", "log").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copies"))
    vectors = written(tfidf_vectors(cut_lineage(lines), size=s.vector_size))
    if s.lof:
        scored = knn_and_lof(vectors, ["source_file"], s.knn_neighbors, s.lof_neighbors, "embedding", "row_id", "_factor", "copies", _how(s))
    else:
        scored = knn_score(vectors, k=s.knn_neighbors, how=_how(s), copies="copies")
    return written(scored.drop("embedding", "row_id", "copies"))


def _how(s: Settings) -> Approximate | None:
    return Approximate(s.neighbor_recall) if s.approximate_neighbors else None


def score_rows(rows: DataFrame, s: Settings, store: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Neighbour and outlier scores with their own flags; ``is_anomaly`` is set if any flag is. ``store`` writes the scored rows.

    With a given vector column, rows without a vector (such as flood summaries) keep neutral scores.
    """
    if s.vector:
        known = rows.filter(F.col(s.vector).isNotNull())
        scored = knn_score(known, k=s.knn_neighbors, vector=s.vector, how=_how(s))
        scored = lof_factor(scored, k=s.lof_neighbors, vector=s.vector, name="_factor", how=_how(s)) if s.lof else scored
    else:
        scored = rows.join(score_lines(rows.filter("log IS NOT NULL"), s), ["source_file", "log"], "left").fillna({"anomaly_score": 0.0})
        scored = scored.fillna({"_factor": -1.0}) if s.lof else scored
    neutral = rows.filter(F.col(s.vector).isNull()) if s.vector else None
    if s.vector:  # both kinds of rows in one table, told apart by their vector
        scored = scored.unionByName(neutral, allowMissingColumns=True)
    scored = store(scored)
    if s.vector:
        scored, neutral = scored.filter(F.col(s.vector).isNotNull()), scored.filter(F.col(s.vector).isNull()).drop("anomaly_score", "_factor")
    scored = top_share(scored, ["source_file"], "anomaly_score", "row_id", s.top_fraction, "is_knn")
    if s.lof:
        scored = label_by_quantile(scored, ["source_file"], s.contamination).withColumn("is_lof", (F.col("lof_label") == -1).cast("int"))
    else:
        scored = scored.withColumn("is_lof", F.lit(0))
    if s.vector:
        scored = scored.unionByName(neutral, allowMissingColumns=True)
        scored = scored.fillna({"anomaly_score": 0.0, "is_knn": 0, "is_lof": 0})
        scored = scored.fillna({"lof_label": 1, "lof_score": 0.0}) if s.lof else scored
    flood = F.col("is_anomaly") if "is_anomaly" in scored.columns else F.lit(0)
    return scored.withColumn("is_anomaly", F.greatest("is_knn", "is_lof", F.coalesce(flood, F.lit(0))))


def analyze(logs: DataFrame, settings: Settings | None = None, allowlist: DataFrame | None = None,
            replies: DataFrame | None = None) -> Outcome:
    """Run every stage. There are three ways to treat the statistical anomalies:

    * without verdicts (the default): all of them are in the final table, with their context and security flag;
    * ``settings.prepare``: they are candidates that wait for a verdict and are not in the final table;
    * with ``replies`` (source_file, line_no, reply[, status, latency_s]): candidates become verdicts.

    A cap on candidates (none by default) and the allow-list apply to candidates for verdicts only. Replies may
    be keyed by ``row_id`` instead if the log table brought that column.

    ``logs`` needs source_file, line_no, ts_raw, ts, log. The log table is written from stage to stage to the shared
    folder, each state in place of the one before; two copies exist while a stage runs.
    """
    s = settings or Settings()
    prepare(logs.sparkSession)
    source = m.SOURCE
    rows = logs if "row_id" in logs.columns else logs.withColumn("row_id", F.monotonically_increasing_id())
    log = StageTable(logs.sparkSession, "log")
    rows = log.put(rows)
    original = rows.groupBy(source).agg(F.count(F.lit(1)).alias("original_count"))
    original = cut_lineage(original)
    rows = cap_rows_per_file(rows, s.max_lines)
    if s.fields or s.fields_by_file:
        rows = extract_fields_by_source(rows, s.fields_by_file, s.fields)
    rows = log.put(mine_templates(rows) if s.cluster_templates else signature_templates(rows))
    counts = cut_lineage(m.template_counts(rows))

    if s.collapse_floods:
        rows = log.put(collapse_floods(rows, s.flood_window, s.flood_threshold))
    rows = score_rows(rows, s, log.put)
    rows = log.put(r.classify_by_rules(rows, s.rules, s.security))
    leaks = cut_lineage(r.find_leaks(rows, s.security))

    found = cand.select_candidates(rows)
    if s.score_threshold > 0:
        found = cand.score_gate(found, rows, s.score_threshold)
    verdicts = s.prepare or replies is not None
    if verdicts and s.max_candidates is not None:
        found = cand.candidate_cap(found, s.max_candidates)
    allowed = None
    if verdicts and allowlist is not None:
        found = written(found)
        allowed = cand.allowlisted_counts(found, allowlist)
        found = cand.drop_allowlisted(found, allowlist)
    found = enrich_logs(cand.with_context(found, rows), context="context_logs")
    found = written(build_prompts(found, limit=s.context_limit, nearest=True) if verdicts else found)

    shown = once(rows, "_shown", redact("log")).withColumn("log", F.col("_shown")).drop("_shown")
    events = b.rule_entries(shown, s.behavior)
    events = None if events is None else written(events)
    hits = b.evaluate_rules(shown, s.behavior, entries=events)
    if s.behavior:
        hits = cut_lineage(hits)
        shown = written(b.apply_hits(shown, b.matched_rows(shown, s.behavior, hits, events)))
    else:
        shown = default_columns(shown)

    parts = [shown.filter("is_rule_based")]
    judged = None
    if not verdicts:
        parts.append(found.withColumn("is_security_related", r.is_security_related()).withColumn("log", redact("log")))
    elif replies is not None and not s.prepare:
        judged = classify_phase(found, replies, "row_id" if "row_id" in replies.columns else [source, "line_no"])
        judged = written(judged)
        parts.append(judged.filter("is_anomaly = 1").withColumn("log", redact("log")))
    parts.append(shown.filter("is_behavioral").withColumn("ts_raw", format_behavior_timestamp("ts")))
    final = union_anomalies(parts, s.dedupe)
    final = written(final)

    levels, times, parts_seen = m.level_counts(shown), m.time_metrics(shown), m.component_metrics(shown)
    volume = original.join(rows.groupBy(source).agg(F.count(F.lit(1)).alias("processed_count")), source, "left")
    summary = report(volume, counts, m.incident_counts(rows, leaks, final, allowed), times, levels, parts_seen,
                     m.leak_examples(leaks), m.tag_counts(final), s.flood_template_share,
                     verdicts=judged, limits=large_file_flag(logs, s.large_file_rows, s.max_lines), max_lines=s.max_lines)
    return Outcome(shown, leaks, found, hits, final, summary)


def union_anomalies(parts: list[DataFrame], dedupe: bool = False) -> DataFrame:
    """Rows of all anomaly families; a row in two families appears twice unless ``dedupe``."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.dropDuplicates(["row_id"]) if dedupe else out
