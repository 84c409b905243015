"""Ordered pattern catalogs: rules, security flags, leaks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import catalogs as c
from emberlog.catalogs import Pattern
from emberlog.functions.text import col, redact
from emberlog.operators.once import once
from emberlog.schema import default_columns


def first_match(log: Column | str, catalog: list[Pattern]) -> Column:
    """Position of the first catalog entry that matches, null if none does."""
    x = col(log)
    out = F.when(F.lit(False), F.lit(0))
    for i, pattern in enumerate(filter(None, (c.spark_pattern(p.pattern) for p in catalog))):
        out = out.when(x.rlike(pattern), i)
    return out


def any_match(log: Column | str, catalog: list[Pattern]) -> Column:
    x = col(log)
    hit = F.lit(False)
    for entry in c.usable(catalog):
        hit = hit | x.rlike(entry.pattern)
    return F.coalesce(hit, F.lit(False))


def _pick(values: list[str], position: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), position) if values else F.lit(None).cast("string")


def classify_by_rules(df: DataFrame, rules: list[Pattern] = c.RULE_PATTERNS,
                      security: list[Pattern] = c.SECURITY_PATTERNS, log: str = "log") -> DataFrame:
    """First matching rule decides; the security flag is set on rule rows only."""
    catalog = [p for p in rules if c.spark_pattern(p.pattern) is not None]
    at = F.col("_rule")
    hit = at.isNotNull()
    fresh = df.drop("is_rule_based", "is_security_related", "classification", "reason", "tag", "anomaly_source")
    marked = default_columns(once(fresh, "_rule", first_match(log, catalog)))
    name = _pick([p.name for p in catalog], at)
    return marked.withColumns({
        "is_rule_based": hit,
        "is_anomaly": F.when(hit, 1).otherwise(F.col("is_anomaly")),
        "classification": F.when(hit, "Operational Error"),
        "reason": _pick([p.reason or "Rule-based detection" for p in catalog], at),
        "tag": F.when(hit, F.array(name)).otherwise(F.array().cast("array<string>")),
        "anomaly_source": F.when(hit, "Rule-Based"),
        "is_security_related": hit & any_match(log, security),
    }).drop("_rule")


def rule_verdict(log: Column | str, rules: list[Pattern] = c.RULE_PATTERNS) -> Column:
    """(label, reason, tags) of the first matching rule, or null."""
    catalog = [p for p in rules if c.spark_pattern(p.pattern) is not None]
    at = first_match(log, catalog)
    return F.when(at.isNotNull(), F.struct(
        F.lit("Operational Error").alias("label"),
        _pick([p.reason or "Rule-based detection" for p in catalog], at).alias("reason"),
        F.array(_pick([p.name for p in catalog], at)).alias("tags"),
    ))


def find_leaks(df: DataFrame, security: list[Pattern] = c.SECURITY_PATTERNS, log: str = "log") -> DataFrame:
    """Rows with a leak: the first matching pattern's name, a reason, the redacted line."""
    catalog = [p for p in security if c.spark_pattern(p.pattern) is not None]
    return (
        once(df, "_leak", first_match(log, catalog))
        .filter(F.col("_leak").isNotNull())
        .withColumn("leak_type", _pick([p.name for p in catalog], F.col("_leak")))
        .withColumns({
            "reason": F.concat(F.lit("Possible "), F.col("leak_type"), F.lit(" leakage.")),
            log: redact(log),
        })
        .drop("_leak")
    )


def _has_word(text: Column, words: list[str]) -> Column:
    """Any of the literal words occurs. Plain substring search is much cheaper here than
    an alternation, which tries every word at every position."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def is_security_related(log: str = "log", classification: str = "classification", reason: str = "reason",
                        tag: str = "tag", security: list[Pattern] = c.SECURITY_PATTERNS) -> Column:
    text = F.lower(F.col(log))
    # Lines without any of the patterns' literal heads need no pattern; a pattern without such a head is always tried.
    heads = list(dict.fromkeys(p.split(".*")[0] for p in c.SECURITY_LOG_PATTERNS))
    headed = all(re.fullmatch(r"[a-z0-9 ]+", h) for h in heads)
    matched = text.rlike("|".join(c.SECURITY_LOG_PATTERNS))
    listed = F.when(_has_word(text, heads), matched).otherwise(F.lit(False)) if headed else matched
    said = F.lower(F.concat_ws("\n", F.col(classification), F.col(reason), F.array_join(F.col(tag), "\n")))
    return any_match(log, security) | _has_word(said, c.SECURITY_KEYWORDS) | F.coalesce(listed, F.lit(False))
