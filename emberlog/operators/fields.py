"""Configured extra fields: from JSON keys, other columns, or a pattern."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.catalogs import spark_pattern
from emberlog.operators.once import once


@dataclass(frozen=True)
class FieldRule:
    name: str
    extractors: list[str] = field(default_factory=list)
    regex: str | None = None


def _json_value(parsed: Column, key: str) -> Column:
    """Value of a top-level key as text; null for null, false, 0, "", [] and {}."""
    value = F.try_variant_get(parsed, f"$['{key}']", "variant")
    text = value.cast("string")
    is_text = F.schema_of_variant(value) == "STRING"
    empty = F.when(is_text, text == "").otherwise(
        text.isin("false", "null", "[]", "{}") | F.coalesce(text.rlike(r"^-?0(?:\.0*)?(?:[eE].*)?$"), F.lit(False)))
    return F.when(~empty, text)


def _matched(log: Column, regex: str) -> Column | None:
    """First group of the first match, or the whole match of a pattern without groups; none for an invalid pattern."""
    pattern = spark_pattern(regex)
    if pattern is None:
        return None
    return F.nullif(F.regexp_extract(log, pattern, min(1, re.compile(regex).groups)), F.lit(""))


def _field(rule: FieldRule, columns: list[str], log: str) -> Column:
    sources = [_json_value(F.col("_body"), k) for k in rule.extractors]
    sources += [F.nullif(F.col(k).cast("string"), F.lit("")) for k in rule.extractors if k in columns]
    if rule.regex and (matched := _matched(F.col(log), rule.regex)) is not None:
        sources.append(matched)
    return F.coalesce(*sources) if sources else F.lit(None).cast("string")


def _body(log: str) -> Column:
    """The line as JSON when it is an object, else null."""
    return F.when(F.col(log).rlike(r"^\s*\{"), F.try_parse_json(F.col(log)))


def extract_fields(df: DataFrame, rules: list[FieldRule], log: str = "log") -> DataFrame:
    """Add one text column per rule. A later rule can use the fields of earlier ones."""
    out = once(df, "_body", _body(log))
    for rule in rules:
        out = out.withColumn(rule.name, _field(rule, out.columns, log))
    return out.drop("_body")


def extract_fields_by_source(df: DataFrame, per_file: dict[str, list[FieldRule]],
                             default: list[FieldRule], log: str = "log",
                             source: str = "source_file") -> DataFrame:
    """Like ``extract_fields`` with the rule list chosen by source file.

    One scan: every field is a CASE with a branch for each different rule, not for each file.
    """
    names = list(dict.fromkeys(r.name for rules in [*per_file.values(), default] for r in rules))
    out = once(df, "_body", _body(log))
    none = F.lit(None).cast("string")
    for name in names:
        def of(rules: list[FieldRule]) -> Column:
            rule = next((r for r in rules if r.name == name), None)
            return _field(rule, out.columns, log) if rule else none
        value = F.when(F.lit(False), none)
        same: dict[str, tuple[list[str], list[FieldRule]]] = {}
        for file, rules in per_file.items():
            rule = next((r for r in rules if r.name == name), None)
            same.setdefault(repr(rule), ([], rules))[0].append(file)
        for files, rules in same.values():
            value = value.when(F.col(source).isin(files), of(rules))
        out = out.withColumn(name, value.otherwise(of(default)))
    return out.drop("_body")


def field_coverage(df: DataFrame, names: list[str]) -> DataFrame:
    """How many rows carry each field: one row per field."""
    counts = df.agg(*[F.count(n).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(n).alias("n_values")) for n in names])).alias("r")).select("r.*")
