"""What one line says about itself: severity, component, action, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import catalogs as c
from emberlog.functions.text import col, found


def severity(log: Column | str) -> Column:
    x = col(log)
    marked = [F.upper(found(x, "(?i)" + p)) for p in c.LEVEL_MARKS]
    return F.coalesce(*marked, _first_of(x, c.SEVERITY_WORDS, "UNKNOWN"))


def _first_of(x: Column, named: list[tuple[str, str]], otherwise: str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in named:
        out = out.when(x.rlike(pattern), name)
    return out.otherwise(otherwise)


def component(log: Column | str) -> Column:
    x = col(log)
    named = F.coalesce(*[found(x, p) for p in c.COMPONENT_PATTERNS])
    after_level = found(x, c.COMPONENT_AFTER_LEVEL)
    return F.coalesce(
        F.regexp_replace(named, r"^(?:service|module|component)\.", ""), after_level, F.lit("unknown")
    )


def action(log: Column | str) -> Column:
    x = col(log)
    pair = rf"(?i)\b({c.ACTION_STEMS})\s+({c.NAME})"
    return F.coalesce(
        *[F.lower(found(x, p)) for p in c.ACTION_MARKS],
        F.lower(found(x, f"(?i)({c.ACTION_VERBS})")),
        F.when(x.rlike(pair), F.concat(F.lower(F.regexp_extract(x, pair, 1)), F.lit("_"),
                                       F.lower(F.regexp_extract(x, pair, 2)))),
        F.lit("unknown"),
    )


def _present(x: Column, names: list[str], test) -> Column:
    return F.array_compact(F.array(*[F.when(test(x, n), F.lit(n)) for n in names]))


def error_indicators(log: Column | str) -> Column:
    return _present(F.lower(col(log)), c.ERROR_WORDS, lambda x, w: F.contains(x, F.lit(w)))


def is_startup(log: Column | str) -> Column:
    return F.lower(col(log)).rlike(c.any_of(c.STARTUP_WORDS))


def is_sensitive(log: Column | str) -> Column:
    return col(log).rlike("(?i)" + "|".join(c.SENSITIVE_PATTERNS))


def _seen(context: Column, word: str) -> Column:
    """``word`` holds no line end, so it stands in the joined lines if it stands in one of them."""
    return F.contains(F.lower(F.array_join(context, "\n")), F.lit(word))


def operation_patterns(log: Column | str, context: Column | None = None) -> Column:
    """Operation kinds in the line, and sequences in its context lines (array of text)."""
    x = col(log)
    parts = [F.when(x.rlike(pattern), F.lit(name)) for name, pattern in c.OPERATIONS]
    if context is not None:
        parts += [
            F.when(_seen(context, "start") & _seen(context, "complete"), F.lit("start_complete_sequence")),
            F.when(_seen(context, "request") & _seen(context, "response"), F.lit("request_response_sequence")),
        ]
    return F.array_compact(F.array(*parts))


def has_number(log: Column | str) -> Column:
    return col(log).rlike("[0-9]")


def level_word(log: Column | str) -> Column:
    return _first_of(F.lower(col(log)), c.LEVEL_WORDS, "unknown")


LEADING = c.LEADING


def leading_component(log: Column | str) -> Column:
    return F.coalesce(found(col(log), LEADING), F.lit("unknown"))


def action_word(log: Column | str) -> Column:
    x = F.lower(col(log))
    out = F.when(F.lit(False), F.lit(""))
    for word in c.ACTION_WORDS:
        out = out.when(F.contains(x, F.lit(word)), word)
    return out.otherwise("unknown")


def error_type(log: Column | str) -> Column:
    return _first_of(F.lower(col(log)), c.ERROR_TYPE_PATTERNS, "none")


def token_patterns(log: Column | str) -> Column:
    by_name = dict(c.TOKEN_PATTERNS)
    return _present(col(log), list(by_name), lambda x, n: x.rlike(by_name[n]))


def enrich_logs(df: DataFrame, log: str = "log", context: str | None = None) -> DataFrame:
    """Two records per line: ``log_info`` and ``log_analysis``. One projection, no Python."""
    lines = F.transform(F.col(context), lambda r: r["log"]) if context else None
    return df.withColumns({
        "log_info": F.struct(
            severity(log).alias("severity"),
            component(log).alias("component"),
            action(log).alias("action"),
            error_indicators(log).alias("error_indicators"),
            operation_patterns(log, lines).alias("patterns"),
            is_startup(log).alias("is_startup_related"),
            is_sensitive(log).alias("contains_sensitive_info"),
            has_number(log).alias("has_numeric_values"),
        ),
        "log_analysis": F.struct(
            level_word(log).alias("severity"),
            leading_component(log).alias("component"),
            action_word(log).alias("action"),
            error_type(log).alias("error_type"),
            token_patterns(log).alias("patterns"),
        ),
    })
