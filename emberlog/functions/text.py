"""Text and array expressions: redaction, cleaning, cutting, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import catalogs as c

# Letters, digits and underscore of any script, as a class body.
WORD = c.WORD


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def words(x: Column | str) -> Column:
    """Blank-separated words; none for an empty text."""
    return F.filter(F.split(col(x), r"\s+"), lambda w: w != "")


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """First match of the group, null when there is none."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def redact(log: Column | str) -> Column:
    """Hide bearer/token/authorization values, three-part JWTs and API keys."""
    hidden = col(log)
    for pattern, by in c.REDACTIONS:
        hidden = F.regexp_replace(hidden, pattern, by)
    return hidden


def hide(text: Column | str) -> Column:
    """``redact``, and then whatever the security catalogs or the secret scanner still find. Most texts hold nothing like it, which a
    search for literals says much faster than the patterns do; these stay as they are."""
    x = col(text)
    return F.get(F.transform(F.array(F.struct(x.alias("text"), F.lower(x).alias("low"))), lambda t: F.when(
        _holds(t["low"], c.SUSPECT) | t["text"].rlike(c.SUSPECT_RUN), _masked(t["text"])).otherwise(t["text"])), F.lit(0))


def _holds(low: Column, literals: tuple[str, ...]) -> Column:
    hit = F.contains(low, F.lit(literals[0]))
    for literal in literals[1:]:
        hit = hit | F.contains(low, F.lit(literal))
    return hit


def _masked(x: Column) -> Column:
    hidden = redact(x)
    for entry in (*c.SECURITY_PATTERNS, *c.SAMPLE_SECURITY_PATTERNS):
        hidden = F.regexp_replace(hidden, "(?i)" + entry.pattern, "<REDACTED>")
    for pattern in c.SECRET_PATTERNS:
        hidden = F.regexp_replace(hidden, pattern, "<SECRET>")
    return hidden


def is_exposed(text: Column | str, low: Column) -> Column:
    """Whether a security catalog or the secret scanner finds something in ``text``; ``low`` is the text in lower case. A pattern is
    tried on texts that hold one of its literals, which are found much faster."""
    x, hit = col(text), F.lit(False)
    for pattern in [*("(?i)" + p.pattern for p in (*c.SECURITY_PATTERNS, *c.SAMPLE_SECURITY_PATTERNS)), *c.SECRET_PATTERNS]:
        heads = c.HEADS.get(pattern) or c.HEADS.get(pattern.removeprefix("(?i)")) or ("",)
        hit = hit | (_holds(low, heads) & x.rlike(pattern))
    return hit


def clean_line(log: Column | str) -> Column:
    """Line without brackets, ISO times, ids, addresses and secrets."""
    out = col(log)
    for pattern, by in c.CLEANINGS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def line_signature(log: Column | str) -> Column:
    """Cheap template: the cleaned line with every number masked."""
    return F.regexp_replace(clean_line(log), r"[0-9]+", "<*>")


def truncate_log(log: Column | str, limit: int = 512) -> Column:
    x = col(log)
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("..."))).otherwise(x)


def short_reason(reason: Column | str, limit: int | None = None) -> Column:
    x = col(reason)
    if limit is None:
        return x
    cut = F.regexp_replace(F.substring(x, 1, limit), r"\s+$", "")
    return F.when(F.length(x) > limit, F.concat(cut, F.lit("..."))).otherwise(x)


def canonical_timestamp(ts_raw: Column | str) -> Column:
    """Blank instead of ``T`` and exactly three fraction digits where there are that many."""
    x = F.replace(strip(F.coalesce(col(ts_raw), F.lit(""))), F.lit("T"), F.lit(" "))
    return (
        F.when(x == "", x)
        .when(F.contains(x, F.lit(".")), F.regexp_extract(x, r"^([^.]*\.[^.]{0,3})", 1))
        .otherwise(F.concat(x, F.lit(".000")))
    )


def format_behavior_timestamp(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss.SSS")


def record_id(ts_raw: Column | str, log: Column | str) -> Column:
    """Stable id: canonical time and the tail of a hash of the line."""
    return F.concat(canonical_timestamp(ts_raw), F.lit("_"), F.right(F.md5(strip(F.coalesce(col(log), F.lit("")))), F.lit(8)))


def label_map(label: Column | str) -> Column:
    x = col(label)
    out = F.when(F.lit(False), F.lit(""))
    for name, shown in c.LABELS.items():
        out = out.when(x == name, shown)
    return out.otherwise(c.LABELS["Unknown"])


def word_jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared words over all words; 0 when both are empty."""
    wa, wb = words(a), words(b)
    union = F.size(F.array_union(wa, wb))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(wa, wb)) / union)


def filter_valid_tags(tags: Column | str, valid: list[str]) -> Column:
    return F.filter(col(tags), lambda t: t.isin(valid))


def dropped_tags(tags: Column | str, valid: list[str]) -> Column:
    return F.array_except(col(tags), F.array(*[F.lit(v) for v in valid]))


def has_secret(log: Column | str) -> Column:
    """Whether the whole line holds something that looks like a secret."""
    hit = F.lit(False)
    for pattern in c.SECRET_PATTERNS:
        hit = hit | col(log).rlike(pattern)
    return F.coalesce(hit, F.lit(False))
