"""Sliding-window behaviour rules: count, distinct count and ratio per group.

All rules of one type are evaluated together: one scan, one shuffle on
(rule, group). A window count is never recomputed per event. Every event adds
its amount when it happens and takes it back when it leaves the window; the
running total of these changes is the content of the window at each moment.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.catalogs import SAMPLE_BEHAVIOR_RULES, spark_pattern
from emberlog.operators.ordering import HOT_ROWS, hot_limit, running_totals
from emberlog.schema import default_columns

NO_GROUP = "*"


@dataclass(frozen=True)
class BehaviorRule:
    name: str = "Unnamed Rule"
    type: str = "count"
    group_by: str | None = None
    window_minutes: float = 60
    threshold: float | None = None
    field: str | None = None
    pattern: str | None = None
    threshold_ratio: float | None = None
    reason: str | None = None
    min_events: int = 1

    def reason_text(self) -> str:
        limit = self.threshold_ratio if self.type == "ratio" else self.threshold
        kind = {"count": "count", "distinct_count": "distinct_count", "ratio": "ratio"}.get(self.type, self.type)
        return self.reason or f"{self.name} triggered by {kind} >= {limit}"


def sample_rules() -> list[BehaviorRule]:
    """The behaviour rules of the sample configuration."""
    return [BehaviorRule(**rule) for rule in SAMPLE_BEHAVIOR_RULES]


def _runnable(rule: BehaviorRule, columns: list[str]) -> bool:
    if rule.type == "ratio":
        return rule.threshold_ratio is not None
    if rule.threshold is None:
        return False
    return rule.type == "count" or (rule.type == "distinct_count" and rule.field in columns)


def _matches(rule: BehaviorRule) -> Column:
    return F.coalesce(F.col("log").rlike(spark_pattern(rule.pattern) or "(?!)"), F.lit(False)) if rule.pattern else F.lit(True)


def _entries(df: DataFrame, rules: list[tuple[int, BehaviorRule]]) -> DataFrame:
    """One row per (rule, event of the rule's group), from a single scan."""
    options = []
    for at, rule in rules:
        key = F.col(rule.group_by).cast("string") if rule.group_by in df.columns else F.lit(NO_GROUP)
        match = _matches(rule)
        limit = rule.threshold_ratio if rule.type == "ratio" else max(1, math.ceil(rule.threshold))
        entry = F.struct(
            F.lit(at).alias("rule_at"),
            key.alias("group_key"),
            F.lit(int(rule.window_minutes * 60_000_000)).cast("long").alias("span"),
            F.lit(float(limit)).alias("limit"),
            match.alias("match"),
            (F.col(rule.field).cast("string") if rule.type == "distinct_count"
             else F.lit(None).cast("string")).alias("field_value"),
        )
        wanted = key.isNotNull() if rule.type == "ratio" else key.isNotNull() & match
        options.append(F.when(wanted, entry))
    return (
        df.filter(F.col("ts").isNotNull())
        .select("row_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
                F.explode(F.array_compact(F.array(*options))).alias("e"))
        .select("row_id", "at", "e.*")
    )


def rule_entries(df: DataFrame, rules: list[BehaviorRule]) -> DataFrame | None:
    """The events of all rules, to be written once for ``evaluate_rules`` and ``matched_rows``: these read them several times, and every time
    would search all lines for the patterns again. None if no rule can run."""
    todo = [(at, r) for at, r in enumerate(rules) if _runnable(r, df.columns)]
    return _entries(df, todo) if todo else None


GROUP = ["rule_at", "group_key"]
# Changes at one moment: arrivals (kind 0) are counted before departures (kind 1),
# so an event exactly one window old still counts.
ORDER = ["moment", "kind", "row_id"]


def _changes(rows: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """Each event twice, from one scan: what it adds at its time and takes back one window later."""
    arrival = F.struct(F.col("at").alias("moment"), F.lit(0).alias("kind"), *[a.alias(n) for n, a in amounts.items()])
    departure = F.struct((F.col("at") + F.col("span")).alias("moment"), F.lit(1).alias("kind"), *[(-a).alias(n) for n, a in amounts.items()])
    return rows.select("*", F.explode(F.array(arrival, departure)).alias("c")).select(*rows.columns, "c.*")


def _first_of(df: DataFrame, fires: Column, value: Column) -> DataFrame:
    """Earliest firing event of every (rule, group)."""
    moment = F.struct(F.col("at"), F.col("row_id"), value.alias("value"), F.col("span"))
    return (
        df.filter((F.col("kind") == 0) & fires)
        .groupBy(*GROUP).agg(F.min(moment).alias("m"))
        .select(*GROUP, F.col("m.at").alias("fire_at"), F.col("m.row_id").alias("fire_row"),
                F.col("m.value").alias("value"), (F.col("m.at") - F.col("m.span")).alias("from_at"))
    )


def _count_hits(entries: DataFrame, hot_rows: int | None) -> DataFrame:
    rows = entries.select(*GROUP, "row_id", "at", "span", "limit")
    changes = _changes(rows, {"change": F.lit(1).cast("long")})
    inside = running_totals(changes, GROUP, ORDER, {"inside": F.col("change")}, hot_rows)
    return _first_of(inside, F.col("inside") >= F.col("limit"), F.col("inside").cast("double"))


def _distinct_hits(entries: DataFrame, hot_rows: int | None) -> DataFrame:
    """A value enters when an event finds none of it in the window and leaves with
    the event after which none of it is left. Only those changes are then totalled."""
    rows = entries.filter(F.col("field_value").isNotNull()).select(*GROUP, "row_id", "at", "span", "limit", "field_value")
    changes = _changes(rows, {"change": F.lit(1).cast("long")})
    alike = running_totals(changes, [*GROUP, "field_value"], ORDER, {"alike": F.col("change")}, hot_rows)
    turns = alike.filter(
        ((F.col("kind") == 0) & (F.col("alike") == 1)) | ((F.col("kind") == 1) & (F.col("alike") == 0))).drop("alike")
    inside = running_totals(turns, GROUP, ORDER, {"inside": F.col("change")}, hot_rows)
    return _first_of(inside, F.col("inside") >= F.col("limit"), F.col("inside").cast("double"))


def _ratio_hits(entries: DataFrame, min_events: dict[int, int], hot_rows: int | None, positive: bool = False) -> DataFrame:
    """Per moment: matches in the window (all of this moment's) over the events up to
    the first one of this moment, which has the smallest denominator. ``positive``: all limits are above zero."""
    moments = entries.groupBy(*GROUP, "at").agg(
        F.min("row_id").alias("row_id"), F.first("span").alias("span"), F.first("limit").alias("limit"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("match")).alias("m"))
    changes = _changes(moments, {"dn": F.col("n"), "dm": F.col("m")})
    inside = running_totals(changes, GROUP, ORDER, {"all_in": F.col("dn"), "match_in": F.col("dm")}, hot_rows)
    total = F.col("all_in") - F.col("n") + 1
    ratio = F.col("match_in") / total
    enough = F.coalesce(*[F.when(F.col("rule_at") == at, total >= least) for at, least in min_events.items()])
    fired = _first_of(inside, (ratio >= F.col("limit")) & enough, ratio)
    if positive:  # then a window that fires holds a match
        return fired
    # A group without any match is not evaluated, whatever the limit.
    matched = moments.filter(F.col("m") > 0).select(*GROUP).distinct()
    return fired.join(matched, GROUP, "left_semi")


def evaluate_rules(df: DataFrame, rules: list[BehaviorRule], hot_rows: int | None = HOT_ROWS, entries: DataFrame | None = None) -> DataFrame:
    """One row per (rule, group) that fires: the trigger and its window.

    Needs ``row_id``, ``ts``, ``log`` and the columns the rules name. ``entries``: the written ``rule_entries`` of the same rows and rules.
    """
    def of(some: list[tuple[int, BehaviorRule]]) -> DataFrame:
        return _entries(df, some) if entries is None else entries.filter(F.col("rule_at").isin([at for at, _ in some]))
    todo = [(at, r) for at, r in enumerate(rules) if _runnable(r, df.columns)]
    found = []
    hot_rows = hot_limit(df, hot_rows)
    for kind, run in (("count", _count_hits), ("distinct_count", _distinct_hits)):
        some = [(at, r) for at, r in todo if r.type == kind]
        if some:
            found.append(run(of(some), hot_rows))
    some = [(at, r) for at, r in todo if r.type == "ratio"]
    if some:
        found.append(_ratio_hits(of(some), {at: r.min_events for at, r in some}, hot_rows, all(r.threshold_ratio > 0 for _, r in some)))
    if not found:
        return df.sparkSession.createDataFrame(
            [], "rule_at int, group_key string, fire_at long, fire_row long, value double, from_at long, rule string, reason string")
    hits = reduce(DataFrame.unionByName, found)
    names, reasons = F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(r.reason_text()) for r in rules])
    return hits.withColumns({"rule": F.get(names, F.col("rule_at")), "reason": F.get(reasons, F.col("rule_at"))})


def matched_rows(df: DataFrame, rules: list[BehaviorRule], hits: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """The rows inside the window of each hit: (row_id, rule_at, group_key, rule, reason). ``entries`` as in ``evaluate_rules``."""
    todo = [(at, r) for at, r in enumerate(rules) if _runnable(r, df.columns)]
    if not todo:
        return hits.select(F.col("fire_row").alias("row_id"), "rule_at", "group_key", "rule", "reason")
    ratio = [at for at, r in todo if r.type == "ratio"]
    rows = (_entries(df, todo) if entries is None else entries).filter("match")
    fired = hits.select(*GROUP, "fire_at", "fire_row", "from_at", "rule", "reason")
    # Rows of the trigger's own moment: up to the trigger, but all of them for a ratio.
    upto = (F.col("at") < F.col("fire_at")) | (F.col("row_id") <= F.col("fire_row"))
    if ratio:
        upto = upto | F.col("rule_at").isin(ratio)
    return (
        rows.join(fired, GROUP)
        .filter(F.col("at").between(F.col("from_at"), F.col("fire_at")) & upto)
        .select("row_id", *GROUP, "rule", "reason")
    )


def apply_hits(df: DataFrame, matched: DataFrame) -> DataFrame:
    """Write hits back: last rule names the row, first rule explains it, all tag it."""
    per_row = matched.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("rule_at", "rule", "reason"))).alias("_hits"))
    rows = default_columns(df).join(per_row, "row_id", "left")
    hit = F.col("_hits").isNotNull()
    tags = F.transform("_hits", lambda h: F.concat(
        F.lit("behavioral_"), F.replace(F.lower(h["rule"]), F.lit(" "), F.lit("_"))))
    return rows.withColumns({
        "is_behavioral": hit | F.col("is_behavioral"),
        "behavioral_rule": F.when(hit, F.element_at("_hits", -1)["rule"]).otherwise(F.col("behavioral_rule")),
        "is_anomaly": F.when(hit, 1).otherwise(F.col("is_anomaly")),
        "anomaly_source": F.when(hit, "Behavioral").otherwise(F.col("anomaly_source")),
        "classification": F.when(hit, F.coalesce("classification", F.lit("Behavioral Anomaly"))).otherwise(F.col("classification")),
        "reason": F.when(hit, F.coalesce("reason", F.element_at("_hits", 1)["reason"])).otherwise(F.col("reason")),
        "tag": F.when(hit, F.concat(F.coalesce("tag", F.array().cast("array<string>")), tags)).otherwise(F.col("tag")),
    }).drop("_hits")
