"""Behaviour rules against a direct sliding-window model, with many equal times."""

import datetime as dt
import random

import pytest

from emberlog.operators import behavior as b
from emberlog.schema import default_columns

BASE = dt.datetime(2024, 1, 1)


def model(events, rule):
    """events: (row_id, minute, matches, value), one group. Returns (fire_row, value, matched ids) or None."""
    ordered = sorted(events, key=lambda e: (e[1], e[0]))
    chosen = ordered if rule.type == "ratio" else [e for e in ordered if e[2]]
    if rule.type == "ratio" and not any(e[2] for e in ordered):
        return None
    for i, e in enumerate(chosen):
        window = [x for x in chosen[: i + 1] if x[1] >= e[1] - rule.window_minutes]
        if rule.type == "count":
            value, ids, fires = len(window), [x[0] for x in window], len(window) >= rule.threshold
        elif rule.type == "distinct_count":
            value = len({x[3] for x in window if x[3] is not None})
            ids, fires = [x[0] for x in window], value >= rule.threshold
        else:
            hit = [x for x in ordered if x[2] and window[0][1] <= x[1] <= e[1]]
            value, ids, fires = len(hit) / len(window), [x[0] for x in hit], len(hit) / len(window) >= rule.threshold_ratio
        if fires:
            return e[0], value, ids
    return None


@pytest.fixture(scope="module")
def cases():
    rnd = random.Random(11)
    out, row_id = {}, 0
    for g in range(160):
        events = []
        for _ in range(rnd.randrange(1, 14)):
            events.append((row_id, rnd.randrange(0, 30), rnd.random() < 0.6, rnd.choice(["x", "y", "z", "w", None])))
            row_id += 1
        out[f"g{g}"] = events
    return out


RULES = [
    b.BehaviorRule("c3", "count", "g", 5, 3, pattern="hit"),
    b.BehaviorRule("c1", "count", "g", 2, 0.5, pattern="HIT"),
    b.BehaviorRule("d2", "distinct_count", "g", 4, 2, field="v", pattern="hit"),
    b.BehaviorRule("d3", "distinct_count", "g", 9, 3, field="v"),
    b.BehaviorRule("r6", "ratio", "g", 6, threshold_ratio=0.6, pattern="hit"),
    b.BehaviorRule("r9", "ratio", "g", 3, threshold_ratio=1.2, pattern="hit"),
    b.BehaviorRule("r0", "ratio", "g", 3, threshold_ratio=0.0, pattern="hit"),
    b.BehaviorRule("bad", "count", "g", 5),
    b.BehaviorRule("odd", "no such type", "g", 5, 1),
    b.BehaviorRule("nofield", "distinct_count", "g", 5, 1, field="missing"),
]


def frame(spark, cases):
    rows = [(i, BASE + dt.timedelta(minutes=m), "a hit" if hit else "calm", g, v)
            for g, events in cases.items() for i, m, hit, v in events]
    noise = [(10**6, None, "a hit", "g0", "x"), (10**6 + 1, BASE, "a hit", None, "x"), (10**6 + 2, BASE, None, "only_null", "x")]
    return spark.createDataFrame(rows + noise, "row_id long, ts timestamp, log string, g string, v string").repartition(5)


@pytest.mark.parametrize("hot_rows", [None, 4])
def test_rules_equal_the_model(spark, cases, hot_rows):
    df = frame(spark, cases)
    hits = b.evaluate_rules(df, RULES, hot_rows)
    got = {(r.rule, r.group_key): r for r in hits.collect()}
    members = {}
    for r in b.matched_rows(df, RULES, hits).collect():
        members.setdefault((r.rule, r.group_key), []).append(r.row_id)
    assert not {r for r, _ in got} & {"bad", "odd", "nofield"}
    for rule in RULES[:7]:
        for g, events in cases.items():
            events = [(i, m, True, v) for i, m, _, v in events] if rule.pattern is None else events
            want = model(events, rule)
            if want is None:
                assert (rule.name, g) not in got
                continue
            hit = got[(rule.name, g)]
            # A ratio is reported for the first event of a moment; equal moments share the rest.
            assert (hit.fire_row, round(hit.value, 9)) == (want[0], round(want[1], 9)), (rule.name, g)
            assert sorted(members.get((rule.name, g), [])) == sorted(want[2]), (rule.name, g)


def test_missing_group_column_is_one_group(spark, cases):
    rule = b.BehaviorRule("all", "count", "no_such_column", 3, 4, pattern="hit")
    everyone = [e for events in cases.values() for e in events]
    hit = b.evaluate_rules(frame(spark, cases).filter("row_id < 1000000"), [rule]).collect()
    want = model(everyone, rule)
    assert [(h.group_key, h.fire_row, h.value) for h in hit] == [("*", want[0], float(want[1]))]


def test_minimum_support(spark):
    rows = [(i, BASE + dt.timedelta(minutes=i), "hit" if i in (0, 4, 5) else "calm", "g") for i in range(6)]
    df = spark.createDataFrame(rows, "row_id long, ts timestamp, log string, g string")
    def first(least):
        rule = b.BehaviorRule("r", "ratio", "g", 60, threshold_ratio=0.5, pattern="hit", min_events=least)
        return [r.fire_row for r in b.evaluate_rules(df, [rule]).collect()]
    assert first(1) == [0]
    assert first(3) == [5]


def test_write_back_order(spark):
    rows = [(1, "old reason", ["T"]), (2, None, []), (3, None, [])]
    df = default_columns(spark.createDataFrame(rows, "row_id long, reason string, tag array<string>"))
    matched = spark.createDataFrame([(1, 0, "First Rule", "r0"), (1, 2, "Last Rule", "r2"), (2, 2, "Last Rule", "r2")],
                                    "row_id long, rule_at int, rule string, reason string")
    got = {r.row_id: r for r in b.apply_hits(df, matched).collect()}
    assert (got[1].behavioral_rule, got[1].reason, got[1].tag) == ("Last Rule", "old reason", ["T", "behavioral_first_rule", "behavioral_last_rule"])
    assert (got[2].reason, got[2].classification, got[2].is_anomaly) == ("r2", "Behavioral Anomaly", 1)
    assert (got[3].is_behavioral, got[3].is_anomaly, got[3].tag) == (False, 0, [])


def test_no_rules(spark, cases):
    assert b.evaluate_rules(frame(spark, cases), []).count() == 0


def test_ratio_rules_read_their_rows_once(spark):
    """A limit above zero needs no second look for groups without a match; a limit of zero does, and such groups do not fire."""
    rows = spark.createDataFrame([(i, BASE + dt.timedelta(minutes=i), "u" if i < 5 else "w", "hit" if i < 5 else "miss") for i in range(9)], "row_id long, ts timestamp, g string, log string")

    def found(limit):
        hits = b.evaluate_rules(rows, [b.BehaviorRule("r", "ratio", "g", 5, threshold_ratio=limit, pattern="hit")])
        return {h.group_key for h in hits.collect()}, "LeftSemi" in hits._jdf.queryExecution().optimizedPlan().toString()
    assert found(0.5) == ({"u"}, False)
    assert found(0.0) == ({"u"}, True)


def test_written_events_give_the_same_hits_and_search_the_lines_once(spark, tmp_path):
    """A whole run searched all lines for the patterns again in each of eight scans."""
    rules = [RULES[0], RULES[2], RULES[3], RULES[4], RULES[6], RULES[7]]
    rows = spark.createDataFrame(
        [(i, BASE + dt.timedelta(minutes=i // 3), f"g{i % 4}" if i % 11 else None, "hit" if i % 5 < 2 else "miss", f"v{i % 3}" if i % 7 else None) for i in range(300)],
        "row_id long, ts timestamp, g string, log string, v string")
    b.rule_entries(rows, rules).write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    hits, apart = b.evaluate_rules(rows, rules, None, entries=events), b.evaluate_rules(rows, rules, None)
    got, want = sorted(map(str, hits.collect())), sorted(map(str, apart.collect()))
    assert got == want and got
    assert "RLIKE" not in hits._jdf.queryExecution().optimizedPlan().toString().upper()
    known = spark.createDataFrame(hits.collect(), hits.schema)
    assert sorted(map(str, b.matched_rows(rows, rules, known, events).collect())) == sorted(map(str, b.matched_rows(rows, rules, known).collect()))
    assert b.rule_entries(rows, [RULES[7]]) is None and b.rule_entries(rows, []) is None
