"""Calls of a user's function: every prompt once, turn by turn, and a turn reads its own rows."""

from pyspark.sql import functions as F

from emberlog.operators import verdicts as v


def judge():
    def answer(text):
        if text.endswith("7"):
            raise RuntimeError("refused")
        return text.upper()
    return answer


def test_every_prompt_is_answered_once(spark):
    rows = spark.createDataFrame([(i, f"prompt {i}") for i in range(230)] + [(5, "prompt 5"), (None, "prompt x")], "row_id long, prompt string").repartition(3)
    for calls in (2_000, 20, 4):
        got = v.classify_with(rows, judge, parallel=3, calls_per_task=calls).collect()
        want = [(i, "refused" if i % 10 == 7 else f"PROMPT {i}", "error" if i % 10 == 7 else "ok") for i in range(230)]
        assert sorted(((r.row_id, r.reply, r.status) for r in got), key=str) == sorted([*want, (5, "PROMPT 5", "ok"), (None, "PROMPT X", "ok")], key=str)
        assert all(r.latency_s >= 0 for r in got)
    assert v.classify_with(rows.limit(0), judge).collect() == []


def test_a_turn_reads_its_own_rows(spark):
    rows = spark.range(500).select(F.col("id").alias("row_id"), F.concat(F.lit("p"), "id").alias("prompt"))
    laid = v.laid_in_turns(rows, "row_id", "prompt", 25)
    read = [t.count() if (t := v._turn(rows, laid, i)) is not None else 0 for i in range(26)]
    assert sum(read) == 500 and max(read) < 60 and read[25] == 0
    assert len(v._turn(rows, laid, 3).inputFiles()) == 1


def test_verdict_steps_run_once(spark):
    """The same verdicts as the single expression, each reply read once."""
    texts = ['{"classification":"x","reason":"y","tags":["error","disk","no"]}', "CLASSIFICATION: Anomalous\nREASON: hot TAGS: cpu, , Disk", "", None, "[1]", "Error: no"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, reply string")
    steps = v.with_parsed(rows, v.reply_parts("reply"), "v").select("row_id", "v", v.normalize_tags("v.tags").alias("tags"))
    plain = rows.select("row_id", v.parse_reply("reply").alias("v"), v.normalize_tags(v.parse_reply("reply")["tags"]).alias("tags"))
    assert sorted(steps.collect()) == sorted(plain.collect())
    assert steps._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") <= 1
