"""Log floods: long stretches where one template dominates become one summary row.

A scan position starts a flood when one template fills at least ``threshold`` of
the next ``window`` lines. All such positions follow from running totals per
(file, template), as intervals. The greedy scan then only jumps over these intervals
and over the runs of lines similar to a dominant template, never over log rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import catalogs as c
from emberlog.functions.enrich import LEADING
from emberlog.functions.text import found, word_jaccard, words
from emberlog.operators.ordering import HOT_ROWS, beside, running_totals
from emberlog.session import cut_lineage

FILE, LINE, TEMPLATE = "source_file", "line_no", "log_template"
SIMILAR = 0.8
# Blocks that become one in a level of the chain.
CHAIN = 64


def flood_starts(df: DataFrame, window: int = 1000, threshold: float = 0.75, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(file, dominant, low, high): the positions from which a template floods the window. Where several do
    (a threshold of a half or less), the most frequent in the window does; of equally frequent ones, the first in it.
    So the intervals of a file never overlap."""
    need = math.ceil(threshold * window - 1e-9)
    long_files = df.groupBy(FILE).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > window).select(FILE)
    heavy = (df.groupBy(FILE, TEMPLATE).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= need)
             .join(long_files, FILE, "left_semi").select(FILE, TEMPLATE))
    lines = df.select(FILE, TEMPLATE, LINE).join(heavy, [FILE, TEMPLATE], "left_semi")
    # A line is inside the windows starting from line - window + 1 to line.
    steps = (
        lines.select(FILE, TEMPLATE, F.explode(F.array(
            F.struct(F.greatest(F.col(LINE) - window + 1, F.lit(1)).alias("at"), F.lit(1).cast("long").alias("step")),
            F.struct((F.col(LINE) + 1).alias("at"), F.lit(-1).cast("long").alias("step")))).alias("s"))
        .groupBy(FILE, TEMPLATE, F.col("s.at").alias("at")).agg(F.sum("s.step").alias("step"))
        .filter(F.col("step") != 0)
    )
    inside = running_totals(steps, [FILE, TEMPLATE], ["at"], {"inside": F.col("step")}, hot_rows)
    was = F.col("inside") - F.col("step")
    key = [FILE, TEMPLATE]
    if threshold <= 0.5:
        level = beside(inside, key, ["at"], after={"_next": F.col("at")}, hot_rows=hot_rows).filter(F.col("inside") >= need)
        return _winners(level.select(FILE, TEMPLATE, "inside", F.col("at").alias("low"), (F.col("_next") - 1).alias("high")), lines, window, hot_rows)
    turns = inside.filter((F.col("inside") >= need) != (was >= need))
    return (
        beside(turns, key, ["at"], after={"_next": F.col("at")}, hot_rows=hot_rows).filter(F.col("inside") >= need)
        .select(FILE, F.col(TEMPLATE).alias("dominant"), F.col("at").alias("low"), (F.col("_next") - 1).alias("high"))
    )


def _winners(levels: DataFrame, lines: DataFrame, window: int, hot_rows: int | None) -> DataFrame:
    """Intervals of the winning template from stretches (low, high) in which a template's count in the window is ``inside``.

    Worked out position by position: a position has few templates that fill a share of its window.
    """
    counted = levels.select(FILE, TEMPLATE, "inside", F.explode(F.sequence("low", "high")).alias("pos"))
    placed = beside(lines, [FILE, TEMPLATE], [LINE], before={"_before": F.col(LINE)}, hot_rows=hot_rows)
    first = F.greatest(F.coalesce("_before", F.lit(0)) + 1, F.col(LINE) - window + 1)
    nearest = placed.select(FILE, TEMPLATE, LINE, first.alias("_from")).select(
        FILE, TEMPLATE, F.col(LINE).alias("nearest"), F.explode(F.sequence("_from", LINE)).alias("pos"))
    best = (counted.join(nearest, [FILE, TEMPLATE, "pos"]).groupBy(FILE, "pos")
            .agg(F.max(F.struct("inside", (-F.col("nearest")).alias("soon"), F.col(TEMPLATE).alias("dominant"))).alias("top"))
            .select(FILE, "pos", "top.dominant"))
    placed = running_totals(best, [FILE, "dominant"], ["pos"], {"_nth": F.lit(1).cast("long")}, hot_rows)
    return placed.groupBy(FILE, "dominant", (F.col("pos") - F.col("_nth")).alias("_run")).agg(
        F.min("pos").alias("low"), F.max("pos").alias("high")).select(FILE, "dominant", "low", "high")


def similar_templates(left: DataFrame, right: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(file, dominant, template) with word Jaccard above ``least``."""
    return candidate_templates(left, right, least).filter(word_jaccard("dominant", "template") > least)


def candidate_templates(left: DataFrame, right: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(file, dominant, template): pairs that may be that similar.

    Two word sets that similar share one of their few first words in any fixed order (prefix filtering). Words are
    ordered by the number of templates of the file that hold them, so the join is on rare words: a word that
    every template has (a wildcard) comes last and joins nothing.
    """
    held = right.select(FILE, F.explode(F.array_distinct(words("template"))).alias("_word")).groupBy(FILE, "_word").agg(F.count(F.lit(1)).alias("_held"))

    def prefixed(df: DataFrame, name: str) -> DataFrame:
        bag = df.select(FILE, name, F.explode(F.array_distinct(words(name))).alias("_word")).join(held, [FILE, "_word"], "left")
        bag = bag.groupBy(FILE, name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_held", F.lit(0)).alias("n"), "_word"))).alias("_bag"))
        keep = F.size("_bag") - F.ceil(F.lit(least) * F.size("_bag")).cast("int") + 1
        return bag.withColumn("_word", F.explode(F.slice("_bag", F.lit(1), keep))).select(FILE, name, "_word._word")
    pairs = prefixed(left, "dominant").join(prefixed(right, "template"), [FILE, "_word"])
    return pairs.drop("_word").distinct()


def similar_runs(df: DataFrame, starts: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(file, dominant, first, last): unbroken stretches of lines similar to a dominant template."""
    dominant = starts.select(FILE, "dominant").distinct()
    names = df.select(FILE, F.col(TEMPLATE).alias("template")).distinct().join(
        dominant.select(FILE).distinct(), FILE, "left_semi")
    alike = similar_templates(dominant, names)
    lines = df.select(FILE, LINE, F.col(TEMPLATE).alias("template")).join(alike, [FILE, "template"])
    placed = running_totals(lines.select(FILE, "dominant", LINE), [FILE, "dominant"], [LINE],
                            {"_nth": F.lit(1).cast("long")}, hot_rows)
    return placed.groupBy(FILE, "dominant", (F.col(LINE) - F.col("_nth")).alias("_run")).agg(
        F.min(LINE).alias("first"), F.max(LINE).alias("last")).drop("_run")


class _Chunk:
    """Greedy scan over the lines of one chunk of a file."""

    def __init__(self, pdf: pd.DataFrame, window: int):
        starts = pdf[pdf["kind"] == "start"].sort_values("first")
        self.lows, self.highs, self.owners = (starts[n].tolist() for n in ("first", "last", "dominant"))
        # Runs that are given to several chunks come with the same bounds.
        self.runs = {d: (r["first"].tolist(), r["last"].tolist())
                     for d, r in pdf[pdf["kind"] == "run"].sort_values("first").groupby("dominant")}
        self.window = window

    def end_of(self, begin: int, owner: str) -> int:
        """First line after a flood that begins here: a window, then lines similar to its template."""
        end = begin + self.window
        firsts, lasts = self.runs.get(owner, ([], []))
        j = bisect_right(firsts, end) - 1
        return lasts[j] + 1 if j >= 0 and lasts[j] >= end else end

    def next_flood(self, at: int) -> tuple[int, int, str] | None:
        """(begin, first line after, dominant) of the first flood from ``at`` on in this chunk.

        Intervals do not overlap, so the first one that ends at or after ``at`` is the next.
        """
        i = bisect_left(self.highs, at)
        if i == len(self.highs):
            return None
        begin = max(at, self.lows[i])
        return begin, self.end_of(begin, self.owners[i]), self.owners[i]

    def exits(self, stop: int) -> set[int]:
        """Every line beyond the chunk at which the scan may continue."""
        out = {lasts[j] + 1 for firsts, lasts in self.runs.values()
               for j in [bisect_right(firsts, stop) - 1] if j >= 0 and lasts[j] >= stop}
        for low, high, owner in zip(self.lows, self.highs, self.owners):
            out.update(self.end_of(s, owner) for s in range(max(low, stop - self.window + 1), high + 1))
        return {x for x in out if x > stop}

    def exit_from(self, at: int, stop: int, known: dict[int, int]) -> int:
        """Where the scan leaves the chunk when it enters at ``at``."""
        path = []
        while at not in known:
            path.append(at)
            flood = self.next_flood(at)
            if flood is None or flood[1] > stop:
                known[at] = max(stop + 1, flood[1] if flood else 0)
                break
            at = flood[1]
        for passed in path:
            known[passed] = known[at]
        return known[at]


def _pieces(starts: DataFrame, runs: DataFrame, window: int, size: int) -> DataFrame:
    """Flood starts and runs dealt to the chunks whose scan may need them."""
    def chunks(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor((first - 1) / size), F.floor((last - 1) / size)))
    low, high = F.col("chunk") * size + 1, (F.col("chunk") + 1) * size
    dealt = (
        starts.withColumn("chunk", chunks(F.col("low"), F.col("high")))
        .select(FILE, "chunk", F.lit("start").alias("kind"), F.greatest("low", low).alias("first"),
                F.least("high", high).alias("last"), "dominant"))
    # A flood that begins at line s asks for the run at line s + window.
    first, last = F.greatest(F.col("first") - window, F.lit(1)), F.greatest(F.col("last") - window, F.lit(1))
    useful = dealt.select(FILE, "chunk", "dominant").distinct()
    asked = (runs.withColumn("chunk", chunks(first, last)).join(useful, [FILE, "chunk", "dominant"], "left_semi")
             .select(FILE, "chunk", F.lit("run").alias("kind"), "first", "last", "dominant"))
    return dealt.unionByName(asked)


def _entries(pieces: DataFrame, window: int, size: int) -> DataFrame:
    """The line at which the scan enters each chunk that has floods.

    A chunk is left at one of at most ``window`` lines per dominant template, whatever
    its size. For each of these the chunk that contains it is scanned once; the chain of
    chunks is then followed over these few (line in, line out) pairs per file.
    """
    chunk = F.floor((F.col("first") - 1) / size)

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        stop = (int(pdf["chunk"].iloc[0]) + 1) * size
        out = pd.DataFrame({"first": sorted(_Chunk(pdf, window).exits(stop))}, dtype="int64")
        out[FILE] = pdf[FILE].iloc[0]
        return out[[FILE, "first"]]

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["chunk"].iloc[0])
        stop, scan, known = (number + 1) * size, _Chunk(pdf, window), {}
        into = sorted(set(pdf.loc[pdf["kind"] == "entry", "first"]) | {number * size + 1}, reverse=True)
        out = pd.DataFrame({"line_in": into, "line_out": [scan.exit_from(int(x), stop, known) for x in into]}, dtype="int64")
        out[FILE], out["chunk"] = pdf[FILE].iloc[0], number
        return out[[FILE, "chunk", "line_in", "line_out"]]

    left = pieces.groupBy(FILE, "chunk").applyInPandas(leave, f"{FILE} string, first long")
    flooded = pieces.filter("kind = 'start'").select(FILE, "chunk").distinct()
    entry = left.distinct().withColumn("chunk", chunk).join(flooded, [FILE, "chunk"], "left_semi").select(
        FILE, "chunk", F.lit("entry").alias("kind"), "first", F.lit(None).cast("long").alias("last"), F.lit(None).cast("string").alias("dominant"))
    moves = pieces.unionByName(entry).groupBy(FILE, "chunk").applyInPandas(cross, f"{FILE} string, chunk long, line_in long, line_out long")
    return _chained(cut_lineage(moves), size)


class _Moves:
    """Where the scan leaves each of some neighbouring blocks of a file, by the line at which it enters."""

    def __init__(self, pdf: pd.DataFrame, size: int):
        self.blocks = []
        for number, rows in pdf.sort_values(["block", "line_in"]).groupby("block"):
            into = dict(zip(rows["line_in"].tolist(), rows["line_out"].tolist()))
            self.blocks.append((int(number), into, [x for x in into if (x - 1) % size == 0]))

    def entered(self, at: int, last: int, which: int) -> int | None:
        """The line at which a scan that is at ``at`` enters block ``which``, which ends at line ``last``: ``at`` itself if the block
        knows it, else the next start of a chunk with floods."""
        _, into, starts = self.blocks[which]
        if at > last or at in into:
            return at if at in into else None
        i = bisect_left(starts, at)
        return starts[i] if i < len(starts) else None

    def ways_out(self, span: int) -> dict[int, int]:
        """Line behind all blocks for every line in: the last blocks first, so that each line is followed one block far."""
        out: dict[int, int] = {}
        for which in reversed(range(len(self.blocks))):
            for begin, at in self.blocks[which][1].items():
                for later in range(which + 1, len(self.blocks)):
                    then = self.entered(at, (self.blocks[later][0] + 1) * span, later)
                    if then is not None:
                        at = out[then]
                        break
                out[begin] = at
        return out

    def path(self, at: int, span: int) -> list[tuple[int, int]]:
        """(block, line in) of the blocks that a scan at ``at`` enters."""
        found = []
        for which, (number, into, _) in enumerate(self.blocks):
            begin = self.entered(at, (number + 1) * span, which)
            if begin is not None:
                found.append((number, begin))
                at = into[begin]
        return found


def _chained(moves: DataFrame, size: int) -> DataFrame:
    """(file, chunk, first): the line at which the scan enters each chunk, from (file, chunk, line_in, line_out).

    What a chunk does to the scan is a function from lines in to lines out, and functions compose in any grouping: ``CHAIN`` neighbouring
    blocks become one, level by level, until a file is one; then the way is found from the top down. A block keeps the lines in
    that another block leaves to, so no task holds more than ``CHAIN`` blocks of about a window's lines each, whatever the file.
    """
    levels = [moves.withColumnRenamed("chunk", "block")]
    span = size
    most = (levels[0].agg(F.max("block")).first()[0] or 0) + 1

    def united(span: int):
        def unite(pdf: pd.DataFrame) -> pd.DataFrame:
            ways = _Moves(pdf, size).ways_out(span)
            out = pd.DataFrame({"line_in": list(ways), "line_out": list(ways.values())}, dtype="int64")
            out[FILE], out["block"] = pdf[FILE].iloc[0], int(pdf["block"].iloc[0]) // CHAIN
            return out[[FILE, "block", "line_in", "line_out"]]
        return unite

    def descended(span: int):
        def descend(above: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            if not len(above) or not len(pdf):
                return pd.DataFrame(columns=[FILE, "block", "first"])
            found = pd.DataFrame(_Moves(pdf, size).path(int(above["first"].iloc[0]), span), columns=["block", "first"], dtype="int64")
            return found.assign(**{FILE: pdf[FILE].iloc[0]})[[FILE, "block", "first"]]
        return descend

    over = F.floor(F.col("block") / CHAIN)
    while most > 1:
        whole = levels[-1].groupBy(FILE, over.alias("_over")).applyInPandas(united(span), f"{FILE} string, block long, line_in long, line_out long")
        whole, most, span = cut_lineage(whole), -(-most // CHAIN), span * CHAIN
        reached = whole.select(FILE, F.col("line_out").alias("line_in")).distinct()
        is_start = (F.col("line_in") - 1) % size == 0
        levels.append(cut_lineage(whole.join(reached.withColumn("_reached", F.lit(True)), [FILE, "line_in"], "left").filter(is_start | F.col("_reached")).drop("_reached")))
    entries = levels.pop().groupBy(FILE, "block").agg(F.min("line_in").alias("first"))
    for level in reversed(levels):
        span //= CHAIN
        entries = cut_lineage(entries.withColumn("_over", F.col("block")).groupBy(FILE, "_over").cogroup(level.withColumn("_over", over).groupBy(FILE, "_over")).applyInPandas(
            descended(span), f"{FILE} string, block long, first long"))
    return entries.withColumnRenamed("block", "chunk")


def flood_blocks(df: DataFrame, window: int = 1000, threshold: float = 0.75, hot_rows: int | None = HOT_ROWS,
                 chunk_lines: int = 1_000_000) -> DataFrame:
    """(file, block_start, block_end, dominant) of every flood, in line numbers.

    The scan of a file is sequential by nature, so it is cut into chunks that are scanned
    in parallel once the entry line of each is known.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is a share of the window")
    size = max(chunk_lines, window)
    df = cut_lineage(df.select(FILE, LINE, TEMPLATE))
    sizes = cut_lineage(df.groupBy(FILE).agg(F.max(LINE).alias("_n")))
    longest, rows = sizes.agg(F.max("_n"), F.sum("_n")).first()
    if hot_rows is not None and (rows or 0) <= hot_rows:
        hot_rows = None
    starts = cut_lineage(flood_starts(df, window, threshold, hot_rows))
    pieces = cut_lineage(_pieces(starts, similar_runs(df, starts, hot_rows), window, size))
    if (longest or 0) <= size:
        entries = pieces.select(FILE, "chunk").distinct().withColumn("first", F.lit(1).cast("long"))
    else:
        entries = _entries(pieces, window, size)
    begin = entries.select(FILE, "chunk", F.lit("begin").alias("kind"), "first", F.lit(None).cast("long").alias("last"),
                           F.lit(None).cast("string").alias("dominant"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [FILE, "block_start", "block_end", "dominant"]
        entered = pdf.loc[pdf["kind"] == "begin", "first"]
        if not len(entered):
            return pd.DataFrame(columns=names)
        chunk, at, out = _Chunk(pdf, window), int(entered.iloc[0]), []
        while (flood := chunk.next_flood(at)) is not None:
            out.append((pdf[FILE].iloc[0], flood[0], flood[1] - 1, flood[2]))
            at = flood[1]
        return pd.DataFrame(out, columns=names)

    found_blocks = pieces.unionByName(begin).groupBy(FILE, "chunk").applyInPandas(
        scan, f"{FILE} string, block_start long, block_end long, dominant string")
    return found_blocks.join(sizes, FILE).withColumn("block_end", F.least("block_end", "_n")).drop("_n")


def mark_blocks(df: DataFrame, blocks: DataFrame, window: int = 1000) -> DataFrame:
    """Add ``block_start`` (null outside floods). A block covers at least a window, so a
    bucket of ``window`` lines meets few blocks; the join is on the bucket."""
    slot = blocks.withColumn("_slot", F.explode(F.sequence(
        F.floor(F.col("block_start") / window), F.floor(F.col("block_end") / window))))
    rows = df.withColumn("_slot", F.floor(F.col(LINE) / window)).alias("l")
    on = (
        (F.col(f"l.{FILE}") == F.col(f"r.{FILE}")) & (F.col("l._slot") == F.col("r._slot"))
        & F.col(f"l.{LINE}").between(F.col("r.block_start"), F.col("r.block_end"))
    )
    return rows.join(slot.alias("r"), on, "left").select(
        *[F.col(f"l.{c}") for c in df.columns], "r.block_start")


def flood_patterns(flooded: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per block: size, times, most common template, severity, differing words, components.

    Words and components are reduced to distinct values before they are listed.
    """
    key = key or [FILE, "block_start"]
    by_template = flooded.groupBy(*key, TEMPLATE).agg(F.count(F.lit(1)).alias("_n"))
    common = by_template.groupBy(*key).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col(TEMPLATE).alias("t"))).alias("_top"), F.sum("_n").alias("count")
    ).select(*key, F.col("_top.t").alias("template"), "count")
    x = F.lower("log")
    level = F.when(F.contains(x, F.lit("error")), 2).when(F.contains(x, F.lit("warn")), 1).otherwise(0)
    times = [F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")] if "ts" in flooded.columns else []
    first_line = [F.min_by(n, LINE).alias(n) for n in ("row_id", "ts_raw") if n in flooded.columns]
    facts = flooded.groupBy(*key).agg(F.max(level).alias("_level"), *times, *first_line)
    parts = flood_variable_parts(flooded, common, key)
    listed = parts.groupBy(*key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seen_line", "seen_word", "word"))), lambda r: r["word"]).alias("variable_parts"))
    named = (flooded.select(*key, found(F.col("log"), LEADING).alias("component")).filter("component IS NOT NULL").distinct()
             .groupBy(*key).agg(F.array_sort(F.collect_list("component")).alias("components")))
    none = F.array().cast("array<string>")
    return (
        common.join(facts, key).join(listed, key, "left").join(named, key, "left")
        .withColumns({
            "severity": F.when(F.col("_level") == 2, "error").when(F.col("_level") == 1, "warning").otherwise("unknown"),
            "variable_parts": F.coalesce("variable_parts", none),
            "components": F.coalesce("components", none),
        }).drop("_level")
    )


def flood_variable_parts(flooded: DataFrame, common: DataFrame, key: list[str]) -> DataFrame:
    """(block, word, where first seen): words at positions where a line of the same length differs from the template."""
    def differing() -> Column:
        return F.filter(
            F.zip_with(F.sequence(F.lit(0), F.size("_theirs") - 1), F.arrays_zip(F.col("_theirs").alias("t"), F.col("_mine").alias("m")),
                       lambda i, p: F.struct(i.alias("i"), p["t"], p["m"])),
            lambda r: r["t"] != r["m"])
    rows = (
        flooded.join(common.select(*key, "template"), key)
        .withColumns({"_theirs": words("template"), "_mine": words("log")})
        .filter((F.size("_theirs") == F.size("_mine")) & (F.size("_theirs") > 0))
        .select(*key, LINE, F.explode(differing()).alias("d"))
    )
    seen = rows.groupBy(*key, F.col("d.m").alias("word")).agg(F.min(F.struct(F.col(LINE).alias("l"), F.col("d.i").alias("i"))).alias("s"))
    return seen.select(*key, "word", F.col("s.l").alias("seen_line"), F.col("s.i").alias("seen_word"))


def collapse_floods(df: DataFrame, window: int = 1000, threshold: float = 0.75, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The log table with every flood replaced by one summary row."""
    marked = mark_blocks(df, flood_blocks(df, window, threshold, hot_rows), window)
    kept = marked.filter("block_start IS NULL").drop("block_start")
    info = F.struct("template", "variable_parts", "severity", "components")
    text = F.concat(F.lit(c.FLOOD_TEXT), F.col("template"))
    summary = flood_patterns(marked.filter("block_start IS NOT NULL")).select(
        FILE, F.col("block_start").alias(LINE),
        F.concat(F.lit(c.FLOOD_MARK), F.col("count").cast("string"), text).alias("log"),
        F.concat(F.lit(c.FLOOD_MARK + "<count>"), text).alias(TEMPLATE),
        (F.col("severity") == "error").cast("int").alias("is_anomaly"), F.lit("FLOOD").alias("anomaly_source"),
        F.lit(True).alias("is_flood"), F.col("count").alias("flood_count"), info.alias("flood_info"),
        *(["first_ts", "last_ts"] if "ts" in df.columns else []), *[n for n in ("row_id", "ts_raw") if n in df.columns],
    )
    if "ts" in df.columns:
        summary = summary.withColumn("ts", F.col("first_ts"))
    return kept.withColumn("is_flood", F.lit(False)).unionByName(summary, allowMissingColumns=True)
