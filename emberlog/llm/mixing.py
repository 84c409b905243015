"""Mixing sources to target weights.

Documents are aggregated by membership pattern (the sources they belong to). A min-cost flow over
patterns and sources routes words to the sources' quotas; each further copy of a pattern's words
costs more than the one before, so repetition is spread. A pattern's flow is so many whole copies
and a rest; the rest goes to documents in a seeded order. Only patterns and sources, never
documents, meet on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from emberlog.llm.inputs import prepare, spread
from emberlog.session import written

WORD = r"[^\x20\x09-\x0D]+"
MOST_PATTERNS = 20_000
BIN_BITS = 12


class Mix(NamedTuple):
    """``sources``: name, source_size, target. ``plan``: for each pattern, how many whole copies and which documents one more."""

    sources: list[tuple[str | None, int, float]]
    plan: DataFrame


def share_out(sizes: list[int], weights: list[float], limit: float) -> list[float]:
    """Targets by weight that share the total size; a target above ``limit`` times its size stops
    there, and the excess is shared again until none is above."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i]]
    while open_:
        rest = total - sum(targets[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        for i in open_:
            targets[i] = rest * weights[i] / weight if weight else 0.0
        above = [i for i in open_ if targets[i] > limit * sizes[i]]
        if not above:
            break
        for i in above:
            targets[i] = float(limit * sizes[i])
        open_ = [i for i in open_ if i not in above]
    return targets


def min_cost_flow(patterns: list[tuple[int, list[int]]], quotas: list[int], copies: int) -> list[int]:
    """Words to take of each pattern (size, its sources): as much of the quotas as can be met, at least cost.

    Copy c of a pattern's words costs c - 1 a word. Successive shortest paths with potentials.
    """
    start, end = 0, 1 + len(patterns) + len(quotas)
    arcs: list[list[int]] = []  # to, capacity left, cost; arc i ^ 1 leads back
    leaving: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            leaving[x].append(len(arcs))
            arcs.append([y, c, w])

    for p, (size, members) in enumerate(patterns):
        for copy in range(copies):
            arc(start, 1 + p, size, copy)
        for s in members:
            arc(1 + p, 1 + len(patterns) + s, size * copies, 0)
    for s, quota in enumerate(quotas):
        arc(1 + len(patterns) + s, end, quota, 0)
    potential = [0] * (end + 1)
    while True:
        distance: list[float] = [float("inf")] * (end + 1)
        by: list[int] = [-1] * (end + 1)
        distance[start], queue = 0, [(0, start)]
        while queue:
            d, node = heappop(queue)
            if d > distance[node]:
                continue
            for i in leaving[node]:
                to, left, cost = arcs[i]
                if left and d + cost + potential[node] - potential[to] < distance[to]:
                    distance[to], by[to] = d + cost + potential[node] - potential[to], i
                    heappush(queue, (distance[to], to))
        if by[end] < 0:
            break
        potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, distance)]
        path, node = [], end
        while node != start:
            path.append(by[node])
            node = arcs[by[node] ^ 1][0]
        amount = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= amount
            arcs[i ^ 1][1] += amount
    taken = [0] * len(patterns)
    for i in leaving[start]:
        taken[arcs[i][0] - 1] += arcs[i ^ 1][1]
    return taken


def described(docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: int, keep: list[str]) -> DataFrame:
    """Per row: ``_row`` (the columns of ``keep``), ``_sources`` (its pattern), ``_size`` in words, ``_order`` (a seeded 24-bit number)."""
    source = F.col(source_column)
    if isinstance(docs.schema[source_column].dataType, T.ArrayType):
        pattern = F.sort_array(F.array_distinct(source))
        source = F.when(F.size(F.coalesce(pattern, F.array())) > 0, pattern).otherwise(F.array(F.lit(None).cast("string")))
    else:
        source = F.array(source.cast("string"))
    size = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_column), size), 64 - 2 * BIN_BITS)
    kept = F.struct(*("`" + c.replace("`", "``") + "`" for c in keep))
    return docs.select(kept.alias("_row"), source.alias("_sources"), size.alias("_size"), order.alias("_order"))


def _cut(bins: DataFrame, rest: str) -> DataFrame:
    """Per pattern the bin in which the running sum of sizes passes ``rest``, and the sum before it."""
    running = Window.partitionBy("_sources").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = bins.withColumn("upto", F.sum("size").over(running)).filter(F.col("upto") > F.col(rest))
    return summed.groupBy("_sources").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("before"), "size")).alias("cut"))


def mix_plan(rows: DataFrame, weights: Callable[[list], list[float]], limit: int = 3) -> Mix:
    """The plan for ``described`` rows. ``weights`` gets the sources' names, by code point, null last."""
    spark = rows.sparkSession
    found = rows.groupBy("_sources").agg(F.sum("_size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} combinations of sources: sources are those of a configuration, not of single documents")
    sums = [(tuple(r["_sources"]), r["size"]) for r in found]
    names = sorted({s for pattern, _ in sums for s in pattern}, key=lambda s: (s is None, s or ""))
    at = {name: i for i, name in enumerate(names)}
    sizes = [sum(size for pattern, size in sums if name in pattern) for name in names]
    total = sum(size for _, size in sums)
    shared = share_out(sizes, [float(w) for w in weights(names)], limit)
    scale = total / sum(sizes) if sum(sizes) else 0.0  # documents in several sources count once in what is shared
    targets = shared if scale == 1.0 else [t * scale for t in shared]
    taken = min_cost_flow([(size, [at[s] for s in pattern]) for pattern, size in sums], [round(t) for t in targets], limit)
    flows = spark.createDataFrame([(list(pattern), *(divmod(flow, size) if size else (0, 0))) for (pattern, size), flow in zip(sums, taken)],
                                  "_sources array<string>, copies long, rest long")
    coarse, fine = F.shiftright("_order", BIN_BITS), F.col("_order").bitwiseAND((1 << BIN_BITS) - 1)
    bins = rows.groupBy("_sources", coarse.alias("bin")).agg(F.sum("_size").alias("size")).join(F.broadcast(flows), "_sources")
    first = flows.join(_cut(bins, "rest"), "_sources", "left").select("_sources", "copies", F.coalesce("cut.bin", F.lit(0)).alias("coarse"),
                                                                     (F.col("rest") - F.coalesce("cut.before", F.lit(0))).alias("rest"))
    first = written(first)
    inside = rows.join(F.broadcast(first), "_sources").filter(coarse == F.col("coarse"))
    bins = inside.groupBy("_sources", "rest", fine.alias("bin")).agg(F.sum("_size").alias("size"))
    nearest = F.when(2 * (F.col("rest") - F.col("cut.before")) >= F.col("cut.size"), F.col("cut.bin") + 1).otherwise(F.col("cut.bin"))
    second = first.join(_cut(bins, "rest"), "_sources", "left").select(
        "_sources", "copies", (F.shiftleft("coarse", BIN_BITS) + F.when(F.col("rest") > 0, F.coalesce(nearest, F.lit(0))).otherwise(0)).alias("below"))
    return Mix(list(zip(names, sizes, targets)), written(second))


def with_copies(rows: DataFrame, mix: Mix) -> DataFrame:
    """``described`` rows with ``copies``: how often the mix takes each. The plan has a row a pattern."""
    return rows.join(F.broadcast(mix.plan), "_sources", "left").withColumn("copies", F.col("copies") + (F.col("_order") < F.col("below")).cast("long"))


def mix_sources(docs: DataFrame, weights: Callable[[list], list[float]], id_column: str = "doc_id", text_column: str = "text",
                source_column: str = "source", limit: int = 3, seed: int = 42) -> tuple[Mix, DataFrame]:
    """The mix, and per row of ``docs``: the identifier, ``sources`` (its pattern), ``size`` in words, ``taken`` (words
    the mix takes, repeats counted), ``copies``.

    ``source_column`` holds a source or an array of them; null (or an empty array) is a source of its own, last. Targets
    share the size of all documents by weight; no target exceeds ``limit`` times its source's size and no row is taken more
    than ``limit`` times. A null text has size 0. The order in which documents get a further copy depends on the identifier, the
    size and ``seed`` only, so reruns agree and repeated rows are taken alike. An empty table gives no rows.

    Patterns and sources are counted on the driver and sent to the tasks: more than ``MOST_PATTERNS`` are an error.
    """
    prepare(docs.sparkSession)
    rows = written(described(spread(docs.select(id_column, text_column, source_column)), id_column, text_column, source_column, seed, [id_column]))
    mix = mix_plan(rows, weights, limit)
    return mix, with_copies(rows, mix).select(f"_row.`{id_column}`", F.col("_sources").alias("sources"), F.col("_size").alias("size"), (F.col("_size") * F.col("copies")).alias("taken"), "copies")


def repeated(docs: DataFrame, weights: Callable[[list], list[float]], id_column: str = "doc_id", text_column: str = "text",
             source_column: str = "source", limit: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once, or several times, in all their columns."""
    prepare(docs.sparkSession)
    columns = docs.columns
    rows = described(spread(docs), id_column, text_column, source_column, seed, columns)
    mix = mix_plan(written(rows.select("_sources", "_size", "_order")), weights, limit)
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.array().cast("array<bigint>"))
    return with_copies(rows, mix).withColumn("_copy", F.explode(times)).select("_row.*")
