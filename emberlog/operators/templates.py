"""Message templates by prefix-tree clustering (Drain, ICWS 2017) over distinct lines.

Log lines repeat heavily, so lines are masked and counted first; only distinct masked lines are
clustered. The tree's leaves (number of tokens and first tokens) are independent of each other and
are spread over the cluster. Within a leaf lines are followed in the order in which they were first seen, as
a stream: a task holds the leaf's clusters, never its lines. So the templates depend on the lines
and their order alone, not on partitions or on the size of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import line_signature
from emberlog.session import written

WILD = "<*>"


def masked_text(log: Column, extra_delimiters: Iterable[str] = ()) -> Column:
    """Tokens of a line joined by blanks; a token with a digit is a wildcard from the start."""
    text = log
    for mark in extra_delimiters:
        text = F.replace(text, F.lit(mark), F.lit(" "))
    single = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(single, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", WILD)


class _Leaf:
    """The clusters of one tree leaf: one row of token numbers each; ``OPEN`` is a wildcard.

    ``holders`` is an inverted index: which clusters have a token at a place. A cluster with enough equal tokens has at
    least one of any ``fixed - need + 1`` fixed tokens of the line, so only the holders of its rarest ones are looked at.
    """

    OPEN, STRANGE = 0, -1

    def __init__(self, tokens: int, similarity: float):
        self.numbers, self.used = {WILD: self.OPEN}, 0
        self.known = np.zeros((4, tokens), np.int32)
        self.open = np.zeros(4, np.int32)
        self.holders: dict[tuple[int, int], list[int]] = {}
        self.need = next(n for n in range(tokens + 2) if n / tokens >= similarity or n > tokens)

    def _candidates(self, row: list[int]) -> np.ndarray | slice:
        """The clusters that may have ``need`` equal tokens, oldest first; all of them if that is hardly fewer."""
        held = sorted((self.holders.get((i, n), ()) for i, n in enumerate(row) if n != self.OPEN), key=len)
        if self.need < 1:
            return slice(self.used)
        rare = held[:max(len(held) - self.need + 1, 0)]
        if 2 * sum(map(len, rare)) > self.used:
            return slice(self.used)
        return np.array(sorted(set().union(*rare)), np.int64)

    def add(self, tokens: list[str]) -> int:
        """Number of the cluster that takes the line: the one with the most equal fixed tokens, if these are
        enough; of several the one with more wildcards, then the older. Tokens that differ become wildcards."""
        numbers = [self.numbers.get(t, self.STRANGE) for t in tokens]
        some = self._candidates(numbers)
        known = self.known[some]
        if len(known):
            row = np.array(numbers, np.int32)
            equal = np.count_nonzero((known == row) & (row != self.OPEN), axis=1)
            at = int(np.argmax(equal * (len(tokens) + 1) + self.open[some]))
            if equal[at] >= self.need:
                best = at if isinstance(some, slice) else int(some[at])
                mine = self.known[best]
                for i in np.flatnonzero((mine != row) & (mine != self.OPEN)).tolist():
                    self.holders[i, int(mine[i])].remove(best)
                    mine[i] = self.OPEN
                    self.open[best] += 1
                return best
        if self.used == len(self.known):
            self.known, self.open = np.concatenate([self.known, np.zeros_like(self.known)]), np.concatenate([self.open, np.zeros_like(self.open)])
        new = [self.numbers.setdefault(t, len(self.numbers)) for t in tokens]
        self.known[self.used] = new
        self.open[self.used] = new.count(self.OPEN)
        for i, n in enumerate(new):
            if n != self.OPEN:
                self.holders.setdefault((i, n), []).append(self.used)
        self.used += 1
        return self.used - 1

    def templates(self) -> list[str]:
        text = list(self.numbers)
        return [" ".join(text[n] for n in row) for row in self.known[:self.used].tolist()]


def learn_templates(df: DataFrame, scope: list[str], depth: int = 3, similarity: float = 0.5,
                    extra_delimiters: Iterable[str] = (), log: str = "log", order: str = "row_id") -> DataFrame:
    """(scope, text, template): the final template of every distinct masked line."""
    lines = df.select(*scope, masked_text(F.col(log), extra_delimiters).alias("text"), F.col(order).alias("first_seen"))
    entries = lines.filter(F.col("text") != "").groupBy(*scope, "text").agg(F.min("first_seen").alias("first_seen"))
    split = F.split("text", " ")
    leaf = F.concat_ws(" ", F.size(split).cast("string"), F.slice(split, 1, max(depth - 2, 1)))
    laid = entries.withColumn("leaf", leaf).repartition(*scope, "leaf").sortWithinPartitions(*scope, "leaf", "first_seen", "text")
    key = [*scope, "leaf"]

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, clusters, done = None, None, []

        def close() -> None:
            if clusters is not None:
                done.extend([*now, None, n, t] for n, t in enumerate(clusters.templates()))

        def finished() -> pd.DataFrame:
            rows = pd.DataFrame(done, columns=[*key, "text", "cluster", "template"])
            done.clear()
            return rows

        for pdf in batches:
            numbers = []
            keys = list(zip(*(pdf[c].tolist() for c in key)))
            for at, text in zip(keys, pdf["text"].tolist()):
                tokens = text.split(" ")
                if at != now:
                    close()
                    now, clusters = at, _Leaf(len(tokens), similarity)
                numbers.append(clusters.add(tokens))
            yield pdf[[*key, "text"]].assign(cluster=numbers, template=None)
            if done:
                yield finished()
        close()
        if done:
            yield finished()

    fields = ", ".join([f"`{n}` {laid.schema[n].dataType.simpleString()}" for n in [*key, "text"]] + ["cluster long", "template string"])
    found = written(laid.mapInPandas(follow, fields))
    named = found.filter("text IS NULL").drop("text")
    return found.filter("text IS NOT NULL").drop("template").join(named, [*key, "cluster"]).select(*scope, "text", "template")


def mine_templates(df: DataFrame, light: bool = True, scope: list[str] | None = None,
                   depth: int | None = None, similarity: float | None = None,
                   extra_delimiters: Iterable[str] = (), log: str = "log", order: str = "row_id") -> DataFrame:
    """Add ``log_template`` ("Unknown" for an empty line) and ``template_id``.

    Every row gets the final template of its cluster. Light mode is depth 3 with
    similarity 0.5, otherwise depth 4 with 0.4; both can be given.
    """
    scope = ["source_file"] if scope is None else scope
    depth = depth or (3 if light else 4)
    similarity = similarity if similarity is not None else (0.5 if light else 0.4)
    learned = learn_templates(df, scope, depth, similarity, extra_delimiters, log, order)
    rows = df.withColumn("text", masked_text(F.col(log), extra_delimiters))
    return (
        rows.join(learned, [*scope, "text"], "left")
        .withColumn("log_template", F.coalesce("template", F.lit("Unknown")))
        .withColumn("template_id", F.xxhash64("log_template"))
        .drop("text", "template")
    )


def mine_templates_variant(df: DataFrame, max_dist: float = 0.6, extra_delimiters: Iterable[str] = (),
                           scope: list[str] | None = None, **kwargs) -> DataFrame:
    """Same miner set by distance instead of similarity.

    There is no limit on the number of clusters: such a limit bounds the memory
    of a single process by forgetting clusters, which is not needed here.
    """
    return mine_templates(df, scope=scope, depth=4, similarity=1.0 - max_dist, extra_delimiters=extra_delimiters, **kwargs)


def signature_templates(df: DataFrame, log: str = "log") -> DataFrame:
    """The cheap template: a pure column expression, no clustering."""
    return df.withColumn("log_template", line_signature(log))


def template_groups(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Template to its lines, as rows: (scope, template, row_id, log).

    Kept as rows because one template may own a third of all lines.
    """
    return df.select(*(scope or ["source_file"]), F.col("log_template").alias("template"), "row_id", "log")


def template_stats(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(scope or ["source_file"]), F.col("log_template").alias("template")).agg(
        F.count(F.lit(1)).alias("count"))
