"""Connected components of a link table, by contraction.

In a round every node points at its smallest neighbour if that is smaller; chains of pointers are
shortened to their roots, and the links are drawn between the roots. The link table shrinks every
round; a node's component is the chain of its roots. Nothing is collected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.inputs import join_hot
from emberlog.session import written


def join_split(rows: DataFrame, table: DataFrame, key: str, salt_from=None) -> DataFrame:
    """``rows`` left-joined to ``table`` (one row a key); a hot key's partition is split by the adaptive plan. Fewer shuffles than ``join_hot``."""
    return rows.join(table, key, "left")


def _roots(pointers: DataFrame, join) -> DataFrame:
    """(node, to) with every chain node -> to -> ... replaced by its end; chains halve in each step."""
    while True:
        behind = pointers.select(F.col("node").alias("to"), F.col("to").alias("further"))
        stepped = written(join(pointers, behind, "to", F.col("node")))
        if stepped.filter(F.col("further").isNotNull()).isEmpty():
            return pointers
        pointers = stepped.select("node", F.coalesce("further", "to").alias("to"))


def _moved(rows: DataFrame, column: str, pointers: DataFrame, salt_from, join) -> DataFrame:
    """``rows`` with ``column`` replaced by the root its value points at."""
    to = pointers.select(F.col("node").alias(column), "to")
    return join(rows, to, column, salt_from).withColumn(column, F.coalesce("to", column)).drop("to")


LINKS_A_TASK = 50_000


def _forests(links: DataFrame, tasks: int) -> DataFrame:
    """(node, root): what the links of each of ``tasks`` tasks connect by themselves."""
    def connect(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = sorted(parent)
        for i in range(0, len(nodes), 10_000):
            some = nodes[i:i + 10_000]
            yield pa.RecordBatch.from_pydict({"node": pa.array(some, pa.int64()), "root": pa.array([root(x) for x in some], pa.int64())})

    return written(links.select("u", "v").repartition(tasks).mapInArrow(connect, "node long, root long"))


def grouped(links: DataFrame) -> DataFrame:
    """(node, root) as ``components``, of links (u, v) between numbers: tasks of ``LINKS_A_TASK`` links connect what they hold, then the
    trees of all tasks are contracted. Few links are one task's work."""
    tasks = -(-links.count() // LINKS_A_TASK)
    trees = _forests(links, max(tasks, 1))
    return trees if tasks <= 1 else components(trees.select(F.col("node").alias("u"), F.col("root").alias("v")), join_split)


def components(links: DataFrame, join=join_hot) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the smallest node of its component.

    ``join``: how a column that may hold one value in many rows is joined.
    Links may be repeated, in either direction, or join a node to itself. Null ends are dropped.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.col("u").isNotNull() & F.col("v").isNotNull())
    links = written(links.filter(links[2]).select("u", "v").distinct())
    nodes = written(links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct().withColumn("root", F.col("node")))
    links = links.filter("u <> v")
    while not links.isEmpty():
        pointers = written(_roots(written(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to"))), join))
        nodes = written(_moved(nodes, "root", pointers, F.col("node"), join))
        drawn = _moved(_moved(links, "u", pointers, F.col("v"), join), "v", pointers, F.col("u"), join)
        links = written(drawn.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return nodes
