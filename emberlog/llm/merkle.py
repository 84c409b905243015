"""Merkle manifest of a table: every row a leaf, one tree a group, and a tree over the groups.

The nodes of a tree stand in a postorder append log: a node is written when its last child is done. A node's place in
it needs no pointer: before leaf ``j`` (from 0) stand ``2j - popcount(j)`` nodes, and the node at level ``k`` stands ``k``
places behind the last leaf below it. So the siblings on the way from a leaf to the root are read by computed positions.

A tree is built by aligned builders. One takes ``2 ** BITS`` neighbouring nodes, starting at a multiple of that, writes all
nodes above them in the order of their completion and hands one node to the next round. Each round has ``2 ** BITS``
times fewer nodes; proofs are read from the last round down, and what stands above a builder is read once for all below it.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.inputs import placed, prepare, spread, tidied
from emberlog.session import scratch_path, written

BITS = 9
LOG = "tree string, block long, position long, level int, digest binary, n long"
STEP = "struct<side:string,digest:string>"
TOP = "top"


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256, lowercase hex, of the values in turn: ``-`` for a null, else UTF-8 byte count, a colon and the value as text."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the steps of ``proof`` lead to: a step hashes the digest so far with its sibling, or alone."""
    def step(so_far, s):
        left = F.when(s["side"] == "left", s["digest"]).otherwise(F.lit(""))
        right = F.when(s["side"] == "right", s["digest"]).otherwise(F.lit(""))
        return F.sha2(F.concat(left, so_far, right), 256)
    return F.aggregate(proof, leaf, step)


def sibling_digests(proof: Column) -> Column:
    """The sibling digests of a proof, concatenated; steps without a sibling add nothing."""
    return F.array_join(F.transform(F.filter(proof, lambda s: s["side"] != "none"), lambda s: s["digest"]), "")


def position(last_leaf, level):
    """Place in the postorder log of the node at ``level`` whose last leaf is ``last_leaf``."""
    last = np.asarray(last_leaf, np.int64)
    return 2 * last - np.bitwise_count(last.view(np.uint64)).astype(np.int64) + level


def node_position(index, level: int, leaves: int):
    """Place of node ``index`` (from 0) of ``level`` in the log of a tree of ``leaves`` leaves."""
    return position(np.minimum((np.asarray(index, np.int64) + 1 << level) - 1, leaves - 1), level)


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def build(first: int, digests: list[str], level: int, leaves: int, bits: int = BITS):
    """(nodes, digest handed on): an aligned builder's nodes (level, index, digest) in the order of completion.

    ``digests``: the nodes of ``level`` from number ``first`` on, at most ``2 ** bits``.
    """
    top = min(bits, max(0, height(leaves) - level))
    last = (leaves - 1 >> level) if leaves else 0
    waiting: list[list[str]] = [[] for _ in range(top + 1)]
    nodes = []
    for i, digest in enumerate(digests, first):
        if not level:
            nodes.append((0, i, digest))
        waiting[0].append(digest)
        for k in range(top):
            if len(waiting[k]) < 2 and not (i == last and waiting[k]):
                break
            digest = sha256("".join(waiting[k]).encode()).hexdigest()
            waiting[k] = []
            waiting[k + 1].append(digest)
            nodes.append((level + k + 1, i >> k + 1, digest))
    return nodes, waiting[top][0]


def _rounds(nodes: DataFrame, bits: int) -> int:
    most = nodes.agg(F.max("n")).first()[0] or 1
    return max(1, -(-height(most) // bits))


def _builder(r: int, bits: int):
    """One aligned block of the nodes of round ``r`` in, its log out; the node handed on has level and position -1."""
    def write(table):
        order = np.argsort(table.column("number").to_numpy())
        number, digests = table.column("number").to_numpy()[order], table.column("digest").take(pa.array(order)).to_pylist()
        tree, leaves = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        made, up = build(int(number[0]), digests, r * bits, leaves, bits)
        block = int(number[0]) >> bits
        place = [int(node_position(i, k, leaves)) for k, i, _ in made] + [-1]
        made.append((-1, block, up))
        size = len(made)
        return pa.table({"tree": pa.array([tree] * size), "block": pa.array([block] * size, pa.int64()),
                         "position": pa.array(place, pa.int64()), "level": pa.array([m[0] for m in made], pa.int32()),
                         "digest": pa.array([bytes.fromhex(m[2]) for m in made], pa.binary()), "n": pa.array([leaves] * size, pa.int64())})
    return write


def append_log(nodes: DataFrame, path: str, bits: int = BITS) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes entering each round, log of each round) of trees whose leaves are ``nodes`` (tree, number, n, digest in hex).

    The builders write their parts of the log below ``path``, a folder a round; what they hand on stands there at level -1.
    """
    entering, logs = [nodes.select("tree", "number", "n", "digest")], []
    for r in range(_rounds(nodes, bits)):
        rows = entering[-1].withColumn("block", F.shiftright("number", bits))
        segments = rows.groupBy("tree", "block").applyInArrow(_builder(r, bits), LOG)
        segments.write.parquet(f"{path}/round={r}")
        segments = nodes.sparkSession.read.schema(segments.schema).parquet(f"{path}/round={r}")
        logs.append(segments.filter("level >= 0"))
        entering.append(segments.filter("level < 0").select("tree", F.col("block").alias("number"), "n", F.lower(F.hex("digest")).alias("digest")))
    return entering, logs


def proofs(nodes: DataFrame, log: DataFrame, above: DataFrame, level: int, bits: int = BITS, carry: list[str] = []) -> DataFrame:
    """``nodes`` (tree, number, n, digest, ``carry``) of one round with ``proof``, ``subroot`` and ``root``: the steps up to the end.

    ``above``: (tree, number, proof, subroot, root) of the nodes that this round's builders handed on.
    """
    kind = nodes.select("tree", "number", "n", "digest", *carry)
    source = kind.withColumn("block", F.shiftright("number", bits))
    read = log.select("tree", "block", "position", "digest", F.lit(None).cast(f"array<{STEP}>").alias("proof"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    read = read.unionByName(above.select("tree", F.col("number").alias("block"), F.lit(-1).cast("long").alias("position"), F.lit(None).cast("binary").alias("digest"), "proof", "subroot", "root"))
    step = pa.list_(pa.struct([("side", pa.string()), ("digest", pa.string())]))

    def collect(left, right):
        if not len(left):
            return _with(left.drop_columns(["block"]), [], [], [], step)
        place = right.column("position").to_numpy()
        top = int(np.flatnonzero(place < 0)[0])
        rest = right.column("proof")[top].as_py()
        ends = [right.column(c)[top].as_py() for c in ("subroot", "root")]
        leaves, number = left.column("n")[0].as_py(), left.column("number").to_numpy()
        known = dict(zip(place.tolist(), right.column("digest").to_pylist()))
        known.update(zip(node_position(number, level, leaves).tolist(), (bytes.fromhex(d) for d in left.column("digest").to_pylist())))
        here = min(bits, max(0, height(leaves) - level))
        steps: list[list] = [[] for _ in range(len(left))]
        for k in range(here):
            at = number >> k
            beside = at ^ 1
            exists = beside <= (leaves - 1 >> level + k)
            where = node_position(beside, level + k, leaves)
            for i, (ok, side, w) in enumerate(zip(exists.tolist(), (at & 1).tolist(), where.tolist())):
                steps[i].append({"side": "left" if side else "right", "digest": known[w].hex()} if ok else {"side": "none", "digest": ""})
        return _with(left.drop_columns(["block"]), [s + rest for s in steps], *([e] * len(steps) for e in ends), step)

    by = ["tree", "block"]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.schema.fields)
    return source.groupBy(*by).cogroup(read.groupBy(*by)).applyInArrow(collect, f"{names}, proof array<{STEP}>, subroot string, root string")


def _with(table, proof, subroot, root, step):
    return table.append_column("proof", pa.array(proof, step)).append_column("subroot", pa.array(subroot, pa.string())).append_column("root", pa.array(root, pa.string()))


def merkle_manifest(docs: DataFrame, leaf: Column, tree: Column, order: Column, carry: dict[str, Column] | None = None,
                    log_path: str | None = None, bits: int = BITS) -> DataFrame:
    """Per row of ``docs``: ``carry``'s columns, ``leaf``, ``subroot``, ``root`` and ``proof`` (array of side, digest: from the leaf's
    sibling up to the root; side ``none`` where a node is hashed alone).

    ``leaf``: 64 hex digits. Rows of the same ``tree`` (as text, null first) form one tree, ascending by ``order`` (null first, ties
    by leaf; rows alike in both are interchangeable). Two consecutive nodes, or a last one alone, become the SHA-256 of their
    concatenated hex digits until one node remains, the subroot; the subroots, in the order of the trees, become the root likewise.
    The log is kept below ``log_path`` (Parquet, ``groups`` and ``top``: tree, round, block, position, level, digest; see ``append_log``). Only the leaf,
    not the row, is shuffled. Repeated rows are leaves of their own; an empty table gives no rows and an empty log.
    """
    spark = docs.sparkSession
    prepare(spark)
    carry = carry or {}
    names = {f"c{i}": c for i, c in enumerate(carry.values())}
    key = F.coalesce(F.concat(F.lit("v"), tree.cast("string")), F.lit("n"))
    rows = spread(docs.select(key.alias("tree"), order.alias("by"), leaf.alias("digest"), *(c.alias(n) for n, c in names.items())))
    leaves = placed(written(rows), "tree", ["by", "digest"]).drop("by")
    path = log_path or scratch_path(spark, "merkle")

    entering, logs = append_log(leaves, f"{path}/groups", bits)
    subroots = written(entering[-1].select("tree", "digest"))
    groups = placed(subroots.select(F.lit(TOP).alias("all"), F.col("tree").alias("group"), "digest"), "all", ["group"])
    groups = groups.select(F.col("all").alias("tree"), "number", "n", "digest", "group")
    over, over_logs = append_log(groups, f"{path}/top", bits)
    nothing = F.array().cast(f"array<{STEP}>")
    above = over[-1].select("tree", "number", nothing.alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for r in reversed(range(len(over_logs))):
        nodes = groups if r == 0 else over[r]
        above = proofs(nodes, over_logs[r], above, r * bits, bits, ["group"] if r == 0 else [])
    above = above.select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("number"), "proof", F.col("digest").alias("subroot"), "root")
    above = written(above)
    for r in reversed(range(1, len(logs))):
        above = written(proofs(entering[r], logs[r], above, r * bits, bits))
    out = proofs(leaves, logs[0], above, 0, bits, list(names))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, carry)), F.col("digest").alias("leaf"), "subroot", "root", "proof")

