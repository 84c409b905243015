"""Hard negatives: rows of other labels whose score with an anchor lies in a window below a positive's score.

All vectors are laid out along a Hilbert curve through the dimensions that vary most, label by label, and written as blocks
of neighbouring rows with a zone map: the smallest and largest value of every dimension. Interval arithmetic over a zone
map bounds the inner product of an anchor with every row of the block from below and above.

Anchors travel in tiles. A tile first reads the anchors' own blocks, which gives a score that the fifth positive must reach,
then those blocks only whose upper bound reaches it. The windows follow from the positives; a block is read for them if its
bounds meet a window above the third negative found so far in a few blocks of high bounds. Blocks that no bound rules out
are read: the result is exact. Vectors without structure leave little to rule out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from emberlog.llm.inputs import placed, prepare, spread, tidied
from emberlog.session import written

BLOCK_BITS = 9
TILE_BITS = 10
LANE = 16
CHUNK = 1024
CURVE_DIMS, CURVE_BITS = 8, 6
FIRST_BLOCKS = 4
NOTHING = np.iinfo(np.int64).min
EXACT = float(1 << 53)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on a Hilbert curve of cells (rows; unsigned coordinates below ``2 ** bits``), after Skilling (2004)."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    d, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, below = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(d):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        bit = one << np.uint64(b)
        flip = np.where((x[d - 1] & bit) != 0, flip ^ (bit - one), flip)
    place = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            place = place << one | ((x[i] ^ flip) >> np.uint64(b) & one)
    return place


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def packed(values: np.ndarray) -> bytes:
    """A matrix in the narrowest integers that hold it; the first byte is their width."""
    for kind in (np.int8, np.int16, np.int32):
        if not values.size or np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max:
            return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()
    return bytes([8]) + values.astype(np.int64).tobytes()


def unpacked(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, dims).astype(np.float64 if data[0] < 8 else np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; a product beyond 64 bits is an error."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * float(a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T).astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that the inner product of each anchor with a vector between ``low`` and ``high`` can be."""
    a, low, high = (x.astype(np.float64) for x in (a, low, high))
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = 1e-9 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T)
    slack[slack < 1e-2] = 0  # products of this size are exact
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def _spreads(vectors: DataFrame, dims: int) -> list:
    """Per dimension, by falling variance: (number, smallest, largest)."""
    def partial(batches):
        for batch in batches:
            m = _matrix(batch.column(0), dims).astype(np.float64)
            if len(m):
                yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dims), pa.int32()), "n": pa.array([float(len(m))] * dims), "s": pa.array(m.sum(0)),
                                                  "q": pa.array((m * m).sum(0)), "low": pa.array(m.min(0)), "high": pa.array(m.max(0))})

    found = vectors.select("vec").mapInArrow(tidied(partial), "dim int, n double, s double, q double, low double, high double")
    mean = F.sum("s") / F.sum("n")
    found = found.groupBy("dim").agg((F.sum("q") / F.sum("n") - mean * mean).alias("spread"), F.min("low").alias("low"), F.max("high").alias("high"))
    return [(r.dim, r.low, r.high) for r in sorted(found.collect(), key=lambda r: (-r.spread, r.dim))]  # one row a dimension


def along_curve(vectors: DataFrame, dims: int) -> DataFrame:
    """``vectors`` (vec, ...) with ``curve``: place on the Hilbert curve through the dimensions that vary most."""
    used = _spreads(vectors, dims)[:CURVE_DIMS]

    def add(batches):
        for batch in batches:
            m = _matrix(batch.column(batch.schema.get_field_index("vec")), dims).astype(np.float64)
            cells = np.zeros((len(m), max(1, len(used))), np.uint64)
            for i, (dim, low, high) in enumerate(used):
                cells[:, i] = np.clip((m[:, dim] - low) / max(high - low, 1) * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, CURVE_BITS).astype(np.int64))], names=[*batch.schema.names, "curve"])

    return vectors.mapInArrow(tidied(add), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", curve long")


BLOCK = "block long, ids array<long>, labels array<long>, vec binary, low binary, high binary, least_label long, most_label long"


def blocks_of(rows: DataFrame, dims: int) -> DataFrame:
    """Blocks of ``2 ** BLOCK_BITS`` consecutive rows of ``rows`` (number, id, label, vec) with their zone maps, written.
    Within a block rows ascend by identifier, null last."""
    def pack(table):
        ids, labels, number = table.column("id").to_pylist(), table.column("label").to_numpy(), table.column("number").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, number[i])))
        m = _matrix(table.column("vec"), dims)[order]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "ids": pa.array([[ids[i] for i in order]], pa.list_(pa.int64())),
                         "labels": pa.array([labels[order].tolist()], pa.list_(pa.int64())), "vec": pa.array([packed(m)], pa.binary()),
                         "low": pa.array([packed(m.min(0)[None])], pa.binary()), "high": pa.array([packed(m.max(0)[None])], pa.binary()),
                         "least_label": pa.array([labels.min()], pa.int64()), "most_label": pa.array([labels.max()], pa.int64())})

    cut = rows.select(F.shiftright("number", BLOCK_BITS).alias("block"), "number", "id", "label", "vec")
    return written(cut.groupBy("block").applyInArrow(pack, BLOCK))


PAIR = "tile long, block long, who binary"


def wanted_blocks(anchors: DataFrame, zones: DataFrame, tiles: int, chunks: int, dims: int, same_label: bool, first: bool) -> DataFrame:
    """(tile, block, who): blocks that may hold a row of the (same or another) label in a range of scores of an anchor.

    ``anchors``: tile, at, label, vec, home, low array<long>, high array<long> (null: no end). ``who`` has a bit for each anchor (``at``).
    ``first``: only a few blocks of the highest bounds of every chunk of zone maps; else all but those. For the same label
    the home blocks are left out, and there are no first blocks.
    """
    def choose(left, right):
        if not len(left) or not len(right):
            return pa.table({"tile": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "who": pa.array([], pa.binary())})
        a, at = np.concatenate([unpacked(v, dims) for v in left.column("vec").to_pylist()]), left.column("at").to_numpy()
        label, home = left.column("label").to_numpy()[:, None], left.column("home").to_numpy()[:, None]
        zone_order = np.argsort(right.column("block").to_numpy())
        right = right.take(pa.array(zone_order))
        block, least, most = (right.column(c).to_numpy()[None, :] for c in ("block", "least_label", "most_label"))
        low, high = (np.concatenate([unpacked(v, dims) for v in right.column(c).to_pylist()]) for c in ("low", "high"))
        below, above = bounds(a, low, high)
        if same_label:
            fits = (least <= label) & (label <= most) & (block != home)
        else:
            fits = (least != label) | (most != label)
        meets = np.zeros_like(fits)
        for k, (lows, highs) in enumerate(zip(left.column("low").to_pylist(), left.column("high").to_pylist())):
            for lo, hi in zip(lows, highs):
                meets[k] |= (True if lo is None else above[k] >= lo) & (True if hi is None else below[k] <= hi)
        fits &= meets
        if not same_label:
            best = np.argsort(-above.mean(axis=0), kind="stable")[:FIRST_BLOCKS]
            chosen = np.zeros(fits.shape[1], bool)
            chosen[best] = True
            fits &= chosen[None, :] if first else ~chosen[None, :]
        some = np.flatnonzero(fits.any(axis=0))
        bits = np.zeros((len(some), 1 << TILE_BITS), np.uint8)
        bits[:, at] = fits[:, some].T
        tile = left.column("tile")[0].as_py()
        return pa.table({"tile": pa.array([tile] * len(some), pa.int64()), "block": pa.array(block[0, some], pa.int64()), "who": pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())})

    asking = anchors.select("tile", "at", "label", "vec", "home", "low", "high").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    offered = zones.withColumns({"tile": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))), "chunk": F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")})
    return asking.groupBy("tile", "chunk").cogroup(offered.groupBy("tile", "chunk")).applyInArrow(choose, PAIR)


def read_blocks(anchors: DataFrame, blocks: DataFrame, pairs: DataFrame, lanes: int, dims: int, same_label: bool, k: int) -> DataFrame:
    """(uid, place, score, id): for every anchor and each of its ranges (``place``) the first ``k`` rows of the blocks it reads, lane by lane.
    An anchor never finds itself."""
    arrow = pa.schema([("uid", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])

    def best(left, right):
        """Anchors of a tile, and the blocks of one lane that it reads."""
        if not len(left) or not len(right):
            return arrow.empty_table()
        order = np.argsort(left.column("at").to_numpy())
        left = left.take(pa.array(order))
        a, at = np.concatenate([unpacked(v, dims) for v in left.column("vec").to_pylist()]), left.column("at").to_numpy()
        label, uid, home, self_id = (left.column(c).to_numpy(zero_copy_only=False) for c in ("label", "uid", "home", "spot"))
        lows, highs = left.column("low").to_pylist(), left.column("high").to_pylist()
        places = max((len(x) for x in lows), default=0)
        low, high = np.full((len(a), places), 1, np.int64), np.full((len(a), places), 0, np.int64)
        for i, (lo, hi) in enumerate(zip(lows, highs)):
            low[i, :len(lo)] = [NOTHING + 1 if x is None else x for x in lo]
            high[i, :len(hi)] = [np.iinfo(np.int64).max if x is None else x for x in hi]
        got: list[list] = [[] for _ in range(len(a) * places)]
        for row in right.select(["block", "who", "ids", "labels", "vec"]).to_pylist():
            asks = np.flatnonzero(np.unpackbits(np.frombuffer(row["who"], np.uint8))[at])
            s = scores(a[asks], unpacked(row["vec"], dims))
            labels, ids = np.array(row["labels"], np.int64), row["ids"]
            same = label[asks][:, None] == labels[None, :]
            fits = same if same_label else ~same
            own = np.flatnonzero(home[asks] == row["block"])
            fits[own, self_id[asks[own]]] = False
            for p in range(places):
                inside = np.where(fits & (s >= low[asks, p][:, None]) & (s <= high[asks, p][:, None]), s, NOTHING)
                rows = np.arange(len(asks))
                for _ in range(k):
                    if not len(rows):
                        break
                    col = np.argmax(inside[rows], axis=1)
                    top = inside[rows, col]
                    rows, col, top = rows[top > NOTHING], col[top > NOTHING], top[top > NOTHING]
                    for r, c, t in zip(rows.tolist(), col.tolist(), top.tolist()):
                        got[int(asks[r]) * places + p].append((-t, ids[c] is None, ids[c] or 0))
                    inside[rows, col] = NOTHING
        out = [(int(uid[i // places]), i % places, -t, None if none else ident) for i, found in enumerate(got) for t, none, ident in sorted(found)[:k]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow) if out else arrow.empty_table()

    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
    given = pairs.join(blocks.select("block", "ids", "labels", "vec"), "block").withColumn("lane", lane)
    asking = anchors.select("tile", "at", "uid", "label", "vec", "home", "spot", "low", "high").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return asking.groupBy("tile", "lane").cogroup(given.groupBy("tile", "lane")).applyInArrow(best, "uid long, place int, score long, id long")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, id_column: str, label: Column, vector: Column, asks: Column, positives: int = 5, negatives: int = 3,
                   least_share: int = 50, most_share: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label``: whole numbers; ``vector``: array<bigint>; rows with a null label, vector or component take no part. Anchors are the rows
    where ``asks`` holds. A row's score is its inner product with the anchor, exactly; a score beyond 64 bits is an error; vectors of
    unequal length are filled up with zeros. An anchor's positives are the first ``positives`` other rows of its label, by falling
    score, then identifier (null last). For each the first ``negatives`` rows of other labels are returned whose score, times 100, is
    between ``least_share`` and ``most_share`` times the positive's. Repeated rows are rows of their own: they find each other, and
    ask and answer each for itself. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = spread(vectors.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks")))
    rows = rows.filter("label IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL)").withColumn("row", F.monotonically_increasing_id())
    dims = max(1, rows.agg(F.max(F.size("vec"))).first()[0] or 0)
    laid = placed(along_curve(rows, dims).withColumn("all", F.lit(0)), "all", ["label", "curve", "row"])
    blocks = blocks_of(laid, dims)
    zones = blocks.select("block", "low", "high", "least_label", "most_label")
    size = zones.count()
    chunks, lanes = max(1, -(-size // CHUNK)), max(1, -(-size // LANE))

    within = Window.partitionBy(F.shiftright("number", BLOCK_BITS)).orderBy(F.asc_nulls_last("id"), F.col("number"))
    spots = laid.withColumn("spot", F.row_number().over(within) - 1).filter("asks").select(
        F.col("number").alias("uid"), F.col("id").alias("anchor_id"), "label", "spot", F.shiftright("number", BLOCK_BITS).alias("home"), "vec")

    def pack(batches):
        for batch in batches:
            m = _matrix(batch.column(batch.schema.get_field_index("vec")), dims)
            columns = [pa.array([packed(v[None]) for v in m], pa.binary()) if n == "vec" else batch.column(i) for i, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    some = spots.mapInArrow(tidied(pack), "uid long, anchor_id long, label long, spot int, home long, vec binary")
    some = placed(some.withColumn("all", F.lit(0)), "all", ["uid"])
    anchors = written(some.select("uid", "anchor_id", "label", "spot", "home", "vec", F.shiftright("number", TILE_BITS).alias("tile"), F.col("number").bitwiseAND((1 << TILE_BITS) - 1).cast("int").alias("at")))
    tiles = (anchors.agg(F.max("tile")).first()[0] or 0) + 1

    open_end = F.array(F.lit(None).cast("long"))
    bit = F.expr(f"unhex(concat(repeat('00', at div 8), lpad(hex(shiftright(128, at % 8)), 2, '0'), repeat('00', {(1 << TILE_BITS) // 8 - 1} - at div 8)))")
    own = anchors.withColumns({"low": open_end, "high": open_end})
    at_home = own.select("tile", F.col("home").alias("block"), bit.alias("who"))
    near = written(_first(read_blocks(own, blocks, _united(at_home), lanes, dims, True, positives), ["uid"], positives).select("uid", "place", "score", "id"))
    reach = near.groupBy("uid").agg(F.when(F.count("*") >= positives, F.min("score")).alias("reach"))
    own = written(anchors.join(reach, "uid", "left").withColumns({"low": F.array("reach"), "high": open_end}))
    far = read_blocks(own, blocks, wanted_blocks(own, zones, tiles, chunks, dims, True, False), lanes, dims, True, positives)
    found = written(_first(near.unionByName(far), ["uid"], positives).select("uid", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    ranges = found.withColumns({"low": _quotient(F.col("positive_score"), least_share, True), "high": _quotient(F.col("positive_score"), most_share, False)})
    of_anchor = ranges.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("r"))
    windows = written(anchors.join(of_anchor.select("uid", F.col("r.low").alias("low"), F.col("r.high").alias("high")), "uid"))
    early = written(_first(read_blocks(windows, blocks, wanted_blocks(windows, zones, tiles, chunks, dims, False, True), lanes, dims, False, negatives), ["uid", "place"], negatives).drop("rank"))
    full = early.groupBy("uid", "place").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("reach"))
    raised = ranges.join(full.select("uid", (F.col("place") + 1).alias("rank"), "reach"), ["uid", "rank"], "left").withColumn("low", F.greatest("low", "reach"))
    of_anchor = raised.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("r"))
    windows = written(anchors.join(of_anchor.select("uid", F.col("r.low").alias("low"), F.col("r.high").alias("high")), "uid"))
    late = read_blocks(windows, blocks, wanted_blocks(windows, zones, tiles, chunks, dims, False, False), lanes, dims, False, negatives)
    chosen = _first(early.unionByName(late), ["uid", "place"], negatives).select("uid", (F.col("place") + 1).alias("of"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = chosen.join(found.select("uid", F.col("rank").alias("of"), "positive_id", "positive_score"), ["uid", "of"]).join(anchors.select("uid", "anchor_id"), "uid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _quotient(score: Column, share: int, up: bool) -> Column:
    """``score * share / 100`` rounded up or down, in whole numbers."""
    product = score.cast("decimal(38,0)") * F.lit(share)
    rest = F.pmod(product, F.lit(100).cast("decimal(38,0)"))
    down = ((product - rest) / F.lit(100)).cast("long")
    return down + F.when(rest > 0, 1).otherwise(0) if up else down


def _united(pairs: DataFrame) -> DataFrame:
    """One row a (tile, block): the bits of all its rows."""
    def unite(table):
        bits = np.bitwise_or.reduce([np.frombuffer(w, np.uint8) for w in table.column("who").to_pylist()])
        return pa.table({"tile": table.column("tile").slice(0, 1), "block": table.column("block").slice(0, 1), "who": pa.array([bits.tobytes()], pa.binary())})
    return pairs.groupBy("tile", "block").applyInArrow(unite, PAIR)
