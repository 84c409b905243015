"""Runs of documents, and which of their hashes occur in more than one run.

The table is cut into runs of neighbouring rows, once, and written, so that every later step sees
the same runs. A step computes 64-bit hashes for a run, keeps the different ones sorted and sends
them, delta-coded, to buckets of the hash range. A bucket compares the runs' lists and tells every
run which of its hashes other runs have too. A hash that a million documents share is one entry of
each run, so no bucket is hot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.inputs import prepare, spread, width
from emberlog.session import scratch_path

RUN_BITS = 10
BUCKET_HASHES = 2_000_000
ODD = 0x9E3779B97F4A7C15
HASHES = "bucket int, run long, hashes binary"


def numbered(docs: DataFrame, id_column: str, text_column: str, run_bits: int = RUN_BITS) -> DataFrame:
    """(id, text, tag, run) of every row, written: ``tag`` numbers the rows, a run has at most ``2 ** run_bits`` of them."""
    spark = docs.sparkSession
    prepare(spark)
    rows = spread(docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")))
    rows = rows.withColumn("tag", F.monotonically_increasing_id()).withColumn("run", F.shiftright("tag", run_bits))
    path = scratch_path(spark, "runs")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def buckets_for(spark, hashes: int, each: int = BUCKET_HASHES) -> int:
    """Bits of the hash that number the buckets: about ``each`` hashes in one, at least one bucket a shuffle partition."""
    return max(1, math.ceil(math.log2(max(width(spark), hashes / each))))


def by_run(batches, columns: list[str]):
    """(run, columns as lists) of each stretch of rows of one run; a run may come in several."""
    held, number = None, None
    for batch in batches:
        runs = batch.column(batch.schema.get_field_index("run")).to_numpy()
        if not len(runs):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
        for a, b in zip(cuts, cuts[1:]):
            part = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a).to_pylist() for c in columns]
            if held is not None and number == runs[a]:
                held = [x + y for x, y in zip(held, part)]
                continue
            if held is not None:
                yield number, held
            held, number = part, int(runs[a])
    if held is not None:
        yield number, held


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ h >> np.uint64(33)
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n``."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        full = np.full(1 << max(18, (n - 1).bit_length()), base, np.uint64)
        full[0] = 1
        known = np.multiply.accumulate(full)
        if len(known) <= 1 << 21:
            _powers[base] = known
    return known[:n]


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of ``values[start:end]`` for every stretch: differences of one
    running sum, scaled back by the inverse power (Rabin-Karp without a loop)."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, len(values)), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return (total[ends] - total[starts]) * inverse[starts]


def pack(ordered: np.ndarray) -> bytes:
    """Sorted different 64-bit numbers as differences, byte by byte, without the bytes that are zero in all."""
    if not len(ordered):
        return b""
    steps = np.diff(ordered)
    planes = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    return bytes([planes]) + int(ordered[0]).to_bytes(8, "little") + steps.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    planes, first = data[0], np.frombuffer(data, "<u8", 1, 1)
    if not planes:
        return first.copy()
    columns = np.frombuffer(data, np.uint8, offset=9).reshape(planes, -1)
    steps = np.zeros((columns.shape[1], 8), np.uint8)
    steps[:, :planes] = columns.T
    return np.cumsum(np.concatenate([first, steps.view(np.uint64).ravel()]), dtype=np.uint64)


def bucketed(hashes: np.ndarray, bits: int):
    """(bucket, packed hashes) of sorted different ``hashes``, by their first ``bits`` bits."""
    number = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(hashes)] if len(hashes) else [0]
    return [(int(number[a]), pack(hashes[a:b])) for a, b in zip(cuts, cuts[1:])]


def shared(lists: list[np.ndarray]) -> list[np.ndarray]:
    """Of each sorted list of different hashes, those that another list has too."""
    every = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    same = ordered[1:] == ordered[:-1]
    found = order[np.r_[same, False] | np.r_[False, same]] if len(ordered) else order
    found.sort()
    cuts = np.searchsorted(owner[found], np.arange(len(lists) + 1))
    return [every[found[a:b]] for a, b in zip(cuts, cuts[1:])]


def repeated_hashes(sent: DataFrame) -> DataFrame:
    """(run, hashes): of ``sent`` (bucket, run, hashes packed) those that another run sent too, packed."""
    def compare(table):
        runs, lists = table.column("run").to_pylist(), [unpack(x) for x in table.column("hashes").to_pylist()]
        rows = [(r, pack(h)) for r, h in zip(runs, shared(lists)) if len(h)]
        return pa.table({"run": pa.array([r for r, _ in rows], pa.int64()), "hashes": pa.array([h for _, h in rows], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(compare, "run long, hashes binary")


def among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` are in sorted ``known``."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal intervals covered by windows of ``length`` at sorted ``starts``; windows that touch make one interval."""
    if not len(starts):
        return []
    first = np.r_[True, starts[1:] > starts[:-1] + length]
    at = np.flatnonzero(first)
    ends = starts[np.r_[at[1:] - 1, len(starts) - 1]] + length
    return list(zip(starts[at].tolist(), ends.tolist()))
