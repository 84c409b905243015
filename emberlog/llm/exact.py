"""Exact duplicates by a tree merge of sorted digest runs.

Every partition turns its texts into sorted runs of (digest, best identifier, count). The runs
then meet in rounds: a round fixes one digit of the place a digest belongs to, and each place
exchanges runs with the ``fan_in`` partners that differ from it in that digit only. A place merges
what it gets in one multiway merge and passes on one sorted run, in which each digest occurs once
with its best identifier so far. After log(places) rounds every digest is whole at one place. A
text with millions of copies is one entry of every run, so no place ever sees its copies.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.inputs import id_type, join_hot, prepare, spread, tidied, width
from emberlog.session import written

RUN_ROWS = 100_000
PLACE_ROWS = 50_000


def _best(a: tuple, b: tuple, largest: bool) -> tuple:
    """Of two (id, tag): the row that stays. A null identifier loses; a tie goes to the row read first."""
    if a[0] is None or b[0] is None:
        return min(a, b, key=lambda x: (x[0] is None, x[1]))
    if a[0] == b[0]:
        return min(a, b, key=lambda x: x[1])
    return max(a, b, key=lambda x: x[0]) if largest else min(a, b, key=lambda x: x[0])


def _merged(runs: list[list[tuple]], largest: bool) -> list[tuple]:
    """One sorted run of several. Entries: (digest, length, id, tag, n). Equal digests of texts of
    different length stay apart."""
    out = []
    for (digest, length), same in groupby(heapq.merge(*runs, key=lambda e: e[:2]), key=lambda e: e[:2]):
        first = next(same)
        best, n = first[2:4], first[4]
        for entry in same:
            best, n = _best(best, entry[2:4], largest), n + entry[4]
        out.append((digest, length, *best, n))
    return out


def _place(digest: bytes, digits: int, bits: int) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - digits * bits) if digits else 0


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest",
                     normalised: Column | None = None, fan_in: int = 8, place_rows: int = PLACE_ROWS) -> DataFrame:
    """One row per row of ``docs``: the identifier, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their whole normalised text is (``normalised``: a column, by default the text
    unchanged), judged by SHA-256 and length in bytes. Of equal texts the row with the ``largest``
    (or ``smallest``) identifier stays. A null text is empty. A null identifier loses against any
    other; of rows with the same identifier and text one stays. An empty table gives no rows.
    ``fan_in`` is a power of two.
    """
    spark, largest = docs.sparkSession, keep == "largest"
    if keep not in ("largest", "smallest") or fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("keep is largest or smallest, fan_in a power of two")
    prepare(spark)
    kind, bits = id_type(docs, id_column), fan_in.bit_length() - 1
    text = F.coalesce(F.col(text_column) if normalised is None else normalised, F.lit(""))
    keys = written(spread(docs.select(F.col(id_column).alias("id"), text.alias("text"))).select(
        "id", F.monotonically_increasing_id().alias("tag"), F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("length")))
    places = max(width(spark), keys.count() / place_rows)
    digits = max(1, math.ceil(math.log(places, fan_in)))
    schema = f"place int, run long, digest binary, length long, id {kind}, tag long, n long"
    arrow = pa.schema([("place", pa.int32()), ("run", pa.int64()), ("digest", pa.binary()), ("length", pa.int64()),
                       ("id", _arrow(docs, id_column)), ("tag", pa.int64()), ("n", pa.int64())])

    def entries(place, run, rows):
        digest, length, ids, tags, n = zip(*rows) if rows else ((), (), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((place, [run] * len(rows), digest, length, ids, tags, n), arrow)], schema=arrow)

    def first_runs(batches):
        found: dict = {}

        def run():
            rows = sorted((*k, *best, n) for k, (best, n) in found.items())
            number = min(r[3] for r in rows)
            found.clear()
            return sent(crc32(str(number).encode()) % fan_in ** digits, 0, number, rows)

        for batch in batches:
            for ident, tag, sha, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                key, now = (bytes.fromhex(sha), length), (ident, tag)
                best, n = found.get(key, (now, 0))
                found[key] = (_best(best, now, largest), n + 1)
                if len(found) >= RUN_ROWS:
                    yield run()
        if found:
            yield run()

    def sent(place, digit, run, rows):
        """A sorted run at ``place``, addressed to the partners of round ``digit``."""
        mask = (fan_in - 1) << (digit * bits) if digit < digits else 0
        return entries([place & ~mask | _place(r[0], digits, bits) & mask for r in rows], run, rows)

    def merge_and_send(digit):
        def merge(table):
            place = table.column("place")[0].as_py()
            rows = sorted(zip(*(table.column(c).to_pylist() for c in ("run", "digest", "length", "id", "tag", "n"))), key=lambda r: r[:3])
            runs = [[r[1:] for r in run] for _, run in groupby(rows, key=lambda r: r[0])]
            return pa.Table.from_batches([sent(place, digit + 1, place, _merged(runs, largest))], schema=arrow)

        return merge

    level = keys.mapInArrow(tidied(first_runs), schema)
    for digit in range(digits):
        level = level.groupBy("place").applyInArrow(merge_and_send(digit), schema)
    best = level.select(F.concat_ws("-", F.lower(F.hex("digest")), "length").alias("key"), F.col("id").alias("keep_id"), F.col("tag").alias("keep_tag"), F.col("n").alias("group_size"))
    found = join_hot(keys.withColumn("key", F.concat_ws("-", "sha", "length")), best, "key", F.col("tag"))
    return found.select(F.col("id").alias(id_column), "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), F.col("sha").alias("text_sha256"))


def _arrow(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(docs.schema[column].dataType)
