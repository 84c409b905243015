"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows
the document's, sketches of parts merge into the sketch of the whole, and what a page shares with a
book can be read from their sketches. A text with fewer than ``LEAST`` such hashes keeps its
``LEAST`` smallest, so that short texts can be compared too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.exact import _arrow
from emberlog.llm.inputs import id_type, prepare, spread, tidied, width
from emberlog.llm.runs import mixed

SHINGLE = 8
FRACTION = 1 / 32
LEAST = 16
HASH_BITS = 48
BASE = 0xD1342543DE82EF95


def sketch(text: str, fraction: float = FRACTION) -> np.ndarray:
    """Sorted different hashes of the shingles (``SHINGLE`` code points; a shorter text is one shingle) that the sketch keeps."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.uint64)
    kept, step = [], 1 << 16
    for at in range(0, max(1, len(points) - SHINGLE + 1), step):
        h = points[at:at + step + SHINGLE - 1].astype(np.uint64) + np.uint64(1)
        length = 1
        while length < SHINGLE and len(points) >= SHINGLE:
            h = h[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + h[length:]
            length *= 2
        if len(points) < SHINGLE:
            h = np.array([(h * np.array([pow(BASE, i, 1 << 64) for i in range(len(h))], np.uint64)).sum()], np.uint64)
        h = mixed(h) >> np.uint64(64 - HASH_BITS)
        low = np.unique(h[h < limit_of(fraction)])
        kept.append(low if len(low) >= LEAST else np.unique(h)[:LEAST])
    return trimmed(np.unique(np.concatenate(kept)), fraction)


def limit_of(fraction: float) -> int:
    return int(fraction * (1 << HASH_BITS))


def trimmed(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Those of sorted ``hashes`` that a sketch keeps."""
    return hashes[:max(LEAST, int(np.searchsorted(hashes, limit_of(fraction))))]


def complete_to(hashes: np.ndarray, fraction: float = FRACTION) -> int:
    """Below this number the sketch has every hash of its document."""
    if len(hashes) < LEAST:
        return 1 << HASH_BITS
    return max(limit_of(fraction), int(hashes[-1]) + 1)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the two documents' shingles together."""
    both = np.union1d(a, b)
    return trimmed(both[both < min(complete_to(a, fraction), complete_to(b, fraction))], fraction) if len(a) and len(b) else both


def _overlap(a: np.ndarray, b: np.ndarray, fraction: float) -> tuple[int, int, int]:
    limit = min(complete_to(a, fraction), complete_to(b, fraction))
    a, b = a[a < limit], b[b < limit]
    return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)


def likeness(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Estimated share of common shingles in all shingles of both (Jaccard). Two empty texts are alike."""
    both, n, m = _overlap(a, b, fraction)
    return both / (n + m - both) if n + m else float(not len(a) and not len(b))


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 for an empty ``a``."""
    both, n, _ = _overlap(a, b, fraction)
    return both / n if n else float(not len(a))


def spelled(hashes: np.ndarray) -> str:
    """A sketch as text: its hashes in hexadecimal, ascending."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BITS // 8:].tobytes().hex()


def parsed(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, HASH_BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - HASH_BITS // 8:] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fraction: float = FRACTION) -> DataFrame:
    """(identifier, fingerprint) per row. A null text is empty and has the empty fingerprint; equal texts have equal ones."""
    arrow = pa.schema([("id", _arrow(docs, id_column)), ("fingerprint", pa.string())])

    def make(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spelled(sketch(t, fraction)) for t in batch.column(1).to_pylist()], pa.string())], schema=arrow)

    prepare(docs.sparkSession)
    rows = spread(docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")))
    return rows.mapInArrow(tidied(make), f"id {id_type(docs, id_column)}, fingerprint string").withColumnRenamed("id", id_column)


def in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) in buckets of the descending identifier, each closed by a copy of the row that
    follows its last one (``late``); after the last row of all comes the first.

    The ids' quantiles and the buckets' first ids are known before anything is moved, so each text is
    shuffled once, and once more if it is the first of its bucket. Null ids come last.
    """
    parts = max(width(rows.sparkSession), rows.rdd.getNumPartitions())
    quantiles = rows.select(F.percentile_approx("id", F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.lit(0.5), 10 * parts)).first()[0]
    bounds = sorted(set(quantiles if isinstance(quantiles, list) else [quantiles] if quantiles is not None else []), reverse=True)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)] or [[]]
    above = lambda values: F.size(F.filter(values, lambda b: F.col("id") < b))
    numbers = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    whole = above(numbers([g[-1] for g in groups if g]))
    part = F.element_at(F.array(*[numbers(g) for g in groups], numbers([])), whole + 1)
    bucket = F.when(F.col("id").isNull(), len(bounds)).otherwise(whole * step + above(part))
    rows = rows.withColumn("bucket", F.least(bucket, F.lit(len(bounds))))
    first = {r.bucket: r.first for r in rows.groupBy("bucket").agg(F.max("id").alias("first")).collect()}
    used = sorted(first)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    line = range(len(bounds) + 1)
    head = F.element_at(numbers([first.get(b) for b in line]), F.col("bucket") + 1)
    to = F.element_at(F.array(*[F.lit(before.get(b, b)) for b in line]), F.col("bucket") + 1)
    own, copy = F.struct("bucket", F.lit(False).alias("late")), F.struct(to.alias("bucket"), F.lit(True).alias("late"))
    placed = rows.withColumn("place", F.explode(F.when(F.col("id").eqNullSafe(head), F.array(own, copy)).otherwise(F.array(own))))
    placed = placed.select("id", "text", "place.bucket", "place.late")
    return placed.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "late", F.col("id").desc_nulls_last(), "text")


def neighbour_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Per row of ``docs``: the identifier, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``, ``kept_in_edited`` (containment of the text in its edited text).

    The edited text is the text with its last half (rounded down) replaced by the first as many code points (or all) of the
    next row, by descending integer identifier, nulls last, equal identifiers by text; after the last row comes the first, so
    a single row is its own next. A null text is empty. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = spread(docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")))
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_in_edited"]
    arrow = pa.schema([(n, t) for n, t in zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()])])

    def pairs(batches):
        """(id, text, sketch) of each row and of the next."""
        last = place = None
        for batch in batches:
            for ident, text, bucket, late in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if last is not None and place == bucket:
                    now = (ident, text, sketch(text, fraction))
                    yield last, now
                    last = None if late else now
                elif not late:
                    last = (ident, text, sketch(text, fraction))
                place = bucket

    def compare(batches):
        out, held = [], 0
        for (ident, text, own), (_, after, following) in pairs(batches):
            half = len(text) // 2
            edited = text[:len(text) - half] + after[:half]
            changed = sketch(edited, fraction)
            out.append((ident, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelled(own), spelled(changed),
                        likeness(own, changed, fraction), likeness(own, following, fraction), containment(own, changed, fraction)))
            held += len(text)
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    made = in_ranges(rows).mapInArrow(tidied(compare), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_in_edited double")
    return made.withColumnRenamed("id", id_column)
