"""Near duplicates by SimHash fingerprints.

Two fingerprints that differ in at most two bits differ in at most two of their eight bytes, so
they share at least six positional bytes: that is the guaranteed count. Posting lists of one
positional byte would hold a 256th of the table each, so postings are keyed by four positional
bytes at once: the bytes form four pairs, two bits can spoil two pairs, and two pairs are left; a
fingerprint has six postings. Within a posting list the shared bytes of a pair are tallied, pairs
that reach six are kept and verified by counting the bits that differ.

A long list (near copies of one text) is indexed again by two more positional bytes; what is then
left of a fingerprint are two bytes, and its links are found by looking up its 136 neighbours. So
no list is ever compared pair by pair, however long.

Equal fingerprints are one node of the graph, whatever their number.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.components import components
from emberlog.llm.exact import _arrow
from emberlog.llm.inputs import id_type, join_hot, texts, tidied
from emberlog.session import written

SEED = 42
BYTES = 8
MAX_BITS = 2
SHORT = 48
# Byte positions of each posting key: two of the four byte pairs.
PAIRS = [(0, 1), (2, 3), (4, 5), (6, 7)]
KEYS = [a + b for a, b in combinations(PAIRS, 2)]
CHUNK = 1 << 16


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes. No words: zero."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """64 bits; a bit is set if it is in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i:i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) per row of ``docs``; fp is the fingerprint as a signed 64-bit integer. A null text has no words."""
    arrow = pa.schema([("id", _arrow(docs, id_column)), ("fp", pa.int64())])

    def make(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], schema=arrow)

    return texts(docs, id_column, text_column).mapInArrow(tidied(make), f"id {id_type(docs, id_column)}, fp long")


def _take(fps: np.ndarray, positions) -> np.ndarray:
    """The bytes at ``positions`` of each fingerprint, as one integer."""
    key = np.zeros(len(fps), np.uint64)
    for p in positions:
        key = key << np.uint64(8) | fps >> np.uint64(8 * p) & np.uint64(255)
    return key


def _verified(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs share at least ``BYTES - max_bits`` positional bytes and differ in at most ``max_bits`` bits."""
    differ = a ^ b
    shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) if len(differ) else np.zeros(0)
    kept = np.flatnonzero(shared >= BYTES - max_bits)
    out = np.zeros(len(a), bool)
    out[kept] = np.bitwise_count(differ[kept]) <= max_bits
    return out


def _neighbours(free, max_bits: int) -> np.ndarray:
    """All differences of one to ``max_bits`` bits within the byte positions ``free``."""
    bits = [1 << 8 * p + i for p in free for i in range(8)]
    return np.array([sum(c) for n in range(1, max_bits + 1) for c in combinations(bits, n)], np.uint64)


def links_in_lists(keys: np.ndarray, fps: np.ndarray, free, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within the posting lists of ``keys`` (sorted, then by fingerprint, all different).

    ``free``: the byte positions the key leaves open.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    first, second = [], []
    short = np.repeat(lengths <= SHORT, lengths) & np.repeat(lengths > 1, lengths)
    at = np.flatnonzero(short)
    k, f = keys[at], fps[at]
    for step in range(1, int(lengths[lengths <= SHORT].max(initial=1))):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        a, b = f[same], f[same + step]
        good = _verified(a, b, max_bits)
        first.append(a[good])
        second.append(b[good])
    for start, length in zip(starts[lengths > SHORT], lengths[lengths > SHORT]):
        one = fps[start:start + length]
        if len(free) > max_bits:
            for more in combinations(free, len(free) - max_bits):
                key = _take(one, more)
                order = np.argsort(key, kind="stable")
                got = links_in_lists(key[order], one[order], [p for p in free if p not in more], max_bits)
                first.append(got[0])
                second.append(got[1])
        else:
            for difference in _neighbours(free, max_bits):
                other = one ^ difference
                found = np.minimum(np.searchsorted(one, other), len(one) - 1)
                good = (one[found] == other) & (one < other)
                first.append(one[good])
                second.append(other[good])
    return (np.concatenate(first), np.concatenate(second)) if first else (fps[:0], fps[:0])


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): all pairs of different fingerprints in ``nodes`` (fp, unique) at ``max_bits`` (at most 2) or fewer differing bits."""
    if not 0 < max_bits <= 2:
        raise ValueError("the postings guarantee links of one or two bits")

    def postings(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for n, positions in enumerate(KEYS):
                key = np.uint64(n) << np.uint64(32) | _take(fps, positions)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "fp": batch.column(0)})

    def linked(key, fps):
        """Links in whole lists; a list's key number says which bytes it leaves open."""
        number = key >> np.uint64(32)
        for n, positions in enumerate(KEYS):
            some = number == n
            if some.any():
                free = [p for p in range(BYTES) if p not in positions]
                u, v = links_in_lists(key[some], fps[some], free, max_bits)
                if len(u):
                    yield pa.RecordBatch.from_pydict({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    def search(batches):
        key, fps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy().view(np.uint64)])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            open_from = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1])) if len(key) else 0
            if open_from:
                yield from linked(*_sorted(key[:open_from], fps[:open_from]))
                key, fps = key[open_from:], fps[open_from:]
        if len(key):
            yield from linked(*_sorted(key, fps))

    lists = nodes.select("fp").mapInArrow(tidied(postings), "key long, fp long").repartition("key").sortWithinPartitions("key")
    return lists.mapInArrow(tidied(search), "u long, v long").distinct()


def _sorted(key, fps):
    order = np.lexsort((fps, key))
    return key[order], fps[order]


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: the identifier, ``fingerprint`` (16 hex digits), ``component_id``.

    Words are what stands between ASCII white space, A-Z lower-cased; shingles of ``words`` words count as often as
    they occur. Rows are linked if their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the smallest
    identifier that links lead to. Null and empty texts have fingerprint zero, which links like any other.
    Null identifiers are left out when the smallest is sought (a component of nothing else has a null id);
    repeated rows give repeated rows; an empty table gives none.
    """
    found = written(fingerprints(docs, id_column, text_column, words).withColumn("tag", F.monotonically_increasing_id()))
    nodes = written(found.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_links(nodes).select(F.col("u"), F.col("v"))).withColumnRenamed("node", "fp")
    rooted = written(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = join_hot(rooted.select("fp", "root"), least, "root", F.col("fp")).select("fp", "component_id")
    out = join_hot(found, of_fp, "fp", F.col("tag"))
    return out.select(F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
