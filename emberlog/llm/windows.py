"""Substring dedup on words: repeated windows of a fixed number of words.

Every window of every document gets a Rabin-Karp hash over hashes of its words. The windows are
counted in Spark (``runs``): a run sends its different hashes, the buckets answer with those that
other runs have too, and the run adds those it holds twice itself. Windows found repeated merge
into maximal intervals, which are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.exact import _arrow
from emberlog.llm.inputs import id_type, tidied
from emberlog.llm.runs import HASHES, among, bucketed, buckets_for, by_run, mixed, numbered, repeated_hashes, spans_of, stretches, unpack

WORD_BASE, WINDOW_BASE = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15
PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of ``data``: what stands between ASCII white space."""
    starts, hashes, at = [], [], 0
    view = np.frombuffer(data, np.uint8)
    while at < len(view):
        end = min(len(view), at + PIECE)
        while end < len(view):  # a piece ends at white space
            gaps = np.flatnonzero(_SPACE[view[max(at, end - 256):end]])
            if len(gaps):
                end = max(at, end - 256) + int(gaps[-1]) + 1
                break
            more = np.flatnonzero(_SPACE[view[end:end + PIECE]])
            end = end + int(more[0]) + 1 if len(more) else min(len(view), end + PIECE)
            if len(more):
                break
        piece = view[at:end]
        space = np.r_[True, _SPACE[piece], True]
        edges = np.flatnonzero(space[1:] != space[:-1])
        first, last = edges[::2], edges[1::2]
        found = stretches(piece.astype(np.uint64) + np.uint64(1), first, last, WORD_BASE)
        hashes.append(mixed(found ^ (last - first).astype(np.uint64) * np.uint64(WINDOW_BASE)))
        starts.append(first + at)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def windows_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every window, index of its first word, words before each text) of a run."""
    start, words = word_hashes(b"\n".join(texts))
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    before = np.searchsorted(start, np.r_[0, np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(texts)), np.diff(before))
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), before
    at = np.flatnonzero(owner[size - 1:] == owner[:len(owner) - size + 1])
    return mixed(stretches(words, at, at + size, WINDOW_BASE)), at, before


def remove_repeated_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 35) -> DataFrame:
    """Per row of ``docs``: the identifier, ``n_words``, ``n_removed``, ``spans`` (maximal removed intervals of
    words, from 0, ends excluded), ``kept`` (the other words, joined by one space).

    A window is ``size`` consecutive words of one row's text; it is repeated if the same words start at any other
    place, in the same row too. Words are judged on the input, unchanged. Null texts have no words. Repeated rows
    (equal identifiers too) are rows of their own and so repeat each other; an empty table gives none.
    """
    rows = numbered(docs, id_column, text_column)
    words = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = buckets_for(rows.sparkSession, words // 6)

    def send(batches):
        for run, (texts,) in by_run(batches, ["text"]):
            found = bucketed(np.unique(windows_of([t.encode() for t in texts], size)[0]), bits)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in found], pa.int32()), "run": pa.array([run] * len(found), pa.int64()),
                                              "hashes": pa.array([h for _, h in found], pa.binary())})

    answers = repeated_hashes(rows.select("run", "text").mapInArrow(tidied(send), HASHES))
    kind = pa.list_(pa.list_(pa.int64()))
    arrow = pa.schema([("id", _arrow(docs, id_column)), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", kind), ("kept", pa.string())])

    def remove(left, right):
        texts = [t.encode() for t in left.column("text").to_pylist()]
        hashes, at, before = windows_of(texts, size)
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for x in right.column("hashes").to_pylist())]))
        ordered = np.sort(hashes)
        own = ordered[1:][ordered[1:] == ordered[:-1]]
        hit = at[among(hashes, known) | among(hashes, own)]
        cuts = np.searchsorted(hit, before)
        out = []
        for i, text in enumerate(texts):
            n = int(before[i + 1] - before[i])
            spans = spans_of(hit[cuts[i]:cuts[i + 1]] - before[i], size)
            found = text.split()
            kept = [w for (_, a), (b, _) in zip([(0, 0), *spans], [*spans, (n, n)]) for w in found[a:b]]
            out.append((n, n - len(kept), [list(s) for s in spans], b" ".join(kept).decode()))
        columns = zip(*out) if out else [()] * 4
        return pa.Table.from_arrays([left.column("id"), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    done = rows.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(
        remove, f"id {id_type(docs, id_column)}, n_words long, n_removed long, spans array<array<long>>, kept string")
    return done.withColumnRenamed("id", id_column)
