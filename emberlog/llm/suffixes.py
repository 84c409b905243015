"""Repeated byte strings by a distributed merge sort of sampled suffixes.

A string of ``size`` bytes is repeated if it starts at two places. Sorting the suffixes of all
places would move the corpus many times over, so suffixes are sampled by content: of each window
of ``size`` bytes the 64-byte gram with the least hash is its anchor (the leftmost, on a tie).
Equal windows have their anchor at the same offset, so comparing suffixes at anchors loses nothing.

1. Runs of documents (see ``runs``) exchange the hashes of their grams. An anchor whose gram stands
   nowhere else cannot lie in a repeated window and takes no further part: as in prefix-doubling
   string sorters, only prefixes known to repeat are sorted on.
2. For the others a run sorts what its windows see of the suffix at the anchor, followed by the bytes
   before the anchor read backwards, and sends these sorted runs front-coded: the length of the
   prefix shared with the entry before, and the rest. A bucket of grams gets one sorted run from
   each run of documents.
3. A bucket merges its runs with a loser tree that carries, for each candidate, the length of the
   prefix it shares with the last winner; prefixes known to be equal are never compared again. In
   the merged order, equal entries are whole contexts that repeat, and entries that share 64 bytes
   or more see the same gram; windows within those are compared by hash.
4. Every run hears which of its contexts, or which windows of them, repeat, and removes their bytes.

A gram that very many documents share (at the edges of a common passage each document has a
context of its own) is not merged by one bucket: its windows travel as hashes and are counted like
the word windows of ``windows``, spread over all buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.exact import _arrow
from emberlog.llm.inputs import id_type, tidied
from emberlog.llm.runs import among, bucketed, buckets_for, by_run, mixed, numbered, pack, powers, shared, spans_of, stretches, unpack

GRAM = 64
PIECE = 1 << 15
BASE = 0xD1342543DE82EF95
CONTEXT_BASE = 0x9E3779B97F4A7C15
HOT_RUNS = 512
HOT_HERE = 48
BUCKET_GRAMS = 50_000
AT_ONCE = 4_000


def _gram_hashes(piece: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position, doubling the length from 1."""
    h = piece.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(BASE, step, 1 << 64)) + h[step:]
        step *= 2
    return mixed(h)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring keys, doubling the width from 1."""
    step = 1
    while 2 * step <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return np.minimum(keys[:len(keys) - (width - step)], keys[width - step:]) if width > step else keys


def anchors(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, number of the gram, first window, last window) of every anchor of a run.

    ``data``: the documents' bytes one after the other, ``ends``: where each ends. Windows do not cross ends.
    """
    grams = size - GRAM + 1
    found = []
    low = np.uint64((1 << 16) - 1)
    for at in range(0, max(0, len(data) - size + 1), PIECE):
        piece = data[at:at + PIECE + size - 1]
        hashes = _gram_hashes(piece)
        keys = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
        chosen = (_least(keys, grams) & low).astype(np.int64)
        change = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        first, last = change, np.r_[change[1:], len(chosen)] - 1
        # The least hashes of windows are small numbers; mixed again, they spread over all buckets.
        found.append((chosen[change] + at, mixed(hashes[chosen[change]] ^ np.uint64(BASE)), first + at, last + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    position, gram, first, last = (np.concatenate(x) for x in zip(*found))
    # Windows that cross an end do not count: an anchor keeps those that lie in its own document.
    owner = np.searchsorted(ends, position, side="right")
    begin = np.r_[0, ends][owner]
    first, last = np.maximum(first, begin), np.minimum(last, ends[owner] - size)
    kept = first <= last
    position, gram, first, last = position[kept], gram[kept], first[kept], last[kept]
    # An anchor cut by a piece's edge is one anchor.
    start = np.flatnonzero(np.r_[True, position[1:] != position[:-1]]) if len(position) else np.zeros(0, np.int64)
    return position[start], gram[start], first[start], last[np.r_[start[1:], len(position)] - 1] if len(position) else last


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def context_hashes(data: np.ndarray, position: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Hash of what an anchor's windows see, and of where the anchor stands in it."""
    if not len(position):
        return np.zeros(0, np.uint64)
    h = _stretches(data, first, last + size)
    return mixed(h ^ mixed((position - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))


def _stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte stretches of bounded length with sorted starts, piece by piece."""
    out, step = np.zeros(len(starts), np.uint64), 1 << 20
    for at in range(0, len(data), step):
        a, b = np.searchsorted(starts, [at, at + step])
        if a < b:
            stop = int(ends[a:b].max())
            out[a:b] = stretches(data[at:stop].astype(np.uint64) + np.uint64(1), starts[a:b] - at, ends[a:b] - at, CONTEXT_BASE)
    return out


def window_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of all windows of the given anchors."""
    counts = last - first + 1
    starts = np.repeat(first - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    return starts, mixed(_stretches(data, starts, starts + size)) if len(starts) else np.zeros(0, np.uint64)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    step = 32
    while known < n:
        m = min(step, n - known)
        x = int.from_bytes(a[known:known + m], "big") ^ int.from_bytes(b[known:known + m], "big")
        if x:
            return known + m - (x.bit_length() + 7) // 8
        known += m
        step *= 4
    return n


def front_coded(entries: list[bytes]) -> tuple[list[int], list[int], bytes]:
    """(shared with the entry before, length of the rest, rests) of sorted entries."""
    lcps, lengths, rests, before = [], [], [], b""
    for entry in entries:
        n = common(before, entry, 0)
        lcps.append(n)
        lengths.append(len(entry) - n)
        rests.append(entry[n:])
        before = entry
    return lcps, lengths, b"".join(rests)


def whole(lcps: list[int], lengths: list[int], rests: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for n, length in zip(lcps, lengths):
        before = before[:n] + rests[at:at + length]
        at += length
        out.append(before)
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]):
    """Merge sorted runs (entries, common prefix with the entry before): yields (entry, common prefix with
    the entry yielded before, run, index in the run).

    A loser tree: each inner node holds the run that lost there and how much of its head it shares
    with the winner that passed. Two heads that share different lengths with the last winner are
    ordered by these lengths alone; only equal lengths need bytes, from that length on.
    """
    k = len(runs)
    heads = [r[0][0] if r[0] else None for r in runs]
    shared_with_last = [0] * k
    index = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = shared_with_last[a], shared_with_last[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = common(x, y, p)
        if n == len(x) or n < len(y) and x[n] < y[n]:
            shared_with_last[b] = n
            return a, b
        shared_with_last[a] = n
        return b, a

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    if not k:
        return
    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        entries, lcps = runs[winner]
        i = index[winner]
        yield entries[i], shared_with_last[winner], winner, i
        index[winner] = i = i + 1
        heads[winner], shared_with_last[winner] = (entries[i], lcps[i]) if i < len(entries) else (None, 0)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(losers[node], winner)
            node //= 2


def _entry(text: bytes, first: int, position: int, last: int, size: int) -> bytes:
    """What sorts a context: the suffix at the anchor, the bytes before it backwards, the suffix's length."""
    return text[position:last + size] + text[first:position][::-1] + (last + size - position).to_bytes(2, "big")


def _parts(entry: bytes) -> bytes:
    """The context of an entry, forwards."""
    n = int.from_bytes(entry[-2:], "big")
    return entry[n:-2][::-1] + entry[:n]


CONTEXTS = "bucket int, run long, hashes binary, counts binary, lcps binary, lengths binary, rests binary, windows binary, settled binary"
ANSWERS = "run long, contexts binary, partly binary, masks binary, windows binary"


def _repeated_contexts(rows: list[dict], size: int):
    """Merge a bucket's runs. Yields (run, hash of a context, None or which of its windows repeat)."""
    mask_bytes = (size - GRAM + 8) // 8
    runs, hashes, counts = [], [], []
    for row in rows:
        lcps = np.frombuffer(row["lcps"], "<u2").tolist()
        runs.append((whole(lcps, np.frombuffer(row["lengths"], "<u2").tolist(), row["rests"]), lcps))
        hashes.append(np.frombuffer(row["hashes"], "<u8").tolist())
        counts.append(np.frombuffer(row["counts"], "<u4").tolist())
    entries: list[bytes] = []
    groups: list[int] = []
    totals: list[int] = []
    holders: list[list[tuple[int, int]]] = []
    group = -1
    for entry, lcp, run, i in merged(runs):
        if entries and lcp == len(entry) == len(entries[-1]):
            totals[-1] += counts[run][i]
        else:
            if lcp < GRAM or not entries:
                group += 1
            entries.append(entry)
            groups.append(group)
            totals.append(counts[run][i])
            holders.append([])
        holders[-1].append((rows[run]["run"], hashes[run][i]))
    sizes = np.bincount(groups) if groups else np.zeros(0, np.int64)
    for at, total in enumerate(totals):
        if total > 1:
            yield from ((run, h, None) for run, h in holders[at])
    open_ = [at for at in range(len(entries)) if sizes[groups[at]] > 1]
    begin = 0
    while begin < len(open_):  # whole groups at a time, about ``AT_ONCE`` contexts
        end = min(len(open_), begin + AT_ONCE)
        while end < len(open_) and groups[open_[end]] == groups[open_[end - 1]]:
            end += 1
        some = open_[begin:end]
        for at, mask in zip(some, _masks([_parts(entries[at]) for at in some], [groups[at] for at in some], size)):
            if totals[at] == 1 and mask.any():
                yield (*holders[at][0], np.packbits(np.r_[mask, np.zeros(8 * mask_bytes - len(mask), bool)]).tobytes())
        begin = end


def _masks(texts: list[bytes], groups: list[int], size: int) -> list[np.ndarray]:
    """For each context, which of its windows start in another context of its group, or twice in it."""
    data, ends = joined(texts)
    first = np.r_[0, ends[:-1]]
    counts = ends - first - size + 1
    _, found = window_hashes(data, first, ends - size, size)
    found = mixed(found + np.repeat(np.array(groups, np.uint64), counts) * np.uint64(CONTEXT_BASE))
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    again = np.zeros(len(found), bool)
    again[order] = np.r_[same, False] | np.r_[False, same]
    return np.split(again, np.cumsum(counts)[:-1])


def remove_repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 200,
                          hot_runs: int = HOT_RUNS, hot_here: int = HOT_HERE) -> DataFrame:
    """Per row of ``docs``: the identifier, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed intervals of bytes,
    from 0, ends excluded), ``kept`` (binary: the other bytes).

    Texts are UTF-8 bytes, null texts empty. A byte goes if a string of ``size`` bytes over it (whole in the row's text)
    also starts anywhere else, in the same row too; strings are judged on the input. Rows are rows: two with the same
    identifier and text repeat each other. An empty table gives no rows. ``size`` is at least 128 and at most 60,000.
    ``hot_runs`` and ``hot_here`` say how many runs, or how many places of one run, make a gram hot; the result is the same.
    """
    if not 2 * GRAM <= size <= 60_000:
        raise ValueError("size must be from 128 to 60,000 bytes")
    rows = numbered(docs, id_column, text_column)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = buckets_for(rows.sparkSession, 2 * total // (size - GRAM), BUCKET_GRAMS)
    mask_bytes = (size - GRAM + 8) // 8

    def send_grams(batches):
        for run, (texts,) in by_run(batches, ["text"]):
            data, ends = joined([t.encode() for t in texts])
            gram, times = np.unique(anchors(data, ends, size)[1], return_counts=True)
            for kind, some in ((0, gram), (1, gram[times >= hot_here])):
                found = bucketed(some, bits)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in found], pa.int32()), "run": pa.array([run] * len(found), pa.int64()),
                                                  "kind": pa.array([kind] * len(found), pa.int32()), "hashes": pa.array([h for _, h in found], pa.binary())})

    def compare_grams(table):
        runs, kinds = table.column("run").to_pylist(), table.column("kind").to_pylist()
        lists = [unpack(h) for h in table.column("hashes").to_pylist()]
        held = [(r, h) for r, k, h in zip(runs, kinds, lists) if k == 0]
        every, times = np.unique(np.concatenate([h for _, h in held] or [np.zeros(0, np.uint64)]), return_counts=True)
        crowded = [h for k, h in zip(kinds, lists) if k == 1]
        hot = np.unique(np.concatenate([every[times >= hot_runs], *crowded]))
        out = [(r, pack(s), pack(s[among(s, hot)]), pack(h[among(h, hot)])) for (r, h), s in zip(held, shared([h for _, h in held]))]
        out = [x for x in out if x[1] or x[3]]
        return pa.table({"run": pa.array([x[0] for x in out], pa.int64()), "grams": pa.array([x[1] for x in out], pa.binary()),
                         "hot": pa.array([x[3] for x in out], pa.binary())})

    grams = rows.select("run", "text").mapInArrow(tidied(send_grams), "bucket int, run long, kind int, hashes binary")
    grams = grams.groupBy("bucket").applyInArrow(compare_grams, "run long, grams binary, hot binary")
    context_schema = pa.schema([("bucket", pa.int32()), ("run", pa.int64())] + [(n, pa.binary()) for n in ("hashes", "counts", "lcps", "lengths", "rests", "windows", "settled")])

    def gathered(table, column):
        return np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for x in table.column(column).to_pylist() if x)]))

    def send_contexts(left, right):
        if not len(left):
            return context_schema.empty_table()
        run = left.column("run")[0].as_py()
        data, ends = joined([t.encode() for t in left.column("text").to_pylist()])
        position, gram, first, last = anchors(data, ends, size)
        known, hot = gathered(right, "grams"), gathered(right, "hot")
        ordered = np.sort(gram)
        repeats = among(gram, known) | among(gram, np.unique(ordered[1:][ordered[1:] == ordered[:-1]]))
        is_hot = among(gram, hot)
        cold = np.flatnonzero(repeats & ~is_hot)
        hashes, at, times = np.unique(context_hashes(data, position[cold], first[cold], last[cold], size), return_index=True, return_counts=True)
        at, text = cold[at], data.tobytes()
        number = (gram[at] >> np.uint64(64 - bits)).astype(np.int64)
        by_bucket: dict[int, list] = {}
        for b, h, n, f, p, l in zip(number.tolist(), hashes.tolist(), times.tolist(), first[at].tolist(), position[at].tolist(), last[at].tolist()):
            by_bucket.setdefault(b, []).append((_entry(text, f, p, l, size), h, n))
        out = []
        for b, found in by_bucket.items():
            found.sort()
            lcps, lengths, rests = front_coded([e for e, _, _ in found])
            out.append((b, run, np.array([h for _, h, _ in found], "<u8").tobytes(), np.array([n for _, _, n in found], "<u4").tobytes(),
                        np.array(lcps, "<u2").tobytes(), np.array(lengths, "<u2").tobytes(), rests, None, None))
        _, windows = window_hashes(data, first[is_hot], last[is_hot], size)
        windows, times = np.unique(windows, return_counts=True)
        out += [(b, run, None, None, None, None, None, h, None) for b, h in bucketed(windows, bits)]
        if (times > 1).any():
            out.append((int(mixed(np.array([run], np.uint64))[0]) % (1 << bits), run, None, None, None, None, None, None, pack(windows[times > 1])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 9, context_schema)], schema=context_schema)

    answer_schema = pa.schema([("run", pa.int64())] + [(n, pa.binary()) for n in ("contexts", "partly", "masks", "windows")])

    def compare_contexts(table):
        given = table.select(["run", "hashes", "counts", "lcps", "lengths", "rests", "windows", "settled"]).to_pylist()
        out = [(r["run"], None, None, None, r["settled"]) for r in given if r["settled"] is not None]
        whole_, partly = {}, {}
        for run, h, mask in _repeated_contexts([r for r in given if r["hashes"] is not None], size):
            if mask is None:
                whole_.setdefault(run, []).append(h)
            else:
                partly.setdefault(run, []).append((h, mask))
        out += [(run, pack(np.unique(np.array(hs, np.uint64))), None, None, None) for run, hs in whole_.items()]
        out += [(run, None, np.array([h for h, _ in x], "<u8").tobytes(), b"".join(m for _, m in x), None) for run, x in partly.items()]
        sent = [r for r in given if r["windows"] is not None]
        out += [(r["run"], None, None, None, pack(h)) for r, h in zip(sent, shared([unpack(r["windows"]) for r in sent])) if len(h)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, answer_schema)], schema=answer_schema)

    contexts = rows.groupBy("run").cogroup(grams.groupBy("run")).applyInArrow(send_contexts, CONTEXTS)
    answers = contexts.groupBy("bucket").applyInArrow(compare_contexts, ANSWERS)
    kind = pa.list_(pa.list_(pa.int64()))
    arrow = pa.schema([("id", _arrow(docs, id_column)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", kind), ("kept", pa.binary())])

    def remove(left, right):
        texts = [t.encode() for t in left.column("text").to_pylist()]
        data, ends = joined(texts)
        begin = np.r_[0, ends[:-1]] if len(ends) else ends
        position, _, first, last = anchors(data, ends, size)
        hashes = context_hashes(data, position, first, last, size)
        settled = among(hashes, gathered(right, "contexts"))
        hit = [np.zeros(0, np.int64)]
        for f, l in zip(first[settled].tolist(), last[settled].tolist()):
            hit.append(np.arange(f, l + 1))
        partly, masks = b"".join(x or b"" for x in right.column("partly").to_pylist()), b"".join(x or b"" for x in right.column("masks").to_pylist())
        partly, masks = np.frombuffer(partly, "<u8"), np.frombuffer(masks, np.uint8).reshape(-1, mask_bytes)
        order = np.argsort(partly)
        for i in np.flatnonzero(among(hashes, partly[order])).tolist():
            mask = np.unpackbits(masks[order[np.searchsorted(partly[order], hashes[i])]])
            hit.append(first[i] + np.flatnonzero(mask[:last[i] - first[i] + 1]))
        windows = gathered(right, "windows")
        if len(windows):
            starts, found = window_hashes(data, first[~settled], last[~settled], size)
            hit.append(starts[among(found, windows)])
        hit = np.unique(np.concatenate(hit))
        cuts = np.searchsorted(hit, np.r_[begin, len(data)])
        out = []
        for i, text in enumerate(texts):
            spans = spans_of(hit[cuts[i]:cuts[i + 1]] - begin[i], size)
            kept = b"".join(text[a:b] for (_, a), (b, _) in zip([(0, 0), *spans], [*spans, (len(text), 0)]))
            out.append((len(text), len(text) - len(kept), [list(s) for s in spans], kept))
        columns = zip(*out) if out else [()] * 4
        return pa.Table.from_arrays([left.column("id"), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    done = rows.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(
        remove, f"id {id_type(docs, id_column)}, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
    return done.withColumnRenamed("id", id_column)
