"""Jaccard join of shingle sets by prefixes of token combinations.

Two sets of similarity ``t`` differ in at most ``n - ceil(t * n)`` of the ``n`` members of either. All members are put in one
order, rare ones first. If ``k - 1`` more members than may differ are taken from the front of each set, similar sets share ``k``
of those taken: so a common member need not be indexed alone, the combinations of ``k`` of them suffice. Here members fall
into classes by their number of sets. Those of few sets are indexed singly; those of many in pairs; those of very many in
threes. A class is cut into subclasses by hash, combinations are built within a subclass, and the prefix is extended by the
members that every subclass loses (after Wang et al., SIGMOD 2016). A combination is in far fewer sets than its members.

Before that a screen finds the sets that can have no partner, without moving a text: every task sends the hashes of its sets'
members to buckets, which answer how many of a set's members another set has too. A set with more members of its own than may
differ is done. What is left, as a rule a small part, is fetched again and joined.

Posting lists of the same sets are kept once. First a list tells the pairs with one of its members. In lists that then hold
several components parity sketches meet, all with all: the bits in which two sketches differ are at most the members in which the
sets do, so a pair that fails this bound is no link. The closest pairs between components are verified on the whole sets first, then
whatever is left between what is still apart.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from emberlog.llm.components import grouped
from emberlog.llm.exact import _arrow
from emberlog.llm.inputs import join_hot, prepare, spread, tidied, width
from emberlog.llm.runs import buckets_for, by_run, mixed, pack, unpack
from emberlog.llm.windows import windows_of
from emberlog.session import written

SLOT_BITS = 40
SOURCE_BYTES, SOURCE_ROWS = 16 << 20, 60_000
SEVERAL = 0xFFFF
RUN_ROWS, RUN_MEMBERS = 512, 1 << 21
FEW, MANY = 5, 9  # members of fewer than 2 ** FEW sets stand alone, of fewer than 2 ** MANY in pairs, the others in threes
SHORT = 16
BLOCK = 1024
LIST_LANE = 1_000_000


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Per text the sorted different hashes of its shingles, A-Z lower-cased; of fewer words the whole sequence is one shingle."""
    lowered = [t.lower() for t in texts]
    hashes, at, before = windows_of(lowered, words)
    cuts = np.searchsorted(at, before)
    out = []
    for i, text in enumerate(lowered):
        n = int(before[i + 1] - before[i])
        if n and n < words:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(text.split()), seed=n)], np.uint64))
        else:
            out.append(np.unique(hashes[cuts[i]:cuts[i + 1]]))
    return out


def set_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets of hashes; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def may_differ(n: int, similarity: float) -> int:
    """Members of a set of ``n`` that a set of this similarity may lack."""
    return n - ceil(similarity * n - 1e-9)


# Parity sketches

def sketch(hashes: np.ndarray) -> bytes:
    """A bit for every slot of the hashes: whether an odd number of them falls there. About four bits a member."""
    size = 1 << max(6, (4 * max(len(hashes), 1) - 1).bit_length())
    slots = (hashes & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) brought down to ``size`` words: halves are added modulo two."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def apart(a: bytes, n: int, b: bytes, m: int) -> float:
    """Lower bound on the share of ``n + m`` members that are in one of the two sets only."""
    x, y = (np.frombuffer(s, np.uint64)[None] for s in (a, b))
    size = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) / max(n + m, 1)


def most_apart(similarity: float) -> float:
    return (1 - similarity) / (1 + similarity) + 1e-9


def sketches_allow(a: bytes, n: int, b: bytes, m: int, similarity: float) -> bool:
    return apart(a, n, b, m) <= most_apart(similarity)


# The screen

def _header(ids):
    return StructType([StructField("bucket", IntegerType()), StructField("src", LongType()), StructField("slots", BinaryType()), StructField("owners", BinaryType()),
                       StructField("ids", ArrayType(ids)), StructField("shas", BinaryType()), StructField("sizes", BinaryType()), StructField("own", BinaryType())])


def screened(rows: DataFrame, words: int, similarity: float, bits: int) -> DataFrame:
    """(id, tag, sha binary, n, open) of ``rows`` (id, sha, text), written: ``open`` if a set of the similarity may exist elsewhere; ``tag`` tells the rows apart.

    A slot is the first bits of a hash: two members that share one count as one, which only leaves more sets open.
    A task sends each slot once, whatever the number of its sets that have it, so no bucket is hot.
    """
    kind = rows.schema["id"].dataType
    arrow = pa.schema([("bucket", pa.int32()), ("src", pa.int64()), ("slots", pa.binary()), ("owners", pa.binary()),
                       ("ids", pa.list_(_arrow(rows, "id"))), ("shas", pa.binary()), ("sizes", pa.binary()), ("own", pa.binary())])

    def send(batches):
        held, size, number = [], 0, 0

        def flush():
            nonlocal held, size, number
            src = (TaskContext.get().partitionId() << 24) + number
            sets = shingle_sets([t for _, _, texts in held for t in texts], words)
            ids = pa.concat_arrays([i for i, _, _ in held])
            shas = b"".join(s for _, some, _ in held for s in some)
            slots = np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - SLOT_BITS)
            owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.argsort(slots, kind="stable")
            slots, owners = slots[order], owners[order]
            starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(slots) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[starts, len(slots)])
            own = np.bincount(owners[np.repeat(counts > 1, counts)], minlength=len(sets))
            slots, owners = slots[starts], np.where(counts > 1, SEVERAL, owners[starts]).astype(np.uint16)
            bucket = (slots >> np.uint64(SLOT_BITS - bits)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(slots)] if len(slots) else [0]
            parts = [(int(bucket[a]), src, pack(slots[a:b]), owners[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            sizes = np.array([len(x) for x in sets], np.int64)
            head = (src % (1 << bits), src, None, None)
            none = [None] * len(parts)
            first = [pa.array(c, f.type) for c, f in zip(zip(head, *parts), arrow)]
            yield pa.RecordBatch.from_arrays([*first, pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array(none, arrow.field("ids").type)]),
                                              pa.array([shas, *none], pa.binary()), pa.array([sizes.tobytes(), *none], pa.binary()), pa.array([own.astype(np.int64).tobytes(), *none], pa.binary())], schema=arrow)
            held, size, number = [], 0, number + 1

        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            if held and (size + sum(map(len, texts)) > SOURCE_BYTES or sum(len(t) for _, _, t in held) + len(texts) > SOURCE_ROWS):
                yield from flush()
            for a in range(0, len(texts), SOURCE_ROWS):
                held.append((batch.column(0).slice(a, SOURCE_ROWS), batch.column(1).slice(a, SOURCE_ROWS).to_pylist(), texts[a:a + SOURCE_ROWS]))
                size += sum(map(len, texts[a:a + SOURCE_ROWS]))
                if len(texts) > SOURCE_ROWS:
                    yield from flush()
        if held:
            yield from flush()

    answer = pa.schema([("src", pa.int64()), ("owners", pa.binary()), *list(arrow)[4:]])

    def compare(table):
        """Headers pass; of each source's slots those that another source has too, or the same in several sets, are counted by set."""
        heads = table.filter(pc.is_valid(table.column("shas"))).select(answer.names)
        sent = table.filter(pc.is_valid(table.column("slots"))).select(["src", "slots", "owners"])
        lists = [unpack(x) for x in sent.column("slots").to_pylist()]
        every = np.concatenate([np.zeros(0, np.uint64), *lists])
        owner = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x, np.uint16) for x in sent.column("owners").to_pylist())])
        origin = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        met = (np.r_[same, False] | np.r_[False, same])[:len(order)]
        rows = order[met]
        rows = rows[owner[rows] != SEVERAL]
        by_set = np.unique(origin[rows] << 16 | owner[rows], return_counts=True)
        cuts = np.searchsorted(by_set[0] >> 16, np.arange(len(lists) + 1))
        src = sent.column("src").to_pylist()
        found = [(src[i], np.stack([by_set[0][a:b] & 0xFFFF, by_set[1][a:b]]).astype(np.int64).tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        counted = pa.table({"src": pa.array([s for s, _ in found], pa.int64()), "owners": pa.array([x for _, x in found], pa.binary()),
                            **{f.name: pa.nulls(len(found), f.type) for f in list(arrow)[4:]}})
        return pa.concat_tables([heads, counted]).cast(answer)

    def judge(table):
        head = table.filter(pc.is_valid(table.column("shas")))
        sizes, own = (np.frombuffer(head.column(c)[0].as_py(), np.int64) for c in ("sizes", "own"))
        shared = own.copy()
        for x in table.column("owners").to_pylist():
            if x is not None:
                who, count = np.frombuffer(x, np.int64).reshape(2, -1)
                shared[who] += count
        shas = head.column("shas")[0].as_py()
        alone = sizes - shared
        is_open = [n > 0 and a <= may_differ(n, similarity) for n, a in zip(sizes.tolist(), alone.tolist())]
        ids = head.column("ids").combine_chunks().flatten()
        tags = (table.column("src")[0].as_py() << 16) + np.arange(len(sizes))
        return pa.table({"id": ids, "tag": pa.array(tags, pa.int64()), "sha": pa.array([shas[i:i + 32] for i in range(0, len(shas), 32)], pa.binary()), "n": pa.array(sizes), "open": pa.array(is_open, pa.bool_())})

    told = rows.select("id", "sha", "text").mapInArrow(tidied(send), _header(kind))
    shape = _header(kind)
    passed = StructType([shape["src"], shape["owners"], *shape.fields[4:]])
    met = told.groupBy("bucket").applyInArrow(compare, passed)
    out = StructType([StructField("id", kind), StructField("tag", LongType()), StructField("sha", BinaryType()), StructField("n", LongType()), StructField("open", BooleanType())])
    return written(met.groupBy("src").applyInArrow(judge, out))


# Sets of what is left

SETS = "run long, node long, sha binary, digest binary, n long, sketch binary, hashes binary"


def fetched_sets(rows: DataFrame, judged: DataFrame, words: int) -> DataFrame:
    """The sets of the open texts, one row a different text, written in runs of neighbouring rows."""
    def once(batches):
        seen: set = set()
        for batch in batches:
            shas = batch.column(0).to_pylist()
            new = []
            for s in shas:
                new.append(s not in seen)
                seen.add(s)
            yield batch.filter(pa.array(new, pa.bool_()))

    def make(batches):
        part, number, members = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            sets = shingle_sets([t.encode() for t in batch.column(1).to_pylist()], words)
            nodes = []
            for x in sets:
                if members + len(x) > RUN_MEMBERS and number % RUN_ROWS:
                    number += RUN_ROWS - number % RUN_ROWS
                members = len(x) if number % RUN_ROWS == 0 else members + len(x)
                nodes.append(part + number)
                number += 1
            yield pa.RecordBatch.from_pydict({"run": pa.array([n // RUN_ROWS for n in nodes], pa.int64()), "node": pa.array(nodes, pa.int64()), "sha": batch.column(0),
                                              "digest": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), "n": pa.array([len(x) for x in sets], pa.int64()),
                                              "sketch": pa.array([sketch(x) for x in sets], pa.binary()), "hashes": pa.array([pack(x) for x in sets], pa.binary())})

    wanted = judged.filter("open").select("sha").distinct()
    texts = rows.select("sha", "text").mapInArrow(tidied(once), "sha binary, text string").join(wanted, "sha", "left_semi").dropDuplicates(["sha"])
    return written(texts.mapInArrow(tidied(make), SETS))


# Signatures

def classes_of(sets: DataFrame, bits: int) -> DataFrame:
    """(run, slots, power): of each run's slots those of several sets, with the whole logarithm of their number of sets."""
    def send(batches):
        for run, (packed,) in by_run(batches, ["hashes"]):
            slots, counts = np.unique(np.concatenate([unpack(x) for x in packed]) >> np.uint64(64 - SLOT_BITS), return_counts=True)
            bucket = (slots >> np.uint64(SLOT_BITS - bits)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(slots)] if len(slots) else [0]
            counts = counts.astype(np.uint16)  # a run has fewer sets than that
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(bucket[a]) for a in cuts[:-1]], pa.int32()), "run": pa.array([run] * (len(cuts) - 1), pa.int64()),
                                              "slots": pa.array([pack(slots[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                                              "counts": pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    def add(table):
        lists = [unpack(x) for x in table.column("slots").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()]).astype(np.int64)
        every, back = np.unique(np.concatenate(lists), return_inverse=True)
        power = np.log2(np.bincount(back, weights=counts, minlength=len(every))).astype(np.uint8)[back]
        cuts = np.cumsum([0, *map(len, lists)])
        rows = []
        for run, slots, a, b in zip(table.column("run").to_pylist(), lists, cuts, cuts[1:]):
            often = power[a:b] > 0
            if often.any():
                rows.append((run, pack(slots[often]), power[a:b][often].tobytes()))
        return pa.table({"run": pa.array([r[0] for r in rows], pa.int64()), "slots": pa.array([r[1] for r in rows], pa.binary()), "power": pa.array([r[2] for r in rows], pa.binary())})

    sent = sets.select("run", "hashes").mapInArrow(tidied(send), "bucket int, run long, slots binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "run long, slots binary, power binary")


def subclasses(scale: int, similarity: float) -> tuple[int, int]:
    """Into how many subclasses the members indexed in pairs and in threes fall, for sets of about ``2 ** scale`` members."""
    share = (1 - similarity) * (1 << scale)
    return max(1, int(share / 2)), max(1, int(share * 3 / 4))


def scales(n: int, similarity: float) -> list[int]:
    """Scales at which a set of ``n`` members is indexed: its own, and the next if sets of that scale can be similar to it."""
    own = n.bit_length() - 1
    return [own, own + 1] if n >= similarity * (1 << own + 1) - 1e-9 else [own]


def smallest_safe(similarity: float) -> int:
    """Sets of at least that many members always reach their guarantee; smaller ones are also indexed by single members."""
    if similarity <= 0.5:
        raise ValueError("combinations need a similarity above one half")
    unsafe = 0
    for n in range(1, 4096):
        lost = max(sum(k * m for k, m in zip((1, 2), subclasses(s, similarity))) for s in scales(n, similarity))
        if n - lost < may_differ(n, similarity) + 1:
            unsafe = n
    return unsafe + 1


_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def signatures(hashes: np.ndarray, power: np.ndarray, similarity: float, safe: int) -> np.ndarray:
    """Keys under which a set is posted: sets of this similarity have one in common.

    ``power``: logarithm of the number of sets that have the member (0: no other, so it is in the prefix but not posted).
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    need = may_differ(n, similarity) + 1
    order = np.lexsort((hashes, power))
    hashes, power = hashes[order], power[order]
    found = []
    if n <= int((safe - 1) / similarity + 1e-9):  # may meet a set too small for combinations
        first = hashes[:need]
        found.append(mixed(first[power[:need] > 0] ^ _SALT[3]))
    alone = int(np.searchsorted(power, FEW))
    front = min(alone, need)
    found.append(hashes[:front][power[:front] > 0])
    if front < need:
        rest, kind = hashes[alone:], np.where(power[alone:] < MANY, 2, 3)
        for scale in scales(n, similarity):
            two, three = subclasses(scale, similarity)
            part = (mixed(rest ^ _SALT[0]) % np.where(kind == 2, two, three).astype(np.uint64)).astype(np.int64) * 4 + kind
            sort = np.argsort(part, kind="stable")
            starts = np.flatnonzero(np.r_[True, part[sort][1:] != part[sort][:-1]])
            rank = np.empty(len(rest), np.int64)
            rank[sort] = np.arange(len(rest)) - np.repeat(starts, np.diff(np.r_[starts, len(rest)]))
            credit = np.cumsum(rank >= kind - 1)
            taken = min(len(rest), int(np.searchsorted(credit, need - front)) + 1)
            groups: dict = {}
            for h, p in zip(rest[:taken].tolist(), part[:taken].tolist()):
                groups.setdefault(p, []).append(h)
            told = [c if len(c) == 3 else (*c, 0) for p, g in groups.items() for c in combinations(sorted(g), p & 3)]
            if told:
                told = np.array(told, np.uint64)
                found.append(mixed(mixed(mixed(told[:, 0] ^ _SALT[1]) + told[:, 1]) * _SALT[2] + told[:, 2] + np.uint64(scale)))
    return np.unique(np.concatenate(found))


def postings(sets: DataFrame, bits: int, similarity: float) -> DataFrame:
    """(key, node, n): where every set is posted; keys that one set has alone are left out as far as a run can tell."""
    safe = smallest_safe(similarity)

    def post(left, right):
        slots, power = (np.concatenate([np.zeros(0, kind), *found]) for kind, found in (
            (np.uint64, [unpack(x) for x in right.column("slots").to_pylist()]), (np.uint8, [np.frombuffer(x, np.uint8) for x in right.column("power").to_pylist()])))
        order = np.argsort(slots)
        slots, power = slots[order], power[order]
        keys = []
        for packed in left.column("hashes").to_pylist():
            hashes = unpack(packed)
            mine = hashes >> np.uint64(64 - SLOT_BITS)
            at = np.minimum(np.searchsorted(slots, mine), max(len(slots) - 1, 0))
            often = np.where(slots[at] == mine, power[at], 0) if len(slots) else np.zeros(len(mine), np.uint8)
            keys.append(signatures(hashes, often, similarity, safe))
        lengths = [len(k) for k in keys]
        node, n = (np.repeat(left.column(c).to_numpy(), lengths) for c in ("node", "n"))
        return pa.table({"key": pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)), "node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64())})

    answers = classes_of(sets, bits)
    return sets.select("run", "node", "n", "hashes").groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(post, "key long, node long, n long")


def different_lists(posted: DataFrame) -> DataFrame:
    """(key, node, n, members) of the lists of several nodes, written; of lists of the same nodes one."""
    heads = posted.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"))
    kept = heads.filter("members > 1").groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key", "members")
    return written(posted.join(written(kept), "key"))


# Pairs

def _whole(batches):
    """Columns, as arrays, of batches sorted by the first: whole stretches of equal values only."""
    parts: list = []
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or parts and parts[-1][0][-1] != now[0][0]:
            done = [*parts, [c[:cut] for c in now]]
            yield [np.concatenate(c) for c in zip(*done)]
            parts = []
        parts.append([c[cut:] for c in now])
    if parts:
        yield [np.concatenate(c) for c in zip(*parts)]


def cross_pairs(key, node, n, part, similarity: float, leaders: int):
    """Pairs (u < v) in whole lists of nodes of different components (``part``) and of sizes that allow the similarity: all
    pairs with one of the list's first ``leaders`` members (by a hash, so lists of one group have the same leaders)."""
    order = np.lexsort((mixed(node.view(np.uint64)), key))
    key, node, n, part = (x[order] for x in (key, node, n, part))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, len(key)])
    place = np.arange(len(key)) - np.repeat(starts, lengths)
    for step in range(leaders):
        behind = np.flatnonzero(place > step)
        if not len(behind):
            break
        leader = behind - place[behind] + step
        good = (part[behind] != part[leader]) & (np.minimum(n[behind], n[leader]) >= similarity * np.maximum(n[behind], n[leader]) - 1e-9)
        a, b = node[behind[good]], node[leader[good]]
        yield np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def pairs_with_first(lists: DataFrame, similarity: float) -> DataFrame:
    """(u, v), different: each node of a list with the list's first one. A list of more than ``LIST_LANE`` nodes is dealt to several tasks,
    each with a first one of its own."""
    def search(batches):
        held, size = [], 0
        for whole in _whole(batches):
            for pairs in cross_pairs(*whole, similarity, 1):
                held.append(pairs)
                size += len(pairs)
                if size > 1_000_000:
                    held = [np.unique(np.concatenate(held), axis=0)]
                    if len(held[0]) > 500_000:
                        yield pa.RecordBatch.from_pydict({"u": pa.array(held[0][:, 0]), "v": pa.array(held[0][:, 1])})
                        held = []
                    size = sum(map(len, held))
        if size:
            found = np.unique(np.concatenate(held), axis=0)
            yield pa.RecordBatch.from_pydict({"u": pa.array(found[:, 0]), "v": pa.array(found[:, 1])})

    lane = F.when(F.col("members") > LIST_LANE, F.xxhash64("key", F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("members") / LIST_LANE)))).otherwise(F.col("key"))
    laid = lists.select(lane.alias("key"), "node", "n", "part").repartition("key").sortWithinPartitions("key")
    return laid.mapInArrow(tidied(search), "u long, v long").distinct()


def _with_sets(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (u, v) with ``columns`` of both sets (suffixes _u and _v); a node of many pairs is split by the adaptive plan."""
    needed = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    some = written(sets.select("node", *columns).join(needed, "node", "left_semi"))
    for side in "uv":
        of = some.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
        pairs = pairs.join(of, side)
    return pairs


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, sketched: bool = False) -> DataFrame:
    """(u, v) of ``pairs`` whose sets are similar enough, written: sketches settle most (unless they have), then the whole sets decide."""
    def possible(batches):
        for batch in batches:
            a, n, b, m = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("sketch_u", "n_u", "sketch_v", "n_v"))
            good = [sketches_allow(*x, similarity) for x in zip(a, n, b, m)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    def alike(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hashes_u", "hashes_v"))
            good = [set_similarity(unpack(x), unpack(y)) >= similarity for x, y in zip(a, b)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    rest = pairs if sketched else written(_with_sets(pairs, sets, ["n", "sketch"]).mapInArrow(tidied(possible), "u long, v long"))
    return written(_with_sets(rest, sets, ["hashes"]).mapInArrow(tidied(alike), "u long, v long"))


def _tables(batches):
    """Tables of the rows of one value of the first column, which ``batches`` are sorted by."""
    parts: list = []
    for batch in batches:
        value = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(value)) + 1).tolist(), len(value)] if len(value) else [0]
        for a, b in zip(cuts, cuts[1:]):
            if parts and parts[-1].column(0)[0].as_py() != value[a]:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def sketch_pairs(node, n, part, side, sketches: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, rows, how far apart) of the pairs of different components whose sketches allow the similarity: all of one side, or across two."""
    words = np.array([len(s) // 8 for s in sketches])
    bits = {int(w): np.stack([np.frombuffer(s, np.uint64) for s, x in zip(sketches, words) if x == w]) for w in np.unique(words)}
    members = {w: np.flatnonzero(words == w) for w in bits}
    both = bool(side.min() != side.max())
    first, second, far = [], [], []
    for w in sorted(bits):
        for v in (w, 2 * w):
            if v not in bits:
                continue
            small, large = bits[w], folded(bits[v], w)
            step = max(1, (1 << 22) // (len(large) * w))
            for a in range(0, len(small), step):
                i, j = members[w][a:a + step][:, None], members[v][None, :]
                share = np.bitwise_count(small[a:a + step, None, :] ^ large[None, :, :]).sum(axis=2, dtype=np.int64) / (n[i] + n[j])
                good = (share <= most_apart(similarity)) & (part[i] != part[j])
                good &= (side[i] != side[j]) if both else True
                if v == w:
                    good &= i < j
                x, y = np.nonzero(good)
                first.append(members[w][a:a + step][x])
                second.append(members[v][y])
                far.append(share[x, y])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second]), np.concatenate([np.zeros(0), *far])


class _Found:
    """Pairs that a task finds: all different ones, or for every component the closest pair that leaves it."""

    def __init__(self, best: bool):
        self.best, self.parts, self.size = best, [], 0

    def add(self, u, v, part_u, part_v, far) -> None:
        swap = u > v
        self.parts.append([np.where(swap, v, u), np.where(swap, u, v), np.where(swap, part_v, part_u), np.where(swap, part_u, part_v), far])
        self.size += len(u)
        if self.size > 500_000:
            self.reduce()

    def reduce(self) -> np.ndarray:
        u, v, pu, pv, far = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 5
        if self.best:
            part, at = np.concatenate([pu, pv]), np.tile(np.arange(len(u)), 2)
            order = np.lexsort((v[at], u[at], far[at], part))
            first = order[np.r_[True, part[order][1:] != part[order][:-1]]] if len(order) else order
            kept = np.unique(at[first])
        else:
            _, kept = np.unique(np.stack([u, v], axis=1), axis=0, return_index=True)
        self.parts, self.size = [[c[kept] for c in (u, v, pu, pv, far)]], len(kept)
        return np.stack([u[kept], v[kept]], axis=1)


def pairs_by_sketch(lists: DataFrame, sets: DataFrame, similarity: float, best: bool) -> DataFrame:
    """(u, v), different: pairs of different components in ``lists`` that sketches allow: all, or for each component the closest that a
    task finds (``best``). A list is cut into blocks; a task holds the sketches of two. Short lists are worked on many at a time.
    Lists of one group tell the same pairs, so these travel packed and meet by their first node."""
    rows = lists.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), "blocks"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "node", "n", "part", (F.col("mine") > F.col("other")).cast("int").alias("side"))
    some = written(sets.select("node", "sketch").join(rows.select("node").distinct(), "node", "left_semi"))
    met = met.join(some, "node").select("task", "node", "n", "part", "side", "sketch")
    buckets = width(sets.sparkSession)

    def of_short(tables, found: _Found) -> None:
        table = pa.concat_tables(tables)
        key, node, n, part = (table.column(i).to_numpy() for i in range(4))
        pairs = list(cross_pairs(key, node, n, part, similarity, SHORT))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        known = dict(zip(node.tolist(), zip(table.column(5).to_pylist(), n.tolist(), part.tolist())))
        far = np.array([apart(*known[u][:2], *known[v][:2]) for u, v in pairs.tolist()])
        good = far <= most_apart(similarity)
        u, v = pairs[good].T
        found.add(u, v, *(np.array([known[x][2] for x in side.tolist()], np.int64) for side in (u, v)), far[good])

    def search(batches):
        found, short, waiting = _Found(best), [], 0
        for table in _tables(batches):
            if len(table) <= SHORT and not table.column(4).to_numpy().any():
                short.append(table)
                waiting += len(table)
                if waiting >= 20_000:
                    of_short(short, found)
                    short, waiting = [], 0
            else:
                node, n, part, side = (table.column(i).to_numpy() for i in (1, 2, 3, 4))
                i, j, far = sketch_pairs(node, n, part, side, table.column(5).to_pylist(), similarity)
                found.add(node[i], node[j], part[i], part[j], far)
        if short:
            of_short(short, found)
        pairs = found.reduce()
        bucket = (mixed(pairs[:, 0].view(np.uint64) if len(pairs) else np.zeros(0, np.uint64)) % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(bucket).tolist():
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "pairs": pa.array([np.ascontiguousarray(pairs[bucket == b]).tobytes()], pa.binary())})

    def unite(table):
        pairs = np.unique(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.column("pairs").to_pylist()]), axis=0)
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    told = met.repartition("task").sortWithinPartitions("task").mapInArrow(tidied(search), "bucket int, pairs binary")
    return told.groupBy("bucket").applyInArrow(unite, "u long, v long")


def connected(sets: DataFrame, bits: int, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes of ``sets`` that similar sets connect; nodes without a link are left out.

    ``known``: links (u, v) that were verified before.
    """
    digests = sets.groupBy("digest").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter("n > 1")
    links = written(sets.select("digest", F.col("node").alias("u")).join(digests, "digest").filter("u <> v").select("u", "v"))
    if known is None:  # every one of these links leads to the smallest node of its group
        roots = links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
    else:
        links = links.union(known)
        roots = grouped(links)
    lists = different_lists(written(postings(sets, bits, similarity)))

    def several():
        """Lists that hold several components, with them."""
        now = written(lists.join(roots, "node", "left").select("key", "node", "n", "members", F.coalesce("root", "node").alias("part")))
        parts = now.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
        return written(now.join(parts, "key", "left_semi"))

    tested = written(pairs_with_first(several(), similarity))
    links = links.union(verified(tested, sets, similarity))
    roots = grouped(links)
    for best in (True, False):  # the closest pair of each component first: it connects most of what is a link
        rows = several().filter("members > 2")
        if rows.isEmpty():
            break
        pairs = written(pairs_by_sketch(rows, sets, similarity, best).join(tested, ["u", "v"], "left_anti"))
        good = verified(pairs, sets, similarity, sketched=True)
        if not good.isEmpty():
            links = links.union(good)
            roots = grouped(links)
        tested = tested.union(pairs)
    return roots


def rows_with_sha(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = spread(docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")))
    return rows.select("id", F.unhex(F.sha2("text", 256)).alias("sha"), "text")


def set_components(docs: DataFrame, id_column: str, text_column: str, words: int, similarity: float, links=None) -> tuple[DataFrame, DataFrame]:
    """(judged, found): ``judged`` is (id, tag, sha, n, open) of every row, ``found`` (sha, root) of every text that may have partners.

    ``links``: function of the sets (node, n, hashes, ...) that gives links verified beforehand.
    """
    prepare(docs.sparkSession)
    rows = rows_with_sha(docs, id_column, text_column)
    amount = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = buckets_for(docs.sparkSession, amount // 6)
    judged = screened(rows, words, similarity, bits)
    sets = fetched_sets(rows, judged, words)
    roots = connected(sets, bits, similarity, links(sets) if links else None)
    found = written(sets.select("sha", "node").join(roots, "node", "left").select("sha", F.coalesce("root", "node").alias("root")))
    return judged, found


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row of ``docs``: the identifier, ``n_shingles``, ``component_id``.

    A set: the different ``words``-word shingles of the whole text, A-Z lower-cased (words stand between ASCII white space; fewer
    words: the whole sequence). Rows are linked if the Jaccard similarity of their sets is at least ``similarity`` (above 0.5);
    ``component_id`` is the smallest identifier that links lead to, the row's own included. Rows without words (null and empty texts)
    have no shingle and no link. Null identifiers are left out when the smallest is sought (a component of nothing else has a null
    id). Repeated rows are linked rows; an empty table gives none. Every link is found and verified on whole sets of 64-bit hashes.
    """
    judged, found = set_components(docs, id_column, text_column, words, similarity)
    is_open = judged.filter("open")
    rooted = written(join_hot(is_open.select("id", "sha", "n"), found, "sha", F.xxhash64("id")))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = join_hot(rooted, least, "root", F.xxhash64("id", "sha")).select("id", "n", "component_id")
    alone = judged.filter("NOT open").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")
