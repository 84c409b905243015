import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm.merkle import build, folded, leaf_digest, merkle_manifest, node_position, sibling_digests

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_in(levels, i):
    out = []
    for level in levels[:-1]:
        out.append(level[i ^ 1] if i ^ 1 < len(level) else "")
        i >>= 1
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g])]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    want = []
    for n, g in enumerate(order):
        for i, (_, _, leaf) in enumerate(sorted(groups[g])):
            want.append((leaf, trees[g][-1][0], top[-1][0], "".join(path_in(trees[g], i) + path_in(top, n))))
    return sorted(want)


def manifest(docs, **more):
    return merkle_manifest(docs, leaf_digest([F.col(c) for c in COLUMNS]), F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "text": F.col("text")}, **more)


def check(spark, rows, bits, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string, number int")
    got = manifest(docs, bits=bits, **more).select("leaf", "subroot", "root", sibling_digests(F.col("proof")).alias("p"), folded(F.col("leaf"), F.col("proof")).alias("f")).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.p) for r in got) == brute(rows)
    assert all(r.f == r.root for r in got)


def test_positions_follow_the_log():
    for leaves in range(1, 70):
        digests = [f"{i:064x}" for i in range(leaves)]
        nodes, root = build(0, digests, 0, leaves, 10)
        assert [int(node_position(i, k, leaves)) for k, i, _ in nodes] == list(range(len(nodes)))
        assert root == levels_of(digests)[-1][0]
    assert node_position(np.array([0, 1]), 1, 4).tolist() == [2, 5]


def test_manifest_equals_plain_trees(spark):
    rng = random.Random(3)
    texts = [None, "", "a" * 200_000, "zwölf Boxkämpfer", "same", "same"]
    rows = [(i, rng.choice(["web", None, "ö"]), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([None, i]), rng.choice(texts)) for i in range(150)]
    rows += [rows[0], rows[0], (None, "web", "en", 1, "x"), (None, None, None, None, None), (7, "lone", "zz", 1, "x")]
    check(spark, rows, 2)
    check(spark, rows[:37], 3)


def test_small_tables_and_log(spark, tmp_path):
    check(spark, [(5, "s", "en", 1, "t")], 4)
    check(spark, [(5, "s", "en", 1, "t"), (6, "s", "de", 1, "t"), (7, "s", None, 1, "t")], 4)
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest(docs).collect() == []
    rows = [(i, "s", "en", i, "t") for i in range(21)]
    check(spark, rows, 2, log_path=str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log" / "groups")).filter("level >= 0").orderBy("position").collect()
    assert [r.position for r in log] == list(range(21 + 11 + 6 + 3 + 2 + 1))
    flat = levels_of([leaf_of(r) for r in rows])
    assert all(bytes(r.digest).hex() in flat[r.level] for r in log)


def test_tampered_leaf_is_found(spark):
    rows = [(i, "s", "en", i, "t") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = manifest(docs).select(folded(F.sha2(F.col("leaf"), 256), F.col("proof")).alias("f"), "root").collect()
    assert all(r.f != r.root for r in out)
