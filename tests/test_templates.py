"""Templates against a plain sequential tree: every line compared with every cluster of its leaf."""

import random

import pytest

from emberlog.operators import templates as tp

WILD = tp.WILD


class PlainTree:
    def __init__(self, depth, similarity):
        self.depth, self.similarity, self.leaves = depth, similarity, {}

    def add(self, line):
        tokens = line.split(" ")
        leaf = self.leaves.setdefault((len(tokens), *tokens[:max(self.depth - 2, 1)]), [])
        best, score = None, (-1, -1)
        for cluster in leaf:
            equal = sum(a == b and a != WILD for a, b in zip(cluster, tokens))
            if (equal, cluster.count(WILD)) > score:
                best, score = cluster, (equal, cluster.count(WILD))
        if best is not None and score[0] / len(tokens) >= self.similarity:
            best[:] = [a if a == b else WILD for a, b in zip(best, tokens)]
            return best
        leaf.append(tokens)
        return tokens


def plain(lines, depth, similarity):
    tree = PlainTree(depth, similarity)
    taken = [tree.add(line) for line in dict.fromkeys(lines)]
    final = dict(zip(dict.fromkeys(lines), (" ".join(c) for c in taken)))
    return [final[line] for line in lines]


def made(rng, n):
    kinds = [[rng.choice(["open", "close", "send", "drop"]), *(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 9)))] for _ in range(12)]
    out = []
    for _ in range(n):
        tokens = list(rng.choice(kinds))
        for _ in range(rng.randrange(0, 4)):
            tokens[rng.randrange(len(tokens))] = rng.choice([WILD, f"v{chr(97 + rng.randrange(20))}", "x"])
        out.append(" ".join(tokens))
    return out


@pytest.mark.parametrize("similarity", [0.0, 0.2, 0.4, 0.5, 0.75, 1.0])
def test_leaf_equals_comparing_all_clusters(similarity):
    rng = random.Random(int(similarity * 100))
    for _ in range(12):
        by_length = {}
        for line in dict.fromkeys(made(rng, 250)):
            by_length.setdefault(len(line.split(" ")), []).append(line)
        for size, lines in by_length.items():
            leaf, tree = tp._Leaf(size, similarity), PlainTree(0, similarity)
            tree.leaves = {(size, first): shared for shared in [[]] for first in {x.split(" ")[0] for x in lines}}
            numbers = [leaf.add(x.split(" ")) for x in lines]
            taken = [tree.add(x) for x in lines]
            assert [leaf.templates()[n] for n in numbers] == [" ".join(c) for c in taken]


def test_a_leaf_looks_at_few_clusters():
    """Two thousand clusters in one leaf: a line is compared with those that share a rare token only."""
    leaf, looked = tp._Leaf(8, 0.5), []
    for i in range(2000):
        leaf.add(["get", f"a{i}", f"b{i}", f"c{i}", f"d{i}", f"e{i}", f"f{i}", "end"])
    assert leaf.used == 2000
    for i in range(0, 2000, 97):
        numbers = [leaf.numbers[t] for t in ("get", f"a{i}", f"b{i}", f"c{i}", f"d{i}", f"e{i}", f"f{i}", "end")]
        looked.append(len(leaf._candidates(numbers)))
    assert max(looked) <= 1


@pytest.mark.parametrize("variant", [False, True])
def test_lines_get_the_templates_of_the_plain_tree(spark, variant):
    rng = random.Random(11)
    files = {"a": made(rng, 300), "b": made(rng, 200) + ["", None]}
    rows = [(f, n, i, line) for i, (f, n, line) in enumerate((f, n, x) for f, lines in files.items() for n, x in enumerate(lines))]
    df = spark.createDataFrame(rows, "source_file string, line_no long, row_id long, log string").repartition(5)
    mined = tp.mine_templates_variant(df, max_dist=0.6) if variant else tp.mine_templates(df)
    got = {r.row_id: r.log_template for r in mined.collect()}
    for f, lines in files.items():
        known = [x for x in lines if x]
        want = iter(plain(known, *((4, 0.4) if variant else (3, 0.5))))
        for r in rows:
            if r[0] == f:
                assert got[r[2]] == (next(want) if r[3] else "Unknown")
    assert any(WILD in t for t in got.values())
