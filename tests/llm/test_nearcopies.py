import random
from itertools import combinations

from emberlog.llm.nearcopies import near_copies


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def groups(rows):
    """Smallest identifier of each row's group, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) and similarity(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def words(rng, n):
    return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.group_id for r in near_copies(docs).collect()}


def test_copies_inside_a_family_of_shared_boilerplate(spark):
    """600 texts share 85 % of their words and are pairwise below the threshold; 60 of them have a copy close to it."""
    rng = random.Random(1)
    passage = words(rng, 340)
    rows = []
    for i in range(600):
        own = words(rng, 60)
        rows.append((len(rows), " ".join(own + passage)))
        if i % 10 == 0:
            copy = own + passage
            copy[100], copy[250] = words(rng, 2)
            rows.append((len(rows), " ".join(copy)))
    want = groups(rows)
    assert 60 == sum(want[i] != i for i in want) and found(spark, rows) == want


def test_family_linked_in_chains(spark):
    """Texts drift away from each other: most pairs of the family are not alike, and links go over a few members."""
    rng = random.Random(2)
    rows, text = [], words(rng, 300)
    for i in range(300):
        text = list(text)
        for _ in range(rng.randrange(1, 9)):
            text[rng.randrange(len(text))] = words(rng, 1)[0]
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    want = groups(rows)
    assert 2 < len(set(want.values())) < 300 and found(spark, rows) == want


def planted(rng, n, target):
    """Two texts of ``n`` words; the second is cut and changed until it is just at ``target`` or above."""
    a = words(rng, n)
    b = list(a)
    while True:
        c = list(b)
        c[rng.randrange(n)] = words(rng, 1)[0]
        if similarity(shingles(" ".join(a)), shingles(" ".join(c))) < target:
            return " ".join(a), " ".join(b)
        b = c


def test_every_pair_just_above_the_threshold_is_found(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        rows += [(len(rows) + k, t) for k, t in enumerate(planted(rng, 200, 0.80 + 0.05 * i / 200))]
    got = found(spark, rows)
    assert sum(got[i + 1] == i for i in range(0, len(rows), 2)) == 200 and all(got[i] == i for i in range(0, len(rows), 2))


def test_long_texts_near_the_threshold_are_decided_exactly(spark):
    """Texts of 600 to 2,000 shingles at 0.77 to 0.83: a cut at the end sets the similarity."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        n, share = rng.randrange(600, 2000), rng.uniform(0.77, 0.83)
        text = words(rng, n)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:4 + round((n - 4) * share)]))]
    want = groups(rows)
    assert 30 < sum(want[i] != i for i in want) < 90 and found(spark, rows) == want

