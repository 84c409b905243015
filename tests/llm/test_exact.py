import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.llm.exact import _merged, exact_duplicates

ROWS = [(5, "a"), (3, "a"), (9, "a"), (9, "a"), (1, ""), (2, None), (None, "b"), (None, "b"), (7, "B"), (8, "x" * 300_000), (4, "x" * 300_000), (6, "a ")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("parts", [1, 5])
def test_odd_rows(spark, keep, parts):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, digest int").repartition(parts)
    got = exact_duplicates(docs, keep=keep).collect()
    pick = max if keep == "largest" else min
    groups = {}
    for ident, text in ROWS:
        groups.setdefault(text or "", []).append(ident)
    best = {t: pick((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, best[t or ""], len(groups[t or ""]), sha(t or "")) for i, t in ROWS)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted(((best[t], sha(t)) for t in groups), key=str)


def test_normalised_and_many_places(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), (F.col("id") % 700).cast("string")).alias("text"))
    got = exact_duplicates(docs, normalised=F.lower("text"), fan_in=4, place_rows=20).collect()
    assert len(got) == 5000 and sum(r.kept for r in got) == 700
    assert all(r.keep_id % 700 == r.doc_id % 700 and r.keep_id + 700 >= 5000 and r.text_sha256 == sha(f"t{r.doc_id % 700}") for r in got)


def test_strings_as_identifiers_and_no_rows(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x")], "doc_id string, text string")
    assert {r.keep_id for r in exact_duplicates(docs).collect()} == {"b"}
    assert exact_duplicates(docs.limit(0)).collect() == []


def test_a_merge_keeps_sorted_runs_and_counts():
    runs = [[(b"a", 1, 4, 0, 2), (b"c", 1, 1, 1, 1)], [(b"a", 1, 7, 5, 1), (b"a", 2, 1, 9, 1)], []]
    assert _merged(runs, True) == [(b"a", 1, 7, 5, 3), (b"a", 2, 1, 9, 1), (b"c", 1, 1, 1, 1)]
