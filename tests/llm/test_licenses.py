import re

import pytest

from emberlog.llm.licenses import BASE_PHRASES, evaluate, parse, scan_licenses


def slow(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [None, "", "---", "MIT License", "the mit-license; MIT  LICENSE mit license", "GNU Lesser General Public License and General Public License", "amit license mit licenses",
         "éMIT License É mit\nlicense", "Apache\x00License apache_license", "general public general public license", "x " * 40_000 + "mit license",
         "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nfoo", "SPDX-License-Identifier: MIT this is prose",
         "// spdx-license-identifier: unknownthing", "SPDX-License-Identifier:", "SPDX-License-Identifier: ((MIT AND"]


def test_against_brute_force(spark):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    rows = [(i if i else None, t, "s") for i, t in enumerate(given + TEXTS)] + [(3, given[3], "s")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *slow(t)) for i, t, _ in rows), key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id - len(given): r for r in got if r.doc_id and r.doc_id >= len(given)}
    assert by[11].labels == "apache,gpl,mit" and by[11].expression_rank == 1 and by[11].score == 1.0
    assert by[12].labels == "mit" and by[12].expression_rank == 0 and by[13].expression_rank == 3 and by[14].expression_rank is None and by[15].labels == "mit"


@pytest.mark.parametrize("text, polish, value", [
    ("a or b and c", ["a", "b", "c", "and", "or"], None),
    ("( a or b ) and c", ["a", "b", "or", "c", "and"], None),
    ("gpl-2.0 with x or mit", ["gpl-2.0", "x", "with", "mit", "or"], (0, {"gpl", "mit"})),
    ("mit and gpl-3.0+", ["mit", "gpl-3.0+", "and"], (2, {"mit", "gpl"})),
    ("gpl-2.0 with x", ["gpl-2.0", "x", "with"], (1, {"gpl"})),
    ("mit the rest", ["mit"], (0, {"mit"})), ("mit or", ["mit"], (0, {"mit"})), ("mit )", ["mit"], (0, {"mit"})), ("or mit", [], None), ("", [], None), ("( mit", ["mit"], (0, {"mit"})),
])
def test_expressions(text, polish, value):
    assert parse(text.split()) == polish
    if value or not polish:
        assert evaluate(polish) == value


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
