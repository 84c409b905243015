import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm.langid import GRAMS_PER_LANGUAGE, LEAST_RATE, RELATIVE, UNKNOWN, grams, identify, in_a_language, judge, make_filters, train


def test_grams():
    assert len(grams("abc")) == 2 and len(grams("Abc")) == 2 and (grams("ABC") == grams("abc")).all()
    assert len(grams("ab, cd!")) == 2 and len(grams("")) == len(grams("12 34")) == 0
    assert (grams("ab   ... cd") == grams("ab cd")).all()


def test_filters_return_all_languages_and_correct_for_accidents():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-2**62, 2**62, 3000), rng.integers(-2**62, 2**62, 3000)
    filters = make_filters([("a", a.tolist()), ("b", np.r_[b, a[:100]].tolist())])
    from emberlog.llm.langid import _bits
    bits = _bits(a.view(np.uint64), filters)
    bits = bits[:, 0]
    assert (bits & 1).all() and (bits[:100] & 2).all() and np.mean(bits[100:] & 2 > 0) < 0.05
    other = _bits(rng.integers(0, 2**63, 20000, dtype=np.uint64), filters)[:, 0]
    assert np.mean(other & 1 > 0) == pytest.approx(filters.accidents[0], abs=0.01)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.expr("crc32(cast(doc_id as string)) % 5 = 0")
    filters = train(docs.filter(~held))
    got = identify(docs, filters, keep=held).join(docs.select("doc_id", "lang"), "doc_id").filter("keep").collect()
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(docs.count()))
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    again = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs.repartition(3), train(docs.filter(~held).repartition(5))).collect()}
    assert all(again[r.doc_id] == (r.lang_pred, r.score) for r in got)


def test_odd_texts(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "and", "here", "there"]) for _ in range(30)), "en", True) for i in range(20)]
    rows += [(100 + i, " ".join(rng.choice(["und", "nicht", "heiter", "eins"]) for _ in range(30)), "de", False) for i in range(20)]
    rows += [(200, None, "en", True), (201, "", None, None), (202, "123 !!! \n", "de", None), (203, "x", "en", None), (None, "nicht und", None, None), (204, "the there " * 50_000, None, None), (204, "the there " * 50_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score boolean")
    filters = train(docs)
    got = {(r.doc_id): r for r in identify(docs, filters).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202)] == [UNKNOWN] * 3 and got[203].lang_pred in ("en", "de")
    assert got[None].lang_pred == "de" and got[204].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    kept = [r.doc_id for r in in_a_language(docs, filters, 0.15).collect()]
    assert sorted(kept, key=str) == sorted([r[0] for r in rows if r[0] not in (200, 201, 202)], key=str)
    assert judge("the", train(docs.limit(0))) == (UNKNOWN, 0.0)
    assert identify(docs.limit(0), filters).collect() == []


def plain(rows):
    """Per language its n-grams, by the rule alone: exact sets, no filter."""
    counts = {}
    for text, lang in rows:
        if lang is not None and text is not None:
            of = counts.setdefault(lang, {})
            for h in grams(text).tolist():
                of[h] = of.get(h, 0) + 1
    totals = {lang: sum(of.values()) for lang, of in counts.items()}
    highest = {}
    for lang, of in counts.items():
        for h, n in of.items():
            highest[h] = max(highest.get(h, 0), n / totals[lang])
    order = sorted((lang for lang in totals if totals[lang]), key=lambda lang: (-totals[lang], lang))
    sets = {}
    for lang in order:
        rates = {h: n / totals[lang] for h, n in counts[lang].items()}
        good = [h for h, r in rates.items() if r >= LEAST_RATE and r >= RELATIVE * highest[h]]
        sets[lang] = set(sorted(good, key=lambda h: (-rates[h], np.uint64(h).astype(np.int64)))[:GRAMS_PER_LANGUAGE])
    return sets


@pytest.mark.parametrize("languages", [3, 65, 300])
def test_predictions_equal_exact_sets(spark, languages):
    """Any number of languages; the prediction is that of exact n-gram sets unless accidental hits of the filter come close."""
    rng = random.Random(languages)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(40)] for _ in range(languages)]
    rows = [(i, " ".join(rng.choice(words[i % languages]) for _ in range(25)), f"l{i % languages}") for i in range(4 * languages)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sets = plain([(t, lang) for _, t, lang in rows])
    filters = train(docs)
    assert filters.languages == list(sets)
    for r in identify(docs, filters).collect():
        hashes = grams(rows[r.doc_id][1]).tolist()
        shares = {lang: sum(h in s for h in hashes) / len(hashes) for lang, s in sets.items()}
        best = max(shares, key=shares.get)
        assert r.lang_pred == best == rows[r.doc_id][2] and r.score == pytest.approx(shares[best], abs=0.02)


def test_nothing_learned_rejects_nothing(spark):
    """No labelled row, clashing column names, odd types: all rows stay, with all their columns."""
    schema = "doc_id long, text string, lang string, _score string, _lang_pred int, kept boolean, `a.b` int, s struct<`x y`:int>"
    rows = [(i, t, None, "s", 1, True, 2, (3,)) for i, t in enumerate(["a", "\u65e5", "whole words here", "12", None])]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, in_a_language(docs, train(docs), 0.15).collect())) == sorted(rows, key=lambda r: r[0])
    labelled = spark.createDataFrame([*rows, (9, "whole words here and there", "en", "s", 1, True, 2, (3,))], schema)
    kept = in_a_language(labelled, train(labelled), 0.15)
    assert kept.columns == labelled.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 9]
