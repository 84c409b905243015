"""Language identification by language-bitmask n-gram filters.

Training counts character n-grams per language over all labelled rows. An n-gram belongs to every
language in which it is frequent enough. A bit-sliced Bloom filter holds, for each slot, one bit per
language: n-gram and language set the language's bit in the n-gram's slots, and the bits common to
an n-gram's slots name all languages that contain it, in one look-up. A text's n-grams give a count
per language (popcounts of the slices); counts are corrected for the share of n-grams that a
language's slice would accept by accident, and the largest decides.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from emberlog.llm.exact import _arrow
from emberlog.llm.inputs import id_type, prepare, spread, tidied
from emberlog.llm.runs import mixed
from emberlog.session import written

GRAM = 4
SLOTS_PER_GRAM = 16
HASHES = 3
WORD = 64
LANES = 64
GRAMS_PER_LANGUAGE = 20_000
LEAST_RATE = 2e-6
RELATIVE = 0.1
UNKNOWN = "und"
BASE = 0xD1342543DE82EF95
PIECE = 1 << 18


class Filters(NamedTuple):
    languages: list[str]
    slots: np.ndarray
    accidents: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Hashes of the text's n-grams: lower-case letters, every other stretch of characters a gap, gaps at
    both ends. N-grams with a gap inside and n-grams of gaps alone are left out."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    kept = letter | np.r_[True, letter[:-1]]
    points, letter = np.where(letter, points, 32)[kept], letter[kept]
    n = len(points) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = []
    for at in range(0, n, PIECE):
        p, l = points[at:at + PIECE + GRAM - 1].astype(np.uint64), letter[at:at + PIECE + GRAM - 1]
        m = len(p) - GRAM + 1
        h = np.zeros(m, np.uint64)
        inside = np.ones(m, bool)
        for i in range(GRAM):
            h = h * np.uint64(BASE) + p[i:i + m]
            if 0 < i < GRAM - 1:
                inside &= l[i:i + m]
        out.append(mixed(h[inside]))
    return np.concatenate(out)


def _slots(hashes: np.ndarray, size: int):
    for i in range(HASHES):
        yield ((hashes >> np.uint64(21 * i)) & np.uint64(size - 1)).astype(np.int64)


def _bits(hashes: np.ndarray, filters: Filters) -> np.ndarray:
    """The languages, as bits of one or more words, that contain each n-gram."""
    found = None
    for slot in _slots(hashes, len(filters.slots)):
        found = filters.slots[slot] if found is None else found & filters.slots[slot]
    return found


def make_filters(counts: list[tuple[str, list[int]]]) -> Filters:
    """Filters of (language, hashes of its n-grams). A slot has one bit a language: a short word for few of them, several words for many."""
    size = 1 << max(10, (SLOTS_PER_GRAM * max([len(h) for _, h in counts], default=1)).bit_length())
    kind = next((k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(counts) <= n), np.uint64)
    slots = np.zeros((size, max(1, -(-len(counts) // WORD))), kind)
    filled = np.zeros(len(counts))
    for number, (_, hashes) in enumerate(counts):
        word, bit = number // WORD, kind(1 << number % WORD)
        for slot in _slots(np.array(hashes, np.int64).view(np.uint64), size):
            slots[slot, word] |= bit
        filled[number] = np.count_nonzero(slots[:, word] & bit) / size
    return Filters([language for language, _ in counts], slots, filled ** HASHES)


def _tallied(bits: np.ndarray, languages: int) -> np.ndarray:
    """How many n-grams each language contains."""
    one = bits.dtype.type
    return np.array([np.count_nonzero(bits[:, n // WORD] & one(1 << n % WORD)) for n in range(languages)])


def judge(text: str | None, filters: Filters) -> tuple[str, float]:
    """(language, score): score is the share of the text's n-grams that the language contains, corrected. ``und`` and 0
    for a text that is null or has no letter, or if no language was learned. Ties, and texts too short for an n-gram,
    go to the language first in ``filters`` (the most frequent in training)."""
    if not text or not filters.languages or not _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any():
        return UNKNOWN, 0.0
    hashes = grams(text)
    if not len(hashes):
        return filters.languages[0], 0.0
    counts = _tallied(_bits(hashes, filters), len(filters.languages))
    corrected = np.clip((counts / len(hashes) - filters.accidents) / np.maximum(1 - filters.accidents, 1e-9), 0, 1)
    best = int(np.argmax(corrected))
    return filters.languages[best], float(corrected[best])


def train(docs: DataFrame, text_column: str = "text", language_column: str = "lang", grams_per_language: int = GRAMS_PER_LANGUAGE) -> Filters:
    """Filters learned from every row with a text and a language.

    An n-gram belongs to a language if at least ``LEAST_RATE`` of the language's n-grams are it and its rate is at least
    ``RELATIVE`` of its highest rate in any language (stray foreign passages don't count); of more than
    ``grams_per_language`` those with the highest rates (equal ones by hash) are kept: that is the model's size.
    """
    prepare(docs.sparkSession)
    rows = spread(docs.select(F.col(language_column).cast("string").alias("lang"), F.col(text_column).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL"))

    def count(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def sums():
            for lang, parts in held.items():
                hashes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(hashes), pa.string()), "gram": pa.array(hashes.view(np.int64)), "n": pa.array(n.astype(np.int64))})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = grams(text)
                held.setdefault(lang, []).append(found)
                size += len(found)
                if size > 8_000_000:
                    yield from sums()
                    size = 0
        yield from sums()

    counts = rows.mapInArrow(tidied(count), "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = written(counts)
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals, key=lambda lang: (-totals[lang], lang))
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint8), np.zeros(0))
    rate = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(1.0 / totals[lang]))])
    rated = counts.withColumn("rate", F.col("n") * F.element_at(rate, F.col("lang"))).filter(F.col("rate") >= LEAST_RATE)
    per_gram = rated.groupBy("gram").agg(F.max("rate").alias("highest"), F.collect_list(F.struct("lang", "rate")).alias("of"))
    kept = written(per_gram.select("gram", "highest", F.explode("of").alias("x")).filter(F.col("x.rate") >= RELATIVE * F.col("highest")).select("gram", "x.lang", "x.rate"))
    best = [F.desc("rate"), F.col("gram")]
    laned = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod("gram", F.lit(LANES))).orderBy(*best))).filter(F.col("rank") <= grams_per_language)
    top = laned.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= grams_per_language)
    chosen: dict[str, list[int]] = {lang: [] for lang in languages}
    for r in top.select("lang", "gram").collect():  # the model: at most grams_per_language a language
        chosen[r.lang].append(r.gram)
    return make_filters(list(chosen.items()))


def identify(docs: DataFrame, filters: Filters, text_column: str = "text", id_column: str = "doc_id", keep: Column | None = None) -> DataFrame:
    """Per row of ``docs``: the identifier, ``keep`` (a boolean column, by default null), ``lang_pred``, ``score``.

    Whole texts are judged, by their text alone. Repeated rows and null identifiers give rows like any other; an empty table gives none.
    """
    prepare(docs.sparkSession)
    keep = F.lit(None).cast("boolean") if keep is None else keep
    rows = spread(docs.select(F.col(id_column).alias("id"), keep.alias("keep"), F.col(text_column).alias("text")))
    model = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slots, filters.accidents))
    arrow = pa.schema([("id", _arrow(docs, id_column)), ("keep", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def look(batches):
        known = Filters(*model.value)
        for batch in batches:
            found = [judge(t, known) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema=arrow)

    return rows.mapInArrow(tidied(look), f"id {id_type(docs, id_column)}, keep boolean, lang_pred string, score double").withColumnRenamed("id", id_column)


def in_a_language(docs: DataFrame, filters: Filters, least_score: float, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, in all their columns, that are not rejected.

    Rejected are texts without a letter (null and empty ones too), and texts of whose n-grams a share below ``least_score`` belongs to
    the language that fits best. Without evidence nothing is rejected: all rows stay if no language was learned, and a text with
    letters but without an n-gram (a letter or two) stays.
    """
    prepare(docs.sparkSession)
    if not filters.languages:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(tuple(filters))
    at = docs.columns.index(text_column)

    def kept(text: str | None, known: Filters) -> bool:
        language, score = judge(text, known)
        return language != UNKNOWN and (score >= least_score or not len(grams(text)))

    def look(batches):
        known = Filters(*model.value)
        for batch in batches:
            yield batch.filter(pa.array([kept(t, known) for t in batch.column(at).to_pylist()], pa.bool_()))

    plain = spread(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))))  # names with dots cannot be passed on
    return plain.mapInArrow(tidied(look), plain.schema).toDF(*docs.columns)
