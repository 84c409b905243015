import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlog.llm.bpe import Remembered, Vocabulary, bpe_decode, bpe_encode
from emberlog.llm.tokenfiles import Library, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "Hello  world", "tabs\tand\nlines \n  x ", "it's we'll 'd", "ß é 漢字  x   y", "x<|endoftext|> y<|endoftext|>",
         "a" * 5000, "ab " * 30000, " lead", "trail ", "1 22 333a b2", "!!! ... $$$ %%%", "\x1c\x1f\x85 ᠎ ​ end", "🙂🙂 👩‍👩‍👧 ok", "line\r\n\r\n  indented"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_matches_the_library_and_round_trips(spark, library):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(3, "a", "again"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.decoded): r for r in bpe_decode(bpe_encode(docs, PATH), PATH).collect()}
    for ident, text, _ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        row = got[ident, text or ""]
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == want and row.n_tokens == len(want)
        assert row.decoded == library.decode(want, skip_special_tokens=False)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_decode(bpe_encode(docs, PATH), PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\tab'sl1.é字 \x85\x1c")), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_any_text(text):
    library, own, cached = _cached()
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == want
    assert np.frombuffer(cached.encode([text])[0], "<u4").tolist() == want
    assert own.decode(own.encode(text)) == text


_made = []


def _cached():
    if not _made:
        _made.extend((Tokenizer.from_file(PATH), Vocabulary(PATH), Library(PATH)))
    return _made


def test_every_character_class_as_the_library(library):
    own = Vocabulary(PATH)
    wrong = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000 and own.encode(t := f"a{chr(c)}b {chr(c)}1 {chr(c)} ") != np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert wrong == []


def test_plain_words_need_no_pattern(library):
    """Letters with a mark at their end are cut without the pattern, and give what the library gives."""
    own = Vocabulary(PATH)
    asked, pattern = [], own.words
    own.words = type("Asked", (), {"findall": staticmethod(lambda t: asked.append(t) or pattern.findall(t))})
    text = "Start one, größe! étude: x. Straße; ok? ɏ"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked == ["Start"]
    for text in ("x . a.. b., 'tis don't, it's. 12. 1a. ǅ, ʰ, ª. ٣, x٣. a² ½. ɐ. 漢字, -, .", "x  a, \n b. "):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [8190, 8191, 8192, 8193])
def test_words_where_places_outgrow_their_bits(library, n):
    text = "x " + ("abcab" * n)[:n]
    assert np.frombuffer(Vocabulary(PATH).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_remembered_stays_bounded():
    seen = Remembered(lambda k: k * 2, limit=10)
    assert [seen[i] for i in range(100)] == [2 * i for i in range(100)] and len(seen) <= 10 and len(seen.old) <= 10


def test_library_is_asked_once_for_a_word():
    """A word goes to the library once, however many lines and texts it opens."""
    book, asked = Library(PATH), []
    own = book.tokenizer
    book.tokenizer = type("Asked", (), {"encode_batch_fast": staticmethod(lambda texts, **kw: asked.extend(texts) or own.encode_batch_fast(texts, **kw))})
    texts = [f"Word{i} (so.\nZanzibar x{i},\nÉtude" for i in range(1000)]
    first = book.encode(texts)
    assert sum(t.count("Zanzibar") for t in asked) == 1 and sum(t.count("Étude") for t in asked) == 1
    asked.clear()
    assert book.encode(texts) == first and asked == []


def test_library_by_words_as_by_whole_texts(library):
    """Texts of odd parts in one call, each as the library encodes it whole."""
    parts = [" ", "  ", "\n", "\n\n", "\r\n", "\t", "\x0b", "\x1c", "\x7f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2009", "\u200b", "\u2028", "\u202f", "\u205f",
             "\u3000", "\u3042", "a", "The", "é", "ß", "×", "÷", "À", "ÿ", "²", "“", "”", "—", "§", "e\u0301", "漢", "🙂", "1", "22", ".", ",", "...", "'", "'s", "'ll", "$", "|", "<|", "<|endoftext|>", "endoftext|>", "\x00"]
    rng = np.random.default_rng(8)
    odds = np.r_[8, [1.0] * (len(parts) - 1)] / (len(parts) + 7)
    texts = ["", "x ", " y", "x\n", "\nY", "", " ", "\n", "z"] + ["".join(rng.choice(parts, rng.integers(0, 12), p=odds)) for _ in range(20_000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    book = Library(PATH)
    assert book.encode(texts) == want and book.encode(texts[::-1]) == want[::-1] and book.encode([]) == []


def test_long_words_are_not_remembered():
    book = Library(PATH)
    book.encode(["a" * 5000 + " b"])
    assert set(book.known) == {" b"}


def test_token_files(spark, library, tmp_path):
    rows = [(7, "b"), (None, "none"), (-3, None), (7, "a"), (7, "b"), (2, "long " * 20000), (9, "x<|endoftext|>y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = write_tokens(docs, str(tmp_path / "t"), PATH)
    got = sorted(read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (ident, text) in zip(got, want, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row.doc_id, row.start, row.n_tokens) == (ident, start, len(ids))
        assert zlib.crc32(bytes(row.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert manifest["tokens"] == start and manifest["docs"] == len(rows)


def test_token_files_of_nothing(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), PATH)
    assert read_tokens(spark, str(tmp_path / "e")).collect() == []


def test_digests(spark):
    from emberlog.llm.queries import op1_bpe_round_trip
    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op1_bpe_round_trip(spark, folder).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
