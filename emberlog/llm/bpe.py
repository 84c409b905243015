"""Byte-pair encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; its mergeable pairs wait in a priority queue by merge
rank, leftmost first. An entry whose pair has changed since is stale and skipped when it comes up.
Decoding concatenates the byte strings of the vocabulary.

Invented and rare words make up a good part of any corpus, so each worker remembers what it has
encoded, word by word, in two generations of bounded size.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from emberlog.llm.exact import _arrow
from emberlog.llm.inputs import id_type, prepare, texts, tidied

# Fixed value: how byte-level vocabularies cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 150_000
_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_SHIFT, _SHORT = 32, 13
_MARKS = frozenset(".,;:!?")
# Below are letters that every version of Unicode knows.
_LATIN = "\u0250"


def segments(text: str) -> list[str]:
    """``text`` cut at every single space before a visible character. No word crosses such a cut:
    the space belongs to the word behind it. All parts but the first have lost that space."""
    return _CUT.split(text) if _LOOSE_SPACE.search(text) else text.split(" ")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered(dict):
    """What ``make`` gave for a key. Two generations of at most ``limit`` keys each."""

    def __init__(self, make, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        return self.remember(key, self.make(key) if value is None else value)

    def remember(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """Merge ranks and token strings of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        ids, symbol = content["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for token, i in ids.items():
            self.strings[i] = bytes(symbol[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        of_bytes = {s: i for i, s in enumerate(self.strings) if i not in self.special.values()}
        self.start = [of_bytes[bytes([b])] for b in range(256)]
        self.made, self.rank = [], [{} for _ in range(size)]  # of each left symbol: the merge rank by its right neighbour
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]):
            self.rank[ids[left]].setdefault(ids[right], len(self.made))
            self.made.append(ids[left + right])
        self.rank_of = [d.get for d in self.rank]
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = Remembered(self._word)
        self.head = Remembered(self._segment, REMEMBERED // 8)
        self.behind_space = Remembered(self._behind_space)

    def forget(self) -> None:
        """Drop what was remembered; a worker that goes on to other tasks needs its memory."""
        for book in (self.word, self.head, self.behind_space):
            book.clear()
            book.old = {}

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one word."""
        start, rank, made = self.start, self.rank_of, self.made
        symbol = [start[b] for b in data]
        n = len(symbol)
        if n == 1:
            return symbol
        # A rank and a place in one number, which stays small for all but the longest words.
        shift = _SHORT if n < 1 << _SHORT else _SHIFT
        place = (1 << shift) - 1
        queue = [r << shift | i for i, (a, b) in enumerate(pairwise(symbol)) if (r := rank[a](b)) is not None]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            r, i = entry >> shift, entry & place
            if (j := after[i]) >= n or (s := symbol[i]) < 0 or rank[s](symbol[j]) != r:
                continue
            symbol[i] = s = made[r]
            symbol[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank[s](symbol[k])) is not None:
                    heappush(queue, r << shift | i)
            if (k := before[i]) >= 0 and (r := rank[symbol[k]](s)) is not None:
                heappush(queue, r << shift | k)
        return [s for s in symbol if s >= 0]

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.merge(word.encode())))

    def _behind_space(self, segment: str) -> bytes:
        """Letters alone are one word with the space before them, and a mark at their end is another: no pattern is asked."""
        body, end = (segment[:-1], segment[-1]) if segment[-1:] in _MARKS else (segment, "")
        if not body.isalpha() or max(body) >= _LATIN:
            return self._segment(" " + segment)
        return self.word[" " + body] + self.word[end] if end else self.word[" " + body]

    def _segment(self, segment: str) -> bytes:
        return b"".join(map(self.word.__getitem__, self.words.findall(segment)))

    def plain(self, text: str) -> bytes:
        first, *rest = segments(text)
        return self.head[first] + b"".join(map(self.behind_space.__getitem__, rest)) if rest else self.head[first]

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers; special tokens in it are tokens."""
        if self.specials is None or not any(s in text for s in self.special):
            return self.plain(text)
        out = []
        for i, part in enumerate(self.specials.split(text)):
            out.append(np.uint32(self.special[part]).astype("<u4").tobytes() if i % 2 else self.plain(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def bpe_encode(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text", decoded: str | None = None) -> DataFrame:
    """Per row of ``docs``: the identifier, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit), and, if ``decoded``
    names a column, the text that decoding the ids gives, from the same pass.

    A null text is empty and has no tokens. Repeated rows and null identifiers give rows like any
    other; an empty table gives none. The vocabulary file must be at ``vocabulary_path`` on every worker.
    """
    arrow = pa.schema([("id", _arrow(docs, id_column)), ("n_tokens", pa.int64()), ("ids", pa.binary())] + [("decoded", pa.string())] * bool(decoded))

    def encode(batches):
        book = vocabulary(vocabulary_path)
        try:
            for batch in batches:
                ids = [book.encode(t) for t in batch.column(1).to_pylist()]
                back = [pa.array([book.decode(x) for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *back], schema=arrow)
        finally:
            book.forget()

    fields = f"id {id_type(docs, id_column)}, n_tokens long, ids binary" + ", decoded string" * bool(decoded)
    encoded = texts(docs, id_column, text_column).mapInArrow(tidied(encode), fields).withColumnRenamed("id", id_column)
    return encoded.withColumnRenamed("decoded", decoded) if decoded else encoded


def bpe_decode(encoded: DataFrame, vocabulary_path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """``encoded`` with the text its ids stand for. Null ids give an empty text."""
    prepare(encoded.sparkSession)
    columns = [c for c in encoded.columns if c != text_column]
    at = columns.index(ids_column)

    def decode(batches):
        book = vocabulary(vocabulary_path)
        for batch in batches:
            text = pa.array([book.decode(x or b"") for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*columns, text_column])

    kept = encoded.select(*columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{text_column}` string"])
    return kept.mapInArrow(tidied(decode), schema)
