"""Token files for training: flat unsigned integers plus 64-bit document offsets.

Documents are laid out by range of identifier; every partition encodes its own and writes two files:

    tokens-00007.bin   the ids, little-endian unsigned, 2 bytes each if the vocabulary fits, else 4
    tokens-00007.idx   n (uint64), n + 1 offsets (uint64, in ids), n identifiers (int64), n null flags (uint8)

``manifest.json`` lists the parts with their bases: the prefix sums of the parts' token counts. A
document starts at its part's base plus its offset. Readers map the files into memory where the
folder is local and read them through its filesystem elsewhere.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import lru_cache
from itertools import accumulate, compress, pairwise
from operator import not_

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.bpe import Remembered
from emberlog.llm.inputs import prepare, tidied, width

OUT_BYTES = 4_000_000
TEXT_BYTES = 8_000_000
ASKED = 500
REMEMBERED, LONG = 600_000, 100
# Fixed value: how byte-level vocabularies write a space.
SPACE = "\u0120"
SPACES = [int.from_bytes(c.encode(), "big") for c in map(chr, range(0x80, 0x10000)) if c.isspace()]


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    """Of each byte, whether it is in one of ``ranges``."""
    return np.array([any(a <= b <= z for a, z in ranges) for b in range(256)])


# Bytes that open a space of several bytes (and much else).
OPENS_SPACE = _table((0xC2, 0xC2), (0xE1, 0xE3))
ALNUM = _table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
MARK = _table((0x21, 0x7E)) & ~ALNUM
# Two bytes that open with this one are letters, but for two marks (times, divided); none is a space.
LATIN, NO_LETTERS = 0xC3, _table((0x97, 0x97), (0xB7, 0xB7))
VISIBLE = _table((0x21, 0x7E), (LATIN, LATIN))


def _before_visible(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a visible character stands behind each place (none is the last) of UTF-8 ``data``."""
    visible = data[at + 1] > 32
    doubtful = np.flatnonzero(OPENS_SPACE[data[at + 1]])
    first, second, third = (data[np.minimum(at[doubtful] + i, len(data) - 1)].astype(np.int64) for i in (1, 2, 3))
    visible[doubtful] = ~np.isin(first << 8 | second, SPACES) & ~np.isin(first << 16 | second << 8 | third, SPACES)
    return visible


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where texts, one behind the other in UTF-8 ``data``, may be cut, since no word of a byte-level vocabulary crosses these
    places: their ``bounds``, single spaces before a visible character (a space belongs to the word behind it), marks behind a
    letter or digit, line ends behind a visible character, and what follows such a line end if it is visible too."""
    cut = np.zeros(len(data) + 1, bool)
    spaces = np.flatnonzero(data[:-1] == 32)
    cut[spaces[_before_visible(data, spaces)]] = True
    cut[bounds[1:] - 1] = False  # what stands behind a text's last space is another text
    letter = ALNUM[data]
    letter[1:] |= (data[:-1] == LATIN) & ~NO_LETTERS[data[1:]]
    cut[1:-1] |= letter[:-1] & MARK[data[1:]]
    lines = 1 + np.flatnonzero(data[1:-1] == 10)
    lines = lines[VISIBLE[data[lines - 1]] | letter[lines - 1]]
    cut[lines] = True
    cut[1 + lines[VISIBLE[data[lines + 1]]]] = True
    cut[bounds] = True
    return np.flatnonzero(cut)


class Library:
    """The tokenizers library, asked once for each different word while it is remembered (very long ones are not).

    Some megabytes of text are cut at once where no word crosses the cut (``cuts``), equal parts are found by a dictionary
    over all of them, and the different ones that are not known go to the library, many in one text. A text that holds a
    special token goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known = Remembered(lambda word: self.apart([word])[0], REMEMBERED)
        self.line_end = self.ids(["\n"])[0]
        opens = (self.tokenizer.id_to_token(i) or "" for i in range(self.size))
        self.opens_word = np.array([token.startswith(SPACE) for token in opens])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def apart(self, words: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self.ids(words)]

    def behind_spaces(self, words: list[str]) -> list[bytes]:
        """Ids of each word, given with the space before it and without other spaces. They go to the library as one text: in it
        exactly the first token of a word opens with a space."""
        text = "".join(words)
        ids = self.ids([text])[0]
        first = np.flatnonzero(self.opens_word[ids])
        if len(first) != len(words) or self.has_special(text):
            return self.apart(words)
        data, ends = ids.tobytes(), [*(4 * first[1:]).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def lines(self, words: list[str]) -> list[bytes]:
        """Ids of each word at the start of a line; a single line end between words is a token of its own."""
        text = "\n".join(words)
        ids = self.ids([text])[0]
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(words) - 1 or self.has_special(text):
            return self.apart(words)
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)])]

    def different(self, words: list[str]) -> list[bytes]:
        """Ids of different words, from memory or from the library."""
        older = self.known.old
        found = list(map(self.known.get, words))
        open_: tuple[list[int], ...] = [], [], []
        for i in compress(range(len(words)), map(not_, found)):
            word = words[i]
            if (ids := older.get(word)) is not None:
                found[i] = self.known.remember(word, ids)
                continue
            bare = word.removeprefix(" ")
            open_[2 if bare.split() != [bare] else len(bare) == len(word)].append(i)
        for ask, at in zip((self.behind_spaces, self.lines, self.apart), open_):
            for k in range(0, len(at), ASKED):
                some = at[k:k + ASKED]
                for i, ids in zip(some, ask([words[i] for i in some])):
                    found[i] = self.known.remember(words[i], ids) if len(words[i]) <= LONG else ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TEXT_BYTES:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str]) -> list[bytes]:
        whole = {i: self.ids([t])[0].tobytes() for i, t in enumerate(texts) if self.has_special(t)}
        raw = [b"" if i in whole else t.encode() for i, t in enumerate(texts)]
        data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        if not len(data):
            return [whole.get(i, b"") for i in range(len(texts))]
        at = cuts(data, bounds)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        words = self.different(parts.dictionary.cast(pa.large_string()).to_pylist())
        ids, size = np.frombuffer(b"".join(words), "<u4"), np.array(list(map(len, words)), np.int64) // 4
        part = parts.indices.to_numpy()
        size, begin = size[part], (np.cumsum(size) - size)[part]
        ends = np.cumsum(size)
        taken = np.repeat(begin - ends + size, size)
        taken += np.arange(len(taken))
        found, ends = ids[taken].tobytes(), 4 * np.r_[0, ends][np.searchsorted(at, bounds)]
        return [whole.get(i, found[a:b]) for i, (a, b) in enumerate(pairwise(ends.tolist()))]


@lru_cache(maxsize=4)
def library(path: str) -> Library:
    return Library(path)


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _stem(part: int) -> str:
    return f"tokens-{part:05d}"


def write_tokens(docs: DataFrame, folder: str, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int | None = 0) -> dict:
    """Encode every text with the tokenizers library and write it below ``folder``; returns the manifest.

    Documents stand in ascending order of identifier (an integer; nulls first; equal identifiers by
    text), each closed by ``end_id`` if that is given. A null text is empty. An empty table gives
    parts without documents. A part is written under another name and then renamed, so a task that
    runs twice leaves one whole part.
    """
    spark = docs.sparkSession
    prepare(spark)
    if docs.schema[id_column].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("token files need integer identifiers")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    parts = max(width(spark), rows.rdd.getNumPartitions())
    store, top = _at(folder)
    store.create_dir(top, recursive=True)

    def write(batches):
        from pyspark import TaskContext
        part, book = TaskContext.get().partitionId(), library(vocabulary_path)
        kind = "<u2" if max(book.size - 1, end_id or 0) < 1 << 16 else "<u4"
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        store, top = _at(folder)
        temporary = f"{top}/.{_stem(part)}-{uuid.uuid4().hex}"
        ids, lengths = [], [0]
        with store.open_output_stream(f"{temporary}.bin") as out:
            for batch in batches:
                ids += batch.column(0).to_pylist()
                for tokens in book.encode(batch.column(1).to_pylist()):
                    tokens = np.frombuffer(tokens + end, "<u4").astype(kind)
                    out.write(tokens.tobytes())
                    lengths.append(len(tokens))
        offsets = np.cumsum(lengths, dtype="<u8")
        with store.open_output_stream(f"{temporary}.idx") as out:
            for column in (np.array([len(ids)], "<u8"), offsets, np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], "u1")):
                out.write(column.tobytes())
        for ending in ("bin", "idx"):
            store.move(f"{temporary}.{ending}", f"{top}/{_stem(part)}.{ending}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([len(ids)], pa.int64()),
                                          "tokens": pa.array([int(offsets[-1])], pa.int64()), "bytes": pa.array([int(kind[-1])], pa.int32())})

    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    made = sorted(ordered.mapInArrow(tidied(write), "part int, docs long, tokens long, bytes int").collect())
    bases = [0, *accumulate(r.tokens for r in made)]
    manifest = {"token_bytes": made[0].bytes if made else 4, "docs": sum(r.docs for r in made), "tokens": bases[-1],
                "parts": [{"part": r.part, "docs": r.docs, "tokens": r.tokens, "base": b} for r, b in zip(made, bases)]}
    with store.open_output_stream(f"{top}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _mapped(store: fs.FileSystem, path: str, kind: str, start: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` numbers (all that follow) from byte ``start``: mapped into memory if the file is local."""
    size = store.get_file_info(path).size
    count = (size - start) // np.dtype(kind).itemsize if count is None else count
    if not count:
        return np.empty(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r", start, (count,))
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read_at(count * np.dtype(kind).itemsize, start), kind)


def read_part(folder: str, part: int, token_bytes: int):
    """(identifier, offset in the part, ids) of each document of a part, in order."""
    store, top = _at(folder)
    index = f"{top}/{_stem(part)}.idx"
    n = int(_mapped(store, index, "<u8", 0, 1)[0])
    offsets = _mapped(store, index, "<u8", 8, n + 1)
    ids = _mapped(store, index, "<i8", 8 * (n + 2), n)
    nulls = _mapped(store, index, "u1", 8 * (2 * n + 2), n)
    tokens = _mapped(store, f"{top}/{_stem(part)}.bin", f"<u{token_bytes}")
    for i in range(n):
        yield None if nulls[i] else int(ids[i]), int(offsets[i]), tokens[int(offsets[i]):int(offsets[i + 1])]


def read_tokens(spark: SparkSession, folder: str, id_column: str = "doc_id") -> DataFrame:
    """The documents of a folder that ``write_tokens`` made, from its files: the identifier, ``start``
    (ids of all documents before it), ``n_tokens``, ``ids`` (binary, unsigned 32-bit)."""
    store, top = _at(folder)
    with store.open_input_stream(f"{top}/manifest.json") as file:
        manifest = json.loads(file.read())
    bases, token_bytes = {p["part"]: p["base"] for p in manifest["parts"]}, manifest["token_bytes"]
    arrow = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows, held = [], 0
                for ident, offset, tokens in read_part(folder, part, token_bytes) if part in bases else ():
                    rows.append((ident, bases[part] + offset, len(tokens), tokens.astype("<u4").tobytes()))
                    held += 4 * len(tokens)
                    if held >= OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    parts = max([0, *bases]) + 1
    return spark.range(0, parts, 1, parts).mapInArrow(tidied(read), "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_column)
