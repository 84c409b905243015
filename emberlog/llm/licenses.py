"""Licence scan: one Aho-Corasick pass finds notice phrases and identifier tags, a shunting-yard
parser evaluates the expressions behind the tags. Map only: nothing is shuffled."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from emberlog.llm.exact import _arrow
from emberlog.llm.inputs import id_type, texts, tidied

# The phrases every scan counts, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# More notice phrases of public licences, as words.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc",
    "licensed under creative commons": "cc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
# How much a licence family asks of those who pass the work on.
PERMISSIVE, WEAK, STRONG, UNKNOWN = 0, 1, 2, 3
FAMILY_RANK = {"mit": 0, "apache": 0, "bsd": 0, "isc": 0, "unlicense": 0, "cc0": 0, "zlib": 0, "mpl": 1, "lgpl": 1, "epl": 1, "cc": 1, "gpl": 2, "agpl": 2}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

SEPARATORS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_EXPRESSION = re.compile(r"spdx-license-identifier\s*:((?:[ \t]*[()]|[ \t]*[a-z0-9][a-z0-9.+:-]*)+)")
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")


def family(identifier: str) -> str:
    """``apache-2.0`` is of family ``apache``; families are the part before the first dash, digit or plus sign."""
    if identifier.startswith("cc0"):
        return "cc0"
    return re.match(r"[a-z]*", identifier)[0] or identifier


def rank(identifier: str) -> int:
    return FAMILY_RANK.get(family(identifier), UNKNOWN)


def parse(tokens: list[str]) -> list[str]:
    """The longest prefix of ``tokens`` that is an expression, in reverse Polish order (shunting-yard).

    An expression ends where an operand follows an operand (prose after the tag), or at an unmatched
    bracket; open brackets and dangling operators at the end are dropped.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in tokens:
        if token == "(" and operand_next:
            waiting.append(token)
        elif token == ")" and not operand_next and "(" in waiting:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in PRECEDENCE and not operand_next:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif token not in PRECEDENCE and token not in "()" and operand_next:
            out.append(token)
            operand_next = False
        else:
            break
    if operand_next and waiting:
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    return out + [w for w in reversed(waiting) if w != "("]


def evaluate(polish: list[str]) -> tuple[int, set[str]] | None:
    """(rank, families): ``or`` leaves the choice of the milder licence, ``and`` binds to the stricter,
    ``with`` (an exception) makes a strong licence weak. None for no expression."""
    stack: list[tuple[int, set[str]]] = []
    for token in polish:
        if token not in PRECEDENCE:
            stack.append((rank(token), {family(token)}))
            continue
        if len(stack) < 2:
            return None
        (r, b), (l, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((min(l, WEAK), a))
        else:
            stack.append((min(l, r) if token == "or" else max(l, r), a | b))
    return stack[0] if len(stack) == 1 else None


def automaton(phrases: dict[str, tuple]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, what in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, what))
    found.make_automaton()
    return found


def scan_text(text: str, found: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, expression rank, score) of one text."""
    lowered = text.encode("utf-8", "surrogatepass").lower()
    words = lowered.translate(SEPARATORS).split()
    line = b" ".join((b"", *words, b"")).decode("utf-8", "surrogatepass")
    base, labels, starts, score, tagged = set(), set(), [], 0.0, False
    for end, (back, (kind, label)) in found.iter(line):
        if kind == "base":
            starts.append(end - back)
            base.add(label)
            score = max(score, 0.6)
        elif kind == "notice":
            labels.add(label)
            score = max(score, 0.9)
        else:
            tagged = True
    worst = None
    if tagged:
        for match in _EXPRESSION.finditer(lowered.decode("utf-8", "surrogatepass")):
            got = evaluate(parse(_TOKEN.findall(match[1])))
            if got:
                worst, score = max(got[0], -1 if worst is None else worst), 1.0
                labels |= got[1]
    first = line.count(" ", 0, min(starts)) if starts else None
    last = line.count(" ", 0, max(starts)) if starts else None
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), worst, score


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``,
    ``expression_rank`` (0 permissive to 3 unknown, the strictest tag; null without a tag), ``score``.

    Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. Every place where the words of
    a phrase stand consecutively counts, overlaps too. A null text is empty: no words, labels "", score 0.
    Repeated rows and null identifiers give rows like any other; an empty table gives none.
    """
    phrases = {p: ("notice", label) for p, label in (NOTICE_PHRASES if notices is None else notices).items()}
    phrases |= {p: ("base", label) for p, label in (BASE_PHRASES if base is None else base).items()} | {TAG: ("tag", "")}
    arrow = pa.schema([("id", _arrow(docs, id_column)), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                       ("base_labels", pa.string()), ("labels", pa.string()), ("expression_rank", pa.int64()), ("score", pa.float64())])

    def scan(batches):
        found = automaton(phrases)
        for batch in batches:
            rows = [scan_text(t, found) for t in batch.column(1).to_pylist()]
            columns = zip(*rows) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:])], schema=arrow)

    kind = id_type(docs, id_column)
    return texts(docs, id_column, text_column).mapInArrow(tidied(scan), f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                                                          "labels string, expression_rank long, score double").withColumnRenamed("id", id_column)
