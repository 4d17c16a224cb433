"""Licence scan: Aho-Corasick over words for notice phrases and over raw text for identifier tags.

The text after an identifier tag is read as a licence expression (``and``, ``or``, ``with``,
parentheses) by a shunting-yard parser and evaluated to its labels and its permissiveness. An expression
ends where a word is no identifier: these are of a known family, have a version, or begin with LicenseRef-.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import table

#: Base phrases and labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: More notice phrases, in words.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "isc license": "isc",
    "boost software license": "bsl",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")
#: Permissiveness of a label's family; others get UNKNOWN.
PERMISSIVE = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "bsl": 1.0, "apache": 0.9, "cc-by": 0.8,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.2, "agpl": 0.1, "proprietary": 0.0, "unlicense": 1.0, "zlib": 1.0,
}
UNKNOWN = 0.4
#: What an exception (``with``) raises a licence to, at least.
WITH_LEAST = 0.6
WORD = re.compile(r"[()]|[A-Za-z0-9.+:_-]+")
#: Identifiers beyond known families: with a version at the end, or of the file's own.
VERSIONED = re.compile(r"[a-z]+(-[a-z]+)*-v?[0-9]+(\.[0-9]+)*(-only|-or-later|\+)?|licenseref-.+")
#: What follows ``with``.
EXCEPTION = re.compile(r".*exception.*|.+-[0-9]+(\.[0-9]+)*|additionref-.+")
#: What stands for no licence at all.
ABSENT = ("none", "noassertion")
NEXT_WORD = re.compile(r"[ \t]+([A-Za-z0-9][A-Za-z0-9.+:_-]*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: A-Z become a-z, what separates words becomes a space, all else stays.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def family(identifier: str) -> str:
    """The label of an identifier: ``gpl-3.0-or-later`` is ``gpl``; unknown ones stay as they are."""
    name = identifier.lower().rstrip("+")
    for label in sorted(PERMISSIVE, key=len, reverse=True):
        if name == label or name.startswith((f"{label}-", f"{label}.")):
            return label
    return name


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard; None if the tokens are no expression."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in tokens:
        low = token.lower()
        if token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(tokens: list[str]) -> tuple[frozenset[str], float] | None:
    """Labels of an expression and its permissiveness: ``and`` takes the lower, ``or`` the higher."""
    rest = postfix(tokens)
    if rest is None:
        return None
    stack: list[tuple[frozenset[str], float]] = []
    for token in rest:
        if token in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            if token == "with":
                stack.append((a[0], max(a[1], WITH_LEAST)))
            else:
                stack.append((a[0] | b[0], (min if token == "and" else max)(a[1], b[1])))
        else:
            label = family(token)
            stack.append((frozenset([label]), PERMISSIVE.get(label, UNKNOWN)))
    return stack[0]


def identifies(token: str, before: list[str], prose_next: bool) -> bool:
    """Whether a word that stands where an operand has to be is one, given the tokens before it and whether a plain word follows.

    NONE and NOASSERTION aren't. The first one after a tag is, whatever it is called, unless it and what follows are plain
    words. After an operator in capitals any name is; after one in small letters, where prose may go on, it has to look like an
    identifier of a licence or, after ``with``, of an exception.
    """
    low = token.lower()
    operator = next((t for t in reversed(before) if t.lower() in PRECEDENCE), None)
    if operator == "with":
        return bool(EXCEPTION.fullmatch(low))
    known = bool(VERSIONED.fullmatch(low)) or family(low) in PERMISSIVE or sum(map(str.isupper, token)) > 1
    if low in ABSENT or not any(c.isalpha() for c in low):
        return False
    if operator is None:
        return known or any(c.isdigit() for c in low) or not prose_next
    return known or operator.isupper()


def plain_word_at(text: str, at: int) -> bool:
    """Whether a word that is no operator comes next on the line."""
    found = NEXT_WORD.match(text, at)
    return found is not None and found[1].lower() not in PRECEDENCE


def expression_at(text: str, start: int) -> tuple[frozenset[str], float] | None:
    """The longest expression that begins at ``start`` and ends on the same line; one pass over it."""
    tokens: list[str] = []
    at, whole, depth, operand_next = start, 0, 0, True
    while True:
        while at < len(text) and text[at] in " \t\r":
            at += 1
        if (m := WORD.match(text, at)) is None:
            break
        token = m[0].rstrip(".:") if len(m[0]) > 1 else m[0]
        low = token.lower()
        opens = token == "("
        if operand_next != (opens or (token != ")" and low not in PRECEDENCE)):
            break
        if operand_next and not opens and not identifies(token, tokens, plain_word_at(text, m.end())):
            break
        depth += opens - (token == ")")
        if depth < 0:
            break
        tokens.append(token)
        operand_next = opens or low in PRECEDENCE
        if not operand_next and depth == 0:
            whole = len(tokens)
        at = m.end()
    return evaluate(tokens[:whole]) if whole else None


class Scan(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float


@cache
def automata():
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE).items():
        phrases.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: bytes | None) -> Scan:
    """Everything found in one whole text; the lowest permissiveness counts, and 0 without a finding."""
    text = text or b""
    phrases, tags = automata()
    words = text.translate(NORMAL).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    starts, base, labels, scores = [], set(), set(), []
    for end, (phrase, label, in_base) in phrases.iter(line):
        if in_base:
            starts.append(end - len(phrase) - 1)
            base.add(label)
        labels.add(label)
        scores.append(PERMISSIVE.get(label, UNKNOWN))
    first = line.count(" ", 0, min(starts)) if starts else None
    last = line.count(" ", 0, max(starts)) if starts else None
    lower = text.lower()
    if b"-expression:" in lower or b"-identifier:" in lower:
        whole, low = text.decode("utf-8", "replace"), lower.decode("utf-8", "replace")
        for end, _ in tags.iter(low):
            if (found := expression_at(whole, end + 1)) is not None:
                labels |= found[0]
                scores.append(found[1])
    return Scan(len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): where notices stand, labels and score.

    Null and empty texts have no words, empty labels and score 0. Rows that repeat an id or have none are scanned
    one by one; other columns don't matter. No shuffle: rows stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            columns = zip(*rows) if rows else ([] for _ in TYPES)
            yield pa.record_batch(
                [batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, TYPES))], ["doc_id", *Scan._fields]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, base places and labels, all labels, and score."""
    return license_scan(table(spark, sf_dir, "documents"))
