"""Licence scans: an Aho-Corasick automaton and a parser for licence expressions.

A text is brought to lower-case words with one blank between; one automaton finds all notice
phrases as whole words in one pass, wherever they overlap. Identifier tags are found by the
automata too; what follows a tag, up to the line's end or the next tag and however long, is a
licence expression, which a shunting-yard parser brings to postfix form, ``with`` binding before
``and`` and ``and`` before ``or``. It ends where a second operand follows an operand. Its
evaluation gives the licences named and whether some choice it offers is permissive throughout.
Only known identifiers and those of the form ``LicenseRef-...`` are licences; all ways of writing
one (``Apache-2.0``, ``GPL-3.0-or-later``) have one label, that of its notice.

Edge cases: null and empty texts have no words and no labels; a malformed expression gives
the known licences named in it and no verdict, one without a known licence nothing; repeated rows
are scanned each; a null ``doc_id`` is kept; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import UPPER, modest_batches, slices, text_of

#: Phrases of the contract and their labels; fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices and their labels; fixed values.
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "permission is hereby granted free of charge": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Licence identifiers, families with their versions and single ones, and the labels and families
#: whose licences let the text be used freely; fixed values.
VERSIONED = {
    "afl": "1.1 1.2 2.0 2.1 3.0", "agpl": "1.0 3.0", "apache": "1.0 1.1 2.0", "apsl": "1.0 1.1 1.2 2.0", "artistic": "1.0 2.0", "bsl": "1.0", "cc0": "1.0", "cc-by": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nc": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-nd": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-sa": "1.0 2.0 2.5 3.0 4.0", "cc-by-nd": "1.0 2.0 2.5 3.0 4.0", "cc-by-sa": "1.0 2.0 2.5 3.0 4.0",
    "cddl": "1.0 1.1", "cecill": "1.0 1.1 2.0 2.1", "cpal": "1.0", "cpl": "1.0", "ecl": "1.0 2.0", "epl": "1.0 2.0", "eupl": "1.0 1.1 1.2", "gfdl": "1.1 1.2 1.3", "gpl": "1.0 2.0 3.0", "ipl": "1.0",
    "lgpl": "2.0 2.1 3.0", "lppl": "1.0 1.1 1.2 1.3a 1.3c", "mpl": "1.0 1.1 2.0", "npl": "1.0 1.1", "odbl": "1.0", "odc-by": "1.0", "ofl": "1.0 1.1", "osl": "1.0 1.1 2.0 2.1 3.0", "pddl": "1.0",
    "php": "3.0 3.01", "psf": "2.0", "python": "2.0", "upl": "1.0", "zpl": "1.1 2.0 2.1", "blueoak": "1.0.0", "mulanpsl": "1.0 2.0", "unicode-dfs": "2015 2016", "sspl": "1.0", "busl": "1.1",
}
SINGLE = (
    "0bsd adsl afmparse aladdin apafml bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsd-source-code bzip2-1.0.6 caldera curl fsfap ftl hpnd icu ijg "
    "imagemagick intel isc jasper-2.0 json libpng libtiff mit mit-0 mit-cmu ms-pl ms-rl naumen ncsa openssl postgresql qhull ruby sgi-b-2.0 sleepycat tcl unlicense vim w3c wtfpl x11 xnet zlib zlib-acknowledgement"
)
PERMISSIVE = (
    "0bsd afl apache artistic-2 blueoak bsd bsd-1-clause bsd-2-clause bsd-3-clause bsl cc-by cc0 curl icu isc libpng mit mit-0 ms-pl ncsa odc-by pddl php postgresql psf python unlicense upl w3c x11 zlib zpl"
)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
RAW_TAG = "spdx-license-identifier"
_LOWER = str.maketrans(UPPER, UPPER.lower())
_TABLE = bytes(b if b >= 0x80 or chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else ord(chr(b).lower()) if chr(b) in UPPER else 0x20 for b in range(256))
_COLON = re.compile(r"[ \t]*:")
_TOKEN = re.compile(r"[()]|[^\s()]+")
_OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
#: What may stand around an identifier in comments and prose.
_AROUND = "\"'`*/<>#!;,.:-{}[]|"
IDENTIFIERS = frozenset(SINGLE.split()) | {f"{family}-{v}" for family, versions in VERSIONED.items() for v in versions.split()}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, TAG: "tag"}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def words_of(text: str) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of everything that isn't ASCII."""
    return text.encode().translate(_TABLE).split()


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, phrase) wherever a phrase's words stand consecutively."""
    joined = " " + b" ".join(words).decode("latin-1") + " "
    found, at, seen = [], 0, 0
    for end, phrase in _automaton().iter(joined):
        # the words before a place are counted from the last place on
        start = end - len(phrase) - 1
        if start >= at:
            seen += joined.count(" ", at, start)
            at = start
            found.append((seen, phrase))
        else:  # a longer phrase that began before the last place
            found.append((seen - joined.count(" ", start, at), phrase))
    return found


@lru_cache(maxsize=1)
def _tags():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word(RAW_TAG, len(RAW_TAG))
    found.make_automaton()
    return found


def expressions_of(text: str) -> Iterator[str]:
    """What follows each tag and its colon, up to the end of the line or the next tag, lowered."""
    text = text.translate(_LOWER)
    ends = [end + 1 for end, _ in _tags().iter(text)]
    for end, following in zip(ends, [*ends[1:], None], strict=True):
        if colon := _COLON.match(text, end):
            limit = len(text) if following is None else following - len(RAW_TAG)
            line = text.find("\n", colon.end(), limit)
            yield text[colon.end() : limit if line < 0 else line]


@lru_cache(maxsize=4096)
def label_of(identifier: str) -> str | None:
    """The label of a known licence identifier, else None: without ``.0``, ``+``, ``-only``, ``-or-later``.

    So every way of writing a licence has one label, the one that notices have.
    """
    if _OWN.fullmatch(identifier):
        return identifier
    name = identifier.removesuffix("+").removesuffix("-only").removesuffix("-or-later")
    return name.removesuffix(".0") if name in IDENTIFIERS else None


FREE = frozenset(PERMISSIVE.split()) | {label_of(f"{family}-{v}") for family in PERMISSIVE.split() for v in VERSIONED.get(family, "").split()}


def tokens_of(expression: str) -> list[str]:
    """Brackets, operators and operands, lowered; an operand is the whole run between blanks and brackets."""
    return [t for found in _TOKEN.finditer(expression.translate(_LOWER)) if (t := found[0] if found[0] in "()" else found[0].strip(_AROUND))]


def named_in(expression: str) -> set[str]:
    """The known licences of a malformed expression, up to where an operand follows an operand."""
    named: set[str | None] = set()
    operand = False
    for token in tokens_of(expression):
        if token in PRECEDENCE:
            operand = False
        elif token not in "()":
            if operand:
                break
            named.add(label_of(token))
            operand = True
    return named - {None}


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: an expression in postfix order, or None where it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last token ended an operand
    for token in tokens_of(expression):
        if token in PRECEDENCE:
            if not operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif operand:
            break  # the expression has ended; what follows is the line's prose
        else:
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(rpn: list[str]) -> tuple[set[str], bool]:
    """The labels of an expression's known licences, and whether one of its choices is permissive throughout.

    An unknown operand has no label and is not permissive. ``with`` adds an exception to the
    licence on its left and changes neither.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in rpn:
        if token in PRECEDENCE:
            (right, r), (left, l_) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, l_))
                continue
            less, more = sorted((left, right), key=len)
            more |= less  # the larger set grows, so that long expressions stay cheap
            stack.append((more, l_ and r if token == "and" else l_ or r))
        else:
            label = label_of(token)
            stack.append(({label} if label else set(), label in FREE))
    return stack[-1]


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive."""
    words = words_of(text)
    found = places(words)
    base = [(at, BASE[p]) for at, p in found if p in BASE]
    labels = {label for _, label in base} | {NOTICES[p] for _, p in found if p in NOTICES}
    verdicts = [label in FREE for label in sorted(labels)]
    expressions = []
    if any(p == TAG for _, p in found):
        for expression in expressions_of(text):
            rpn = postfix(expression)
            named, verdict = evaluate(rpn) if rpn else (named_in(expression), False)
            labels |= named
            if rpn and named:  # without a known licence it is prose
                verdicts.append(verdict)
                expressions.append(" ".join(rpn))
    evidence = len(expressions) * 2 + sum(p != TAG for _, p in found)
    score = 1 - 0.5 ** min(evidence, 50)  # each piece of evidence halves the doubt
    starts = [at for at, _ in base]
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)),
        score, "; ".join(expressions), all(verdicts) if verdicts else None,
    )


FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expressions": pa.string(), "permissive": pa.bool_()}


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A scan of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [scan(t.as_py()) for t in batch[1]]
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(FIELDS.values()))], ["doc_id", *FIELDS])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean"
    modest_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
