import random
import re
from collections import Counter

import pytest

from spindle.llm import op9_licences as op
from spindle.llm.queries import licences

from .edges import documents, empty

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_hand(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    found = [(i, label) for phrase, label in op.BASE.items() for i in range(len(words)) if words[i : i + len(p := phrase.split())] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, small, sf):
    place = small.replace("sf0.001", sf)
    rows = spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()
    got = licences(spark, place).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((d, *by_hand(t)) for d, t in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    notices = sum("GNU General Public License, version 3" in t for _, t in rows)
    assert sum("gpl-3" in r.labels.split(",") for r in got) == notices


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    more = [(20, "Under the MIT License under the mit license-CC BY-NC 4.0; Apache License, Version 2.0", None, None, 1), (21, "under themit license cc by-ncx éunder the mit license", None, None, 1)]
    docs = documents(spark, extra=extra)
    if not extra:
        docs = docs.union(spark.createDataFrame(more, docs.schema))
    assert Counter(tuple(r)[:6] for r in op.licences(docs).collect()) == Counter((r.doc_id, *by_hand(r.text)) for r in docs.collect())
    assert op.licences(empty(spark)).collect() == []


def test_overlapping_places():
    words = op.words_of("x cc by nc cc by nc sa creative commons attribution under the mit license version 2")
    assert [(a, p) for a, p in op.places(words)] == [(1, "cc by nc"), (4, "cc by nc"), (8, "creative commons attribution"), (11, "under the mit license")]


@pytest.mark.parametrize(
    ("expression", "rpn"),
    [
        ("MIT", ["mit"]),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]),
        ("(MIT OR GPL-2.0+) AND ISC", ["mit", "gpl-2.0+", "or", "isc", "and"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "or"]),
        ("MIT and more prose", ["mit", "more", "and"]),
        ("MIT */", ["mit"]),
        ("OR MIT", None),
        ("(MIT", None),
        ("MIT)", None),
        ("MIT OR", None),
        ("()", None),
        ("", None),
    ],
)
def test_shunting_yard(expression, rpn):
    assert op.postfix(expression) == rpn


@pytest.mark.parametrize(
    ("expression", "labels", "verdict"),
    [
        ("MIT OR GPL-3.0", {"mit", "gpl-3"}, True),
        ("MIT AND GPL-3.0", {"mit", "gpl-3"}, False),
        ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl-2"}, False),
        ("(MIT OR GPL-3.0) AND ISC", {"mit", "gpl-3", "isc"}, True),
        ("CC-BY-4.0 OR Nobody-knows", {"cc-by-4"}, True),
        ("Nobody-knows AND MIT", {"mit"}, False),
    ],
)
def test_evaluation(expression, labels, verdict):
    assert op.evaluate(op.postfix(expression)) == (labels, verdict)


def test_tags():
    row = op.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only\ncode")
    assert row[5] == "apache-2,gpl-3,mit" and row[7] == "mit apache-2.0 or gpl-3.0-only and" and row[8] is False
    assert op.scan("SPDX-License-Identifier: MIT OR")[5] == "mit" and op.scan("SPDX-License-Identifier: MIT OR")[8] is None


def test_two_tags_in_one_line():
    row = op.scan("a.c: SPDX-License-Identifier: MIT b.c: SPDX-License-Identifier: GPL-3.0 OR ISC c.c: spdx-license-identifier:Zlib")
    assert row[5] == "gpl-3,isc,mit,zlib" and row[7] == "mit; gpl-3.0 isc or; zlib" and row[8] is True
    assert op.scan("SPDX-License-Identifier:\nSPDX-License-Identifier: MIT")[5] == "mit"


def test_expressions_of_any_length():
    names = [f"LicenseRef-{i:04d}" for i in range(3000)]
    row = op.scan(f"SPDX-License-Identifier: ({' OR '.join(names)}) AND MIT\nGPL-2.0")
    assert row[5].split(",") == sorted([n.lower() for n in names] + ["mit"]) and row[8] is False
    tail = op.scan("SPDX-License-Identifier: (" + " " * 500 + "MIT AND ISC) SPDX-License-Identifier: BSL-1.0")
    assert tail[7] == "mit isc and; bsl-1.0" and tail[5] == "bsl-1,isc,mit"


def test_prose_after_a_malformed_expression_names_nothing():
    assert op.scan("SPDX-License-Identifier: (MIT OR ISC " + "some prose " * 100)[5] == "isc,mit"


def test_eighty_licences_in_one_expression():
    names = sorted(op.IDENTIFIERS)[-80:]
    assert len({op.label_of(n) for n in names}) == 80
    row = op.scan("SPDX-License-Identifier: " + " AND ".join(n.upper() for n in names))
    assert row[5].split(",") == sorted(map(op.label_of, names)) and row[8] is False


def test_prose_behind_a_tag_has_no_label():
    for text in ["(see the file for details of this", "see LICENSE", "see LICENSE OR ask", "and others", "unknown-1.0", "éMIT", "MITé"]:
        row = op.scan(f"SPDX-License-Identifier: {text}")
        assert row[5] == "" and row[6] == 0 and row[7] == "" and row[8] is None, text
    assert op.scan("SPDX-License-Identifier (MIT)")[5] == ""  # no colon, no tag
    assert op.scan("\u017fpdx-license-identifier: MIT")[5] == ""  # only A-Z are lowered
    assert op.scan("<!-- SPDX-License-Identifier: 'Apache-2.0'. -->")[5] == "apache-2"


def test_one_label_a_licence():
    for names, label in [("Apache-2.0", "apache-2"), ("GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later", "gpl-3"), ("LicenseRef-Own.1", "licenseref-own.1"), ("DocumentRef-a:LicenseRef-b", "documentref-a:licenseref-b"), ("Apache-2 GPL LICENSE", None)]:
        assert {op.label_of(n.lower()) for n in names.split()} == {label}


def choice(tokens):
    """(labels, permissive) of an expression by recursive descent; None where it is malformed."""
    tokens = list(tokens)

    def operand():
        if not tokens or tokens[0] in ("or", "and", "with", ")"):
            raise ValueError
        if (token := tokens.pop(0)) == "(":
            value = level("or")
            if not tokens or tokens.pop(0) != ")":
                raise ValueError
            return value
        return {op.label_of(token)} - {None}, op.label_of(token) in op.FREE

    def level(name):
        below = {"or": lambda: level("and"), "and": lambda: level("with"), "with": operand}[name]
        labels, free = below()
        while tokens and tokens[0] == name:
            tokens.pop(0)
            more, other = below()
            if name != "with":
                labels, free = labels | more, (free or other) if name == "or" else (free and other)
        return labels, free

    try:
        value = level("or")
        if tokens and tokens[0] in (")", "("):
            raise ValueError
        return value
    except ValueError:
        return None


def labels_by_hand(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    phrases = {**op.NOTICES, **op.BASE}
    found = {phrases[p] for p in phrases if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
    for line in lowered.split("\n"):
        for part in line.split("spdx-license-identifier")[1:]:
            if part.lstrip(" \t").startswith(":"):
                expression = part.lstrip(" \t")[1:]
                value = choice(op.tokens_of(expression))
                found |= value[0] if value else op.named_in(expression)
    return ",".join(sorted(found))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_labels_of_a_whole_table(spark, small, sf):
    place = small.replace("sf0.001", sf)
    rows = spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.labels) for r in licences(spark, place).collect()) == Counter((d, labels_by_hand(t)) for d, t in rows)


def test_random_expressions_against_recursive_descent():
    rng = random.Random(4)
    for _ in range(3000):
        tokens = rng.choices(["mit", "gpl-3.0", "isc", "nobody", "or", "and", "with", "(", ")"], k=rng.randint(1, 9))
        expression, value = " ".join(tokens), choice(tokens)
        rpn = op.postfix(expression)
        if value is None and rpn is not None:  # the parser ends where an operand follows an operand
            assert any(a not in "( or and with".split() and b not in ") or and with".split() for a, b in zip(tokens, tokens[1:]))
        else:
            assert (op.evaluate(rpn) if rpn else None) == value
