import random
import re
from re import _constants as C
from re import _parser as parser

from peakframe.llm import license_scan as L

from ..conftest import SMALL
from .cases import awkward, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    """Base columns and the kept labels, word by word."""
    words = WORD.findall((text or "").translate(LOWER))
    joined = " ".join(words)
    starts = {0: 0}
    at = 0
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 1
    found = []
    for r in L.rules():
        for m in re.finditer(r["pattern"], joined):
            first = starts[m.start()]
            found.append((first, -(first + m[0].count(" ") + 1), r["class"], r["label"], r["weight"], r["base"]))
    found.sort()
    base = [f for f in found if f[5]]
    reach, labels, doubt = [-1, -1, -1], [], 1.0
    for start, back, strength, label, weight, _ in found:
        if any(strength >= k and -back <= reach[k] for k in range(3)):
            continue
        reach[strength] = max(reach[strength], -back)
        labels.append(label)
        doubt *= 1 - weight
    own = sorted({f[3] for f in base})
    return (len(words), len(base), base[0][0] if base else None, max((f[0] for f in base), default=None), ",".join(own), ",".join(sorted({*labels, *own})), round(1 - doubt, 6))


def test_equals_brute_force(spark):
    texts = [
        "Released under the MIT License.", "CC BY, cc-by CC BY-NC 4.0", "GNU General Public License, version 3 or the GNU general public license", "SPDX-License-Identifier: Apache-2.0 " * 30, "mit\x00LICENSE mit-license's",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "Copyright (c) 2020 X. All rights reserved.", "Äpache license apacheé license K mit license",
    ]
    for docs in (awkward(spark, texts), spark.read.parquet(f"{SMALL}/documents.parquet")):
        want = sorted(((r.doc_id is not None, r.doc_id or 0, *map(str, brute(r.text))) for r in docs.collect()))
        got = sorted((r.doc_id is not None, r.doc_id or 0, str(r.n_words), str(r.n_base), str(r.first_word), str(r.last_word), r.base_labels, r.labels, str(r.score)) for r in L.scan(docs).collect())
        assert got == want


def test_rules_are_sound():
    rules = L.rules()
    assert len(rules) > 250
    for r in rules:  # the keyword is in whatever the rule matches
        assert re.search(rf"(?<![a-z0-9]){r['keyword']}(?![a-z0-9])", r["pattern"].replace("[sc]", "s" if "licens" in r["keyword"] else "c")) or r["keyword"] in r["pattern"], r


def _sample(parsed, rng):
    """A random string that the parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.IN:
            kind, value = rng.choice(arg)
            out += "x" if kind is C.NEGATE else chr(value if kind is C.LITERAL else rng.randint(*value))
        elif op is C.NOT_LITERAL:
            out += "x"
        elif op is C.BRANCH:
            out += _sample(rng.choice(arg[1]), rng)
        elif op is C.SUBPATTERN:
            out += _sample(arg[3], rng)
        elif op is C.MAX_REPEAT:
            out += "".join(_sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert op is C.ASSERT_NOT, op
    return out


def test_matches_of_every_branch_hold_the_keyword():
    rng = random.Random(5)
    for r in L.rules():
        parsed = parser.parse(r["pattern"])
        for text in {_sample(parsed, rng) for _ in range(100)}:
            assert re.search(r["pattern"], text), (r, text)
            assert r["keyword"] in text.split(" "), (r, text)


def test_names_without_abbreviation(spark):
    texts = [
        "licensed under the Common Development and Distribution License", "Common Development and Distribution Licence", "SPDX-License-Identifier: CDDL-1.0", "CDDL version 1.0",
        "https://creativecommons.org/licenses/by/4.0", "http://creativecommons.org/licenses/by-sa/3.0/", "Zero-Clause BSD License", "released under the zero clause BSD", "0BSD license", "the GNU AGPLv3",
    ]
    got = {r.doc_id: r for r in L.scan(awkward(spark, texts)).collect() if r.doc_id and r.doc_id >= 100}
    for i, t in enumerate(texts):
        assert (got[100 + i].labels, got[100 + i].score) == brute(t)[5:], t
    assert [got[100 + i].labels for i in range(4)] == ["cddl-1.0"] * 4
    assert "cc-by" in got[104].labels.split(",") and "cc-by-sa" in got[105].labels.split(",") and "0bsd" in got[106].labels.split(",") and got[109].labels == "agpl"


def test_empty(spark):
    assert L.scan(empty(spark)).count() == 0
