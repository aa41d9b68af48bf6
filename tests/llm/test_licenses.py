import re

import pytest

from cairn.llm import licenses as L

from .helpers import awkward, documents


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def base(text):
    w = words(text)
    hits = [(k, label) for phrase, label in L.PHRASES.items() for p in [phrase.split()] for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    starts = [k for k, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def labels(text):
    """All rules over the text, those within a better or equal one left out, and the base labels."""
    u = " " + " ".join(words(text)) + " "
    found = {(m.end(), m.start(), r.priority, r.label) for r in L.rules() for m in re.finditer(f" (?:{r.pattern})(?= )", u)}
    order = sorted(found, key=lambda d: (d[1], -d[0], d[2], d[3]))
    kept = [d for k, d in enumerate(order) if not any(e[0] >= d[0] and e[2] <= d[2] for e in order[:k])]
    return ",".join(sorted({d[3] for d in kept} | set(filter(None, base(text)[4].split(",")))))


TEXTS = [
    "Licensed under CC BY-NC 4.0.\nMore words. cc-by  CC.BY",
    "Released under the terms of the GNU General Public License, version 2 or later; all rights reserved",
    "cc by cc by cc by cc",
    "GENERAL PUBLIC LICENSE general public license",
    "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: Apache-2.0",
    "the new BSD license; MIT licence, MIT License",
    "Copyright (c) 2019 2020 Someone. Some rights reserved.",
    "İ cc by K all rights reserved ſ",
    "Creative Commons Attribution-ShareAlike 3.0",
    "public domain",
    "nothing to see",
    "all rights",
    "general general public license",
    "x cc by" * 3000,
    "The new BSD. zero clause BSD licence; cc0, Creative Commons Zero 1.0",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of X nor the names of its contributors may be used to endorse or promote products",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3",
    "you can buy me a beer in return",
    "For personal use only. No part of this document may be reproduced.",
]


def test_against_brute_force(spark):
    rows = awkward() + [(100 + k, t) for k, t in enumerate(TEXTS)]
    got = L.scanned(documents(spark, rows, clashing=True)).collect()
    show = lambda r: (r[0], *(x or "" if k in (4, 5) else x for k, x in enumerate(r[1:])))
    want = sorted(((i, *base(t), labels(t)) for i, t, *_ in rows), key=repr)
    assert sorted((show(tuple(r)[:7]) for r in got), key=repr) == want
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_contained_matches_are_suppressed(spark):
    docs = documents(spark, [(1, "licensed under the Apache License Version 2.0 and under CC BY-NC 4.0")])
    got = {(r.label, r.suppressed) for r in L.detections(docs).collect()}
    assert ("apache-2.0", False) in got and ("cc-by-nc-4.0", False) in got and ("cc-by", True) in got


def test_the_gate_opens_for_every_rule():
    """A match made of each rule: groups by their first alternative, optional parts left out, classes by a letter."""
    for r in L.rules():
        text = r.pattern
        while (new := re.sub(r"\(\?:([^()]*)\)\?|\(\?=[^()]*\)", "", text)) != text:
            text = new
        for pick in (0, -1):
            sample = re.sub(r"\(\?:([^()]*)\)", lambda m: m.group(1).split("|")[pick], text)
            sample = re.sub(r".\?", "", sample)
            sample = re.sub(r"\[([a-z0-9])[^\]]*\](\{(\d+),?\d*\})?\+?", lambda m: m.group(1) * int(m.group(3) or 1), sample)
            if re.fullmatch(r.pattern, sample) or "(?=" in r.pattern:
                assert any(g in f" {sample} " for g in L.gate()), r
                assert r.keyword in sample, r


def test_rules():
    rules = L.rules()
    assert len(L.SIGNATURES) > 150 and len(rules) > 500 and [r.priority for r in rules] == sorted(r.priority for r in rules)
    assert all(re.compile(r.pattern) for r in rules)
    assert sum(not r.keyword for r in rules) < 10  # those run in every text that passes the gate
    assert all(r.keyword in r.pattern for r in rules)


@pytest.mark.parametrize("pattern, literal", [("mozilla public licen[sc]e", "mozilla public licen"), ("(?:gnu )?gpl(?: 2)?", "gpl"), ("share ?alike", "share"), ("a{2,3}bcd", "bcd"), ("(?:released|licensed) under (?:the )?mit", "mit")])
def test_keywords(pattern, literal):
    assert L.keyword(pattern).strip() == literal


def test_empty_table(spark):
    assert L.scanned(documents(spark, [])).collect() == []
