import random
import re
from collections import Counter

import pytest

from cairn.llm import quality as K

from .helpers import awkward, documents, prose


def counts(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def corpus(seed=2, n=400):
    r, docs, labels = random.Random(seed), [], []
    for k in range(n):
        text = prose(r, r.randint(5, 120))
        bad = k % 4 == 0
        if bad:
            text = " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in text.split()) if k % 8 else "\n".join([text.upper() + "!!"] * 3)
        docs.append((k, text))
        if k % 3:
            labels.append((k, int(not bad)))
    return docs, labels


TEXTS = ["a " * 100, "one two three four five six seven eight " * 2 + "nine", "same line\nsame line\n \n \nother", "a b c d e f g h i a b c d e f g h", "#*$%&|<>" * 5, "x\x0by\x0cz    "]


def labelled(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, quality int, toxic int, text string")


def test_counts_against_brute_force(spark):
    docs, _ = corpus()
    rows = awkward() + [(500 + k, t) for k, t in enumerate(TEXTS)] + docs
    got = K.counted(documents(spark, rows, clashing=True)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=repr) == sorted(((i, *counts(t)) for i, t, *_ in rows), key=repr)


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    bad = {k for k, _ in docs if k % 4 == 0}
    kept = {r.doc_id: (r.kept, r.base_failed) for r in K.judged(documents(spark, docs), labelled(spark, labels)).collect()}
    unseen = [k for k, _ in docs if not k % 3 and not kept[k][1]]
    assert sum(kept[k][0] == (k not in bad) for k in unseen) >= 0.97 * len(unseen)
    assert all(not kept[k][0] for k in kept if kept[k][1])


def test_expression_and_rules_say_the_same(spark):
    docs, labels = corpus()
    frame = documents(spark, docs)
    rows = K.labelled(frame, labelled(spark, labels))
    rules = K.learned(rows)
    assert rules and all(1 <= len(r) <= K.CONDITIONS for r in rules)
    got = {r.doc_id: r.kept for r in K.counted(frame).withColumn("kept", K.keeps(rules)).collect()}
    for r in rows:
        value = lambda c, r=r: r[c.name] if c.name not in K.RATES else r[K.RATES[c.name][0]] / max(r[K.RATES[c.name][1]], 1)
        rejected = any(all(value(c) >= c.cut if c.above else value(c) <= c.cut for c in rule) for rule in rules)
        assert got[r["doc_id"]] == (not rejected)


@pytest.mark.parametrize("rows", [[], [(k, 1) for k in range(50)], [(1, None), (2, 7), (None, 0)]])
def test_without_labels_of_both_kinds_the_base_decides(spark, rows):
    docs, _ = corpus(n=40)
    got = K.judged(documents(spark, docs), labelled(spark, rows)).collect()
    assert all(r.kept == (not r.base_failed) for r in got)


def test_at_most_a_sample_is_learned_from(spark):
    docs, labels = corpus()
    assert len(K.labelled(documents(spark, docs), labelled(spark, labels), 20)) <= 40


def test_good_documents_are_whole_rows(spark):
    docs, labels = corpus()
    frame = documents(spark, docs + awkward()[1:4], clashing=True)
    got = K.good_documents(frame, labelled(spark, labels))
    assert got.columns == frame.columns
    kept = {r.doc_id for r in K.judged(frame, labelled(spark, labels)).collect() if r.kept}
    texts = dict(docs)
    assert {r.doc_id for r in got.collect()} == kept and all(r.text == texts[r.doc_id] for r in got.collect())


def test_empty_table(spark):
    assert K.judged(documents(spark, []), labelled(spark, [])).collect() == []
