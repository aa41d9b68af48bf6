import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cairn.llm import lm_score as M

from .helpers import awkward, documents, prose


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def base(rows):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    c = Counter(t for i, text, *_ in rows if fold(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text, *_ in rows:
        ts = tokens(text)
        out.append((i, fold(i) == 0, len(ts), sum(t in c for t in ts), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    # The second word of a pair follows from the first, so a model of pairs must do better than one of words.
    pairs = [(a, f"{a}{b}") for a in ("red", "blue", "green", "old", "new", "big") for b in ("fox", "dog")]
    texts = [" ".join(w for p in r.choices(pairs, k=r.randint(5, 40)) for w in p) for _ in range(300)]
    return [(k, t) for k, t in enumerate(texts)] + [(1000 + k, prose(r, 30)) for k in range(60)]


def test_counts_and_base_against_brute_force(spark, rows):
    every = rows + awkward()
    got = sorted((tuple(r)[:6] for r in M.scored(documents(spark, every, clashing=True)).collect()), key=repr)
    want = base(every)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_held_out_texts_are_likelier_than_by_words_alone(spark, rows):
    got = [r for r in M.scored(documents(spark, rows)).collect() if r.held_out and r.doc_id < 1000]
    assert len(got) > 15
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)  # both are negative
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert all(r.score < 0 for r in got)


def test_the_same_for_any_size_of_block(spark, rows, monkeypatch):
    score = lambda: {r.doc_id: (r.score, r.base_score) for r in M.scored(documents(spark, rows)).collect()}
    one = score()
    monkeypatch.setattr(M, "BLOCK_BYTES", 1500)
    many = score()
    assert one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k], rel=1e-9) for k in one)


def test_probabilities_sum_to_one():
    """After a known and an unknown context, over five words and an unknown one."""
    w = M.Weights(100, 5)
    w.mix = np.tile([0.5, 0.3, 0.2], (64, 1))
    c = np.array([40, 30, 10, 15, 5, 0])
    for n, pair in ((40, [10, 20, 4, 6, 0, 0]), (0, [0] * 6)):
        assert (10 ** w.after(np.full(6, n), np.array(pair), c)).sum() == pytest.approx(1)


def test_weights_follow_held_out_counts():
    w = M.Weights(1000, 50)
    w.learn(np.array([3, 3, 9]), np.array([0.5, 0.4, 0.0]), np.array([0.01, 0.01, 0.2]), np.array([10.0, 10.0, 10.0]))
    assert w.mix[3][0] > 0.9 and w.mix[9][1] > 0.9 and np.allclose(w.mix.sum(1), 1)


def test_packing():
    r = random.Random(2)
    for top in (0, 1, 255, 256, 1 << 40, (1 << 64) - 1):
        x = np.array([r.randint(0, top) for _ in range(50)], np.uint64)
        assert M._unpacked(M._packed(x), 50).tolist() == x.tolist()
    assert len(M._packed(np.zeros(50, np.int64))) == 0 and M._unpacked(b"", 0).tolist() == []


def brute_scores(docs):
    """Counts, weights by expectation-maximisation over cells of held-out tokens, and scores, with dictionaries alone."""
    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 for i, *_ in docs}
    one, two, fit, fit2 = Counter(), Counter(), Counter(), Counter()
    for i, t, *_ in docs:
        ts = tokens(t)
        ps = list(zip([None, *ts], ts, strict=False))
        for a, b in ((one, two), (fit, fit2)) if fold[i] > 1 else ((one, two),) if fold[i] else ():
            a.update(ts)
            b.update(ps)
    n, nf, v, vf = sum(one.values()), sum(fit.values()), len(one), len(fit)
    bucket = lambda c, of: min(63, max(0, math.floor(-math.log2(max(c, 0.5) / of))))
    cell = lambda a, b: math.floor(math.log10(a / b) * M.GRID) if a else None
    cells = Counter()
    for i, t, *_ in docs:
        ts = tokens(t)
        for u, x in zip([None, *ts], ts, strict=False):
            if fold[i] == 1 and fit[u]:
                cells[bucket(fit[u], nf), cell(fit2[u, x], fit[u]), cell(fit[x], nf)] += 1
    mix = {}
    for b in {k[0] for k in cells}:
        own = [([0.0 if e is None else 10 ** ((e + 0.5) / M.GRID) for e in k[1:]] + [1 / (vf + 1)], m) for k, m in cells.items() if k[0] == b]
        l, total = [1 / 3] * 3, sum(m for _, m in own)
        for _ in range(M.ROUNDS):
            new = [0.0] * 3
            for p, m in own:
                parts = [a * x for a, x in zip(l, p, strict=True)]
                for k in range(3):
                    new[k] += m * parts[k] / sum(parts)
            l = [max(x / total, 1e-6) for x in new]
            l = [x / sum(l) for x in l]
        mix[b] = l
    out = []
    for i, t, *_ in docs:
        ts, score = tokens(t), 0.0
        for u, x in zip([None, *ts], ts, strict=False):
            l = mix.get(bucket(one[u], n), [1 / 3] * 3) if one[u] else [0, 2 / 3, 1 / 3]
            score += math.log10(l[0] * two[u, x] / max(one[u], 1) + l[1] * one[x] / n + l[2] / (v + 1))
        out.append((i, score))
    return sorted(out, key=repr)


def test_score_against_brute_force(spark, rows, monkeypatch):
    """Weights and all, with many blocks and parts."""
    r = random.Random(31)
    rare = [(5000 + k, " ".join(f"r{r.randrange(9000)}" + r.choice(["", " of", " and the"]) for _ in range(60))) for k in range(120)]
    every = rows + rare + awkward()
    monkeypatch.setattr(M, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(M, "PART_BYTES", 20_000)
    got = sorted(((x.doc_id, x.score) for x in M.scored(documents(spark, every, clashing=True)).collect()), key=repr)
    want = brute_scores(every)
    assert [i for i, _ in sorted(got, key=lambda x: (repr(x[0]), x[1]))] == [i for i, _ in want]
    for (i, g), (_, w) in zip(sorted(got, key=lambda x: (repr(x[0]), x[1])), sorted(want, key=lambda x: (repr(x[0]), x[1])), strict=True):
        assert g == pytest.approx(w, rel=1e-9), i


def test_empty_and_untrained_tables(spark):
    assert M.scored(documents(spark, [])).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = M.scored(documents(spark, [(alone, "a b")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)
    assert math.isfinite(r.score) and r.base_score == 0.0


@pytest.mark.parametrize("size", [8 << 20, 20_000])
def test_pairs_of_rare_words_against_brute_force(spark, monkeypatch, size):
    """No word has one in 10,000 of the tokens, and each is followed by its own."""
    r = random.Random(9)
    pairs = [f"a{k} b{k}" for k in range(7000)] * 3
    r.shuffle(pairs)
    docs = [(k, " ".join(pairs[10 * k : 10 * k + 10])) for k in range(2100)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    tested = [i for i in range(10_000, 10_100) if fold(i) == 0][:2]
    docs += [(tested[0], "a1 b1 a2 b2"), (tested[1], "b1 a1 b2 a2")]
    c, two = Counter(), Counter()
    for i, t in docs:
        if fold(i):
            ts = tokens(t)
            c.update(ts)
            two.update(zip([None, *ts], ts))
    n, v = sum(c.values()), len(c)
    assert 3 < n * 1e-4
    monkeypatch.setattr(M, "BLOCK_BYTES", size)
    learned = M.scored(documents(spark, docs)).collect()
    by_id = {x.doc_id: x.score for x in learned}
    assert by_id[tested[0]] > by_id[tested[1]] + 4
    monkeypatch.setattr(M.Weights, "learn", lambda self, *_: setattr(self, "mix", np.tile([0.5, 0.3, 0.2], (64, 1))))
    got = {x.doc_id: x.score for x in M.scored(documents(spark, docs)).collect()}
    for i, t in docs:
        ts = tokens(t)
        l = lambda u: (0.5, 0.3, 0.2) if c[u] else (0, 2 / 3, 1 / 3)
        p = [l(u)[0] * two[u, x] / max(c[u], 1) + l(u)[1] * c[x] / n + l(u)[2] / (v + 1) for u, x in zip([None, *ts], ts)]
        assert got[i] == pytest.approx(sum(map(math.log10, p)), rel=1e-9)
