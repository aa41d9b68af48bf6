import math
import random

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import near_dup as N
from cairn.llm import tokens as T

from .helpers import awkward, documents, edited, prose


def shingles(text, words):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


class Groups:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, x, y):
        self.parent[self.root(x)] = self.root(y)


def linked(rows, how):
    """Numbers of rows with doc_id and words, in groups."""
    sets, groups = [shingles(t, how.words) for _, t, *_ in rows], Groups()
    own = [k for k, (i, *_) in enumerate(rows) if i is not None and sets[k]]
    for x in own:
        for y in own:
            if x <= y and 100 * len(sets[x] & sets[y]) >= how.percent * len(sets[x] | sets[y]):
                groups.join(x, y)
    return sets, own, groups


def brute(rows, how):
    """A document is one node, whatever texts it has."""
    sets, own, groups = linked(rows, how)
    for x in range(len(rows)):
        for y in range(x):
            if rows[x][0] is not None and rows[x][0] == rows[y][0]:
                groups.join(x, y)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[groups.root(k)] = min(i, least.get(groups.root(k), i))
    return sorted(((i, len(sets[k]), least[groups.root(k)] if i is not None else None) for k, (i, *_) in enumerate(rows)), key=repr)


def brute_kept(rows, how):
    """(doc_id, text): of each group of linked texts one with the least doc_id (any of its texts), and all rows outside groups."""
    _, own, groups = linked(rows, how)
    by = {}
    for k in own:
        by.setdefault(groups.root(k), []).append(rows[k][:2])
    return [r[:2] for k, r in enumerate(rows) if k not in own], [{r for r in g if r[0] == min(i for i, _ in g)} for g in by.values()]


def assert_kept(got, rows, how):
    free, groups = brute_kept(rows, how)
    left = list(got)
    for r in free:
        left.remove(r)
    assert len(left) == len(groups)
    for g in groups:
        assert len(hit := [r for r in left if r in g]) == 1
        left.remove(hit[0])


def found(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def test_word_hashes_follow_words_not_places():
    texts = ["The cat  sat", "", None, "the CAT", "x", "\n", "a b the", "sat\x0bcat"]
    data, at = T.buffers(pa.array(texts))
    h, rows = T.word_hashes(data, at)
    words = [w for t in texts for w in (t or "").lower().split()]
    assert rows.tolist() == [0, 3, 3, 3, 5, 6, 6, 9, 11]
    assert len(set(h.tolist())) == len(set(words))
    by = {}
    assert all(by.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True))


def test_words_that_differ_in_pattern_alone():
    """Thue-Morse words, on which a polynomial modulo 2^64 gives the same for any base."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    texts = [one, two, "abcdefgh" * 2, "abcdefgh", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "hgfedcba" + "abcdefgh", "abcdefgh" + "hgfedcba", "ab\0", "ab", "ab\0\0"]
    h, _ = T.word_hashes(*T.buffers(pa.array(texts)))
    assert len(set(h.tolist())) == len(texts)


def test_long_words_hash_alike_wherever_they_stand():
    r = random.Random(2)
    words = ["".join(r.choice("abcdeü") for _ in range(r.randint(1, 60))) for _ in range(200)]
    one, _ = T.word_hashes(*T.buffers(pa.array(words)))
    two, _ = T.word_hashes(*T.buffers(pa.array(["x " + " \n".join(words)])))
    assert one.tolist() == two.tolist()[1:] and len(set(one.tolist())) == len(set(words))


def test_sliced_arrays_and_pieces():
    a = pa.array(["skip", "a b", "c", "d e f"]).slice(1)
    data, at = T.buffers(a)
    assert at.tolist() == [0, 3, 4, 9]
    assert list(T.pieces(np.array([0, 5, 5 + T.PIECE * 2, 6 + T.PIECE * 2]))) == [(0, 1), (1, 2), (2, 3)]


def test_awkward_rows(spark):
    """Among them two long words that differ in their pattern alone."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    rows = awkward() + [(50, one), (51, one.translate(str.maketrans("ab", "ba")))]
    assert found(N.near_duplicates(documents(spark, rows, clashing=True), N.QUERY)) == brute(rows, N.QUERY)


def test_empty_table(spark):
    assert N.near_duplicates(documents(spark, []), N.QUERY).collect() == []
    assert N.one_of_each(documents(spark, [])).collect() == []


def test_groups_near_the_threshold_against_brute_force(spark):
    r = random.Random(3)
    rows, k = [], 0
    for _ in range(9):
        base = prose(r, r.randint(20, 150))
        for _ in range(r.randint(1, 14)):
            rows.append((k, edited(r, base, r.randint(0, 6)) if r.random() < 0.8 else base.upper()))
            k += 1
    r.shuffle(rows)
    assert found(N.near_duplicates(documents(spark, rows), N.QUERY)) == brute(rows, N.QUERY)


@pytest.mark.parametrize("how", [N.QUERY, N.NearDup()])
def test_keys_meet_for_every_pair_within_the_threshold(how):
    r, keys = random.Random(1), how.left_out()
    for _ in range(300):
        wrong = set(r.sample(range(how.symbols), how.errors))
        assert any(not wrong & set(k) for k in keys)

    def missed(n, p, most):
        log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)
        return sum(math.exp(log(k)) for k in range(most + 1, n + 1))

    p = 1 - how.percent / 100
    assert missed(how.symbols, p, how.errors) < 4e-6
    assert missed(N.WIDE, p * 3 / 4, N._wide_errors(how, N.WIDE, 5)) < 2e-6


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in N.components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_one_of_each_keeps_all_columns(spark):
    rows = [(3, "a b c d e f g h"), (1, "A b c d e f g h"), (2, "something else entirely in here today"), (None, None)]
    docs = documents(spark, rows, clashing=True)
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, None]


def test_documents_with_several_texts_lose_none(spark):
    """Rows linked on both sides of a document's texts, blank texts and repeated rows among them, five tables in one."""
    x, y, z = "one text about the first of these things", "quite another text that says something else", "and a third that no one has seen before"
    cases = [
        [(5, x), (5, y), (3, y), (9, x)],
        [(5, x), (5, y), (3, y), (9, x), (9, z), (2, z), (2, ""), (2, None), (7, ""), (None, x)],
        [(1, x), (1, y), (1, z), (1, ""), (2, x), (3, y), (4, z)],
        [(4, x), (4, x + " more"), (4, y), (1, y), (1, y)],
        [(1, x), (1, x), (2, x.upper()), (3, y), (3, y), (3, z), (4, ""), (4, ""), (None, "x y z"), (None, "x y z")],
    ]
    rows = [(i if i is None else 100 * k + i, t and " ".join(f"{w}{k}" for w in t.split())) for k, case in enumerate(cases) for i, t in case]
    docs = documents(spark, rows, clashing=True)
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert found(N.near_duplicates(docs, N.QUERY)) == brute(rows, N.QUERY)
    assert_kept([(r.doc_id, r.text) for r in kept.collect()], rows, N.NearDup())


def test_many_repeated_ids_against_brute_force(spark):
    r = random.Random(12)
    bases = [prose(r, 40) for _ in range(12)]
    rows = [(r.randrange(30), edited(r, r.choice(bases), r.randint(0, 2))) for _ in range(90)]
    docs = documents(spark, rows)
    assert found(N.near_duplicates(docs, N.QUERY)) == brute(rows, N.QUERY)
    assert_kept([(r.doc_id, r.text) for r in N.one_of_each(docs, N.QUERY).collect()], rows, N.QUERY)


def test_large_buckets_in_parts(spark, monkeypatch):
    """Both ways through the buckets, with parts and blocks of a few rows and without sending ids."""
    monkeypatch.setattr(N, "TOGETHER", 7)
    monkeypatch.setattr(N, "BLOCK", 5)
    monkeypatch.setattr(N, "SENT_IDS", 0)
    r = random.Random(6)
    base = prose(r, 60)
    rows = [(k, edited(r, base, r.randint(0, 6))) for k in range(70)] + [(200 + k, base) for k in range(20)]
    docs = documents(spark, rows)
    for few in (0, 500):
        monkeypatch.setattr(N, "FEW", few)
        assert found(N.near_duplicates(docs, N.QUERY)) == brute(rows, N.QUERY)


def test_texts_near_a_group_make_few_rows(spark, monkeypatch):
    """Texts that are near all of a group, some linked with one of it, most with none, meet the group and not each of its texts."""
    r, wrote, written = random.Random(8), [], N.written

    def seen(df, tag):
        out = written(df, tag)
        wrote.append((tag, out.count()))
        return out

    def changed(k, words, at):
        words = list(words)
        for i in at:
            words[i] = f"new{k}x{i}"
        return " ".join(words)

    base = prose(r, 400).split()[:200]
    rows = [(k, changed(k, base, r.sample(range(200), 1))) for k in range(40)]
    rows += [(100 + k, changed(100 + k, base, r.sample(range(200), 6 if k % 5 else 4))) for k in range(30)]
    monkeypatch.setattr(N, "written", seen)
    for met in (7, 100):
        monkeypatch.setattr(N, "MET", met)
        wrote.clear()
        assert found(N.near_duplicates(documents(spark, rows), N.QUERY)) == brute(rows, N.QUERY)
        rest = wrote[[tag for tag, _ in wrote].index("links") + 1 :]
        assert 0 < max(n for tag, n in rest if tag in ("candidates", "dealt", "visits", "links")) <= 3 * len(rows)


def test_blocks_of_second_signatures(spark, monkeypatch):
    """Blocks and groups of a few rows, over many batches."""
    for name, value in {"NEAR": 6, "COMPARED": 4, "MET": 3, "SENT_IDS": 0}.items():
        monkeypatch.setattr(N, name, value)
    r = random.Random(16)
    base = prose(r, 60)
    rows = [(k, edited(r, base, r.randint(0, 6))) for k in range(70)] + [(200 + k, base) for k in range(20)]
    monkeypatch.setattr(N, "bound_batches", lambda spark: None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(N.near_duplicates(documents(spark, rows), N.QUERY)) == brute(rows, N.QUERY)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_distance_counts_symbols(spark):
    how = N.QUERY
    r = np.random.default_rng(3)
    a, b = (r.integers(0, 3, (400, how.symbols)) * 0x8001 % 65536 for _ in "ab")
    row = lambda s: s.astype("<u2").view("<i8").tolist()
    cols = [*how.columns(), *(f"o{c[1:]}" for c in how.columns())]
    df = spark.createDataFrame([(k, *row(a[k]), *row(b[k])) for k in range(400)], ", ".join(f"{c} long" for c in ["n", *cols]))
    got = {x.n for x in df.where(N._near(how)).collect()}
    assert got == set(np.flatnonzero((a != b).sum(1) <= how.errors).tolist()) and 0 < len(got) < 400


def test_against_sql(spark, tmp_path):
    import duckdb

    from cairn.llm.queries import NEAR_DUP_SQL

    r = random.Random(4)
    bases = [prose(r, r.randint(1, 60)) for _ in range(20)]
    rows = awkward() + [(100 + r.randrange(70), edited(r, r.choice(bases), r.randint(0, 2))) for _ in range(90)]
    documents(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = c.execute(NEAR_DUP_SQL).fetchall()
    assert all(k == (i is None or i == m) for i, _, m, k in got)
    assert sorted(((i, n, m) for i, n, m, _ in got), key=repr) == brute(rows, N.QUERY)
