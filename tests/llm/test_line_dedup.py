import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import line_dedup as L
from cairn.llm.queries import LINE_DEDUP_SQL

from .helpers import awkward, documents

BLANKS = " \t\n\x0b\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, at_least):
    texts = [(i, t or "") for i, t, *_ in rows]
    n = Counter(k for _, t in texts for k in {key(x) for x in t.split("\n")} if k)
    out = []
    for i, t in texts:
        lines = t.split("\n")
        kept = [x for x in lines if not (key(x) and n[key(x)] >= at_least)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    common = ["Share this", " share THIS\t", "Über uns", "© all", "-"]
    return [(k, "\n".join(r.choice([*common, f"own {k} {j}", "", "  "]) for j in range(r.randint(1, 12)))) for k in range(n)]


def test_against_brute_force(spark):
    rows = awkward() + corpus()
    for at_least in (2, 10):
        assert found(L.deduplicated(documents(spark, rows, clashing=True), at_least)) == brute(rows, at_least)


def test_many_shards_and_parts(spark, monkeypatch):
    """Filters of two keys or so, lines in parts of a few: the same lines go."""
    rows = corpus(2) + [(500 + k, "\n".join(f"common {j}" for j in range(40))) for k in range(30)]
    docs = documents(spark, rows)
    monkeypatch.setattr(L, "SHARD_KEYS", 4)
    monkeypatch.setattr(L, "TOGETHER", 9)
    state = L.LineState.built(docs, 5)
    assert state.shards > 4 and state.filters.count() > 4
    assert found(state.applied(docs)) == brute(rows, 5)


def probe(filters, keys, many=None):
    lines = pa.table({"shard": [0] * len(keys), "part": [0] * len(keys), "doc_id": pa.array([None, *range(1, len(keys))][: len(keys)], pa.int64()), "th": pa.array(range(len(keys)), pa.int64()), "k1": pa.array([k for k, _ in keys], pa.int64()), "k2": pa.array([k for _, k in keys], pa.int64())})
    f = pa.table({"shard": [0], "part": [0], "buckets": [filters.mask + 1], "slots": [filters.slots.tobytes()], "many": [many]})
    return L._probe((0, 0), lines, f)


def test_lines_end_at_the_filter():
    r = random.Random(3)
    keys = [(r.getrandbits(62), r.getrandbits(62)) for _ in range(3000)]
    f = L.Cuckoo.planned(100)
    assert all(f.insert(*k) for k in keys[:100])
    out = probe(f, keys, [{"k1": keys[0][0], "k2": keys[0][1], "parts": 4}])
    passed = set(zip(out["k1"].to_pylist(), out["k2"].to_pylist(), strict=True))
    assert set(keys[:100]) <= passed and len(passed) < 120
    assert out.column_names == ["doc_id", "th", "k1", "k2", "part"] and set(out["part"].to_pylist()[1:]) == {0}
    assert probe(f, keys[:0]).num_rows == 0
    spread = probe(f, [keys[0]] * 400, [{"k1": keys[0][0], "k2": keys[0][1], "parts": 4}])
    assert set(spread["part"].to_pylist()) == {0, 1, 2, 3}


def test_deleting_what_was_never_inserted(spark):
    state = L.LineState.built(documents(spark, [(1, "a\nb")]), 2)
    with pytest.raises(ValueError, match="never inserted"):
        state.deleted(documents(spark, [(2, "c")]))


def test_more_shards_as_keys_grow(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 4)
    few = documents(spark, [(k, "a\nb") for k in range(3)])
    many = [(10 + k, "\n".join(f"l {j}" for j in range(100))) for k in range(3)]
    state = L.LineState.built(few, 3).inserted(documents(spark, many))
    assert state.shards > 4
    assert found(state.applied(documents(spark, many))) == brute(many, 3)


def test_against_sql(spark, tmp_path):
    import duckdb

    rows = awkward() + corpus(3)
    documents(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(c.execute(LINE_DEDUP_SQL).fetchall(), key=repr)
    got = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows, 10)]
    assert want == sorted(got, key=repr)


def test_empty_table(spark):
    assert L.deduplicated(documents(spark, [])).collect() == []
    assert L.without_common_lines(documents(spark, [])).collect() == []


def test_inserting_and_deleting_leads_back(spark):
    a, b = documents(spark, corpus(4, 30)), documents(spark, [(100 + i, t) for i, t in corpus(5, 30)])
    state = L.LineState.built(a, 8)
    more = state.inserted(b)
    whole = L.LineState.built(a.union(b), 8)
    refs = lambda s: sorted(map(tuple, s.refs.collect()))
    hot = lambda s: {(r.k1, r.k2) for r in s.refs.where(f"n >= {s.at_least}").collect()}
    assert refs(more) == refs(whole)
    assert found(more.applied(a)) == found(whole.applied(a))
    back = more.deleted(b)
    assert refs(back) == refs(state)
    assert found(back.applied(a)) == found(state.applied(a))
    keys = np.array(sorted(hot(back)), np.int64).view(np.uint64).reshape(-1, 2)
    shard = L.shard_of(keys[:, 0], back.shards)
    for r in back.filters.collect():
        own = keys[shard == r.shard]
        assert L.Cuckoo(r.buckets, np.frombuffer(r.slots, np.uint16)).may_have(own[:, 0], own[:, 1]).all()
    assert sum(r["keys"] for r in back.filters.collect()) == len(hot(back))


def test_a_full_filter_is_built_anew(spark, monkeypatch):
    monkeypatch.setattr(L, "MOVES", 2)
    a = documents(spark, [(k, "x\ny") for k in range(3)])
    b = documents(spark, [(10 + k, "\n".join(f"line {j}" for j in range(300))) for k in range(3)])
    state = L.LineState.built(a, 3).inserted(b)
    assert sum(r["keys"] for r in state.filters.collect()) == 302
    assert all(r.text == "" for r in state.applied(b).collect())


def test_cuckoo_filter():
    r = random.Random(9)
    keys = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(4000)]
    f = L.Cuckoo.planned(len(keys))
    assert all(f.insert(*k) for k in keys)
    ask = lambda ks: f.may_have(*(np.array(c, np.uint64) for c in zip(*ks, strict=True)))
    assert ask(keys).all()
    other = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(20_000)]
    assert ask(other).mean() < 0.01
    assert all(f.delete(*k) for k in keys[:2000])
    assert ask(keys[2000:]).all() and ask(keys[:2000]).mean() < 0.01
    assert all(f.delete(*k) for k in keys[2000:]) and not f.slots.any()


def test_documents_keep_their_columns(spark):
    rows = awkward() + [(50 + k, f"same line\nown {k}") for k in range(12)]
    docs = documents(spark, rows, clashing=True)
    got = L.without_common_lines(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert texts[50] == ("own 0", 5) and texts[2] == (None, None)
