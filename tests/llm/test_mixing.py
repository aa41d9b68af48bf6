import re
from collections import defaultdict

import pytest

from cairn.llm import mixing as M
from cairn.llm.queries import MIX_SQL

from .helpers import awkward, documents


def n_words(text):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])


def levels(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Reshares the excess until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * share for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def corpus():
    rows = [(k, " ".join(f"w{j}" for j in range(5 + k * 7 % 60)), f"s{k % 7}") for k in range(900)]
    return rows + [(2000 + k, "tiny source", "zz") for k in range(5)] + [(3000 + k, "of nobody " * 30, None) for k in range(40)]


def test_targets_by_resharing(spark):
    rows = corpus()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += n_words(t)
    got = {r.source: r for r in M.targets(M.sized(documents(spark, rows))).collect()}
    want = levels(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s].source_size == sizes[s] and got[s].target == pytest.approx(want[s])


def per_source(rows, got):
    sources, taken, target = {i: s for i, _, s in rows}, defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    return taken, target


def test_taken_words_are_the_targets(spark):
    rows = corpus()
    got = M.mixed(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.size == n_words(dict((i, t) for i, t, _ in rows)[r.doc_id]) for r in got)
    taken, target = per_source(rows, got)
    assert all(taken[s] == int(target[s]) for s in target)


@pytest.mark.parametrize("block", [1, 64, 1000])
def test_small_and_large_sources(spark, block):
    """Sources of 1, 10, 65 and a million words get their targets, whatever the block."""
    rows = [(0, "one", "a"), (1, "one two three four five six seven eight nine ten", "b"), (2, "w " * 65, "c"), (3, "", "d"), (4, None, "e")]
    rows += [(10 + k, "w " * 10_000, "f") for k in range(100 if block > 1 else 2)]
    got = M.mixed(documents(spark, rows), block=block).collect()
    taken, target = per_source(rows, got)
    assert [target[s] for s in "abcde"] == [3, 30, 195, 0, 0]
    assert all(taken[s] == int(target[s]) for s in target)


@pytest.mark.parametrize("make", [corpus, awkward, lambda: []])
def test_against_sql(spark, tmp_path, make):
    import duckdb

    docs = documents(spark, make(), clashing=True)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(c.execute(MIX_SQL).fetchall(), key=repr)
    got = sorted((tuple(r)[:5] for r in M.mixed(docs).collect()), key=repr)
    assert got == [tuple(w) for w in want]


def test_schedule_is_even_all_along(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 100)
    monkeypatch.setattr(M, "RUN", 64)
    monkeypatch.setattr(M, "TASK", 500)
    sizes = spark.createDataFrame([("a", 40_000), ("b", 30_000), ("c", 30_000)], "source string, size long")
    per = M.targets(sizes)
    slots = M.schedule(per, 50).orderBy("slot").collect()
    target = {r.r: r.target for r in per.collect()}
    assert len(slots) == len({r.slot for r in slots}) == sum(-(-int(t) // 50) for t in target.values())
    ranks, words = defaultdict(list), defaultdict(int)
    for k, r in enumerate(slots, 1):
        ranks[r.r].append(r["rank"])
        words[r.r] += r.words
        if k % 100 == 0:
            assert all(abs(len(ranks[s]) - target[s] / 100_000 * k) < 8 for s in target), (k, {s: len(ranks[s]) - target[s] / 100_000 * k for s in target})
    assert all(v == list(range(len(v))) for v in ranks.values())
    assert all(words[s] == int(target[s]) for s in target)


def test_golden_steps_are_a_permutation(spark):
    for bits in (1, 2, 7, 13):
        g, back = M._golden(bits)
        got = {r.id: r.slot for r in spark.range(1 << bits).withColumn("slot", M._times(M.F.col("id"), back, bits)).collect()}
        assert sorted(got.values()) == list(range(1 << bits))
        assert all(slot * g % (1 << bits) == x for x, slot in got.items())
    far = (1 << M.MOST_BITS) - 1
    (r,) = spark.range(far, far + 1).select(M._times(M.F.col("id"), M._golden(M.MOST_BITS)[1], M.MOST_BITS).alias("slot")).collect()
    assert r.slot * M._golden(M.MOST_BITS)[0] % (1 << M.MOST_BITS) == far


def test_many_sources_in_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE", 30)
    rows = [(k, "w " * (1 + k * k % 97), f"{k % 211:03d}") for k in range(800)]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += n_words(t)
    got = M.mixed(documents(spark, rows)).collect()
    taken, target = per_source(rows, got)
    want = levels(sizes)
    assert all(target[s] == pytest.approx(want[s]) and taken[s] == int(target[s]) for s in want)


def test_reruns_agree(spark):
    docs = documents(spark, corpus())
    one, two = (sorted(map(tuple, M.mixed(d).collect())) for d in (docs, docs.repartition(7)))
    assert one == two


def test_documents_of_the_mix(spark):
    rows = [(10_000 + i, t, s) for i, t, s in corpus()] + awkward()
    docs = documents(spark, rows, clashing=True)
    got = M.mix_documents(docs)
    assert got.columns == docs.columns
    words, texts = defaultdict(int), {i: t for i, t, _ in rows}
    for r in got.collect():
        assert r.text and (r.doc_id is None or (texts[r.doc_id] or "").startswith(r.text)) and r.n_chars == len(r.text)
        words[r.doc_id] += n_words(r.text)
    taken = defaultdict(int)
    for r in M.mixed(docs).collect():
        taken[r.doc_id] += r.taken
    assert all(abs(words[i] - taken[i]) <= (1 if i == 1 else 0) for i in taken if i is not None)


def test_slots_and_blocks_are_not_sent_to_all(spark):
    plan = M.mixed(documents(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
