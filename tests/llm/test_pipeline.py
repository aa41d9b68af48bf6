"""The pipeline against the stages' brute-force versions, one after the other."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
import pytest
from cairn.llm import bpe, mixing, near_dup, quality

from .helpers import documents, edited, prose
from .test_line_dedup import brute as lines_left
from .test_near_dup import assert_kept
from .test_quality import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, rows, labels = random.Random(8), [], []
    for k in range(160):
        text = prose(r, r.randint(25, 90))
        if k % 5 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append([k, text, f"s{k % 4}"])
        labels.append((k, int(k % 5 != 0)))
    for k in range(40):
        rows.append([500 + k, edited(r, rows[7][1], r.randint(0, 2)), "s1"])
    for row in rows[::3]:
        row[1] += "\nAll about cookies"
    rows += [[900, None, "s0"], [901, "", None], [None, prose(r, 40), "s2"]]
    # Documents with several texts, each of which is a copy of another's.
    own = [prose(r, 50) for _ in range(3)]
    rows += [[705, own[0], "s1"], [705, own[1], "s1"], [703, own[1], "s2"], [709, own[0], "s3"], [709, own[2], "s3"]]
    labels += [(i, 1) for i in (703, 705, 709)]
    path = tmp_path_factory.mktemp("tables")
    documents(spark, [tuple(x) for x in rows]).coalesce(2).write.parquet(f"{path}/documents.parquet")
    labelled(spark, labels).coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path), [tuple(x) for x in rows]


def test_stages(spark, folder):
    path, rows = folder
    docs, stages = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, path)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{path}/{k}")
        docs = stages[name] = spark.read.parquet(f"{path}/{k}")
    texts = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    good, left, single, mix, last = (stages[name] for name, _ in P.STAGES)
    labels = spark.read.parquet(f"{path}/labels.parquet")
    kept = {r.doc_id for r in quality.judged(spark.read.parquet(f"{path}/documents.parquet"), labels).collect() if r.kept}
    assert Counter(texts(good)) == Counter(r for r in rows if r[0] in kept)
    assert [r[0] for r in texts(good) if "###" in r[1]] == [] and len(kept) > 150, quality.learned(quality.labelled(spark.read.parquet(f"{path}/documents.parquet"), labels))
    want = sorted(((i, t) for i, t, _, _ in lines_left(texts(good), 10)), key=repr)
    assert sorted(((i, t) for i, t, _ in texts(left)), key=repr) == want
    assert not any("cookies" in t for _, t in want)
    assert_kept([(i, t) for i, t, _ in texts(single)], texts(left), near_dup.NearDup())
    assert len({t for i, t, _ in texts(single) if i in (703, 705, 709) and t}) == 3  # no text goes with another of its document
    taken = defaultdict(int)
    for r in mixing.mixed(single).collect():
        taken[r.doc_id] += r.taken
    words = defaultdict(int)
    for i, t, _ in texts(mix):
        words[i] += len(t.split())
    assert {i: n for i, n in taken.items() if n} == words
    e = bpe.encoder(bpe.default_path())
    digest = lambda t: (len(e.encode(t)), hashlib.sha256(np.array(e.encode(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert sorted(map(tuple, last.collect()), key=repr) == sorted(((i, *digest(t)) for i, t, _ in texts(mix)), key=repr)
    assert sorted(map(tuple, P.run(spark, path).collect()), key=repr) == sorted(map(tuple, last.collect()), key=repr)


def test_stage_order():
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
