"""A text of 30 MB, with words of every kind and one very long word, goes through every operator whole."""

import hashlib
import random
import resource

import pytest

from cairn.llm import bpe, licenses, line_dedup, lm_score, media, mixing, near_dup, quality, secrets, warc

from .helpers import documents

SIZE = 30 << 20


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = ["w" + "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(5000)]
    part = "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(12_000))
    text = part + "\n" + "x" * (1 << 20) + "\n"
    while len(text) < SIZE:
        text += part[r.randrange(1000) :] + "\n"
    rows = [(1, text, "a"), (2, "a short text of its own", "a"), (3, None, "b")]
    return documents(spark, rows).repartition(3).persist(), text


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row(df):
    return next(r for r in df.collect() if r.doc_id == 1)


def test_words(docs):
    df, text = docs
    assert row(mixing.sized(df)).size == len(text.split())
    assert row(lm_score.scored(df)).n_tokens == len(text.split()) + 1
    assert row(licenses.scanned(df)).n_words == len(text.split())
    assert row(quality.counted(df)).n_words == len(text.split())


def test_whole_texts(docs):
    df, text = docs
    assert row(line_dedup.deduplicated(df)).n_lines == text.count("\n") + 1
    assert row(near_dup.near_duplicates(df, near_dup.QUERY)).n_shingles == len({tuple(w) for w in zip(*(text.split()[k:] for k in range(3)), strict=False)})
    got = row(media.carried(df))
    assert (got.n_bytes, got.payload_sha256) == (len(text), digest(text + "\0" * (-len(text) % 64)))
    assert secrets.scanned(df, secrets.default_findings(df.sparkSession).drop("template")).count() == 3
    pages = df.selectExpr("doc_id AS page_id", "source AS url", "text AS html")
    back = next(r for r in warc.read_archives(warc.write_archives(pages), payloads=False).collect() if r.page_id == 1)
    assert back.payload_digest == hashlib.sha1(text.encode()).hexdigest()


def test_byte_pairs_of_a_long_text(docs):
    df, text = docs
    got = row(bpe.digests(df))
    assert got.decoded_sha256 == digest(text) and got.n_tokens > len(text) // 8


def test_memory_of_the_workers_tools(docs):
    """Hashes, shingles and images of the text, here and now: some times its bytes, no more."""
    import pyarrow as pa

    from cairn.llm import tokens

    _, text = docs
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    data, at = tokens.buffers(pa.array([text]))
    near_dup.shingle_sets(data, at, 3)
    for _ in media._stored_one(text.encode()):
        pass
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000  # KB
