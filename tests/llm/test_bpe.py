import functools
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import bpe as B

from .helpers import awkward, documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(B.default_path())


@pytest.fixture(scope="module")
def own():
    return B.encoder(B.default_path())


TEXTS = ["", "a", "<|endoftext|>x <|endoftext|>", "a" * 3000, "abc" * 700, "it's  \t\tx \n\n y ", "日本語 テスト", "é" * 90, "  x  y", "  ", "A\r\n\r\nB", "don't'LL", "\U0001f600" * 60, "xyzzyq" * 90, "\x00\x01\x1c \x1d\x85z ˀ ²³ ½ Ⅷ ", "<|endoftext", "=" * 500]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120))
def test_any_text_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    own = B.encoder(B.default_path())
    ids = _library().encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == text


@functools.cache
def _library():
    return Tokenizer.from_file(B.default_path())


def test_cuts_are_forced(own):
    r = random.Random(1)
    tokens = [t for t in own.bytes if len(t) > 1]
    for t in r.sample(tokens, 500):
        assert own.cut(t) == [t]
    piece = bytes(r.randrange(256) for _ in range(400))
    parts = own.cut(piece)
    assert b"".join(parts) == piece and len(parts) > 100
    for a, b in zip(parts, parts[1:], strict=False):
        assert not any(a[-1:] + b[:1] in t for t in r.sample(tokens, 300))
    assert [i for p in parts for i in own._merged(p)] == own._merged(piece)


def test_heap_and_list_agree(own):
    r = random.Random(2)
    for _ in range(200):
        piece = "".join(r.choice("etaoin shrdl") for _ in range(r.randint(2, 60))).replace(" ", "e").encode()
        assert own._merged_long([own.byte_id[b] for b in piece]) == own._merged(piece)


def test_memory_of_pieces_is_bounded(own, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 10)
    e = B.Encoder(B.default_path())
    text = " ".join(f"word{k}" for k in range(500))
    assert e.encode(text) == own.encode(text) and len(e.known) <= 10 and len(e.older) <= 10


def test_tables(spark, library):
    rows = awkward() + [(100 + k, t) for k, t in enumerate(TEXTS) if "\x00" not in t]
    docs = documents(spark, rows, clashing=True)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, B.digests(docs).collect()), key=repr) == sorted(want, key=repr)
    ids = B.encoded(docs)
    back = {r.doc_id: r.text for r in B.decoded(ids).collect() if r.doc_id}
    assert all(back[i] == (t or "") for i, t, *_ in rows if i)
    assert B.digests(documents(spark, [])).collect() == []


def test_other_files_are_refused(tmp_path):
    with pytest.raises((ValueError, KeyError, TypeError)):
        import public_tokenizers

        B.Encoder(public_tokenizers.path("word_bpe_49k.json"))
