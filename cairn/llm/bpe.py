"""Byte-pair encoding and decoding with forced boundaries.

A text is split as the tokenizer's file says: first at added tokens, then by the pattern of byte-level tokenizers. Within
such a piece, two neighbouring bytes that no token of the vocabulary has anywhere inside are a certain cut: no merge can
ever reach across, since its result would be a token with that pair inside. So the fragments between cuts are encoded
independently and the ids are put together; frequent pieces are remembered, in two generations of bounded size. Short
fragments are merged by looking for the lowest rank again and again, long ones with a heap, so a piece of n bytes
takes n log n steps.

Decoding joins the tokens' bytes and reads them as UTF-8, with the replacement character for what isn't.

Defined results: a null or empty text has no ids and decodes to the empty text. Other columns play no part.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_of

#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of a generation, of so many characters at most, whose ids are remembered; fragments above LONG use a heap.
REMEMBERED, SHORT, LONG = 250_000, 64, 64
_NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters by which tokenizer files write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Encoder:
    """A byte-level BPE vocabulary (a tokenizers file without normaliser, dropout or prefix space)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or model.get("dropout") or model.get("ignore_merges") or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.byte_id = [vocab.get(bytes([b]), -1) for b in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: left id << 20 | right id -> rank << 20 | id of both
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in reversed([*enumerate((raw(x), raw(y)) for x, y in merges)])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take blanks along or stand alone")
        self.bytes = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in vocab.items():
            self.bytes[i] = t
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        inside = np.zeros(1 << 16, bool)
        for t in vocab:
            for k in range(len(t) - 1):
                inside[t[k] << 8 | t[k + 1]] = True
        #: Whether two bytes stand side by side inside some token; all other pairs are cuts.
        self.inside = inside.tobytes()
        self.split = regex.compile(PATTERN).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def cut(self, piece: bytes) -> list[bytes]:
        """The fragments between forced boundaries."""
        inside, out, start = self.inside, [], 0
        for k in range(1, len(piece)):
            if not inside[piece[k - 1] << 8 | piece[k]]:
                out.append(piece[start:k])
                start = k
        out.append(piece[start:])
        return out

    def _merged(self, fragment: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in fragment]
        if len(ids) > LONG:
            return self._merged_long(ids)
        get = self.merges.get
        pairs = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while pairs and (best := min(pairs)) != _NONE:
            k = pairs.index(best)
            ids[k] = new = best & 0xFFFFF
            del ids[k + 1], pairs[k]
            if k:
                pairs[k - 1] = get(ids[k - 1] << 20 | new, _NONE)
            if k < len(pairs):
                pairs[k] = get(new << 20 | ids[k + 1], _NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list; ties go from left to right."""
        get, n = self.merges.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m >> 20, k, ids[k], ids[k + 1], m & 0xFFFFF) for k in range(n - 1) if (m := get(ids[k] << 20 | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (m := get(ids[left] << 20 | ids[right])):
                    heapq.heappush(heap, (m >> 20, left, ids[left], ids[right], m & 0xFFFFF))
        return [i for i in ids if i >= 0]

    def _of(self, piece: str) -> tuple[int, ...]:
        got = self.older.get(piece)
        if got is None:
            got = tuple(i for fragment in self.cut(piece.encode()) for i in self._merged(fragment))
        if len(piece) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.older = self.known.copy()
                self.known.clear()
            self.known[piece] = got
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            for piece in self.split(part):
                out += known.get(piece) or self._of(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _little(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = [e.encode(t.decode("utf-8", "replace") if t else "") for t in b.column(1).cast(pa.binary()).to_pylist()]
            flat = array("i")
            for x in ids:
                flat.extend(x)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32)))], ["doc_id", "ids"])

    return run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array) of each row of docs."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_encode(path or default_path()), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = [e.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows with ids."""
    bound_batches(rows.sparkSession)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(path or default_path()), "doc_id long, text string")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _both_ways(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            rows = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                ids = e.encode(t.decode("utf-8", "replace") if t else "")
                rows.append((len(ids), hashlib.sha256(_little(ids)).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*rows, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs: encoded, then decoded from the ids."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_both_ways(path or default_path()), _DIGESTS)
