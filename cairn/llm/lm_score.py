"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of three orders; the weights depend on how frequent the context is and are
learned by expectation-maximisation on held-out counts:

    P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1)

v is the word before, or the end token at the start of a text, so c(v) is at once how often v occurs and how often it is a
context. It sums to one over the V known words and one unknown. Every word and every pair of words counts, however rare. The
bucket of a context is its share of the training tokens, in powers of two. One training document in ten (crc32 of its id,
remainder 1) is held out for the weights; then all training documents give the counts.

Every word and every pair is counted over the whole corpus, as a 64-bit hash (``tokens``). Documents are dealt into blocks of
about BLOCK_BYTES, held-out ones into blocks of their own. A block asks once for each different word or pair that it holds,
however often it occurs, so no key has more rows than there are blocks. Its sorted keys are cut into parts of all keys; a
part's keys go out as one packed row, and what comes back are the counts of the other blocks in the same order, mostly zeros, so that
neither keys nor blocks are written again.

The mixture's weights are learned from all held-out tokens in cells of about equal estimates, 1/GRID of a factor of ten wide, so
an estimate is taken up to 6 percent off in learning (never in scoring); both estimates of a token stay together in a cell.

Defined results: a null or empty text is the end token alone. A row without doc_id counts as id "" (held out). A row is a
document, repeated or not. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import bound_batches, forget, text_of, written

_U = np.uint64
#: Text of a block, and text whose keys make up a part.
BLOCK_BYTES, PART_BYTES = 8 << 20, 16 << 20
#: Rounds of expectation-maximisation, and cells for each factor of ten of a probability.
ROUNDS, GRID = 40, 20
#: The end of a text as a word, and as the context of the next text's first word.
END = np.int64(0x3C6EF372FE94F82A)
#: Where a cell of estimates has its parts, and the number that stands for an estimate of zero.
_SHIFT, _ZERO = 13, -2000


def fold(doc_id="doc_id"):
    """crc32 of the id as text, modulo 10: 0 is not trained on, 1 is held out for the weights."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row and one END, and for each row the number of tokens before it."""
    h, rows = T.word_hashes(data, at)
    h = h.view(np.int64)
    h[h == END] += 1
    n = len(rows) - 1
    return np.insert(h, rows[1:], END), rows + np.arange(n + 1)


def _block(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a block, their pairs with the word before, for each row the number of tokens before it, and each token's fold."""
    data, at = T.buffers(docs["text"])
    parts, rows = [], [np.zeros(1, np.int64)]
    for i, j in T.pieces(at):
        w, r = _tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
        parts.append(w)
        rows.append(r[1:] + rows[-1][-1])
    w, rows = np.concatenate(parts), np.concatenate(rows)
    ctx = _before(w, rows, END)
    pairs = T.mix(T.mix(ctx.view(_U) + _U(0x9E3779B97F4A7C15)) + w.view(_U)).view(np.int64)
    return w, pairs, rows, np.repeat(docs["fold"].to_numpy(), np.diff(rows))


def _before(values: np.ndarray, rows: np.ndarray, start) -> np.ndarray:
    """The value of the token before each, or start."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[rows[:-1]] = start
    return out


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, lowest bytes first, as many bytes of each as the largest needs: bytes alike lie together."""
    n = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return out.view("<u8").ravel()


def _counts(x: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, ascending as unsigned numbers, how often each occurs in documents to fit and to hold out, and each token's key."""
    keys, inverse = np.unique(x.view(_U), return_inverse=True)
    fit, held = (np.bincount(inverse[own], minlength=len(keys)) for own in (fold > 1, fold == 1))
    return keys, fit, held, inverse


_ASK = "kind int, part long, block long, n long, keys binary, fit binary, held binary"
_ANSWER = "kind int, part long, block long, n long, fit binary, held binary, kinds long, fit_kinds long, fit_tokens long, held_tokens long"


def _ask(bits: int):
    """Of a block, a row for each kind (0: words, 1: pairs) and part of the keys."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        w, pairs, _, fold = _block(docs)
        rows = []
        for kind, x in enumerate((w, pairs)):
            keys, fit, held, _ = _counts(x, fold)
            part = keys >> _U(64 - bits) if bits else np.zeros(len(keys), _U)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows.append((kind, int(part[a]), key[0].as_py(), b - a, _packed(np.diff(keys[a:b], prepend=_U(0))), _packed(fit[a:b]), _packed(held[a:b])))
        return _rows(_ASK, rows)

    return run


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(fields, columns, strict=True)})


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """For each block that asked, how often its keys occur in other blocks; and a row (block -1) of totals."""
    kind, part = (k.as_py() for k in key)
    blocks, sizes = asked["block"].to_pylist(), asked["n"].to_pylist()
    ends = np.cumsum([0, *sizes])
    of = lambda c: [_unpacked(raw, n) for raw, n in zip(asked[c].to_pylist(), sizes, strict=True)]
    keys, inverse = np.unique(np.concatenate([np.cumsum(d) for d in of("keys")]), return_inverse=True)
    others, totals = [], []
    for c in ("fit", "held"):
        own = np.concatenate(of(c)).astype(np.int64)
        # Sums stay whole up to 2^53 tokens.
        total = np.bincount(inverse, own, len(keys)).astype(np.int64)
        others.append(total[inverse] - own)
        totals.append(total)
    rows = [(kind, part, b, n, *(_packed(x[e : e + n]) for x in others), None, None, None, None) for b, n, e in zip(blocks, sizes, ends, strict=False)]
    fit, held = totals
    rows.append((kind, part, -1, 0, b"", b"", int((fit + held > 0).sum()), int((fit > 0).sum()), int(fit.sum()), int(held.sum())))
    return _rows(_ANSWER, rows)


def _answered(answers: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of words and of pairs, the counts (to fit, held out) of the other blocks, in the order of the block's keys."""
    rows = sorted(zip(*(answers[c].to_pylist() for c in ("kind", "part", "n", "fit", "held")), strict=True), key=lambda r: r[:2])
    out = []
    for kind in (0, 1):
        own = [r for r in rows if r[0] == kind]
        out.append(tuple(np.concatenate([_unpacked(r[k], r[2]) for r in own]).astype(np.int64) for k in (3, 4)))
    return out


class Weights:
    """The mixture: totals, and (l2, l1, l0) for each bucket of contexts."""

    def __init__(self, tokens: int, kinds: int):
        self.tokens, self.kinds = tokens, kinds
        self.mix = np.full((64, 3), 1 / 3)

    @staticmethod
    def bucket(count: np.ndarray, tokens: int) -> np.ndarray:
        """Contexts by their share of all tokens, in powers of two."""
        return np.floor(-np.log2(np.maximum(count, 0.5) / max(tokens, 1))).astype(np.int64).clip(0, 63)

    def learn(self, bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, mass: np.ndarray) -> None:
        """Expectation-maximisation for each bucket; without held-out counts the weights stay even."""
        p0 = 1 / (self.kinds + 1)
        self.mix = np.full((64, 3), 1 / 3)
        for b in np.unique(bucket):
            own = bucket == b
            p = np.stack([p2[own], p1[own], np.full(own.sum(), p0)], 1)
            m = mass[own]
            if m.sum() <= 0:
                continue
            for _ in range(ROUNDS):
                share = p * self.mix[b]
                share /= share.sum(1, keepdims=True)
                self.mix[b] = np.maximum((share * m[:, None]).sum(0) / m.sum(), 1e-6)
                self.mix[b] /= self.mix[b].sum()

    def after(self, n: np.ndarray, pair: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of tokens with count c after contexts with count n, which they follow pair times."""
        l = self.mix[self.bucket(n, self.tokens)]
        l[n == 0] = [0, 2 / 3, 1 / 3]
        p = l[:, 0] * pair / np.maximum(n, 1) + l[:, 1] * c / max(self.tokens, 1) + l[:, 2] / (self.kinds + 1)
        return np.log10(p)


def _cells(fit: int):
    """The held-out tokens of a block, counted in cells of about equal estimates; fit: the tokens that are not held out."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        w, pairs, rows, fold = _block(docs)
        c, pair = ((own_fit + others)[inverse] for (_, own_fit, _, inverse), (others, _) in zip((_counts(w, fold), _counts(pairs, fold)), _answered(answers), strict=True))
        n = _before(c, rows, c[rows[1:] - 1])
        known = n > 0
        c, pair, n = c[known], pair[known], n[known]
        p2, p1 = (np.where(x > 0, _log_cell(np.maximum(x, 1) / of), _ZERO) for x, of in ((pair, n), (c, fit)))
        cell = ((Weights.bucket(n, fit) << _SHIFT) + p2 - _ZERO << _SHIFT) + p1 - _ZERO
        cell, m = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(cell), "m": pa.array(m.astype(np.int64))})

    return run


def _score(w: Weights):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        t, pairs, rows, fold = _block(docs)
        c, pair = ((fit + held + more_fit + more_held)[inverse] for (_, fit, held, inverse), (more_fit, more_held) in zip((_counts(t, fold), _counts(pairs, fold)), _answered(answers), strict=True))
        logs = w.after(_before(c, rows, c[rows[1:] - 1]), pair, c)
        first = rows[:-1]
        n = np.diff(rows)
        hit = np.add.reduceat((c > 0).astype(np.int64), first)
        base = np.add.reduceat(np.log10((c + 0.1) / (w.tokens + 0.1 * (w.kinds + 1))), first)
        score = np.add.reduceat(logs, first)
        return pa.table(
            {"doc_id": docs["doc_id"], "held_out": pa.array(docs["fold"].to_numpy() == 0), "n_tokens": pa.array(n), "n_known": pa.array(hit), "train_tokens": pa.array(np.full(len(n), w.tokens)), "base_score": pa.array(base), "score": pa.array(score)}
        )

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _log_cell(p):
    return np.floor(np.log10(p) * GRID).astype(np.int64)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold().cast("long").alias("fold"), text_of().alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, bits = -(-size // BLOCK_BYTES) or 1, max(0, (-(-size // PART_BYTES) - 1).bit_length())
    row, held_blocks = F.xxhash64("doc_id", "text"), -(-blocks // 10)
    dealt = own.withColumn("block", F.when(F.col("fold") == 1, F.lit(blocks) + F.pmod(row, F.lit(held_blocks))).otherwise(F.pmod(row, F.lit(blocks))))
    asked = dealt.groupBy("block").applyInArrow(_ask(bits), _ASK)
    answers = written(asked.groupBy("kind", "part").applyInArrow(_answer, _ANSWER), "answers")
    fit, held, kinds, fit_kinds = (x or 0 for x in answers.where("kind = 0 and block = -1").agg(*map(F.sum, ("fit_tokens", "held_tokens", "kinds", "fit_kinds"))).first())
    per_block = answers.where("block >= 0").select("kind", "part", "block", "n", "fit", "held")
    w = Weights(fit + held, kinds)
    if fit:
        cells = dealt.where("fold = 1").groupBy("block").cogroup(per_block.where(F.col("block") >= blocks).groupBy("block")).applyInArrow(_cells(fit), "cell long, m long")
        cells = written(cells.groupBy("cell").agg(F.sum("m").alias("m")), "cells")
        _learn(w, cells.collect(), Weights(fit, fit_kinds))
        forget(cells)
    return dealt.groupBy("block").cogroup(per_block.groupBy("block")).applyInArrow(_score(w), _SCORES)


def _learn(w: Weights, cells: list, learner: Weights) -> None:
    """Learns the weights from held-out counts in cells of about equal estimates, which are few."""
    if not cells:
        return
    cell, m = (np.array(x, np.int64) for x in zip(*sorted(map(tuple, cells)), strict=True))
    low = (1 << _SHIFT) - 1
    p2, p1 = (np.where(k == _ZERO, 0.0, 10 ** ((k + 0.5) / GRID)) for k in (((cell >> _SHIFT) & low) + _ZERO, (cell & low) + _ZERO))
    learner.learn(cell >> 2 * _SHIFT, p2, p1, m.astype(float))
    w.mix = learner.mix
