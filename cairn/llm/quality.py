"""Quality rules: decision lists learned by sequential covering, in DataFrame operations alone.

Statistics of every text are built-in expressions within its row, so nothing is shuffled. Windows of eight words are
compared by 64-bit hashes; only texts in which one occurs twice pay for finding out where.

The list is learned from labelled documents: a rule for rejection starts empty and grows by the threshold that gains
most (FOIL's gain) on two thirds of the sample, is pruned from its end on the other third, and is taken if it is right
there in at least PRECISION of the cases; what it covers is set aside and the next one is grown. The rules become one
ordered ``CASE WHEN``: the first that holds rejects, none keeps. Learning takes at most SAMPLE labelled documents of
each kind, chosen by a hash of their id, and runs on the driver over their statistics.

Defined results: a null or blank text has no words and fails the base rules. A document whose labels disagree counts once
for each. Labels other than 0 and 1 are passed over; without labels of both kinds there are no rules and the base
decides. Other columns play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, let, text_of, words_of

#: Labelled documents of each kind at most; rules and conditions at most.
SAMPLE, RULES, CONDITIONS = 4000, 12, 4
#: Share of right rejections that a rule needs, and how many documents it must cover.
PRECISION, COVER = 0.95, 5
WINDOW = 8
#: Statistics that conditions are about, each from the counts.
RATES = {
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "exclamations": ("n_exclamations", "n_words"),
    "digits": ("n_digits", "word_chars"),
    "distinct": ("n_distinct", "n_words"),
}


def _covered(keys: Column) -> Column:
    """Of the windows' hashes in order, how many words lie in windows found twice or more."""
    at = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["k"] == F.get(s, j)["k"], F.lit(False))
        twice = F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))
        return F.sort_array(F.filter(twice, lambda p: p.isNotNull()))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"))
    return F.aggregate(let(at, positions), start, step, lambda a: a["n"])


def _repeats(hashes: Column) -> Column:
    def of(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(h[i + k] for k in range(WINDOW))))
        found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(0))
        return F.when(F.size(h) > WINDOW, found).otherwise(0)

    return let(hashes, of)


def _count(text: Column, others: str) -> Column:
    """Characters of text that others, an expression for all other characters, leaves."""
    return F.char_length(F.regexp_replace(text, others, "")).cast("long")


def counted(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, the columns ``keep`` and the counts of every row of docs."""
    t = F.col("t")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"), *keep)
    kept = d.columns[2:]
    d = d.withColumn("words", words_of(t)).withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_BLANK)))
    size = lambda c: F.size(c).cast("long")
    return d.select(
        "doc_id",
        *kept,
        size("words").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(t, "[^#*$%&|<>]+").alias("n_symbols"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeats(F.col("h")).cast("long").alias("n_repeat_words"),
        size("lines").alias("n_lines"),
        _count(t, "[^A-Z]+").alias("n_capitals"),
        (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        _count(t, "[^0-9]+").alias("n_digits"),
        size(F.array_distinct("h")).alias("n_distinct"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


@dataclass(frozen=True)
class Condition:
    """A statistic at least (or at most) a threshold."""

    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = _rate(self.name)
        return value >= self.cut if self.above else value <= self.cut

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.cut if self.above else x[self.name] <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _rate(name: str) -> Column:
    if name not in RATES:
        return F.col(name).cast("double")
    over, under = RATES[name]
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def _all(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for c in rule:
        held &= c.holds(x)
    return held


def _best_cut(v: np.ndarray, bad: np.ndarray, above: bool, before: float) -> tuple[float, float]:
    """Of all thresholds of a statistic the one with the greatest gain, and the gain."""
    order = np.argsort(-v if above else v, kind="stable")
    v, p = v[order], np.cumsum(bad[order])
    last = np.flatnonzero(np.append(v[1:] != v[:-1], True))  # equal values go together
    n, p = last + 1, p[last]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(p > 0, p * (np.log2(p / n) - before), 0.0)
    k = int(np.argmax(gain))
    return float(v[last[k]]), round(float(gain[k]), 9)


def _grown(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition of the greatest gain until a rule covers no good document or nothing gains."""
    rule: list[Condition] = []
    held = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (held & ~bad).any():
        p, n = (held & bad).sum(), held.sum()
        best, worth = None, (1e-9, -1.0)
        for name, v in x.items():
            for above in (True, False):
                cut, gain = _best_cut(v[held], bad[held], above, math.log2(p / n))
                if gain >= worth[0]:  # of equal ones, that with the widest gap
                    c = Condition(name, above, cut)
                    gap = abs(_midway(c, v[held]).cut - cut) / (float(v[held].std()) or 1.0)
                    if (gain, gap) > worth:
                        best, worth = c, (gain, gap)
        if best is None:
            break
        rule.append(best := _midway(best, x[best.name][held]))
        held &= best.holds(x)
    return tuple(rule)


def _midway(c: Condition, v: np.ndarray) -> Condition:
    """The threshold moved half the way to the next value beyond it, so that it doesn't cling to the sample."""
    beyond = v[v < c.cut] if c.above else v[v > c.cut]
    return Condition(c.name, c.above, float((c.cut + (beyond.max() if c.above else beyond.min())) / 2)) if len(beyond) else c


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on documents it wasn't grown on."""

    def worth(r: Rule) -> float:
        held = _all(r, x, len(bad))
        p, n = (held & bad).sum(), (held & ~bad).sum()
        return (p - n) / max(p + n, 1) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learned(rows: list[dict]) -> list[Rule]:
    """The decision list from counts with a quality of 0 or 1."""
    if not rows:
        return []
    value = lambda name: np.array([float(r[name]) if name not in RATES else r[RATES[name][0]] / max(r[RATES[name][1]], 1) for r in rows])
    x = {name: value(name) for name in ("n_words", *RATES)}
    bad = np.array([r["quality"] == 0 for r in rows])
    third = np.arange(len(rows)) % 3 == 0  # rows come in the order of a hash
    left = np.ones(len(rows), bool)
    out: list[Rule] = []
    while len(out) < RULES and (left & bad & ~third).any():
        grow, prune = left & ~third, left & third
        on = lambda m: {k: v[m] for k, v in x.items()}
        rule = _grown(on(grow), bad[grow])
        if not rule:
            break
        rule = _pruned(rule, on(prune), bad[prune])
        held = _all(rule, x, len(rows))
        p, n = (held & left & bad).sum(), (held & left & ~bad).sum()
        q, m = (held & prune & bad).sum(), (held & prune & ~bad).sum()
        if p < COVER or p < PRECISION * (p + n) or q < PRECISION * (q + m):
            break
        out.append(rule)
        left &= ~held
    return out


def keeps(rules: list[Rule]) -> Column:
    """The ordered conditional expression: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        out = F.when(held, False) if out is None else out.when(held, False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[dict]:
    """Counts and quality of at most ``sample`` labelled documents of each kind, in the order of a hash."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null").withColumn("o", F.xxhash64("doc_id"))
    chosen = None
    for q in (0, 1):
        part = own.where(F.col("quality") == q).orderBy("o", "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * sample rows.
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    named = texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    rows = counted(named).where("not base_failed").join(F.broadcast(chosen), "doc_id").orderBy("o", "doc_id", "quality", *sorted({c for pair in RATES.values() for c in pair})).limit(2 * sample).collect()
    return [r.asDict() for r in rows]


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the counts, base_failed, kept of each row of docs, by a list learned from labels (doc_id, quality)."""
    rules = learned(labelled(docs, labels, sample))
    return counted(docs).withColumn("kept", ~F.col("base_failed") & keeps(rules))


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are kept, whole; a decision rests on doc_id and text alone."""
    rules = learned(labelled(docs, labels, sample))
    names = [f"c{k}" for k in range(len(docs.columns))]
    row = F.struct(*(docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True))).alias("row")
    good = counted(docs, row).where(~F.col("base_failed") & keeps(rules))
    return good.select(*(F.col("row")[n].alias(c) for c, n in zip(docs.columns, names, strict=True)))
