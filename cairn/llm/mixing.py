"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

The mix is a row of slots of a block of BLOCK words each. A source needs as many slots as its target has blocks, whole passes
over its documents first and then a part of one; its shuffled documents are laid end to end and cut into blocks, rank k
of its slots takes block k modulo their number, and the last slot takes just the words that are left of the target. So every
source gets its target to the word, whether it has one word or most of the corpus, and the last, short block of a pass
is counted by its words.

Sources own intervals of positions, as long as the slots that they need. Position x of 2^k is slot x / G modulo 2^k, G being
2^k over the golden ratio: slot i has the golden-ratio point i * G / 2^k, and goes to the source in whose interval, which are
the cumulative target weights, that point lies. The points of a stretch of slots are spread evenly, so every stretch is near
the target weights, not just the whole. (The first 2^k >= slots positions; those that no source owns are passed over.)

No source is gathered in one task: documents and slots are first dealt into bounded groups, groups are summed, and only
the sums (a row for each group) are run through a window per source. Sources are ranked, and their slots added up, within
ranges; their common level is found by a few sums.

Defined results: a null text has no words and takes none; sources go by code point, null last, and no source at all gives
an empty table. Equal rows are shuffled to neighbouring places; which of them a cut falls on makes no difference to the row
set. A source whose words are all blank has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANK, NOT_BLANK, forget, text_of, unused, words_of, written

WEIGHTS = (5.0, 2.0, 1.0)
#: A document's words are taken at most so often.
MOST = 3
#: Words of a block, whatever the size of the input.
BLOCK = 64
#: Documents of a group to aim at, slots of a group, positions that a row makes, slots that a task makes, and sources of a range.
DOCUMENTS, GROUP, RUN, TASK, RANGE = 4096, 1 << 16, 1 << 16, 1 << 22, 100_000
#: 2^k of positions at most, so that products stay below 2^63: 140 trillion words.
MOST_BITS = 41


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), th (a hash of the text), place (a shuffle hash, alike in every run and in SQL)."""
    t = text_of()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(words_of(t)).cast("long").alias("size"),
        F.xxhash64(t).alias("th"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"),
    )


def _running(df: DataFrame, order: Column, value: Column, name: str) -> DataFrame:
    """df, written, with the sum of value over all rows before: within ranges of the order, and over the ranges' sums."""
    rows = written(df.select("*", value.alias("value")), "rows")
    ranges = -(-rows.count() // RANGE) or 1
    if ranges == 1:
        return rows.select(*df.columns, F.coalesce(F.sum("value").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias(name))
    dealt = written(rows.repartitionByRange(ranges, order).withColumn("range", F.spark_partition_id()), "ranges")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("range").agg(F.sum("value").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("value").over(W.partitionBy("range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # A row for each range, of which there are as many as partitions.
    out = written(dealt.withColumn("inner", inner).join(F.broadcast(sums), "range").select(*df.columns, (F.col("before") + F.col("inner")).cast("long").alias(name)), "running")
    forget(rows, dealt)
    return out


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, r (its rank), source_size, target: shares by weight, at most ``most`` times a source's size, all used.

    A common level is raised until the targets, min(weight * level, most * size), add up to all words. Each step gives all that
    sources at their limit leave to the others; the level only rises, and it stands when no further source reaches its limit."""
    per = _running(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last(), F.lit(1), "r")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("r", F.lit(len(weights))) + 1).cast("int"))
    t = per.select("source", "r", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("limit"))
    ratio = F.col("limit") / F.col("weight")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full, free = t.agg(F.sum(F.when(ratio <= level, F.col("limit"))), F.sum(F.when(ratio > level, F.col("weight")))).first()
        higher = (total - (full or 0.0)) / free if free else level
        if higher <= level:
            break
        level = higher
    return t.select("source", "r", "source_size", F.least(F.col("weight") * level, F.col("limit")).alias("target"))


def _golden(bits: int) -> tuple[int, int]:
    """The odd number nearest to 2^bits over the golden ratio, and its inverse."""
    g = int((5**0.5 - 1) / 2 * (1 << bits)) | 1
    return g, pow(g, -1, 1 << bits)


def _times(x: Column, factor: int, bits: int) -> Column:
    """x * factor modulo 2^bits, in two steps that stay below 2^63."""
    half = bits // 2
    mod = lambda c, b: c.bitwiseAND(F.lit((1 << b) - 1).cast("long"))
    high = F.shiftleft(mod(x * F.lit(factor >> half).cast("long"), bits - half), half)
    return mod(high + mod(x * F.lit(factor & (1 << half) - 1).cast("long"), bits), bits)


def schedule(per_source: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, r, rank (of the slot among its source's), block (its number), words (that it takes of the block at most).

    Slots that no source owns are missing."""
    whole = per_source.where("source_size > 0").select("r", "source_size", F.floor("target").alias("whole"))
    size, left = F.col("source_size"), F.pmod(F.col("whole"), F.col("source_size"))
    blocks = F.ceil(size / F.lit(block))
    need = F.floor(F.col("whole") / size) * blocks + F.ceil(left / F.lit(block))
    need = whole.select("r", blocks.alias("blocks"), left.alias("left"), need.alias("need")).where("need > 0")
    own = _running(need, F.col("r").asc(), F.col("need"), "lo")
    slots = own.agg(F.sum("need")).first()[0] or 0
    bits = max(slots - 1, 1).bit_length()
    if bits > MOST_BITS:
        raise ValueError(f"{slots} slots are more than 2^{MOST_BITS}; take larger blocks")
    tasks = max(1, -(-slots // TASK))
    low, high = F.col("lo"), F.col("lo") + F.col("need")
    runs = own.select("*", F.explode(F.sequence(F.floor(low / RUN), F.floor((high - 1) / RUN))).alias("run"))
    if tasks > 1:
        runs = runs.repartition(tasks, "r", "run")
    x = F.explode(F.sequence(F.greatest(low, F.col("run") * RUN), F.least(high, (F.col("run") + 1) * RUN) - 1))
    dealt = runs.select("r", "blocks", "left", "need", x.alias("x"))
    dealt = dealt.withColumn("slot", _times(F.col("x"), _golden(bits)[1], bits)).withColumn("g", F.floor(F.col("slot") / GROUP))
    before = dealt.groupBy("r", "g").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("r", "g", F.coalesce(F.sum("n").over(W.partitionBy("r").orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # Rows that a sequence makes aren't in Spark's estimates: without the hints it would take them for few and send them to all.
    ranked = dealt.withColumn("k", F.row_number().over(W.partitionBy("r", "g").orderBy("slot")) - 1).join(before.hint("merge"), ["r", "g"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("k"))
    last = F.when((F.col("rank") == F.col("need") - 1) & (F.col("left") % block > 0), F.col("left") % block)
    return ranked.select("slot", "r", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.coalesce(last, F.lit(block)).alias("words"))


def _laid(sizes: DataFrame, per_source: DataFrame, docs: int) -> DataFrame:
    """Where each document begins on its source's line (start), in the order of place."""
    digits = 2
    while 16**digits * DOCUMENTS < docs:
        digits += 1
    d = sizes.withColumn("g", F.substring("place", 1, digits))
    held = d.groupBy("source", "g").agg(F.sum("size").alias("n"))
    held = held.select(F.col("source").alias("s"), F.col("g").alias("sg"), F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    held = held.join(per_source.withColumnRenamed("source", "ts"), held["s"].eqNullSafe(F.col("ts"))).drop("ts")
    inner = F.coalesce(F.sum("size").over(W.partitionBy("source", "g").orderBy("place", "doc_id", "size", "th").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("inner", inner)
    d = d.join(held, d["source"].eqNullSafe(held["s"]) & (d["g"] == held["sg"]))
    return d.select("doc_id", "th", "size", "r", "source_size", "target", (F.col("before") + F.col("inner")).alias("start"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes), th; a row for each row of docs."""
    sizes = written(sized(docs), "sizes")
    per_source = written(targets(sizes, weights, most), "targets")
    full = F.col("words") == block
    times = schedule(per_source, block).groupBy("r", "block").agg(F.count_if(full).alias("times"), F.coalesce(F.max(F.when(~full, F.col("words"))), F.lit(0)).alias("rest"))
    laid = written(_laid(sizes, per_source, sizes.count()).withColumn("row", F.monotonically_increasing_id()), "laid")
    forget(sizes, per_source)
    end = F.col("start") + F.col("size")
    spread = laid.where("size > 0").select("row", "r", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    first, last = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(F.col("end") - F.col("block") * block, F.lit(block))
    rest = F.greatest(F.least(last, F.col("rest")) - first, F.lit(0))
    taken = spread.join(times.hint("merge"), ["r", "block"]).groupBy("row").agg(F.sum((last - first) * F.col("times") + rest).alias("taken"))
    return laid.join(taken.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "th")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: whole copies, and where the last block ends within a document, its words up to there.

    All columns stay; n_chars, if there, is brought up to date. Rows alike in doc_id and text share what they take evenly."""
    id_, th, taken, size, words = unused(docs, "id", "th", "taken", "size", "words")
    m = mixed(docs).groupBy("doc_id", "th").agg(F.floor(F.sum("taken") / F.count(F.lit(1))).alias(taken), F.first("size").alias(size))
    m = m.where(F.col(taken) > 0).withColumnsRenamed({"doc_id": id_} | ({} if th == "th" else {"th": th}))
    copies = F.transform(F.sequence(F.lit(0), F.floor((F.col(taken) - 1) / F.col(size))), lambda k: F.least(F.col(size), F.col(taken) - k * F.col(size)))
    m = m.select(id_, th, size, F.explode(copies).alias(words))
    both = docs.join(m, docs["doc_id"].cast("long").eqNullSafe(m[id_]) & (F.xxhash64(text_of(docs["text"])) == m[th]))
    runs = F.split(docs["text"], f"(?<={BLANK})(?={NOT_BLANK})")
    start = F.col(words) + F.when(docs["text"].rlike(f"^{BLANK}"), 1).otherwise(0)
    text = F.when(F.col(words) == F.col(size), docs["text"]).otherwise(F.array_join(F.slice(runs, F.lit(1), start.cast("int")), ""))
    new = both.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns))
    return new.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new
