"""Line dedup that can be taken back: sharded cuckoo filters over exact reference counts.

The state is two tables in the shared folder. ``refs`` holds, for every line key, the number of documents that have it
(128 bits of the key, exact counts). ``filters`` holds, for each shard of the keys, a cuckoo filter of those keys that
have reached the threshold. Inserting documents adds to the counts and puts keys that cross the threshold into their
shard's filter; deleting documents subtracts and takes keys that fall below it out again, which a cuckoo filter can
do and a Bloom filter can't. So inserting and then deleting the same documents gives the state from before.

To drop lines, every line key of the documents goes to its shard's filter: a miss is certain, so most lines end there. Hits
are confirmed against ``refs`` in a join. It is the same way at every size: filters and lines meet by shard, nothing is sent out whole but
a number for each shard. A shard's lines are dealt into parts of about TOGETHER by the exact counts, each part with the
shard's filter, and the hits of a key that more than TOGETHER documents have into parts by that key's count.

Defined results: null and empty texts are one empty line, which has no key and stays. A row is a document, so a
repeated row counts twice. A text whose lines all go becomes empty. Deleting a document that was never inserted raises.
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .common import bound_batches, forget, text_of, unused, written

_U = np.uint64
#: Slots of a bucket, keys of a shard to aim at, moves before a filter counts as full, and how full to plan it.
SLOTS, SHARD_KEYS, MOVES, FILL = 4, 1 << 14, 500, 0.8
#: Shards at most, as each is a number on every executor; beyond that they hold more keys.
MOST_SHARDS = 1 << 20
#: Lines of a shard, and of a key, that stay together.
TOGETHER = 200_000


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints; keys are pairs of unsigned 64-bit numbers."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.mask = buckets - 1
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots.reshape(buckets, SLOTS).copy()

    @staticmethod
    def planned(keys: int) -> Cuckoo:
        return Cuckoo(1 << max(0, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * FILL))))))

    @staticmethod
    def print_of(k1: int) -> int:
        return (k1 & 0xFFFF) or 1

    def other(self, bucket: int, mark: int) -> int:
        """The second bucket of a fingerprint; of that, the first again."""
        return (bucket ^ (mark * 0x5BD1E995 >> 3)) & self.mask

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = mark
        return bool(len(free))

    def insert(self, k1: int, k2: int) -> bool:
        """False if the filter is full; it then has lost a fingerprint and must be rebuilt."""
        mark, at = self.print_of(k1), k2 & self.mask
        if self._put(at, mark) or self._put(self.other(at, mark), mark):
            return True
        for move in range(MOVES):
            slot = (mark + move) % SLOTS
            mark, self.slots[at, slot] = int(self.slots[at, slot]), mark
            at = self.other(at, mark)
            if self._put(at, mark):
                return True
        return False

    def may_have(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark = (k1 & _U(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        one = (k2 & _U(self.mask)).astype(np.int64)
        two = (one ^ (mark * 0x5BD1E995 >> 3)) & self.mask
        m = mark[:, None].astype(np.uint16)
        return (self.slots[one] == m).any(1) | (self.slots[two] == m).any(1)

    def delete(self, k1: int, k2: int) -> bool:
        mark, at = self.print_of(k1), k2 & self.mask
        for bucket in (at, self.other(at, mark)):
            held = np.flatnonzero(self.slots[bucket] == mark)
            if len(held):
                self.slots[bucket, held[0]] = 0
                return True
        return False


def shard_of(k1: np.ndarray, shards: int) -> np.ndarray:
    return ((k1 >> _U(40)) & _U(shards - 1)).astype(np.int64)


def _keys(text: bytes, shortest: int) -> list[bytes]:
    """The key of each line, empty where it is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        if len(key) < shortest or not key or shortest > 1 and len(key.decode("utf-8", "replace")) < shortest:
            out.append(b"")
        else:
            out.append(blake2b(key, digest_size=16).digest())
    return out


def _line_keys(shortest: int):
    """doc_id, th, k1, k2 for each distinct key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = _distinct_keys(b.column(2), shortest)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(keys[:, k].copy().view(np.int64)) for k in (0, 1))], ["doc_id", "th", "k1", "k2"])

    return run


def _distinct_keys(texts: pa.Array, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    found, rows = [], []
    for r, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        own = set(_keys(text, shortest))
        own.discard(b"")
        found += own
        rows += [r] * len(own)
    return np.frombuffer(b"".join(found), _U).reshape(-1, 2), np.array(rows, np.int64)


def _dealt(doc_id: np.ndarray, th: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part of so many that a document's line goes to: by its own hash, alike in every run."""
    return (T.mix(T.mix(doc_id.astype(_U)) + th.astype(_U)) % parts.astype(_U)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False)


def _dealt_lines(shortest: int, parts):
    """The lines, with the shard and the part of it that they go to; those of shards without a filter end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = parts.value
        for b in batches:
            keys, rows = _distinct_keys(b.column(2), shortest)
            shard = shard_of(keys[:, 0], len(of))
            own = of[shard] > 0
            keys, rows, shard = keys[own], rows[own], shard[own]
            take = pa.array(rows)
            doc, th = b.column(0).take(take), b.column(1).take(take)
            part = _dealt(_ids(doc), th.to_numpy(zero_copy_only=False), of[shard])
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part), doc, th, *(pa.array(keys[:, k].copy().view(np.int64)) for k in (0, 1))], ["shard", "part", "doc_id", "th", "k1", "k2"])

    return run


def _probe(key: tuple, lines: pa.Table, filters: pa.Table) -> pa.Table:
    """The lines of a part that its shard's filter lets through, with the part of their key (0 unless it is in many documents)."""
    (f,) = filters.to_pylist()
    k1, k2 = (lines[c].to_numpy().view(_U) for c in ("k1", "k2"))
    hit = Cuckoo(f["buckets"], np.frombuffer(f["slots"], np.uint16)).may_have(k1, k2)
    out = lines.filter(pa.array(hit)).select(["doc_id", "th", "k1", "k2"]).combine_chunks()
    parts = np.ones(len(out), np.int64)
    k1, k2 = k1[hit].view(np.int64), k2[hit].view(np.int64)
    for many in f["many"] or ():
        parts[(k1 == many["k1"]) & (k2 == many["k2"])] = many["parts"]
    doc, th = _ids(out["doc_id"].combine_chunks()), out["th"].to_numpy()
    return out.append_column("part", pa.array(_dealt(doc, th, parts)))


_LINE = "doc_id long, th long, k1 long, k2 long"
_FILTER = "shard long, buckets long, slots binary, keys long"


def _identified(docs: DataFrame) -> DataFrame:
    """Rows by doc_id and a hash of the text: rows alike in both get the same decisions."""
    bound_batches(docs.sparkSession)
    t = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"))


def _built(shards: int):
    def run(key: tuple, hot: pd.DataFrame) -> pd.DataFrame:
        k1, k2 = (hot[c].to_numpy().view(_U).tolist() for c in ("k1", "k2"))
        made, room = False, len(hot)
        while not made:
            f = Cuckoo.planned(room)
            made = all(f.insert(a, b) for a, b in zip(k1, k2, strict=True))
            room *= 2
        return pd.DataFrame({"shard": [key[0]], "buckets": [f.mask + 1], "slots": [f.slots.tobytes()], "keys": [len(hot)]})

    return run


def _changed(key: tuple, old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after changes; null slots say that it must be built anew."""
    f = Cuckoo(int(old["buckets"][0]), np.frombuffer(old["slots"][0], np.uint16)) if len(old) else Cuckoo.planned(len(changes))
    n, whole = int(old["keys"][0]) if len(old) else 0, True
    for k1, k2, put in zip(changes["k1"].to_numpy().view(_U).tolist(), changes["k2"].to_numpy().view(_U).tolist(), changes["put"], strict=True):
        whole = (f.insert(k1, k2) if put else f.delete(k1, k2)) and whole
        n += 1 if put else -1
    return pd.DataFrame({"shard": [key[0]], "buckets": [f.mask + 1], "slots": [f.slots.tobytes() if whole else None], "keys": [n]})


@dataclass(frozen=True)
class LineState:
    """Counts and filters after some insertions and deletions; a change makes a new state and leaves this one."""

    spark: SparkSession
    refs: DataFrame
    filters: DataFrame
    shards: int
    at_least: int
    shortest: int

    @staticmethod
    def built(docs: DataFrame, at_least: int = 10, shortest: int = 1) -> LineState:
        """The state of all lines of docs: keys of at_least documents and shortest code points are to go."""
        spark = docs.sparkSession
        lines = _identified(docs).mapInArrow(_line_keys(shortest), _LINE)
        refs = written(lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")), "line-refs")
        hot = refs.where(F.col("n") >= at_least)
        shards = _shards(hot.count())
        return LineState(spark, refs, _filters(hot, shards), shards, at_least, shortest)

    def inserted(self, docs: DataFrame) -> LineState:
        return self._moved(docs, 1)

    def deleted(self, docs: DataFrame) -> LineState:
        """The state without docs, which were inserted before."""
        return self._moved(docs, -1)

    def _moved(self, docs: DataFrame, by: int) -> LineState:
        more = _identified(docs).mapInArrow(_line_keys(self.shortest), _LINE).groupBy("k1", "k2").agg((F.count(F.lit(1)) * by).alias("d"))
        both = self.refs.join(more, ["k1", "k2"], "full")
        now = both.select("k1", "k2", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n"))
        now = written(now, "line-changes")
        if not now.where("n < 0").isEmpty():
            forget(now)
            raise ValueError("a document is deleted that was never inserted")
        refs = written(now.where("n > 0").drop("was"), "line-refs")
        shards = _shards(refs.where(F.col("n") >= self.at_least).count())
        if shards > 4 * self.shards:
            forget(now)
            return replace(self, refs=refs, filters=_filters(refs.where(F.col("n") >= self.at_least), shards), shards=shards)
        over, before = F.col("n") >= self.at_least, F.col("was") >= self.at_least
        changes = now.where(over != before).select(_shard(self.shards).alias("shard"), "k1", "k2", over.alias("put"))
        touched = self.filters.join(changes.select("shard").distinct(), "shard", "left_semi")
        new = written(touched.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_changed, _FILTER), "line-filters")
        full = new.where("slots is null").select("shard")
        hot = refs.where(F.col("n") >= self.at_least).select("k1", "k2", _shard(self.shards).alias("shard")).join(full, "shard", "left_semi")
        same = self.filters.join(new.select("shard"), "shard", "left_anti")
        filters = same.union(new.where("slots is not null and keys > 0")).union(_filters(hot, self.shards))
        filters = written(filters, "line-filters")
        forget(now, new)
        return replace(self, refs=refs, filters=filters)

    def dropped(self, docs: DataFrame) -> DataFrame:
        """doc_id, th, and the keys that go (gone) of each row that has any."""
        shard = _shard(self.shards).alias("shard")
        parts = F.ceil(F.col("n") / F.lit(TOGETHER)).cast("long").alias("parts")
        hot = self.refs.where(F.col("n") >= self.at_least)
        per_shard = self.refs.groupBy(shard).agg(F.sum("n").alias("n")).select("shard", parts)
        per_shard = written(self.filters.select("shard", "buckets", "slots").join(per_shard, "shard"), "line-probes")
        of = np.zeros(self.shards, np.int32)
        for r in per_shard.select("shard", "parts").toLocalIterator():
            of[r["shard"]] = r["parts"]
        lines = _identified(docs).mapInArrow(_dealt_lines(self.shortest, self.spark.sparkContext.broadcast(of)), "shard long, part long, " + _LINE)
        # Keys of so many documents: at most one for each TOGETHER lines of the shard.
        many = hot.where(F.col("n") > TOGETHER).select(shard, F.struct("k1", "k2", parts).alias("m")).groupBy("shard").agg(F.collect_list("m").alias("many"))
        probes = per_shard.join(many, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "buckets", "slots", "many")
        hits = lines.groupBy("shard", "part").cogroup(probes.groupBy("shard", "part")).applyInArrow(_probe, _LINE + ", part long")
        sure = hot.select("k1", "k2", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1)).alias("part"))
        return hits.join(sure, ["k1", "k2", "part"]).groupBy("doc_id", "th").agg(F.collect_set(F.struct("k1", "k2")).alias("gone"))

    def applied(self, docs: DataFrame) -> DataFrame:
        """doc_id, text (what is left), n_lines (before), n_dropped of each row of docs."""
        gone = self.dropped(docs).select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), F.transform("gone", lambda g: g["k1"]).alias("g1"), F.transform("gone", lambda g: g["k2"]).alias("g2"))
        own = _identified(docs)
        both = own.join(gone, own["doc_id"].eqNullSafe(gone["g_id"]) & (own["th"] == gone["g_th"]), "left").select("doc_id", "text", "g1", "g2")
        return both.mapInArrow(_without(self.shortest), "doc_id long, text string, n_lines long, n_dropped long")


def _shards(keys: int) -> int:
    """A power of two of shards for so many keys."""
    return min(1 << max(0, int(np.ceil(np.log2(max(keys, 1) / SHARD_KEYS)))), MOST_SHARDS)


def _shard(shards: int):
    return F.shiftrightunsigned("k1", 40).bitwiseAND(shards - 1).cast("long")


def _filters(hot: DataFrame, shards: int) -> DataFrame:
    return written(hot.select("k1", "k2", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(_built(shards), _FILTER), "line-filters")


def _without(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, lines, dropped = [], [], []
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for text, g1, g2 in zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n = text.count(b"\n") + 1
                if g1:
                    pairs = np.array([g1, g2], np.int64).T.tobytes()
                    gone = {pairs[k : k + 16] for k in range(0, len(pairs), 16)}
                    left = [line for line, key in zip(text.split(b"\n"), _keys(text, shortest), strict=True) if key not in gone]
                    text = b"\n".join(left)
                    dropped.append(n - len(left))
                else:
                    dropped.append(0)
                kept.append(text)
                lines.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return run


def deduplicated(docs: DataFrame, at_least: int = 10, shortest: int = 1) -> DataFrame:
    """doc_id, text without the lines that at_least documents have, n_lines, n_dropped."""
    return LineState.built(docs, at_least, shortest).applied(docs)


def without_common_lines(docs: DataFrame, at_least: int = 10, shortest: int = 1) -> DataFrame:
    """docs with their texts deduplicated and n_chars, if there, brought up to date; all columns stay."""
    id_, th, g1, g2 = unused(docs, "id", "th", "g1", "g2")
    state = LineState.built(docs, at_least, shortest)
    gone = state.dropped(docs).select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.transform("gone", lambda g: g["k1"]).alias(g1), F.transform("gone", lambda g: g["k2"]).alias(g2))
    both = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[id_]) & (F.xxhash64(text_of(docs["text"])) == gone[th]), "left")
    kept = F.when(F.col(g1).isNull(), docs["text"]).otherwise(_stripped(shortest)(docs["text"], F.col(g1), F.col(g2)))
    new = both.select(*(kept.alias(c) if c == "text" else docs[c] for c in docs.columns))
    return new.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def _stripped(shortest: int):
    @F.pandas_udf("string")
    def strip(texts: pd.Series, g1: pd.Series, g2: pd.Series) -> pd.Series:
        out = []
        for text, a, b in zip(texts, g1, g2, strict=True):
            if a is None or text is None:
                out.append(text)
                continue
            raw = text.encode()
            pairs = np.array([a, b], np.int64).T.tobytes()
            gone = {pairs[k : k + 16] for k in range(0, len(pairs), 16)}
            out.append(b"\n".join(line for line, key in zip(raw.split(b"\n"), _keys(raw, shortest), strict=True) if key not in gone).decode())
        return pd.Series(out, dtype=object)

    return strip
