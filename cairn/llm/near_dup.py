"""Near duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A signature holds K symbols of B bits. Two texts whose shingle sets have a Jaccard similarity of s differ in about
(1 - s) * K symbols, so all pairs whose signatures differ in at most ``errors`` symbols are candidates. They are found
whole by pigeonhole: the signature is split into ``chunks``; of two signatures within the threshold, some chunk differs
in at most ``errors // chunks`` symbols, and a key is written for every way to leave that many symbols of a chunk out.
At the default's threshold of 0.8 (48 symbols, 23 errors), and at QUERY's of 0.85 (32 symbols, 15 errors), a pair is missed
with a chance below 4 in a million, and far more rarely above it. Symbols lie four to a 64-bit column, so keys and distances
are bit operations.

Texts with equal shingle sets (128 bits of the set) are one class from the start, numbered when the classes are written.
Within a bucket of classes pairs aren't all written: every class is held against the bucket's leader (the class that shares
most keys with others), a link joins components, the leader leaves the bucket (its links are all known), and a bucket whose
classes are in one component is done. What is left are classes near a group but not in it. They get a second signature of
WIDE 2-bit symbols, and the buckets' blocks are compared in memory on the distance of those, which lets through
pairs just below the similarity at the lowest (a linked pair is missed with a chance of one in a million). Such pairs aren't
written: a class near a component visits it, and is held against its classes on the full sets. Links are
confirmed on the full sets. So a bucket of n near copies makes about n pairs, not n * n, and no component differs for
it. Every join is between distributed tables; rows of a large bucket, and pairs with one text, are dealt into parts
by how many they are.

Defined results: a null, empty or blank text has an empty set, is linked with nothing and stays. A row without doc_id is
neither linked nor dropped (component_id null). Rows that share a doc_id are one document with several texts: it is linked
through each of them and has one component_id. ``one_of_each`` goes by texts instead, so that a document's other text
never goes with one that is a copy. Other columns play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import bound_batches, forget, text_of, unused, written

_U = np.uint64
#: Pairs of a bucket, for each row that the buckets held at first, up to which second signatures are compared.
FEW = 500
#: 2-bit symbols of the second signature; ids that are sent to the executors (16 bytes each).
WIDE, SENT_IDS = 2048, 2_000_000
_LONGS = WIDE // 32
#: Bits of a symbol in a column of 64, and symbols there.
LANE, LANES = 16, 4
#: Rows of a bucket, and pairs with one text, that stay together; a larger number is dealt into parts.
TOGETHER, BLOCK = 50_000, 2000
#: Rows of a bucket's block where second signatures are compared, and pairs at a time; members and visitors that meet in a group.
NEAR, COMPARED, MET = 500, 50_000, 100


@dataclass(frozen=True)
class NearDup:
    """Shingles of ``words`` words, linked from a Jaccard similarity of ``percent`` / 100 on; symbols of up to LANE bits."""

    words: int = 5
    percent: int = 80
    symbols: int = 48
    chunks: int = 12
    errors: int = 23
    bits: int = 16

    def left_out(self) -> list[tuple[int, ...]]:
        """The symbols that each key of a signature is made of."""
        size = self.symbols // self.chunks
        out = self.errors // self.chunks
        return [tuple(c * size + p for p in kept) for c in range(self.chunks) for kept in combinations(range(size), size - out)]

    def columns(self) -> list[str]:
        """Where signatures lie, LANES symbols in each."""
        return [f"s{k}" for k in range(-(-self.symbols // LANES))]

    def keys(self) -> list[Column]:
        """A key for each of ``left_out``: a hash of those symbols, the others masked."""
        out = []
        for number, kept in enumerate(self.left_out()):
            masks: dict[int, int] = {}
            for s in kept:
                masks[s // LANES] = masks.get(s // LANES, 0) | (1 << LANE) - 1 << LANE * (s % LANES)
            parts = [F.col(f"s{k}").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for k, m in sorted(masks.items())]
            out.append(F.xxhash64(F.lit(number), *parts))
        return out


#: 3-word shingles from 85 % on, as the query asks for.
QUERY = NearDup(words=3, percent=85, symbols=32, chunks=8, errors=15)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, and for each row the number of them before it.

    A text with fewer words than a shingle has its whole sequence as one."""
    h, rows = T.word_hashes(data, at)
    n = np.diff(rows)
    steps = [T.mix(np.array([k + 1], _U))[0] | _U(1) for k in range(words)]
    if len(h) >= words:
        size = len(h) - words + 1
        long = np.zeros(size, _U)
        for k in range(words):
            long += h[k : k + size] * steps[k]
        long = T.mix(long)
    sets = []
    for r in range(len(n)):
        a, b = rows[r], rows[r + 1]
        if n[r] >= words:
            sets.append(np.unique(long[a : b - words + 1]))
        elif n[r]:
            sets.append(T.mix(np.array([(h[a:b] * np.array(steps[: n[r]])).sum() + _U(int(n[r]))], _U) ^ _U(0x5851F42D4C957F2D)))
        else:
            sets.append(np.zeros(0, _U))
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, _U), np.concatenate([[0], np.cumsum(sizes)])


@functools.lru_cache(8)
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = T.mix(np.arange(1, 2 * k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return seeds[:k] | _U(1), seeds[k:]


def signatures(h: np.ndarray, rows: np.ndarray, how: NearDup) -> np.ndarray:
    """rows x symbols; zeros for an empty set."""
    n = len(rows) - 1
    sig = np.zeros((n, LANES * len(how.columns())), "<u2")
    full = np.flatnonzero(np.diff(rows))
    if not len(full):
        return sig
    times, plus = _permutations(how.symbols)
    for k in range(how.symbols):
        low = np.minimum.reduceat(h * times[k] + plus[k], rows[:-1][full])
        sig[full, k] = (T.mix(low) & _U((1 << how.bits) - 1)).astype(np.uint16)
    return sig


def _signer(how: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = T.buffers(b.column(2))
            for i, j in T.pieces(at):
                h, rows = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], how.words)
                ends = np.concatenate([np.zeros(1, _U), np.cumsum(h)]), np.concatenate([np.zeros(1, _U), np.cumsum(T.mix(h ^ _U(0x2545F4914F6CDD1D)))])
                digests = [pa.array((e[rows[1:]] - e[rows[:-1]]).view(np.int64)) for e in ends]
                sig = signatures(h, rows, how).view("<i8")
                own = [b.column(k).slice(i, j - i) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(rows)), *digests, *(pa.array(c.copy()) for c in sig.T)], ["doc_id", "th", "n_shingles", "d1", "d2", *how.columns()])

    return run


def _with_th(docs: DataFrame, *more: Column) -> DataFrame:
    t = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"), *more)


def signed(docs: DataFrame, how: NearDup) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, d1 and d2 (128 bits of the set), the signature; a row for each row of docs."""
    bound_batches(docs.sparkSession)
    return _with_th(docs).mapInArrow(_signer(how), ", ".join(f"{c} long" for c in ["doc_id", "th", "n_shingles", "d1", "d2", *how.columns()]))


def _judge(how: NearDup):
    """Of pairs of texts (b follows b), whether their full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for b in batches:
            linked = []
            (data, at), (more, its) = T.buffers(b.column(2)), T.buffers(b.column(3))
            leaders = b.column(1).to_pylist()
            for i, j in T.pieces(at):
                h, rows = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], how.words)
                for r in range(i, j):
                    if leaders[r] != last:
                        last, kept = leaders[r], shingle_sets(more[its[r] : its[r + 1]], np.array([0, its[r + 1] - its[r]]), how.words)[0]
                    own = h[rows[r - i] : rows[r - i + 1]]
                    both = len(np.intersect1d(own, kept, assume_unique=True))
                    linked.append(both > 0 and 100 * both >= how.percent * (len(own) + len(kept) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _widely_signed(how: NearDup):
    """The second signature: for each of WIDE permutations two bits of the least shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = _permutations(WIDE)
        for b in batches:
            data, at = T.buffers(b.column(1))
            for i, j in T.pieces(at):
                h, rows = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], how.words)
                longs = np.zeros((j - i, _LONGS), _U)
                full = np.flatnonzero(np.diff(rows))
                for k in range(WIDE if len(full) else 0):
                    two = T.mix(np.minimum.reduceat(h * times[k] + plus[k], rows[:-1][full])) & _U(3)
                    longs[full, k // 32] |= two << _U(2 * (k % 32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(longs[:, k].copy().view(np.int64)) for k in range(_LONGS))], ["cid", *(f"w{k}" for k in range(_LONGS))])

    return run


def _wide_errors(how: NearDup, symbols: int, deviations: int) -> int:
    """In how many of so many symbols the second signatures of a linked pair differ, and some standard deviations more."""
    p = (100 - how.percent) / 100 * 3 / 4
    return int(symbols * p + deviations * (symbols * p * (1 - p)) ** 0.5) + 1


#: Two lanes of a column at their highest, each with LANE bits free above it, and the lowest of those free bits.
_PAIR, _ABOVE = 0x0000FFFF0000FFFF, 0x0001000000010000


def _near(how: NearDup) -> str:
    """Signatures (s..., o...) within the threshold: a lane that differs carries into the free bit above it."""
    lanes = [part for c in how.columns() for part in (f"(s{c[1:]} ^ o{c[1:]})", f"shiftrightunsigned(s{c[1:]} ^ o{c[1:]}, {LANE})")]
    return " + ".join(f"bit_count((({x} & {_PAIR}L) + {_PAIR}L) & {_ABOVE}L)" for x in lanes) + f" <= {how.errors}"


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, t of the wanted texts (cid, id, th), written; one row for each, however often it is repeated. The ids go to the
    executors while they are few, else the texts are shuffled."""
    wanted = written(wanted, "wanted")
    n = wanted.count()
    own = _with_th(docs)
    both = own.join(F.broadcast(wanted) if n <= SENT_IDS else wanted, (own["doc_id"] == wanted["id"]) & (own["th"] == wanted["th"])).select("cid", "t")
    texts = written(both, "texts")
    forget(wanted)
    if texts.count() == n:
        return texts
    once = written(texts.dropDuplicates(["cid"]), "texts")
    forget(texts)
    return once


def _within(pairs: DataFrame, classes: DataFrame, how: NearDup) -> DataFrame:
    """The pairs whose signatures are within the threshold; written."""
    a = classes.select(F.col("cid").alias("a"), *how.columns())
    b = classes.select(F.col("cid").alias("b"), *(F.col(c).alias(f"o{c[1:]}") for c in how.columns()))
    return written(pairs.join(a, "a").join(b, "b").where(_near(how)).select("a", "b"), "close")


def _parts(n: Column, together: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(together)), F.lit(1)).cast("long")


def _part(of: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), of), parts)


def _linked(close: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """The links (a, b) among pairs, by the full sets; written. The pairs of one b are dealt into parts by their number, and its
    text goes to each part."""
    many = written(close.groupBy("b").agg(_parts(F.count(F.lit(1)), BLOCK).alias("parts")).where("parts > 1"), "many")
    # One in BLOCK pairs at most; beyond the bound by a shuffle.
    known = close.join(F.broadcast(many) if many.count() <= SENT_IDS else many, "b", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = written(known.select("a", "b", _part("a", F.col("parts")).alias("part"), "parts"), "dealt")
    forget(many)
    ours = dealt.select("a", "b", "part").join(texts.select(F.col("cid").alias("a"), F.col("t").alias("s")), "a")
    theirs = dealt.select("b", "parts").distinct().select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    theirs = theirs.join(texts.select(F.col("cid").alias("b"), "t"), "b")
    both = ours.join(theirs, ["b", "part"]).select("a", "b", "s", "t").mapInArrow(_judge(how), "a long, b long, linked boolean")
    links = written(both.where("linked").select("a", "b").distinct(), "links")
    forget(dealt)
    return links


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """node, comp (the smallest node reachable) of the undirected graph of a, b; nodes without links are absent.

    The smallest neighbouring label and then the label of the label are taken until nothing changes, each round written."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), f"{tag}-edges")
    at = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), tag)
    while True:
        best = both.join(at.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = at.join(best, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("mid"))
        jump = at.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = written(step.join(jump, "mid", "left").select("node", "was", F.coalesce(F.least("mid", "far"), "mid").alias("comp")), tag)
        forget(at)
        if not new.where("was <> comp").limit(1).count():
            forget(both)
            return new
        at = new


def _sent(few: DataFrame) -> DataFrame:
    """A written table, to be sent to the executors while it is small."""
    return F.broadcast(few) if few.count() <= SENT_IDS else few


def _differ(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many symbols rows of second signatures differ."""
    x = one ^ two
    return np.bitwise_count((x | x >> _U(1)) & _U(0x5555555555555555)).sum(1, dtype=np.int64)


def _visiting(how: NearDup):
    """Of rows (key, p, q, second, cid, comp, size, signature) in the order of key, p, q: which class (cid) is near a class of which
    other component (comp). The class of the smaller component visits the larger one."""
    quarter = _LONGS // 4
    few, most = _wide_errors(how, WIDE // 4, 6), _wide_errors(how, WIDE, 5)

    def met(ids: np.ndarray, wide: np.ndarray) -> np.ndarray:
        second, cid, comp, size = ids[:, 3], ids[:, 4], ids[:, 5], ids[:, 6]
        within = ids[0, 1] == ids[0, 2]
        one = np.arange(len(ids)) if within else np.flatnonzero(second == 0)
        two = one if within else np.flatnonzero(second == 1)
        out, step = [], max(1, COMPARED // max(1, len(two)))
        for k in range(0, len(one), step):
            i, j = np.nonzero(comp[one[k : k + step], None] != comp[two])
            i, j = one[i + k], two[j]
            if within:
                i, j = i[i < j], j[i < j]
            # Most pairs differ too much in the first quarter already.
            near = _differ(wide[i, :quarter], wide[j, :quarter]) <= few
            i, j = i[near], j[near]
            near = _differ(wide[i], wide[j]) <= most
            i, j = i[near], j[near]
            visits = (size[i] < size[j]) | (size[i] == size[j]) & (comp[i] > comp[j])
            out.append(np.column_stack([cid[np.where(visits, i, j)], comp[np.where(visits, j, i)]]))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wide = np.zeros((0, 7), np.int64), np.zeros((0, _LONGS), _U)

        def done(until: int) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.any(np.diff(ids[:until, :3], axis=0), 1)) + 1
            found = [met(ids[i:j], wide[i:j]) for i, j in zip([0, *cuts], [*cuts, until], strict=True) if j - i > 1]
            found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["cid", "comp"])

        for b in batches:
            if not b.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            ids, wide = np.concatenate([ids, np.column_stack(columns[:7])]), np.concatenate([wide, np.column_stack(columns[7:]).view(_U)])
            # The last group may go on in the next batch.
            before = np.flatnonzero(np.any(ids[:, :3] != ids[-1, :3], axis=1))
            if len(before):
                until = int(before[-1]) + 1
                yield done(until)
                ids, wide = ids[until:], wide[until:]
        if len(ids):
            yield done(len(ids))

    return run


def _received(how: NearDup):
    """Of rows (comp, m, v, visits, cid, text) in the order of the first four, members before visitors: for each visitor the member
    that is most similar to it, if their full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, sets, starts, whole = None, [], [], None, None
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
            data, at = T.buffers(b.column(5))
            links = []
            for i, j in T.pieces(at):
                h, rows = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], how.words)
                for r in range(i, j):
                    *here, visits, cid = keys[r]
                    own = h[rows[r - i] : rows[r - i + 1]]
                    if here != group:
                        group, members, sets, whole = here, [], [], None
                    if not visits:
                        members.append(cid)
                        sets.append(own)
                        continue
                    if not members or not len(own):
                        continue
                    if whole is None:
                        whole, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
                        starts = np.cumsum(sizes) - sizes
                    both = np.add.reduceat(own[np.minimum(np.searchsorted(own, whole), len(own) - 1)] == whole, starts, dtype=np.int64)
                    union = sizes + len(own) - both
                    linked = np.flatnonzero((both > 0) & (100 * both >= how.percent * union))
                    if len(linked):
                        links.append((cid, members[linked[np.argmax(both[linked] / union[linked])]]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _joining(active: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """Links (a, b) that join the components whose classes meet in a bucket; written.

    Pairs of classes aren't written. Buckets are cut into blocks of NEAR rows, and a task that holds two of them says which class is
    near which other component, by the second signatures. Such a class visits the component: it is held against all of its
    classes that are left in buckets, on the full sets, and gives one link for each part of them at most."""
    names = [f"w{k}" for k in range(_LONGS)]
    members = written(active.select("cid", "comp").distinct(), "members")
    wide = written(texts.join(members.select("cid"), "cid", "left_semi").select("cid", "t").mapInArrow(_widely_signed(how), ", ".join(f"{c} long" for c in ["cid", *names])), "wide")
    several = written(members.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "several")
    blocks = active.groupBy("key").agg(_parts(F.count(F.lit(1)), NEAR).alias("blocks"))
    rows = active.select("key", "cid", "comp").join(wide, "cid").join(blocks, "key").join(_sent(several), "comp", "left")
    rows = rows.withColumn("size", F.coalesce("size", F.lit(1).cast("long"))).withColumn("mine", _part("cid", F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")}).withColumn("second", (F.col("mine") != F.col("p")).cast("long"))
    rows = rows.select("key", "p", "q", "second", "cid", "comp", "size", *names).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    visits = written(rows.mapInArrow(_visiting(how), "cid long, comp long").distinct(), "visits")
    forget(wide)
    many = visits.groupBy("comp").agg(_parts(F.count(F.lit(1)), MET).alias("vs"))
    plan = written(many.join(_sent(several), "comp", "left").select("comp", "vs", _parts(F.coalesce("size", F.lit(1)), MET).alias("ms")), "plan")
    till = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    ours = members.join(_sent(plan), "comp").join(texts, "cid").select("comp", _part("cid", F.col("ms")).alias("m"), till("vs").alias("v"), F.lit(False).alias("visits"), "cid", "t")
    theirs = visits.join(_sent(plan), "comp").join(texts, "cid").select("comp", till("ms").alias("m"), _part("cid", F.col("vs")).alias("v"), F.lit(True).alias("visits"), "cid", "t")
    both = ours.union(theirs).repartition("comp", "m", "v").sortWithinPartitions("comp", "m", "v", "visits")
    links = written(both.mapInArrow(_received(how), "a long, b long"), "links")
    forget(members, several, visits, plan)
    return links


def _also(old: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if old is None else old.union(more)


def _linked_classes(docs: DataFrame, how: NearDup) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Written tables: the signed rows (doc_id, th, n_shingles, d1, d2); the classes (cid, d1, d2, and id and th of a text of it, id
    the smallest); the links (a, b, by cid), if any."""
    signs = written(signed(docs, how), "signed")
    classes = signs.where("doc_id is not null and n_shingles > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th")).alias("first"), *(F.min(c).alias(c) for c in how.columns()))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "d1", "d2", F.col("first.doc_id").alias("id"), F.col("first.th").alias("th"), *how.columns()), "classes")
    rows = classes.select("cid", F.explode(F.array(*how.keys())).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    active = written(rows.join(shared, "key"), "buckets")
    texts = _texts(docs, classes.select("cid", "id", "th").join(active.select("cid").distinct(), "cid", "left_semi"))
    degree = active.groupBy("cid").agg(F.sum("n").alias("degree"))
    active, old = written(active.join(degree, "cid").select("key", "cid", F.col("cid").alias("comp"), "degree", _parts(F.col("n"), TOGETHER).alias("parts")), "buckets"), active
    forget(old)
    links, tested, leads = None, None, 1
    few = left = active.count()
    while left:
        lead = F.pmod(F.xxhash64("cid", "key"), F.lit(leads))
        best = F.min(F.struct((-F.col("degree")).alias("d"), F.col("cid"), F.col("comp"), F.col("parts")))
        leaders = written(active.groupBy("key", lead.alias("lead")).agg(best.alias("l")).select("key", F.col("l.cid").alias("b"), F.col("l.comp").alias("comp_b"), F.col("l.parts").alias("parts")), "leaders")
        theirs = leaders.select("key", "b", "comp_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        pairs = active.withColumn("part", _part("cid", F.col("parts"))).join(theirs, ["key", "part"]).where("cid <> b and comp <> comp_b").select(F.col("cid").alias("a"), "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "candidates")
        close = _within(pairs, classes, how)
        links = _also(links, _linked(close, texts, how))
        forget(close)
        tested = _also(tested, pairs)
        rest = active.drop("comp").join(leaders.select("key", F.col("b").alias("cid")), ["key", "cid"], "left_anti")
        named = components(links)
        rest = rest.join(named.select(F.col("node").alias("cid"), "comp"), "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"), "degree", "parts")
        rest = written(rest, "buckets")
        mixed = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        more = written(rest.join(mixed, "key"), "buckets")
        forget(active, rest, leaders, named)
        active = more
        left = active.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
        if left <= FEW * few:
            break
        leads *= 4
    if left:
        links = _also(links, _joining(active, texts, how))
    forget(texts, active)
    return signs, classes, links


_OWN = "doc_id is not null and n_shingles > 0"


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the component's smallest doc_id); a row for each row of docs."""
    signs, classes, links = _linked_classes(docs, how)
    ids = classes.select("cid", "id")
    edges = None
    if links is not None:
        edges = links.join(ids.withColumnsRenamed({"cid": "a", "id": "ida"}), "a").join(ids.withColumnsRenamed({"cid": "b", "id": "idb"}), "b").select(F.col("ida").alias("a"), F.col("idb").alias("b"))
    own, blank = F.expr(_OWN), F.expr("n_shingles = 0")
    sums = [f(F.when(own, F.col(d))).alias(f"{n}_{d}") for d in ("d1", "d2") for n, f in (("lo", F.min), ("hi", F.max))]
    several = signs.where("doc_id is not null").groupBy("doc_id").agg(*sums, F.count_if(blank).alias("blank"), F.count_if(own).alias("own"))
    several = written(several.where("lo_d1 <> hi_d1 or lo_d2 <> hi_d2 or blank > 0 and own > 0").select("doc_id"), "several")
    texts = None
    if not several.isEmpty():
        # A document with several texts joins their components.
        texts = signs.where(_OWN).join(several, "doc_id").join(classes.select("d1", "d2", "id"), ["d1", "d2"]).select("doc_id", "id").distinct()
        edges = _also(edges, texts.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    named = classes.select("d1", "d2", "id", F.col("id").alias("least"))
    if edges is not None:
        found = components(edges, "documents")
        named = classes.join(found.select(F.col("node").alias("id"), "comp"), "id", "left").select("d1", "d2", "id", F.coalesce("comp", "id").alias("least"))
    out = signs.select("doc_id", "n_shingles", *(F.when(own, F.col(d)).alias(d) for d in ("d1", "d2"))).join(named.drop("id"), ["d1", "d2"], "left")
    if texts is not None:
        # So do its blank ones.
        other = texts.join(named.select("id", "least").distinct(), "id").groupBy("doc_id").agg(F.min("least").alias("other")).withColumnRenamed("doc_id", "several")
        out = out.join(other, (out["doc_id"] == other["several"]) & out["least"].isNull(), "left").withColumn("least", F.coalesce("least", "other"))
    out = out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """docs with one row for each group of linked texts; all columns stay.

    The row with the least doc_id of the group stays, of several such the one whose text and then whose other columns hash
    least. A group is of texts: a document's other text stays or goes with its own group. Rows that are linked with nothing
    (blank texts, no doc_id) all stay."""
    signs, classes, links = _linked_classes(docs, how)
    named = classes.select("d1", "d2", F.col("cid").alias("comp"))
    if links is not None:
        found = components(links)
        named = classes.join(found.select(F.col("node").alias("cid"), "comp"), "cid", "left").select("d1", "d2", F.coalesce("comp", "cid").alias("comp"))
    rows = written(signs.where(_OWN).join(named, ["d1", "d2"]).select("doc_id", "th", "comp"), "grouped")
    forget(signs, classes)
    first = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "th")).alias("f"))
    first = written(first.select("comp", "f.doc_id", "f.th"), "first")
    id_, th = unused(docs, "id", "th")
    gone = rows.join(first, ["comp", "doc_id", "th"], "left_anti").select(F.col("doc_id").alias(id_), F.col("th").alias(th)).distinct()
    text = text_of(docs["text"])
    here = (docs["doc_id"].cast("long") == F.col(id_)) & (F.xxhash64(text) == F.col(th))
    kept = docs.join(gone, here, "left_anti")
    again = rows.join(first, ["comp", "doc_id", "th"], "left_semi").groupBy("doc_id", "th").count().where("count > 1")
    again = written(again.select(F.col("doc_id").alias(id_), F.col("th").alias(th)), "repeated")
    if again.isEmpty():
        return kept
    once, several = kept.join(again, here, "left_anti"), kept.join(again, here, "left_semi")
    row = F.struct(*(docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)))
    least = several.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(text).alias("th"), row.alias("row"))
    least = least.groupBy("doc", "th").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.union(least.select(*(F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns))))
