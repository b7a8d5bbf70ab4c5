"""Jaccard similarity self-join of shingle sets with PartEnum signatures.

Sets of nearly equal size are put in bands. In a band, two sets that reach the threshold
differ in at most k features. The feature domain is cut into n > k partitions; as at most
k of them hold a difference, the sets agree on whole partitions, and one signature for
each non-empty partition of a set (the hash of what it holds there) is enough to bring
every such pair together. A pair that agrees on empty partitions alone has few non-empty
ones on both sides; such sets get one signature for each feature besides, so no pair is
lost. A set joins its own band and the one below.

Equal sets are one class, by a 128-bit key, in the task that reads them, in the join and
in the result: copies are never paired. Signatures travel packed, many to a row, with
labels of 48 bits: what meets by chance, or shares a label, is only one more candidate. A
signature that many classes share is cut in blocks, whose pairs are compared in separate
tasks by size and by histograms of features, which bound the difference from below, so
only pairs that may reach the threshold are written. Each is then verified on the sets,
in cells of bounded bytes. What is left of a cell is a row for each class that has links
there: how many documents it links to, and the least class it is connected with. Linked
pairs themselves are never written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import U64, buckets_for, hash_words, joined, map_arrow, mix, pack, slices, texts, unpack, windows
from folioflow.runtime import forget, shuffle_partitions, stored

SHINGLE = 5
NUM, DEN = 4, 5  # the threshold: intersection / union >= NUM / DEN
#: Groups of more classes go to the blocked comparison.
SMALL_GROUP = 48
#: Signatures packed at a time.
PACKED = 1 << 19
#: Classes of one side of a block, about, and bytes that these hold.
BLOCK = 512
BLOCK_BYTES = 4 << 20
#: Signatures and labels of classes travel in so many bits.
WIRE = U64((1 << 48) - 1)


class Band:
    """Sizes low..high; pairs of this band and the next differ in at most k features."""

    def __init__(self, low: int):
        self.low = low
        self.high = max(low, math.floor(low * 1.6))
        self.k = self.high * (DEN - NUM) // NUM
        self.n = math.ceil(1.12 * (self.k + 1)) + 1


def _bands(most: int = 1 << 34) -> list[Band]:
    out = [Band(1)]
    while out[-1].high < most:
        out.append(Band(out[-1].high + 1))
    return out


BANDS = _bands()
_LOWS = np.array([b.low for b in BANDS])


def shingle_sets(raws: list[bytes | None]) -> list[np.ndarray]:
    """The sorted 64-bit hashes of the distinct shingles of each text, ASCII letters lower-cased."""
    data, at = joined(raws, lower=True)
    h, starts, _ = hash_words(data)
    first = np.searchsorted(starts, at)
    out = []
    for i, j in zip(first[:-1], first[1:]):
        w = h[i:j]
        s = windows(w, SHINGLE) if len(w) >= SHINGLE else windows(w, len(w)) + U64(len(w)) if len(w) else np.empty(0, U64)
        s = np.sort(s)
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
    return out


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set; (0, 0) names the empty one."""
    return (int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)), int(mix(s ^ U64(0x14057B7EF767814F)).sum(dtype=U64))) if len(s) else (0, 0)


def signatures(s: np.ndarray) -> tuple[np.ndarray, int]:
    """All signatures of a sorted set, for its band and, if it may have partners there, the one below; and how many of them it shares at least with each partner."""
    if not len(s):
        return s, 0
    own = int(np.searchsorted(_LOWS, len(s), side="right")) - 1
    out, shared = [], len(s)
    for b in (own, own - 1):
        if b < 0 or b < own and len(s) * NUM > BANDS[b].high * DEN:
            continue
        band = BANDS[b]
        tag = U64((b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        part = ((s >> U64(32)) * U64(band.n)) >> U64(32)
        at = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
        out.append(mix(np.add.reduceat(mix(s + tag), at) + part[at] * U64(0xD1342543DE82EF95) + tag))
        shared = min(shared, max(1, len(at) - band.k))
        if len(at) <= band.k:
            out.append(mix(mix(s ^ tag) + U64(1)))
    return np.concatenate(out), shared


def wired(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of each value, six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def unwired(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.view("<u8").ravel()


def histogram(s: np.ndarray) -> bytes:
    """How many features fall in each bin, modulo 16, two bins to a byte; a power of two of bins, so that few hold more than 16."""
    bits = max(8, math.ceil(math.log2(max(len(s), 1) / 8)))
    h = (np.bincount((mix(s) >> U64(64 - bits)).astype(np.int64), minlength=1 << bits) & 15).astype(np.uint8)
    return (h[0::2] << 4 | h[1::2]).tobytes()


def opened(blobs: list[bytes]) -> np.ndarray:
    """Histograms as rows of bins, all folded to the fewest bins among them (neighbours added)."""
    least = min(map(len, blobs), default=0) * 2
    if len(set(map(len, blobs))) <= 1:
        x = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
        return np.stack((x >> 4, x & 15), 2).reshape(len(blobs), -1)
    out = np.empty((len(blobs), least), np.uint8)
    for i, blob in enumerate(blobs):
        x = np.frombuffer(blob, np.uint8)
        out[i] = np.stack((x >> 4, x & 15), 1).reshape(least, -1).sum(1, dtype=np.uint8) & 15
    return out


def may_reach(n: np.ndarray, h: np.ndarray, m: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether sets of n and m features with (opened) histograms h and g can reach the threshold; never wrongly false.

    Bins differ at least by their distance modulo 16, and the sum over bins is at most the sets' difference.
    """
    d = (h - g) & 15
    apart = np.minimum(d, 16 - d).sum(-1, dtype=np.int64)
    return (np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM) & (apart * (NUM + DEN) <= (n + m) * (DEN - NUM))


def reaches(both: int | np.ndarray, a, b):
    return both * DEN >= NUM * (a + b - both)


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links).

    members: doc_id, hi, lo and n_shingles of each row; (hi, lo) names a class. classes:
    hi, lo, n, rep (its least doc_id), copies, h. links: (hi, lo, more, root_hi, root_lo):
    for each cell and class that has links there, the documents of other classes that it
    links to, and the least class that the cell's links connect it with. Each link is in one cell.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    groups = buckets_for(parts)

    def emit(batches):
        seen: set[tuple[int, int]] = set()
        sigs: list[np.ndarray] = []
        own: list[np.ndarray] = []
        many = 0

        def out():
            got = [(b, wired(np.concatenate(unpack(d, "u8", "u8"))).tobytes()) for b, d in pack(np.concatenate(sigs), np.concatenate(own), groups=groups)] if sigs else []
            sigs.clear()
            own.clear()
            return _rows(1, [g for g, _ in got], [b for _, b in got])

        for batch, raws in slices(batches):
            ids = batch.column(0)
            sets = shingle_sets(raws)
            keys = [class_key(s) for s in sets]
            hi = np.array([k[0] for k in keys], U64).view(np.int64)
            lo = np.array([k[1] for k in keys], U64).view(np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            sketches, shared = [], []
            for s, k in zip(sets, keys):
                fresh = len(s) > 0 and k not in seen
                sketches.append(histogram(s) if fresh else None)
                shared.append(None)
                if fresh:
                    seen.add(k)
                    g, shared[-1] = signatures(s)
                    sigs.append(g)
                    own.append(np.full(len(g), k[0], U64))
                    many += len(g)
            yield _rows(0, [], sketches, ids=ids, hi=hi, lo=lo, size=size, shared=pa.array(shared, pa.int64()))
            if len(seen) > 500_000:
                seen.clear()
            if many > PACKED:
                yield out()
                many = 0
        yield out()

    def meet(batches):
        """Members pass; the signatures of one bucket after the other, which come sorted, are brought together."""
        now, waiting, met = None, [], Met()
        for batch in batches:
            kind = batch.column(0).to_numpy()
            keep = batch.filter(pa.array(kind == 0))
            if keep.num_rows:
                yield _meeting(0, keep.num_rows, ids=keep.column(3), hi=keep.column(4), lo=keep.column(5), size=keep.column(6), shared=keep.column(7), h=keep.column(2))
            for i in np.flatnonzero(kind == 1):
                bucket = batch.column(1)[i].as_py()
                if bucket != now:
                    yield from together(waiting, met)
                    now, waiting = bucket, []
                waiting.append(np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8).copy())
        yield from together(waiting, met)
        yield from met.rows()

    def together(blobs, met):
        """Pairs of labels that share a signature, each once while ``met`` holds it; and the members of crowded signatures."""
        if not blobs:
            return
        k = unwired(np.concatenate([b[: len(b) // 2] for b in blobs]))
        order = np.argsort(k)
        k = k[order]
        same = np.flatnonzero(k[1:] == k[:-1])
        if not len(same):
            return
        take = np.unique(np.concatenate((same, same + 1)))
        k, o = k[take], unwired(np.concatenate([b[len(b) // 2 :] for b in blobs]))[order[take]]
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))
        k, o = k[fresh], o[fresh]
        at = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
        m = np.diff(at)
        for size in np.unique(m[(m > 1) & (m <= SMALL_GROUP)]):
            rows = o[at[:-1][m == size][:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            step = max(1, (1 << 19) // len(i))
            for r in range(0, len(rows), step):
                p = rows[r : r + step]
                yield from met.add(np.stack((p[:, i].ravel(), p[:, j].ravel()), 1))
        for g in np.flatnonzero(m > SMALL_GROUP):
            part = o[at[g] : at[g + 1]].view(np.int64)
            for r in range(0, len(part), 1 << 16):
                yield _meeting(2, len(part[r : r + (1 << 16)]), hi=np.full(len(part[r : r + (1 << 16)]), k[at[g]].view(np.int64)), lo=part[r : r + (1 << 16)])

    packed = map_arrow(texts(docs), emit, "kind int, bucket int, data binary, doc_id long, hi long, lo long, size long, shared long")
    # members only pass through; spread by document, so that copies of one text don't meet in a task
    place = F.when(F.col("kind") == 1, F.col("bucket").cast("long")).otherwise(F.xxhash64("doc_id"))
    met = map_arrow(packed.repartition(parts, place).sortWithinPartitions("bucket"), meet, "kind int, doc_id long, hi long, lo long, size long, shared long, h binary")
    met = stored(met, "similar-met")

    members = met.filter("kind = 0").select("doc_id", "hi", "lo", F.col("size").alias("n_shingles"))
    classes = met.filter("kind = 0 and size > 0").groupBy("hi", "lo").agg(F.max("size").alias("n"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("shared").alias("shared"), F.max("h").alias("h"))
    classes = stored(classes.withColumn("label", F.col("hi").bitwiseAND(F.lit(int(WIRE)))), "similar-classes")
    pairs = met.filter("kind = 1").select(F.col("hi").alias("a"), F.col("lo").alias("b")).distinct()
    near = _screened(pairs, classes)
    crowded = met.filter("kind = 2").select(F.col("hi").alias("sig"), F.col("lo").alias("o"))
    if crowded.head(1):
        near = near.union(_crowded_pairs(crowded, classes))
    ends = [F.struct(F.col(x).alias("hi"), F.col(f"{x}_lo").alias("lo")) for x in "ab"]
    near = near.select(F.least(*ends).alias("p"), F.greatest(*ends).alias("q")).distinct()  # one order of each pair
    near = stored(near.select(F.col("p.hi").alias("a"), F.col("p.lo").alias("a_lo"), F.col("q.hi").alias("b"), F.col("q.lo").alias("b_lo")), "similar-near")
    verified, blocks = _verified(docs, near, classes)
    links = stored(verified, "similar-links")
    for done in (near, blocks):
        forget(done)
    return members, classes, links


class Met:
    """Pairs met so far, each once; up to MOST of them wait for those of the next buckets, as a pair shares many signatures."""

    MOST = 1 << 21

    def __init__(self):
        self.found = np.empty((0, 2), U64)
        self.waiting: list[np.ndarray] = []
        self.many = 0

    def add(self, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.waiting.append(pairs)
        self.many += len(pairs)
        if self.many > self.MOST:
            self.settle()
            if len(self.found) > self.MOST // 2:
                yield from self.rows()

    def settle(self) -> None:
        self.found = _distinct(np.concatenate([self.found, *self.waiting]))
        self.waiting, self.many = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for r in range(0, len(self.found), 1 << 16):
            p = self.found[r : r + (1 << 16)].view(np.int64)
            yield _meeting(1, len(p), hi=p[:, 0], lo=p[:, 1])
        self.found = np.empty((0, 2), U64)


def _distinct(p: np.ndarray) -> np.ndarray:
    if not len(p):
        return p
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    return p[np.concatenate(([True], (p[1:] != p[:-1]).any(1)))]


def _rows(kind: int, buckets, blobs, ids=None, hi=None, lo=None, size=None, shared=None) -> pa.RecordBatch:
    n = len(ids) if ids is not None else len(buckets)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(np.zeros(n, np.int32) if ids is not None else buckets, pa.int32()), pa.array(blobs, pa.binary())]
        + [none if c is None else c if isinstance(c, pa.Array) else pa.array(c) for c in (ids, hi, lo, size, shared)],
        ["kind", "bucket", "data", "doc_id", "hi", "lo", "size", "shared"],
    )


def _meeting(kind: int, n: int, ids=None, hi=None, lo=None, size=None, shared=None, h=None) -> pa.RecordBatch:
    numbers = [pa.nulls(n, pa.int64()) if c is None else c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in (ids, hi, lo, size, shared)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *numbers, pa.nulls(n, pa.binary()) if h is None else h], ["kind", "doc_id", "hi", "lo", "size", "shared", "h"])


def _bitmap(ids: DataFrame, bits: int = 24) -> bytes:
    """A bitmap of 2**bits hashed ids: one of its bits is set for each id, so it never misses one."""

    def run(batches):
        out = np.zeros(1 << bits, bool)
        some = False
        for b in batches:
            x = b.column(0).drop_null().to_numpy().view(U64)
            out[(mix(x) >> U64(64 - bits)).astype(np.int64)] = True
            some = some or len(x) > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], ["bits"])

    def both(batches):
        out = None
        for b in batches:
            for x in b.column(0).to_pylist():
                x = np.frombuffer(x, np.uint8)
                out = x if out is None else out | x
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])

    parts = map_arrow(map_arrow(ids, run, "bits binary").repartition(8), both, "bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _screened(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, a_lo, b, b_lo) of the pairs (a, b) of labels that sizes and histograms don't rule out."""
    pairs = pairs.withColumnsRenamed({"a": "a_label", "b": "b_label"})
    side = lambda x: classes.select(F.col("label").alias(f"{x}_label"), F.col("hi").alias(x), F.col("lo").alias(f"{x}_lo"), F.col("n").alias(f"{x}_n"), F.col("h").alias(f"{x}_h"))
    both = pairs.join(side("a"), "a_label").join(side("b"), "b_label").filter(f"least(a_n, b_n) * {DEN} >= greatest(a_n, b_n) * {NUM}").select("a", "a_lo", "b", "b_lo", "a_n", "b_n", "a_h", "b_h")

    def screen(batches):
        for batch in batches:
            if batch.num_rows:
                ok = np.zeros(batch.num_rows, bool)
                n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
                left, right = batch.column(6).to_pylist(), batch.column(7).to_pylist()
                fewest = np.fromiter((min(len(x), len(y)) for x, y in zip(left, right)), np.int64, len(left))
                for width in np.unique(fewest):  # pairs of about the same size together
                    at = np.flatnonzero(fewest == width)
                    for k in range(0, len(at), max(1, (1 << 22) // int(width))):
                        now = at[k : k + max(1, (1 << 22) // int(width))]
                        both = opened([left[i] for i in now] + [right[i] for i in now])
                        ok[now] = may_reach(n[now], both[: len(now)], m[now], both[len(now) :])
                yield batch.select(["a", "a_lo", "b", "b_lo"]).filter(pa.array(ok))

    return map_arrow(both, screen, "a long, a_lo long, b long, b_lo long")


def _crowded_pairs(crowded: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of the classes that share a crowded signature and that sizes and histograms don't rule out.

    A class of which fewer signatures are crowded than it shares with each partner has a
    quiet one in common with all of them, so it is left out: passages that many documents
    hold crowd a few signatures of each. Of the rest, mostly copies of one another, a
    group is cut by size class and, within these, into blocks; only blocks of size
    classes that may link meet, each two in a task of their own.
    """
    crowds = crowded.groupBy("o").agg(F.count("*").alias("crowds"))
    held = crowds.join(classes.select(F.col("label").alias("o"), "hi", "lo", "n", "shared", "h"), "o").filter("crowds >= shared").drop("crowds", "shared")
    member = crowded.join(held, "o").drop("o")
    # two sizes that may link are at most one step apart; a second one allows for rounding
    member = member.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))))
    own = member.groupBy("sig", "step").agg(_width(F.length("h")))
    member = member.join(own, ["sig", "step"]).withColumn("block", F.pmod(F.xxhash64("hi", "lo"), F.col("width")).cast("int"))
    reach = own.select("sig", F.col("step").alias("l_step"), F.col("width").alias("l_width"), F.explode(F.array(F.col("step"), F.col("step") + 1, F.col("step") + 2)).alias("step")).join(own.withColumnRenamed("width", "r_width"), ["sig", "step"]).withColumnRenamed("step", "r_step")
    cells = reach.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("l_width") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("r_width") - 1))).filter("l_step != r_step or i <= j").select("sig", "l_step", "i", "r_step", "j")
    cells = cells.withColumn("cell", F.xxhash64("sig", "l_step", "i", "r_step", "j"))
    left = cells.join(member.withColumnsRenamed({"step": "l_step", "block": "i"}), ["sig", "l_step", "i"]).select("cell", F.lit(0).alias("side"), "hi", "lo", "n", "h", ((F.col("l_step") == F.col("r_step")) & (F.col("i") == F.col("j"))).alias("alone"))
    right = cells.filter("l_step != r_step or i != j").join(member.withColumnsRenamed({"step": "r_step", "block": "j"}), ["sig", "r_step", "j"]).select("cell", F.lit(1).alias("side"), "hi", "lo", "n", "h", F.lit(False).alias("alone"))

    def compare(table):
        side = table.column("side").to_numpy()
        hi, lo, n = (table.column(c).to_numpy() for c in ("hi", "lo", "n"))
        h = opened(table.column("h").to_pylist())
        a = np.flatnonzero(side == 0)
        alone = bool(table.column("alone")[0].as_py()) if len(a) == len(side) else False
        b = a if alone else np.flatnonzero(side == 1)
        out = [np.empty((0, 4), np.int64)]
        for p, i in enumerate(a):
            q = b[p + 1 :] if alone else b
            q = q[may_reach(n[i], h[i], n[q], h[q]) & ((hi[q] != hi[i]) | (lo[q] != lo[i]))]
            if len(q):
                first = (hi[i] < hi[q]) | (hi[i] == hi[q]) & (lo[i] < lo[q])
                out.append(np.stack((np.where(first, hi[i], hi[q]), np.where(first, lo[i], lo[q]), np.where(first, hi[q], hi[i]), np.where(first, lo[q], lo[i])), 1))
        got = np.concatenate(out)
        return pa.table({c: pa.array(np.ascontiguousarray(got[:, k])) for k, c in enumerate(("a", "a_lo", "b", "b_lo"))})

    return left.union(right).groupBy("cell").applyInArrow(compare, "a long, a_lo long, b long, b_lo long")


def _width(size: Column) -> Column:
    """How many blocks a group is cut into, by its rows and by the bytes that each holds."""
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(size) / BLOCK_BYTES)).cast("int").alias("width")


def _verified(docs: DataFrame, near: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what the pairs of ``near`` whose sets reach the threshold come to, as ``near_links`` says; the stored table of blocks).

    Classes that pair with one another are put in blocks, by their least partner, and a
    set goes once to each two blocks that hold a pair of it, not to each pair. Sets are
    made again from the documents; a bitmap of fixed size lets the tasks that read these
    leave out nearly all others, and what it lets through by chance joins nothing.
    """
    sc = docs.sparkSession.sparkContext
    ends = near.select(F.col("a").alias("hi"), F.col("a_lo").alias("lo"), F.col("b").alias("other")).union(near.select("b", "b_lo", "a"))
    led = ends.groupBy("hi", "lo").agg(F.least(F.min("other"), F.col("hi")).alias("leader"))
    led = led.join(classes.select("hi", "lo", "rep", "copies", "n"), ["hi", "lo"])
    width = led.groupBy("leader").agg(_width(8 * F.col("n")))
    placed = stored(led.join(width, "leader").select("hi", "lo", F.xxhash64("leader", F.pmod(F.xxhash64("hi", "lo"), F.col("width"))).alias("block"), "rep", "copies"), "similar-blocks")
    side = lambda x: placed.select(F.col("hi").alias(x), F.col("lo").alias(f"{x}_lo"), F.col("block").alias(f"{x}_block"), F.col("rep").alias(f"{x}_rep"), F.col("copies").alias(f"{x}_copies"))
    celled = near.join(side("a"), ["a", "a_lo"]).join(side("b"), ["b", "b_lo"]).withColumn("cell", F.xxhash64(F.least("a_block", "b_block"), F.greatest("a_block", "b_block")))
    partner = F.struct(F.col("b").alias("hi"), F.col("b_lo").alias("lo"))
    rows = celled.select("cell", F.col("a").alias("hi"), F.col("a_lo").alias("lo"), F.col("a_rep").alias("rep"), F.col("a_copies").alias("copies"), partner.alias("with")).union(celled.select("cell", "b", "b_lo", "b_rep", "b_copies", F.lit(None).cast("struct<hi: long, lo: long>")))
    wanted = rows.groupBy("cell", "hi", "lo", "rep", "copies").agg(F.collect_list("with").alias("partners"))
    bitmap = sc.broadcast(_bitmap(placed.select("rep")))

    def sets(batches):
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).view(bool)
        shift = U64(64 - int(math.log2(len(bits))))
        for batch in batches:
            col = batch.column(0)
            x = col.fill_null(0).to_numpy().view(U64)
            ok = bits[(mix(x) >> shift).astype(np.int64)] | col.is_null().to_numpy(zero_copy_only=False)
            for part, raws in slices([batch.filter(pa.array(ok))]):
                made = shingle_sets(raws)
                keys = np.array([class_key(s) for s in made], U64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array([s.tobytes() for s in made], pa.binary())], ["doc_id", "hi", "lo", "features"])

    found = map_arrow(texts(docs), sets, "doc_id long, hi long, lo long, features binary").alias("f")
    w = wanted.alias("w")
    on = F.col("f.doc_id").eqNullSafe(F.col("w.rep")) & (F.col("f.hi") == F.col("w.hi")) & (F.col("f.lo") == F.col("w.lo"))
    ready = w.join(found, on).select("w.cell", "w.hi", "w.lo", "w.copies", "w.partners", "f.features")

    def verify(table):
        keys = list(zip(table.column("hi").to_pylist(), table.column("lo").to_pylist()))
        held = {k: np.frombuffer(f.as_buffer(), U64) for k, f in zip(keys, table.column("features"))}
        copies = dict(zip(keys, table.column("copies").to_pylist()))
        more: dict[tuple[int, int], int] = {}
        root: dict[tuple[int, int], tuple[int, int]] = {}

        def top(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        done = set()
        for k, partners in zip(keys, table.column("partners").to_pylist()):
            if k in done:  # a repeated row
                continue
            done.add(k)
            x = held[k]
            for p in partners:
                other = (p["hi"], p["lo"])
                y = held.get(other)
                if y is None:
                    raise AssertionError("a set is missing from its cell")
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                if reaches(int(np.count_nonzero(y[at] == x)), len(x), len(y)):
                    for one, two in ((k, other), (other, k)):
                        more[one] = more.get(one, 0) + copies[two]
                        root.setdefault(one, one)
                    a, b = top(k), top(other)
                    root[max(a, b)] = min(a, b)
        got = np.array([(*k, n, *top(k)) for k, n in more.items()], np.int64).reshape(-1, 5)
        return pa.table({c: pa.array(np.ascontiguousarray(got[:, i])) for i, c in enumerate(("hi", "lo", "more", "root_hi", "root_lo"))})

    return ready.groupBy("cell").applyInArrow(verify, "hi long, lo long, more long, root_hi long, root_lo long"), placed


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node of ``edges`` (u, v), by large and small stars.

    Each round is one group-by for each kind of star, on edges that no longer hold a hub's
    pairs; rounds end when no edge changes, after about the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "star")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        after = stored(small, "star")
        changed = after.join(now, ["u", "v"], "left_anti").head(1) or now.join(after, ["u", "v"], "left_anti").head(1)
        forget(now)
        now = after
        if not changed:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_similar and component_id of each row of ``docs``.

    Sets of shingles link when 5 * shared >= 4 * united (80 %). Equal sets are linked too.
    Null and empty texts, and such with white space alone, have no shingles, no links and
    their own doc_id as component. Rows that repeat a doc_id count as documents each, and a
    null doc_id never names a component unless all of it are null. A similarity of 80 %
    exactly is a link. Texts are taken whole, however long, each in memory as one slice. An
    empty table gives no rows; other columns are not read.
    """
    members, classes, links = near_links(docs)
    classes = classes.select("hi", "lo", "copies", F.col("rep").alias("least"), F.xxhash64("hi", "lo").alias("node"))
    linked = links.groupBy("hi", "lo").agg(F.sum("more").alias("more"))
    edges = links.select(F.xxhash64("hi", "lo").alias("u"), F.xxhash64("root_hi", "root_lo").alias("v"))
    roots = components(edges)
    placed = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # only components of several classes need the join
    known = placed.join(least, "root").join(linked, ["hi", "lo"], "left").select(F.col("hi").alias("k_hi"), F.col("lo").alias("k_lo"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_similar"), "component_id")
    out = members.join(known, (members["hi"] == known["k_hi"]) & (members["lo"] == known["k_lo"]) & (members["n_shingles"] > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("n_similar", F.lit(0).cast("long")).alias("n_similar"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component (of repeated rows each); others go.

    Rows with null doc_ids stay: they can't be told apart. Rows with null or empty texts
    have no shingles and stay, too; so do both of two rows that repeat the least doc_id.
    Columns of any name pass through. Texts are compared whole, however long; an empty
    table gives no rows.
    """
    drop = near_duplicates(docs).filter("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["__gone"], "left_anti")
