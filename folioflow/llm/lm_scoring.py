"""Language-model scoring: context-tree weighting over bytes, and the unigram base score.

Context-tree weighting. A text is its lower-cased bytes and an end byte (0); DEPTH zero
bytes stand ahead of it. Each byte is eight binary decisions, and each of the 255 bit
prefixes has a context tree over the bytes before. A node's Krichevsky-Trofimov block
probability depends on its two counts alone, so all counts are sums of byte (DEPTH+1)-gram
counts: tasks sum their documents' grams, the grams are shuffled packed, by the two bytes
next to the symbol, and each reducer builds the nodes of depth two and more of its
subtrees bottom-up, where P = KT / 2 + (product of the children) / 2. What is left, depths
one and none, has 65,535 nodes at most. A node's weight is the posterior of stopping there;
the prediction mixes the estimates of all depths along the path. A context that training
never showed predicts 1/2, as an empty node does.

Nodes are broadcast in blocks of a bounded size, cut by the two bytes next to the symbol.
The documents are read once, however many blocks there are: a task holds the distinct
grams of some megabytes of text, opens one block after the other for them, and adds up
each text's score. A worker evaluates a gram once and keeps it.

Base score. Words are counted by 64-bit hashes, summed in the tasks and again in the
reducers, for every training token. The most frequent, up to a fixed number, are
broadcast; other words of a document meet their counts in a shuffle, packed.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import U64, bucket_of, buckets_for, by_bucket, hash_words, joined, map_arrow, mix, pack, slices, sum_by_key, texts, unpack
from folioflow.runtime import shuffle_partitions, stored

DEPTH = 5
FOLDS, FOLD = 7, 2
#: Nodes in a broadcast block, 16 bytes each.
NODES_IN_BLOCK = 2_000_000
#: Bytes of text whose distinct grams a task holds where there are several blocks.
HELD = 12 << 20
#: Words of the broadcast tier, 16 bytes each.
FREQUENT_WORDS = 1 << 20
END = U64(0xE4D0E4D0E4D0E4D1)
_KEEP_SUMS = 1 << 18


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == FOLD


# grams and trees


def grams(raws: list[bytes | None], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each byte and the end, text by text; where each text's grams begin). A gram is the context and, lowest, the byte."""
    pad = b"\0" * depth
    buf = np.frombuffer(b"".join([p for r in raws for p in (pad, (r or b"").lower(), b"\0")]), np.uint8)
    code = np.zeros(len(buf) - depth, U64)
    for i in range(depth + 1):
        code = (code << U64(8)) | buf[i : len(buf) - depth + i]
    lengths = np.fromiter((len(r) + 1 if r else 1 for r in raws), np.int64, len(raws))
    first = np.concatenate(([0], np.cumsum(lengths)))
    keep = np.ones(len(code), bool)
    for k in range(depth):  # grams that end in the next text's padding
        keep[first[1:-1] + np.arange(len(raws) - 1) * depth + k] = False
    return code[keep], first


def branch(code: np.ndarray) -> np.ndarray:
    """The two bytes next to the symbol, which name a gram's subtree."""
    return (code >> U64(8)) & U64(0xFFFF)


_LANCZOS = (76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.1208650973866179e-2, -0.5395239384953e-5)


def lgamma(x: np.ndarray) -> np.ndarray:
    tmp = x + 5.5
    tmp = tmp - (x + 0.5) * np.log(tmp)
    ser = np.full_like(x, 1.000000000190015)
    for i, c in enumerate(_LANCZOS):
        ser += c / (x + 1 + i)
    return -tmp + np.log(2.5066282746310005 * ser / x)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - math.log(math.pi)


def _key(depth: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (U64(depth) << U64(56)) | (context << U64(8)) | node


def _summed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.zeros(0, int)
    return (key[at], *[np.add.reduceat(c[order], at) if len(key) else c for c in columns])


def leaves(code: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, zeros, ones) of the nodes at full depth."""
    context, symbol = code >> U64(8), code & U64(0xFF)
    keys, ones = [], []
    for k in range(8):
        keys.append((context << U64(8)) | (U64(1) << U64(k)) | (symbol >> U64(8 - k)))
        ones.append(((symbol >> U64(7 - k)) & U64(1)) == 1)
    key, one, total = np.concatenate(keys), np.concatenate(ones), np.tile(n.astype(np.float64), 8)
    return _summed(key, np.where(one, 0.0, total), np.where(one, total, 0.0))


def stop_weight(a: np.ndarray, b: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of stopping at the node, log of its weighted probability); children: the sum of theirs, None at full depth."""
    own = log_kt(a, b)
    if children is None:
        return np.ones(len(a)), own
    total = np.logaddexp(own, children) - math.log(2)
    return np.exp(own - math.log(2) - total), total


def rarer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimate of the rarer bit, negative where that is a zero: the other's would round to 1 at 2^24 counts, and leave nothing for this one."""
    return np.where(b <= a, (b + 0.5) / (a + b + 1), -(a + 0.5) / (a + b + 1)).astype(np.float32)


def climb(key: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, least: int) -> tuple[list[tuple[np.ndarray, ...]], tuple[np.ndarray, ...]]:
    """From the full-depth nodes up to depth ``least``: (key, weight, estimate of the rarer bit) by depth, and what goes to the depth above: (context and node, zeros, ones, log probabilities)."""
    out, below = [], None
    for d in range(depth, least - 1, -1):
        w, total = stop_weight(a, b, below)
        out.append((key | (U64(d) << U64(56)), w.astype(np.float32), rarer(a, b)))
        if d == 0:
            return out, (key, a, b, total)
        context, node = key >> U64(8), key & U64(0xFF)
        up = ((context & U64((1 << (8 * (d - 1))) - 1)) << U64(8)) | node
        key, a, b, below = _summed(up, a, b, total)
    return out, (key, a, b, below)


class Tree:
    """Nodes as sorted arrays; evaluates grams, and keeps what it evaluated in a fixed table."""

    SLOTS = 1 << 20

    def __init__(self, key: np.ndarray, weight: np.ndarray, one: np.ndarray, depth: int):
        order = np.argsort(key)
        self.key, self.weight, self.one, self.depth = key[order], weight[order], one[order], depth  # one: see ``rarer``
        self.seen = np.full(self.SLOTS, ~U64(0), U64)
        self.value = np.zeros(self.SLOTS, np.float64)

    def evaluate(self, code: np.ndarray) -> np.ndarray:
        """Log probability of the symbol of each gram after its context."""
        context, symbol = code >> U64(8), code & U64(0xFF)
        out = np.zeros(len(code))
        if not len(self.key):
            return out - 8 * math.log(2)
        for k in range(8):
            node = (U64(1) << U64(k)) | (symbol >> U64(8 - k))
            bit = (symbol >> U64(7 - k)) & U64(1) == 1
            p = np.full(len(code), 0.5)
            for d in range(self.depth, -1, -1):
                key = _key(d, context & U64((1 << (8 * d)) - 1), node)
                at = np.searchsorted(self.key, key)
                at[at == len(self.key)] = 0
                found = self.key[at] == key
                w, rare = self.weight[at].astype(np.float64), self.one[at].astype(np.float64)
                own = np.where((rare > 0) == bit, np.abs(rare), 1 - np.abs(rare))
                p = np.where(found, w * own + (1 - w) * p, 0.5)
            out += np.log(p)
        return out

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        slot = (mix(code) >> U64(44)).astype(np.int64)
        miss = self.seen[slot] != code
        out = self.value[slot]
        if miss.any():
            new, back = np.unique(code[miss], return_inverse=True)
            got = self.evaluate(new)
            out[miss] = got[back]
            at = (mix(new) >> U64(44)).astype(np.int64)
            self.seen[at], self.value[at] = new, got
        return out


# training


class _Sums:
    """Counts by key, merged now and then so that memory stays bounded by the distinct keys kept."""

    def __init__(self):
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.waiting.append((k, n.astype(np.int64)))
        self.rows += len(k)
        if self.rows > 4 * _KEEP_SUMS:
            self.waiting = [self.merged()]
            self.rows = len(self.waiting[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.waiting:
            return np.empty(0, U64), np.empty(0, np.int64)
        return sum_by_key(np.concatenate([k for k, _ in self.waiting]), np.concatenate([n for _, n in self.waiting]))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.waiting, self.rows = [], 0
        return out


def _blob_rows(kind: int, pieces) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(pieces), pa.int32()), pa.array([b for b, _ in pieces], pa.int32()), pa.array([d for _, d in pieces], pa.binary())], ["kind", "bucket", "data"])


WORDS, GRAMS, NODES, TOP = 0, 1, 2, 3


def gathered(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, bucket, data) of training: word counts, nodes of depth two and more, and what they pass on to depth one."""
    parts = shuffle_partitions(docs.sparkSession)
    groups = buckets_for(parts)

    def emit(batches):
        words, codes = _Sums(), _Sums()

        def out():
            k, n = words.take()
            yield _blob_rows(WORDS, list(pack(k, k, n, groups=groups)))
            k, n = codes.take()
            yield _blob_rows(GRAMS, list(pack(branch(k), k, n, groups=groups)))

        for batch, raws in slices(batches):
            raws = [r for r, i in zip(raws, batch.column(0).to_pylist()) if i is not None and not is_held_out(i)]
            if not raws:
                continue
            h, _, _ = hash_words(joined(raws, lower=True)[0])
            words.add(np.concatenate((h, np.full(len(raws), END))))
            codes.add(grams(raws, depth)[0])
            if words.rows > 2 * _KEEP_SUMS or codes.rows > 3 * _KEEP_SUMS:
                yield from out()
        yield from out()

    def reduce(batches):
        for (kind, bucket), blobs in by_bucket(batches, "kind", "bucket"):
            k, n = sum_by_key(*map(np.concatenate, zip(*(unpack(d, "u8", "u8", "i8")[1:] for d in blobs))))
            del blobs
            if kind == WORDS:
                yield _blob_rows(WORDS, [(bucket, k.tobytes() + n.tobytes())])
                continue
            nodes, (key, a, b, p) = climb(*leaves(k, n, depth), depth, 2)
            key3, w, one = (np.concatenate(x) for x in zip(*nodes))
            yield _blob_rows(NODES, [(bucket, key3.tobytes() + w.tobytes() + one.tobytes())])
            yield _blob_rows(TOP, [(bucket, key.tobytes() + a.tobytes() + b.tobytes() + p.tobytes())])

    packed = map_arrow(texts(docs), emit, "kind int, bucket int, data binary")
    return stored(map_arrow(packed.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket"), reduce, "kind int, bucket int, data binary"), "lm-model")


def _top(model: DataFrame, depth: int) -> tuple[np.ndarray, ...]:
    """(key, weight, estimate of the rarer bit) of depths one and none: 65,535 nodes at most. Partial sums are merged in tasks first."""

    def merge(batches):
        got = [unpack(d, "u8", "f8", "f8", "f8") for b in batches for d in b.column(2).to_pylist()]
        if got:
            key, a, b, p = _summed(*map(np.concatenate, zip(*got)))
            yield _blob_rows(TOP, [(0, key.tobytes() + a.tobytes() + b.tobytes() + p.tobytes())])

    got = [unpack(bytes(r["data"]), "u8", "f8", "f8", "f8") for r in map_arrow(model.filter(f"kind = {TOP}").repartition(8), merge, model.schema).toLocalIterator()]
    if not got:
        return np.empty(0, U64), np.empty(0, np.float32), np.empty(0, np.float32)
    key, a, b, p = _summed(*map(np.concatenate, zip(*got)))
    w, total = stop_weight(a, b, p)
    one = [(key | (U64(1) << U64(56)), w.astype(np.float32), rarer(a, b))]
    key, a, b, p = _summed(key & U64(0xFF), a, b, total)
    w, _ = stop_weight(a, b, p)
    one.append((key, w.astype(np.float32), rarer(a, b)))
    return tuple(np.concatenate(x) for x in zip(*one))


def tree_blocks(model: DataFrame, depth: int = DEPTH, most: int = NODES_IN_BLOCK) -> Iterator[tuple[Tree, int]]:
    """(tree, its first bucket): the nodes of consecutive buckets, ``most`` at most unless one bucket has more, with the shared top; each node reaches the driver once, a block at a time."""
    top = _top(model, depth)
    nodes = model.filter(f"kind = {NODES}")
    sizes = sorted((r["bucket"], r["n"]) for r in nodes.groupBy("bucket").agg(F.sum(F.length("data")).alias("n")).collect())
    cuts, held = [0], 0
    for bucket, n in sizes:
        if held and held + n > 16 * most:
            cuts.append(bucket)
            held = 0
        held += n
    for low, high in zip(cuts, [*cuts[1:], None]):
        part = nodes.filter(F.col("bucket") >= low) if high is None else nodes.filter((F.col("bucket") >= low) & (F.col("bucket") < high))
        got = [top, *(unpack(bytes(r["data"]), "u8", "f4", "f4") for r in part.select("data").toLocalIterator())]
        yield Tree(*[np.concatenate(x) for x in zip(*got)], depth), low


# scoring


def rank(n: np.ndarray) -> np.ndarray:
    """A place for each count, in their order: counts below 4096 have their own, beyond there are 256 for each doubling."""
    return np.where(n < 4096, n, 4096 + np.floor(256 * np.log2(np.maximum(n, 4096) / 4096))).astype(np.int64)


def word_tiers(model: DataFrame, most: int = FREQUENT_WORDS) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """(N, V, least rank of the broadcast tier, its hashes in order, its counts); the least rank is chosen so that the tier keeps its bound."""

    def census(batches):
        for b in batches:
            for d in b.column(0).to_pylist():
                n = unpack(d, "u8", "i8")[1]
                r, back = np.unique(rank(n), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.bincount(back)), pa.array(np.bincount(back, n).astype(np.int64))], ["rank", "words", "tokens"])

    words = model.filter(f"kind = {WORDS}").select("data")
    rows = map_arrow(words, census, "rank long, words long, tokens long").groupBy("rank").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()
    total, distinct = sum(r["tokens"] for r in rows), sum(r["words"] for r in rows)
    least, taken = np.iinfo(np.int64).max, 0
    for r in sorted(rows, key=lambda r: -r["rank"]):
        if taken + r["words"] > most:
            break
        taken += r["words"]
        least = r["rank"]

    def frequent(batches):
        for b in batches:
            for d in b.column(0).to_pylist():
                k, n = unpack(d, "u8", "i8")
                at = rank(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array([k[at].tobytes() + n[at].tobytes()], pa.binary())], ["data"])

    got = [unpack(bytes(r["data"]), "u8", "i8") for r in map_arrow(words, frequent, "data binary").toLocalIterator()] if taken else []
    k, n = (np.concatenate(x) for x in zip(*got)) if got else (np.empty(0, U64), np.empty(0, np.int64))
    order = np.argsort(k)
    return total, distinct, least, k[order], n[order]


def looked_up(k: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each hash, 0 where it isn't among the known."""
    if not len(known):
        return np.zeros(len(k), np.int64)
    at = np.searchsorted(known, k)
    at[at == len(known)] = 0
    return np.where(known[at] == k, counts[at], 0)


def score(docs: DataFrame, depth: int = DEPTH, nodes: int = NODES_IN_BLOCK, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    ``score`` is the log10 probability of the lower-cased bytes and the end. Null and empty texts are an end alone. A null
    doc_id is neither held out nor learned from. Rows that repeat doc_id and text are
    scored each, alike, and are learned from as often. With nothing to learn from, every
    bit has probability 1/2 and the base score is 0. Texts are scored and learned whole,
    however long, each in memory as one slice. Counts have no ties to settle: the tier of
    broadcast words takes all of equal rank or none. An empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    groups = max(64, parts * 4)  # rare words of a slice are few: larger pieces for each bucket
    model = gathered(docs, depth)
    total, distinct, least, known, counts = word_tiers(model, frequent)
    tier = spark.sparkContext.broadcast((known, counts))
    rare_words = distinct > len(known)
    denominator = float(total + distinct + 1)
    docs = texts(docs)

    trees, cuts = [], []
    for tree, low in tree_blocks(model, depth, nodes):
        trees.append(spark.sparkContext.broadcast((uuid.uuid4().hex, tree)))
        cuts.append(low)
    node_groups = buckets_for(parts)

    def scored_by_blocks(held) -> pa.RecordBatch:
        """Partial rows of the held slices: (ids, marks, distinct grams, place of each gram among them, where texts begin)."""
        codes, back = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
        block = np.searchsorted(cuts, bucket_of(branch(codes), node_groups), side="right") - 1
        lp = np.zeros(len(codes))
        for i in np.unique(block):
            mine = block == i
            lp[mine] = released(trees[i]).evaluate(codes[mine])
        out, at = [], 0
        for ids, mark, own, places, first in held:
            got = lp[back[at : at + len(own)]][places]
            at += len(own)
            out.append(_partial(ids, mark, ctw=np.add.reduceat(got, first[:-1]) / math.log(10)))
        return out

    def run(batches):
        words, n_words = tier.value
        held, size = [], 0
        for batch, raws in slices(batches, most=2 << 20):  # rare words are packed by slice
            ids, mark = batch.column(0), marks(raws)
            code, begin = grams(raws, depth)
            ctw = None
            if len(trees) == 1:
                ctw = np.add.reduceat(worker_tree(trees[0]).log_probability(code), begin[:-1]) / math.log(10)
            else:
                own, places = np.unique(code, return_inverse=True)
                held.append((ids, mark, own, places.astype(np.int32), begin))
                size += len(code)
            del code
            data, at = joined(raws, lower=True)
            h, starts, _ = hash_words(data)
            first = np.searchsorted(starts, at)
            # the end is each text's last token
            owner = np.concatenate((np.repeat(np.arange(len(raws)), np.diff(first)), np.arange(len(raws))))
            h = np.concatenate((h, np.full(len(raws), END)))
            c = looked_up(h, words, n_words)
            sure = (c > 0) if rare_words else np.ones(len(c), bool)
            n_known = np.bincount(owner[c > 0], minlength=len(raws))
            log = np.bincount(owner[sure], np.log10((c[sure] + 1) / denominator), len(raws))
            yield _partial(ids, mark, n=np.diff(first) + 1, known=n_known, log=log, ctw=ctw)
            if not sure.all():
                yield from _misses(ids, mark, owner[~sure], h[~sure], groups)
            if size > HELD:
                yield from scored_by_blocks(held)
                held, size = [], 0
        if held:
            yield from scored_by_blocks(held)

    scored = map_arrow(docs, run, "kind int, bucket int, data binary, doc_id long, mark long, n long, known long, log double, ctw double")
    if rare_words:
        counted = model.filter(f"kind = {WORDS}").select("data")

        def rare(batches):
            for b in batches:
                for d in b.column(0).to_pylist():
                    k, n = unpack(d, "u8", "i8")
                    below = rank(n) < least
                    k, n = k[below], n[below]
                    pieces = list(pack(k, k, n, groups=groups))
                    m = len(pieces)
                    none = pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([2] * m, pa.int32()), pa.array([p for p, _ in pieces], pa.int32()), pa.array([x for _, x in pieces], pa.binary()), none, none, none, none, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], _PARTIAL)

        def meet(batches):
            """Partial rows pass; of each bucket, which comes sorted, the counts come ahead of the tokens that want them."""
            now, model_parts, words, n = None, [], np.empty(0, U64), np.empty(0, np.int64)
            for b in batches:
                kind = b.column(0).to_numpy()
                rows = b.filter(pa.array(kind == 0))
                if rows.num_rows:
                    yield rows
                for i in np.flatnonzero(kind > 0):
                    bucket, d = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                    if bucket != now:
                        now, model_parts, words, n = bucket, [], np.empty(0, U64), np.empty(0, np.int64)
                    if kind[i] == 2:
                        model_parts.append(unpack(d, "u8", "u8", "i8")[1:])
                        continue
                    if model_parts:
                        words, n = sum_by_key(*map(np.concatenate, zip(*model_parts)))
                        model_parts = []
                    ids, has, mark, row, k = _open_misses(d)
                    c = looked_up(k, words, n)
                    used = np.unique(row)
                    log = np.bincount(row, np.log10((c + 1) / denominator), len(ids))[used]
                    yield _partial(pa.array(ids[used], mask=~has[used]), mark[used], known=np.bincount(row[c > 0], minlength=len(ids))[used], log=log)

        everything = scored.union(map_arrow(counted, rare, scored.schema))
        place = F.when(F.col("kind") > 0, F.col("bucket").cast("long")).otherwise(F.xxhash64("doc_id", "mark"))
        scored = map_arrow(everything.repartition(parts, place).sortWithinPartitions("bucket", F.desc("kind")), meet, scored.schema)
    rows = F.greatest(F.count("n"), F.lit(1))
    summed = scored.groupBy("doc_id", "mark").agg(rows.alias("rows"), (F.sum("n") / rows).cast("long").alias("n_tokens"), (F.sum("known") / rows).cast("long").alias("n_known"), (F.sum("log") / rows).alias("base_score"), (F.sum("ctw") / rows).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))
    out = summed.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.coalesce("base_score", F.lit(0.0)).alias("base_score"), "score")


_tree: tuple[str, Tree] | None = None


def worker_tree(shared) -> Tree:
    """The block's tree, one at a time in each worker, with what it has evaluated so far."""
    global _tree
    name, tree = shared.value
    if _tree is None or _tree[0] != name:
        _tree = (name, tree)
    return _tree[1]


def released(shared) -> Tree:
    """A block's tree, which the worker doesn't keep."""
    tree = shared.value[1]
    if hasattr(shared, "_value"):
        del shared._value
    return tree


def marks(raws: list[bytes | None]) -> np.ndarray:
    """A hash of each text, which with doc_id names a row."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(r) if r else 0 for r in raws), U64, len(raws)).view(np.int64)


_PARTIAL = ["kind", "bucket", "data", "doc_id", "mark", "n", "known", "log", "ctw"]


def _partial(ids, mark, n=None, known=None, log=None, ctw=None) -> pa.RecordBatch:
    m = len(mark)
    col = lambda x, t: pa.nulls(m, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.binary()), ids, pa.array(mark), col(n, pa.int64()), col(known, pa.int64()), col(log, pa.float64()), col(ctw, pa.float64())], _PARTIAL)


def _misses(ids: pa.Array, mark: np.ndarray, owner: np.ndarray, h: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Packed: for each bucket the rows it speaks of (doc_id, whether it is there, mark) and (row, hash) of each token."""
    id_values, has = ids.fill_null(0).to_numpy(), ~ids.is_null().to_numpy(zero_copy_only=False)
    out = []
    for bucket, data in pack(h, h, owner.astype(np.int32), groups=groups):
        _, k, o = unpack(data, "u8", "u8", "i4")
        used, row = np.unique(o, return_inverse=True)
        head = np.array([len(used), len(k)], np.int64).tobytes()
        out.append((bucket, head + id_values[used].astype(np.int64).tobytes() + has[used].astype(np.int8).tobytes() + mark[used].tobytes() + row.astype(np.int32).tobytes() + k.tobytes()))
    m = len(out)
    none = pa.nulls(m, pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.array([b for b, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary()), none, none, none, none, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], _PARTIAL)


def _open_misses(d: bytes):
    n, m = np.frombuffer(d, np.int64, 2)
    at = 16
    out = []
    for kind, many in (("i8", n), ("i1", n), ("i8", n), ("i4", m), ("u8", m)):
        x = np.frombuffer(d, kind, int(many), at)
        at += x.nbytes
        out.append(x)
    ids, has, mark, row, k = out
    return ids, has.astype(bool), mark, row, k
