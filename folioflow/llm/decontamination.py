"""Benchmark decontamination as a prefix-filtered set join.

An item's set is its windows of eight words. Words are ordered by rarity, counted over
the whole corpus. As a window must be held whole, its prefix is one token: its rarest
word, which every document that holds the window must have. Documents are joined with
the windows on that token; the positional bound is that the window must begin as far
ahead of the token as in the item and end within the document, the length bound that a
document shorter than an item's window is never tried; what is left is verified word for
word over the item's window.

The index of the items is broadcast in blocks of a bounded size. A benchmark beyond one
block takes a pass for each, and each document's hits are united.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import batch_of, map_arrow, sha256, slices, texts

WINDOW = 8
#: Bytes of item text in a broadcast block.
BLOCK_BYTES = 16 << 20
#: Lower-cases A-Z and turns what separates words into blanks.
_FOLD = bytes(ord(chr(c).lower()) if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


def item_windows(raw: bytes | None) -> list[tuple[bytes, ...]]:
    w = words(raw)
    return [tuple(w[i : i + WINDOW]) for i in range(len(w) - WINDOW + 1)] if len(w) >= WINDOW else [tuple(w)] if w else []


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items, streamed to the driver in blocks of about ``most`` bytes; one block is held at a time."""
    now, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).filter("text is not null").toLocalIterator():
        now.append((r["item_id"], bytes(r["text"])))
        size += len(r["text"])
        if size >= most:
            yield now
            now, size = [], 0
    if now:
        yield now


def rarity(docs: DataFrame, vocabulary: set[bytes]) -> Counter:
    """How often each word of ``vocabulary`` occurs in all of ``docs``, summed in the tasks first."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        keep, sums = known.value, Counter()
        for _, raws in slices(batches):
            sums.update(w for r in raws for w in words(r) if w in keep)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

    rows = map_arrow(texts(docs), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return Counter({bytes(r["word"]): r["n"] for r in rows})


class Index:
    """Windows of a block of items by their prefix token, with the token's place in the window."""

    def __init__(self, items: list[tuple[int, bytes]], counts: Counter):
        owners: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        for item, raw in items:
            for w in item_windows(raw):
                owners[w].add(item)
        by_token = defaultdict(lambda: defaultdict(dict))
        for w, own in owners.items():
            at = min(range(len(w)), key=lambda i: (counts[w[i]], w[i]))
            by_token[w[at]][at, len(w)][w] = tuple(own)
        #: token -> list of (place, length, {window: items})
        self.windows = {t: [(*k, v) for k, v in x.items()] for t, x in by_token.items()}

    def hits(self, raw: bytes | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, the hit spans of words, and the items whose windows occur."""
        w = words(raw)
        n = len(w)
        spans, items = [], set()
        known = self.windows
        if not known.keys().isdisjoint(w):
            for i, x in enumerate(w):
                if x in known:
                    for place, length, held in known[x]:
                        s = i - place
                        if s >= 0 and s + length <= n:
                            own = held.get(tuple(w[s : s + length]))
                            if own is not None:
                                spans.append((s, s + length))
                                items.update(own)
        return n, spans, items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MIN_ITEMS = 2
#: Items shorter than a window that a document must hold to go from the corpus.
LEAST_SHORT = 2


def _indexes(docs: DataFrame, benchmark: DataFrame, most: int) -> Iterator:
    sc = docs.sparkSession.sparkContext
    for items in blocks(benchmark, most):
        yield sc.broadcast(Index(items, rarity(docs, {w for _, raw in items for w in words(raw)})))


def _row(n: int, spans, items) -> tuple:
    hit = sum(e - s for s, e in united(spans))
    return n, hit, len(items), sha256(",".join(sorted(map(str, items)))), len(items) >= MIN_ITEMS


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of each row of ``docs``.

    Null or empty texts have no words; items with null texts or none have no windows, a
    null item_id counts as an item named None; an empty benchmark hits nothing. Repeated
    rows of ``docs`` are judged each (when the benchmark takes several blocks, rows that
    agree in doc_id and text are told apart by their number); repeated items with one
    item_id are one item. Other columns are not read; an empty table gives no rows.
    """
    index = list(_indexes(docs, benchmark, most))
    if len(index) <= 1:
        found = index[0] if index else docs.sparkSession.sparkContext.broadcast(Index([], Counter()))

        def run(batches):
            ix = found.value
            for batch, raws in slices(batches):
                yield batch_of(_ARROW, [batch.column(0), *zip(*[_row(*ix.hits(r)) for r in raws])])

        return map_arrow(texts(docs), run, SCHEMA)

    def partial(index):
        def run(batches):
            ix = index.value
            for batch, raws in slices(batches):
                got = [ix.hits(r) for r in raws]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sha256((r or b"").hex()) for r in raws]), pa.array([g[0] for g in got], pa.int64()), pa.array([[x for s in united(g[1]) for x in s] for g in got], pa.list_(pa.int64())), pa.array([sorted(g[2], key=str) for g in got], pa.list_(pa.int64()))], ["doc_id", "mark", "n", "spans", "items"])

        return map_arrow(texts(docs), run, "doc_id long, mark string, n long, spans array<long>, items array<long>")

    total = len(index)
    parts = partial(index[0])
    for ix in index[1:]:
        parts = parts.union(partial(ix))
    grouped = parts.groupBy("doc_id", "mark").agg(F.first("n").alias("n"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), (F.count("*") / total).cast("int").alias("rows"))
    grouped = grouped.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))

    def finish(batches):
        for b in batches:
            out = [_row(n, list(zip(s[::2], s[1::2])), set(i)) for n, s, i in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)])]
            if out:
                yield batch_of(_ARROW, [b.column(0), *zip(*out)])

    return map_arrow(grouped.select("doc_id", "n", "spans", "items"), finish, SCHEMA)


def leaks(spans: list[tuple[int, int]], items: set) -> bool:
    """Whether a document goes from the corpus: it holds a full window of an item, or LEAST_SHORT items that are shorter than a window."""
    return any(e - s >= WINDOW for s, e in spans) or len(items) >= LEAST_SHORT


def clean_documents(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark (see ``leaks``), unchanged and without a shuffle.

    One full window of eight words is a passage, so a document goes by a single item,
    unlike ``contaminated``, which wants two. An item shorter than a window may stand
    anywhere by chance and counts only with another. Null and empty texts hold nothing and
    stay; repeated rows are judged each, alike; a null doc_id and columns of any other
    name pass through; an empty benchmark keeps all, an empty table gives no rows. Texts
    are judged whole, however long, each in memory as one slice. With a benchmark of
    several blocks, short items are carried from block to block beside the row.
    """
    schema = docs.schema
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"), F.array().cast("array<string>").alias("items"))

    def step(index):
        def run(batches):
            ix = index.value
            for batch, raws in slices(batches):
                now, stays = [], []
                for had, raw in zip(batch.column(2).to_pylist(), raws):
                    _, spans, items = ix.hits(raw)
                    now.append(sorted({*had, *map(str, items)}))
                    stays.append(not leaks(spans, now[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(now, pa.list_(pa.string()))], ["row", "text", "items"]).filter(pa.array(stays))

        return run

    for index in _indexes(docs, benchmark, most):
        carried = map_arrow(carried, step(index), carried.schema)
    return carried.select("row.*").to(schema)
