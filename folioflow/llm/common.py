"""Batches of whole texts, vectorised word hashing, and packed shuffles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.runtime import ship

#: Bytes of text worked on at once: the arrays of a slice should stay in a core's cache.
SLICE_BYTES = 512 << 10
U64 = np.uint64

#: [\x20\x09-\x0D] separates words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
WORD_BYTE = np.ones(256, np.int8)
WORD_BYTE[list(SPACES)] = 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id and text (and ``more``), by name; other columns never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in more])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cuts Arrow batches to about ``most`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        sizes = np.nan_to_num(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
        at = 0
        ends = np.cumsum(sizes)
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at), col.slice(at, to - at).to_pylist()
            at = to


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# word hashes

_rng = np.random.Generator(np.random.PCG64(20240611))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow = np.ones(1, U64)
_ipow = np.ones(1, U64)
BLOCK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, 1 << 16)
        for name, b in (("_pow", _BASE), ("_ipow", _BASE_INV)):
            a = np.full(size, b, U64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _pow, _ipow


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def hash_words(data: bytes, word_byte: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each maximal run of word bytes. Equal words have equal 64-bit hashes.

    Runs in blocks that end at a separator, so memory follows the block, not the text.
    """
    buf = np.frombuffer(data, np.uint8)
    if len(buf) <= BLOCK:
        return _hash_block(buf, word_byte)
    out, at = [], 0
    while at < len(buf):
        to = min(at + BLOCK, len(buf))
        while to < len(buf) and word_byte[buf[to]]:
            more = np.flatnonzero(word_byte[buf[to : to + 65536]] == 0)
            to += int(more[0]) if len(more) else min(65536, len(buf) - to)
        h, s, e = _hash_block(buf[at:to], word_byte)
        out.append((h, s + at, e + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out))


def _hash_block(buf: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf)
    flags = np.zeros(n + 2, np.int8)
    flags[1:-1] = word_byte[buf]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_VALUE[buf] * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts, ends


def joined(raws: list[bytes | None], lower: bool = False) -> tuple[bytes, np.ndarray]:
    """All texts of a slice in one buffer, a newline after each, and where each begins (one more at the end)."""
    lengths = np.fromiter((len(r) + 1 if r else 1 for r in raws), np.int64, len(raws))
    data = b"\n".join([r or b"" for r in raws]) + b"\n"
    return (data.lower() if lower else data), np.concatenate(([0], np.cumsum(lengths)))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by the hashes of the words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * U64(0xD6E8FEB86659FD93) + h[i : i + n]
    return mix(out)


# packed shuffles


def buckets_for(partitions: int) -> int:
    """How many buckets spread evenly over so many partitions; fewer to each where there are many, as pieces shrink."""
    return max(64, partitions * (16 if partitions <= 1024 else 4))


def pack(keys: np.ndarray, *columns: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed columns) pieces, sorted by bucket; ``groups`` buckets."""
    b = bucket_of(keys, groups)
    order = np.argsort(b, kind="stable")
    b = b[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    edges = np.concatenate(([0], cuts, [len(b)])) if len(b) else np.zeros(1, int)
    cols = [c[order] for c in (keys, *columns)]
    for i, j in zip(edges[:-1], edges[1:]):
        yield int(b[i]), b"".join(c[i:j].tobytes() for c in cols)


def bucket_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return ((mix(keys) >> U64(32)) * U64(groups) >> U64(32)).astype(np.int32)


def by_bucket(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[bytes]]]:
    """(values of ``names``, their ``data``) of rows that come sorted by ``names``; one group is held at a time."""
    now, held = None, []
    for b in batches:
        keys = list(zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in names]))
        data = b.column(b.schema.get_field_index("data"))
        for key, blob in zip(keys, data):
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(blob.as_py())
    if held:
        yield now, held


def unpack(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    kinds = [np.dtype(d) for d in dtypes]
    n = len(blob) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * k.itemsize
    return out


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return keys[at], np.add.reduceat(counts, at)
