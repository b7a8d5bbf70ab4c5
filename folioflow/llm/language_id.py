"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts by language in the tasks and shuffles these sums alone. The
log-probabilities are a matrix of fixed rows (hash buckets) and a column for each
language, which is broadcast; its size is bounded by MAX_LANGUAGES, above which training
refuses to run. Texts are scored in numpy, many at a time, by gathering matrix rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import batch_of, map_arrow, slices, texts

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 512
UNKNOWN = "und"
FOLDS = 5

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def features(raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its text, whether the text has a letter); n-grams of lower-cased letters, with one blank for all else, never across texts."""
    parts = [(r.decode().lower() if r else "") for r in raws]
    counts = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(parts)), counts)
    is_letter = letters()[cp]
    has = np.bincount(owner[is_letter], minlength=len(parts)) > 0
    first = np.ones(len(cp), bool)
    first[1:] = owner[1:] != owner[:-1]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & ~first[1:]  # one blank after a word
    cp, owner, is_letter = cp[keep], owner[keep], is_letter[keep]
    x = np.where(is_letter, cp, 32).astype(np.uint32)
    out, own, h = [], [], np.zeros(len(x), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(x):
            break
        h = h[: len(x) - n + 1] * np.uint32(0x9E3779B1) + x[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            whole = owner[: len(h)] == owner[n - 1 :]
            g = h[whole]
            g = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((g ^ (g >> np.uint32(13))) >> np.uint32(16))
            own.append(owner[: len(h)][whole])
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), has
    return np.concatenate(out).astype(np.int64), np.concatenate(own), has


def is_held_out(doc_id: int | None, folds: int = FOLDS, fold: int = 0) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def train(docs: DataFrame, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by bucket and language), from all labelled documents that aren't held out.

    Each language is as likely as any other beforehand. A null doc_id has no fold and is not learned from.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def rows():
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

        for batch, raws in slices(batches):
            ids, langs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            use = [i for i, (d, lang) in enumerate(zip(ids, langs)) if lang is not None and raws[i] and d is not None and not is_held_out(d)]
            bucket, owner, _ = features([raws[i] for i in use])
            own = np.array([langs[i] for i in use], object)
            for lang in set(own):
                mine = np.isin(owner, np.flatnonzero(own == lang))
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket[mine], minlength=BUCKETS)
            if len(sums) > MAX_LANGUAGES:  # dirty labels must not fill the task
                yield from rows()
                sums.clear()
        yield from rows()

    counts = map_arrow(texts(docs, "lang"), run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would exceed its bound")
    langs = sorted(r["lang"] for r in rows)
    table = np.zeros((BUCKETS, len(langs)))
    for r in rows:
        for bucket, n in r["counts"]:
            table[bucket, langs.index(r["lang"])] = n
    return langs, np.log((table + alpha) / (table.sum(0) + alpha * BUCKETS)).astype(np.float32)


def score(raws: list[bytes | None], langs: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    bucket, owner, has = features(raws)
    total = np.zeros((len(raws), max(1, len(langs))))
    if langs and len(bucket):
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        step = max(1, (1 << 24) // len(langs))
        for i in range(0, len(bucket), step):
            own = owner[i : i + step]
            at = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
            total[own[at]] += np.add.reduceat(table[bucket[i : i + step]], at, axis=0, dtype=np.float64)
    best = total.argmax(1)
    share = np.exp(total - total.max(1, keepdims=True))
    p = 1 / share.sum(1)
    known = has & bool(langs)
    return [langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p, 0.0)


_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior) of each row of ``docs``.

    Null texts, and such without a letter, are ``und`` at 0; so is everything when nothing
    is labelled. Ties go to the first language by name. A null doc_id is not held out.
    Repeated rows are predicted each, alike, and are learned from as often; an empty table
    gives no rows; lang serves training alone, other columns are not read. Texts are taken
    whole, however long, each in memory as one slice.
    """
    langs, table = train(docs)
    model = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch, raws in slices(batches, most=1 << 20):
            pred, p = score(raws, langs, model.value)
            ids = batch.column(0)
            yield batch_of(_ARROW, [ids, [is_held_out(i) for i in ids.to_pylist()], pred, p])

    return map_arrow(texts(docs), run, SCHEMA)
