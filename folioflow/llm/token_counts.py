"""Token counts of whole texts, map side, in two tiers.

A first pass over all documents finds the frequent pre-tokens: each task counts in a
summary of bounded size (Misra-Gries: whatever holds more than one part in FREQUENT of
the task's pre-tokens stays), and summaries of this size are merged, in groups, down to
one. Tier 1 is the table of these pre-tokens' lengths, which is broadcast. Tier 2 are two
caches in each worker, of other pre-tokens, encoded by the library once, and of stretches
between blanks, which are what a text is looked up by. No pre-token is shuffled.

The byte-level split ahead of the merges never reaches over a blank that a character
other than white space follows, so a text is the sum of its stretches between these.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioflow.llm.common import batch_of, map_arrow, slices, texts
from folioflow.runtime import shuffle_partitions

#: How byte-level BPE splits text ahead of its merges.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the broadcast table, and of each summary.
FREQUENT = 1 << 15
#: Entries of each of a worker's caches; a full one begins anew.
CACHE_ENTRIES = 600_000
#: Longer strings are not kept.
CACHED_CHARS = 64
#: Code points of a text that are split at once.
BLOCK = 1 << 20
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
_MORE_SPACE = re.compile(r" (?:\s|\Z)")
_STRETCH = regex.compile(r" (?=\S)")
_split = regex.compile(PRE_TOKEN).findall
_each = regex.compile(PRE_TOKEN).finditer

_loaded: dict[str, "Lengths"] = {}


def checked(path: str) -> list[str]:
    """The special strings of a tokenizer file; one that doesn't split as PRE_TOKEN says, or changes texts, is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or spec["normalizer"] is not None or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) != ("ByteLevel", False, True):
        raise ValueError(f"not a byte-level BPE without prefix: {path}")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"special strings that take in what surrounds them: {path}")
    return [t["content"] for t in spec["added_tokens"]]


def blocks(text: str) -> Iterator[tuple[str, bool]]:
    """(part, whether a blank stands ahead of it): the text cut at blanks with a word behind, each part BLOCK long or a little more."""
    at, blank = 0, False
    while len(text) - at > BLOCK:
        m = _STRETCH.search(text, at + BLOCK)
        if m is None:
            break
        yield text[at : m.start()], blank
        at, blank = m.end(), True
    yield text[at:] if at else text, blank


def stretches(part: str, blank: bool) -> list[str]:
    """The part's stretches between blanks with a word behind. The first of a text, which has none ahead of it, gets one as its mark: no other begins so."""
    out = _STRETCH.split(part) if _MORE_SPACE.search(part) else part.split(" ")
    if not blank:
        out[0] = " " + out[0]
    return out


def surface(stretch: str) -> str:
    """What a stretch stands for in the text."""
    return stretch[1:] if stretch[:1] == " " else " " + stretch


class Lengths:
    """Counts tokens with the broadcast table, the worker's caches and the library, in this order."""

    def __init__(self, path: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.specials = checked(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.frequent = frequent
        self.cache: dict[str, int] = {}
        self.stretches: dict[str, int] = {}

    def encode(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def pre_tokens(self, words: set[str]) -> dict[str, int]:
        """Lengths of pre-tokens that the table lacks, from the cache or the library."""
        out = {w: self.cache[w] for w in words if w in self.cache}
        missing = [w for w in words if w not in out]
        for i in range(0, len(missing), 4096):
            out.update(zip(missing[i : i + 4096], self.encode(missing[i : i + 4096])))
        if len(self.cache) + len(missing) > CACHE_ENTRIES:
            self.cache.clear()
        self.cache.update((w, out[w]) for w in missing[:CACHE_ENTRIES] if len(w) <= CACHED_CHARS)
        return out

    def long(self, text: str) -> int:
        """Tokens of a stretch of any length, its pre-tokens taken a few thousand at a time."""
        total, waiting = 0, []
        for m in _each(text):
            waiting.append(m[0])
            if len(waiting) == 4096:
                total += self.summed(waiting)
                waiting = []
        return total + self.summed(waiting)

    def summed(self, pieces: list[str]) -> int:
        known = self.pre_tokens(set(pieces).difference(self.frequent))
        return sum(known[p] if p in known else self.frequent[p] for p in pieces)

    def learn(self, keys: set[str]) -> dict[str, int]:
        """Lengths of stretches that the cache lacks."""
        out, split, wanted = {}, {}, set()
        for k in keys:
            if len(k) > BLOCK:
                out[k] = self.long(surface(k))
            else:
                split[k] = [" " + k] if k.isalpha() else _split(surface(k))
                wanted.update(split[k])
        known = self.pre_tokens(wanted.difference(self.frequent))
        known.update((w, self.frequent[w]) for w in wanted.intersection(self.frequent))
        get = known.__getitem__
        for k, pieces in split.items():
            out[k] = sum(map(get, pieces))
        return out

    def looked_up(self, pieces: list[tuple[int, list[str]]], totals: list[int]) -> None:
        """Adds the tokens of each list of stretches to the total of its text."""
        missing = set().union(*(p for _, p in pieces)).difference(self.stretches)
        if len(self.stretches) + len(missing) > CACHE_ENTRIES:
            self.stretches.clear()
            missing = set().union(*(p for _, p in pieces))
        if missing:
            self.stretches.update(self.learn(missing))
        get = self.stretches.__getitem__
        for i, p in pieces:
            totals[i] += sum(map(get, p))
        for k in missing:
            if len(k) > CACHED_CHARS:
                del self.stretches[k]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; what about BLOCK code points hold is looked up together."""
        totals, pieces, size = [0] * len(texts), [], 0
        for i, t in enumerate(texts):
            parts = [t]
            if self.cut and any(s in t for s in self.specials):
                totals[i] += sum(1 for _ in self.cut.finditer(t))
                parts = self.cut.split(t)
            for part in parts:
                for block, blank in blocks(part) if part else ():
                    pieces.append((i, stretches(block, blank)))
                    size += len(block)
                    if size > BLOCK:
                        self.looked_up(pieces, totals)
                        pieces, size = [], 0
        if pieces:
            self.looked_up(pieces, totals)
        return totals


def pruned(counts: Counter, most: int) -> Counter:
    """At most ``most`` of the counts, less the greatest of those left out: what was counted more often than that stays."""
    if len(counts) <= most:
        return counts
    n = np.fromiter(counts.values(), np.int64, len(counts))
    least = int(np.partition(n, len(n) - most - 1)[len(n) - most - 1])
    return Counter({w: k - least for w, k in counts.items() if k > least})


def frequent_pre_tokens(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    """The pre-tokens that are frequent in all of ``docs``, ``most`` of them at most."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], ["words", "n"])

    def count(batches):
        found: Counter = Counter()
        for _, raws in slices(batches):
            for r in raws:
                for block, blank in blocks(r.decode()) if r else ():
                    found.update(s for s in stretches(block, blank) if len(s) <= CACHED_CHARS)
            if len(found) > 16 * most:
                found = pruned(found, 4 * most)
        pieces: Counter = Counter()
        for s, n in pruned(found, 4 * most).items():
            for w in [" " + s] if s.isalpha() else _split(surface(s)):
                pieces[w] += n
        if pieces:
            yield rows(pruned(pieces, most))

    def merge(batches):
        found: Counter = Counter()
        for b in batches:
            for words, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, k in zip(words, n):
                    found[w] += k
                found = pruned(found, most)
        if found:
            yield rows(found)

    schema = "words array<string>, n array<long>"
    summaries = map_arrow(texts(docs).select("text"), count, schema)
    found: Counter = Counter()
    merged = map_arrow(summaries.repartition(shuffle_partitions(docs.sparkSession)), merge, schema)
    for r in map_arrow(merged.repartition(8), merge, schema).toLocalIterator():
        for w, k in zip(r["words"], r["n"]):
            found[w] += k
    return list(pruned(found, most))


def frequent_lengths(docs: DataFrame, path: str, most: int = FREQUENT) -> dict[str, int]:
    words = frequent_pre_tokens(docs, most)
    return dict(zip(words, Lengths(path, {}).encode(words)))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs``, for the file ``tokenizer``.

    Counts are those of the library, without begin, end or added special tokens; the
    special strings are tokens where a text holds them. Null and empty texts count 0
    tokens; a null doc_id stays null; repeated rows are counted each; an empty table
    gives none; other columns are not read. Texts are counted whole: a long one is a slice
    of its own and is split a block at a time. ``tokenizer`` is a path on every worker.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast((uuid.uuid4().hex, frequent_lengths(docs, tokenizer)))

    def run(batches):
        counter = worker_lengths(tokenizer, *table.value)
        for batch, raws in slices(batches):
            n = counter.count([r.decode() if r else "" for r in raws])
            yield batch_of(_ARROW, [batch.column(0), [len(r) if r else 0 for r in raws], n, [x > limit for x in n]])

    return map_arrow(texts(docs), run, SCHEMA)


def worker_lengths(path: str, name: str, frequent: dict[str, int]) -> Lengths:
    """The worker's counter for a broadcast table, with its caches; one is held at a time."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Lengths(path, frequent)
    return _loaded[name]
