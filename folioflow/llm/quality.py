"""Quality rules: base counts, and divergence from language references.

Each language's reference is the pooled histogram of its documents over character
classes and over common words, summed over the whole corpus in the tasks that read it;
only these sums are shuffled. A document is far from a reference when the Jensen-Shannon
distance of its own histogram is above a threshold; that of the words lies below the
distance of a text without common words. A document is compared with every language,
and rejected when it is far from all; short texts are not compared at all.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import SPACES, WORD_BYTE, batch_of, hash_words, joined, map_arrow, slices, texts, windows

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_LINE_WORD = re.compile(rb"[^\x20\x09-\x0D]")

CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "pair", "symbol", "letter beyond ASCII", "control")
_CLASS = np.full(256, 7, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[0x0A] = 4
_CLASS[list(b".,;:?!'\"-")] = 5
_CLASS[list(b"()[]{}/")] = 6
_CLASS[0xC0:] = 8
_CLASS[:0x09] = _CLASS[0x0B:0x20] = 9
_CLASS[0x7F] = 9
_CLASS[0x80:0xC0] = 10  # continuation bytes count with their first

COMMON_WORDS = tuple(
    dict.fromkeys(
        "the of and to in a is that for it was on with as by at this from be are or an have not "
        "der die und das in zu den mit von für auf ist im dem nicht ein eine sich als auch es an "
        "le la les de des et à un une du en que qui dans pour est pas sur au avec ce il "
        "el los las y en que del se con por para una no su al lo como más o pero".split()
    )
)
_WORD_INDEX = {w.encode(): i for i, w in enumerate(COMMON_WORDS)}
N_CLASSES, N_WORDS = len(CLASSES), len(COMMON_WORDS) + 1
#: References at most.
LANGUAGES = 512


@dataclass(frozen=True)
class Rules:
    """Thresholds: distances lie in 0..1; the guards are in code points and words.

    word_share: of the distance from a reference at which a text without any common word
    lies. A reference nearer to such a text than least_reach has too few common words of
    its own to tell, and no text is far from it by its words.
    """

    min_words: int = 10
    repeat_percent: int = 20
    class_distance: float = 0.30
    word_share: float = 0.95
    least_reach: float = 0.2
    guard_chars: int = 200
    guard_words: int = 60


def base_counts(raws: list[bytes | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; None has no words."""
    data, at = joined(raws)
    h, starts, ends = hash_words(data)
    first = np.searchsorted(starts, at)
    n_words = np.diff(first)
    out = {k: np.zeros(len(raws), np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, raw in enumerate(raws):
        if not raw:
            continue
        bare = raw.translate(None, SPACES)
        out["word_chars"][i] = len(bare) if raw.isascii() else len(bare.translate(None, _CONTINUATION))
        out["n_symbols"][i] = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = raw.split(b"\n")
        if len(set(lines)) < len(lines):
            seen = set()
            for line in lines:
                if line in seen:
                    out["n_dup_lines"][i] += bool(_LINE_WORD.search(line))
                else:
                    seen.add(line)
        out["n_repeat_words"][i] = repeated_words(h[first[i] : first[i + 1]])
    return {"n_words": n_words} | out


def repeated_words(h: np.ndarray, k: int = 5) -> int:
    """Words that lie in a k-word window found twice or more, by the hashes of the words."""
    w = windows(h, k)
    if len(w) < 2:
        return 0
    ordered = np.sort(w)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    step = np.zeros(len(h) + 1, np.int64)
    hit = np.flatnonzero(np.isin(w, twice))
    np.add.at(step, hit, 1)
    np.add.at(step, hit + k, -1)
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def histograms(raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and common words (the last bin: other words) of each text."""
    classes = np.zeros((len(raws), 11), np.int64)
    words = np.zeros((len(raws), N_WORDS), np.int64)
    for i, raw in enumerate(raws):
        if raw:
            classes[i] = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 11).astype(np.int64)
            split = raw.lower().split()
            found = [_WORD_INDEX[w] for w in split if w in _WORD_INDEX]
            words[i] = np.bincount(found, minlength=N_WORDS) if found else 0
            words[i, -1] = len(split) - len(found)
    return classes[:, :N_CLASSES], words


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root, base 2) of each row of p to each row of q; rows of zeros are at 0."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = q / np.maximum(q.sum(1, keepdims=True), 1)
    out = np.zeros((len(p), len(q)))
    for j, r in enumerate(q):
        m = (p + r) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
            b = np.where(r > 0, r * np.log2(r / m), 0).sum(1)
        out[:, j] = np.sqrt(np.clip((a + b) / 2, 0, 1))
    out[p.sum(1) == 0] = 0
    return out


def references(docs: DataFrame, rules: Rules = Rules(), most: int = LANGUAGES) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The two reference histograms of each non-null language, over every document that has ``rules.min_words`` words or more.

    Of more than ``most`` labels, those with the most words are references (of equal ones
    the first by name), so what reaches the driver and the tasks has a bound however dirty
    the labels are; a task sends its sums on when it holds so many.
    """
    n = N_CLASSES + N_WORDS

    def run(batches):
        sums = defaultdict(lambda: np.zeros(n, np.int64))

        def rows():
            keys = list(sums)
            return pa.RecordBatch.from_arrays([pa.array([k for k in keys for _ in range(n)], pa.string()), pa.array(list(range(n)) * len(keys), pa.int32()), pa.array(np.concatenate([sums[k] for k in keys]))], ["lang", "bin", "n"])

        for batch, raws in slices(batches):
            c, w = histograms(raws)
            for i, lang in enumerate(batch.column(2).to_pylist()):
                if w[i].sum() >= rules.min_words:
                    sums[lang][:N_CLASSES] += c[i]
                    sums[lang][N_CLASSES:] += w[i]
            if len(sums) > most:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    bins = map_arrow(texts(docs, "lang").filter("lang is not null and text is not null"), run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    words = F.sum(F.when(F.col("bin") >= N_CLASSES, F.col("n")).otherwise(0))
    rows = bins.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins"), words.alias("words")).orderBy(F.desc("words"), "lang").limit(most).collect()
    out: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
    for r in rows:
        for b in r["bins"]:
            out[r["lang"]][b["bin"]] = b["n"]
    return {k: (v[:N_CLASSES], v[N_CLASSES:]) for k, v in sorted(out.items())}


def word_limits(words: np.ndarray, rules: Rules) -> np.ndarray:
    """The distance from each reference beyond which a text's common words are far from it."""
    bare = np.zeros((1, N_WORDS))
    bare[0, -1] = 1
    reach = js_distance(bare, words)[0]
    return np.where(reach >= rules.least_reach, rules.word_share * reach, np.inf)


def judge(raws: list[bytes | None], refs: dict[str, tuple[np.ndarray, np.ndarray]], rules: Rules) -> dict[str, np.ndarray]:
    out = base_counts(raws)
    failed = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_percent * out["n_words"])
    classes, words = histograms(raws)
    if refs:
        ref_words = np.array([w for _, w in refs.values()])
        dc, dw = js_distance(classes, np.array([c for c, _ in refs.values()])), js_distance(words, ref_words)
        far_class = (dc > rules.class_distance) & (classes.sum(1) >= rules.guard_chars)[:, None]
        far_words = (dw > word_limits(ref_words, rules)) & (out["n_words"] >= rules.guard_words)[:, None]
        far = (far_class | far_words).all(1)
        dc, dw = dc.min(1), dw.min(1)
    else:
        dc = dw = np.zeros(len(raws))
        far = np.zeros(len(raws), bool)
    return out | {"base_failed": failed, "class_distance": dc, "word_distance": dw, "kept": ~failed & ~far}


_COLUMNS = [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())]
_ARROW = pa.schema(_COLUMNS)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The counts, distances and verdict of each row of ``docs``.

    Null or empty texts have no words, so they fail the base rules. With no labelled
    document there are no references, and the base rules decide alone. Rows that repeat
    are judged each, alike, and count as often in the references; a document as far from
    its nearest references as a threshold is kept. Texts are judged whole, however long,
    each in memory as one slice. A null doc_id stays null; columns other than lang are not
    read; an empty table gives no rows.
    """
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, rules))

    def run(batches):
        for batch, raws in slices(batches):
            got = judge(raws, refs.value, rules)
            yield batch_of(_ARROW, [batch.column(0), *[got[c] for c, _ in _COLUMNS[1:]]])

    return map_arrow(texts(docs), run, SCHEMA)


def kept_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, whole and unchanged, filtered where they are read.

    Null and empty texts fail the base rules and go; repeated rows stay or go together; a
    null doc_id and columns of any other name pass through; an empty table gives no rows.
    """
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, rules))

    def run(batches):
        for batch, raws in slices(batches):
            yield batch.filter(pa.array(judge(raws, refs.value, rules)["kept"]))

    return map_arrow(docs, run, docs.schema)
