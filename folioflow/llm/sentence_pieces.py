"""SentencePiece encoding and decoding of whole texts.

Texts of at most CHUNK code points are encoded in the tasks that read them. A longer one is
cut into chunks wherever CHUNK falls, which become rows of a table and are worked on in
tasks of their own: each gives its transfer matrix between the states of its two borders
(`maxplus`, with the weights of a model that merges by rank), the matrices of a text are
combined, which leaves one state at each border, and each chunk is traced back between its
two states. So a text costs a task's memory for a chunk at a time, even without a blank.

No piece of such a model reaches over a blank mark after another character; there is one
state only at these places. Between the first and the last of them in a chunk, as in short
texts, stretches are encoded by the library, small ones through a cache. A model that has a piece
across such a place is refused.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import maxplus
from folioflow.llm.common import batch_of, map_arrow, slices, texts
from folioflow.runtime import shuffle_partitions, stored

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_SAFE = re.compile(f"[^{MARK}](?={MARK})")
CACHE_ENTRIES = 400_000
CACHED_CHARS = 64
#: Code points of a chunk; longer texts are cut. What a chunk costs besides its encoding is a table row and the borders, some thousand characters' worth.
CHUNK = 1 << 16


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        crossing = [p for p in names if re.search(f"[^{MARK}]{MARK}", p)]
        if crossing:
            raise ValueError(f"pieces span a blank mark after another character: {crossing[:3]}")
        if lib.encode("a  b ") != [*lib.encode("a"), *lib.encode(" b"), lib.piece_to_id(MARK)]:
            raise ValueError("the model trims or rewrites blanks")
        self.pieces = [bytes([int(n[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.cache: dict[str, bytes] = {}
        self.names = names
        self._ranked: maxplus.Ranked | None = None

    @property
    def ranked(self) -> maxplus.Ranked:
        if self._ranked is None:
            lib = self.library
            self._ranked = maxplus.Ranked({n: lib.get_score(i) for i, n in enumerate(self.names) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))})
            self.ids = {n: i for i, n in enumerate(self.names)}
        return self._ranked

    def ids_of(self, pieces: list[str]) -> bytes:
        """The ids of pieces; a character that is none is spelled in bytes, where the model has them."""
        known, out = self.ranked.scores, []
        for p in pieces:
            if p in known:
                out.append(self.ids[p])
            elif "<0x00>" in self.ids:
                out += [self.ids[f"<0x{b:02X}>"] for b in p.encode()]
            else:
                out.append(self.library.unk_id())
        return np.array(out, "<i4").tobytes()

    def matrix(self, text: str, start: int, end: int) -> tuple[list[maxplus.State], dict[maxplus.State, int]]:
        """(states at ``start``, transfer matrix) of the chunk start..end of a marked text; 0 is where the whole text begins only if ``start`` is."""
        entries = maxplus.states_at(text, start, self.ranked) if start else [maxplus.BEGIN]
        return entries, maxplus.rank_transfer(text, start, end, entries, self.ranked, safe_borders(text, start, end))

    def traced(self, text: str, start: int, end: int, enter: maxplus.State, leave: maxplus.State) -> bytes:
        """The ids of the pieces that begin in the chunk, between two known states."""
        safe = safe_borders(text, start, end)
        if not safe:
            return self.ids_of(maxplus.rank_trace(text, start, end, enter, leave, self.ranked))
        first, last = safe
        head = self.ids_of(maxplus.rank_trace(text, start, first, enter, state_before(text, start, first, enter, self.ranked), self.ranked)) if first > start else b""
        tail = self.ids_of(maxplus.rank_trace(text, last, end, maxplus.BEGIN, leave, self.ranked))
        return head + self.stretches(text[first:last]) + tail

    def stretches(self, marked: str) -> bytes:
        return b"".join(map(self.chunk, _CHUNK.findall(marked)))

    def chunk(self, c: str) -> bytes:
        """The ids (4 bytes each) of a chunk, which begins with a blank mark."""
        got = self.cache.get(c)
        if got is None:
            surface = c[1:].replace(MARK, " ")
            ids = self.library.encode(surface) if surface else [self.library.piece_to_id(MARK)]
            got = np.array(ids, "<i4").tobytes()
            if len(c) <= CACHED_CHARS:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[c] = got
        return got

    def encode(self, text: str) -> bytes:
        """The library's ids of ``text``, as little-endian 32-bit numbers."""
        if not text:
            return b""
        return self.stretches(MARK + text.replace(" ", MARK))

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        out = b"".join([pieces[i] for i in np.frombuffer(ids, "<i4").tolist()])
        return (out[1:] if out[:1] == b" " else out).decode(errors="replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec, loaded once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def safe_borders(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The first and last place in start..end (before its end) where a blank mark follows another character."""
    m = _SAFE.search(text, max(0, start - 1), end)
    if m is None:
        return None
    at = text.rfind(MARK, start, end)
    while text[at - 1] == MARK:
        at -= 1
    return m.end(), at


def state_before(text: str, start: int, border: int, enter: maxplus.State, ranked: maxplus.Ranked) -> maxplus.State:
    """The one state at a safe border that ``enter`` leads to by the pieces up to there."""
    seeds = [(start + enter[1], text[start - enter[0] : start + enter[1]], 1)]
    found = maxplus.reach(text, start, border, seeds, ranked)[border]
    if len(found) != 1:
        raise AssertionError(f"{len(found)} ways to a safe border")
    return len(found[0][0]), 0


def chunks_of(text: str, size: int, reach: int) -> Iterator[tuple[int, int, str, int, int, str]]:
    """(number, how many, the marked chunk with ``reach`` characters on each side, its start and end there, its part of ``text``); a short last one belongs to the one ahead."""
    marked = MARK + text.replace(" ", MARK)
    cuts = list(range(0, len(marked), size))
    if len(cuts) > 1 and len(marked) - cuts[-1] < reach:
        cuts.pop()
    for k, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(marked)])):
        low = max(0, s - reach)
        yield k, len(cuts), marked[low : e + reach], s - low, e - low, text[max(0, s - 1) : e - 1]


def _encoded(docs: DataFrame, model: str, row: Callable[[Codec, bytes, str], tuple], arrow: pa.Schema, schema: str, size: int) -> DataFrame:
    """``row`` of each document's ids and text, behind its doc_id; long texts by their chunks."""
    docs = texts(docs)
    long = F.coalesce(F.length("text") > size, F.lit(False))

    def columns(ids, rows) -> pa.RecordBatch:
        parts = list(zip(*rows))
        return batch_of(arrow, [ids, *[_lists(c) if f.type == pa.list_(pa.int32()) else list(c) for c, f in zip(parts, list(arrow)[1:])]])

    def short(batches):
        c = codec(model)
        for batch, raws in slices(batches, most=1 << 20):
            given = [r.decode() if r else "" for r in raws]
            yield columns(batch.column(0), [row(c, c.encode(t), t) for t in given])

    def cut(batches):
        reach = codec(model).ranked.longest
        for batch, raws in slices(batches):
            for i, raw in enumerate(raws):
                name = uuid.uuid4().hex  # kept by the stored table
                for k, n, window, s, e, own in chunks_of(raw.decode(), size, reach):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), batch.column(0).slice(i, 1), *(pa.array([x], pa.int32()) for x in (k, n, s, e)), pa.array([window]), pa.array([own])], ["name", "doc_id", "k", "n", "s", "e", "window", "own"])

    out = map_arrow(docs.filter(~long), short, schema)
    chunks = stored(map_arrow(docs.filter(long), cut, "name string, doc_id long, k int, n int, s int, e int, window string, own string"), "pieces-chunks")
    if not chunks.head(1):
        return out
    parts = shuffle_partitions(docs.sparkSession)

    def matrices(batches):
        c = codec(model)
        for b in batches:
            for name, k, window, s, e in zip(*[b.column(i).to_pylist() for i in range(5)]):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([pickle.dumps(c.matrix(window, s, e))], pa.binary())], ["name", "k", "matrix"])

    def solve(table):
        order = np.argsort(table.column("k").to_numpy())
        found = maxplus.rank_states([pickle.loads(table.column("matrix")[int(i)].as_py()) for i in order])
        numbers = [np.array(x, np.int32) for x in zip(*[(*a, *b) for a, b in zip(found, found[1:])])]
        return pa.table([pa.array([table.column("name")[0].as_py()] * len(order)), pa.array(np.arange(len(order), dtype=np.int32)), *map(pa.array, numbers)], names=["name", "k", "back_in", "out_in", "back_out", "out_out"])

    def trace(batches):
        c = codec(model)
        for b in batches:
            for name, doc_id, k, window, s, e, own, *ends in zip(*[b.column(i).to_pylist() for i in range(11)]):
                ids = c.traced(window, s, e, (ends[0], ends[1]), (ends[2], ends[3]))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([doc_id], pa.int64()), pa.array([k], pa.int32()), pa.array([ids], pa.binary()), pa.array([own])], ["name", "doc_id", "k", "ids", "text"])

    def whole(table):
        """A text of all its chunks: the row that it is in the result."""
        table = table.sort_by("k")
        ids, text = b"".join(table.column("ids").to_pylist()), "".join(table.column("text").to_pylist())
        return pa.Table.from_batches([columns(pa.array(table.column("doc_id").to_pylist()[:1], pa.int64()), [row(codec(model), ids, text)])])

    spread = chunks.repartition(parts, "name", "k")
    solved = map_arrow(spread.select("name", "k", "window", "s", "e"), matrices, "name string, k int, matrix binary").groupBy("name").applyInArrow(solve, "name string, k int, back_in int, out_in int, back_out int, out_out int")
    known = chunks.join(solved, ["name", "k"]).select("name", "doc_id", "k", "window", "s", "e", "own", "back_in", "out_in", "back_out", "out_out")
    traced = map_arrow(known, trace, "name string, doc_id long, k int, ids binary, text string")
    return out.union(traced.groupBy("name").applyInArrow(whole, schema))


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _lists(encoded: Iterable[bytes]) -> pa.ListArray:
    encoded = list(encoded)
    offsets = np.concatenate(([0], np.cumsum([len(e) // 4 for e in encoded]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode_documents(docs: DataFrame, model: str, size: int = CHUNK) -> DataFrame:
    """(doc_id, ids, decoded) of each row of ``docs``: the library's ids, and the text they give back.

    Null and empty texts have no ids and decode to the empty text. Repeated rows are
    encoded each, alike; a null doc_id stays null; an empty table gives no rows, other
    columns are not read. Texts are encoded whole; those of more than ``size`` code points
    by chunks in several tasks, which give the same ids. Of pieces that may merge with equal
    scores the first does, as the library has it. ``model`` is a path on every worker.
    """
    return _encoded(docs, model, lambda c, ids, text: (ids, c.decode(ids)), _IDS, "doc_id long, ids array<int>, decoded string", size)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def _digest(c: Codec, ids: bytes, text: str) -> tuple:
    back = c.decode(ids)
    numbers, digest = np.frombuffer(ids, "<i4"), hashlib.sha256()
    for i in range(0, len(numbers), 1 << 20):
        digest.update(((i > 0) * "," + ",".join(map(str, numbers[i : i + (1 << 20)].tolist()))).encode())
    return len(numbers), digest.hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text


def digests(docs: DataFrame, model: str, size: int = CHUNK) -> DataFrame:
    """n_pieces, the digests of the ids (comma-joined decimals) and of the decoded text, and whether it is the text (null: the empty one), of each row of ``docs``.

    Rows are treated as ``encode_documents`` says: null and empty texts have no pieces and
    the digests of the empty text, and come back as they are.
    """
    return _encoded(docs, model, _digest, _DIGEST, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean", size)
