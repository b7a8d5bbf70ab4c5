"""Segmentation by a max-plus scan over chunks, for unigram piece tables and for such that merge by rank.

A chunk's transfer matrix has, for each way a piece may reach into it from the left and out
of it to the right, the best score of what begins within it. Matrices combine
associatively under (max, +), so chunks are worked out independently, combined in any
grouping, and traced back each on its own once its two ends are known.

Unigram tables score by sums. Where pieces merge by rank, a sequence of pieces is what
merging gives exactly if each piece and each two neighbours are what merging gives for
them alone: the first merge across a border would happen between these two by themselves
as well. So a way scores 0 where all its neighbours fit and -inf else, one way has 0, and
a matrix of zeros and -inf is kept as bits: for each state at the right end, the states at
the left end that lead to it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np

NONE = -np.inf
#: What the unigram library takes off the least score for a character that no piece holds.
UNKNOWN_PENALTY = 10.0


class Pieces:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY

    def at(self, text: str, i: int):
        """(length, score) of what may begin at i; a lone unknown character where no piece holds just it."""
        alone = False
        for n in range(1, min(self.longest, len(text) - i) + 1):
            s = self.scores.get(text[i : i + n])
            if s is not None:
                alone |= n == 1
                yield n, s
        if not alone:
            yield 1, self.unknown


def transfer(text: str, start: int, end: int, pieces: Pieces) -> np.ndarray:
    """Best scores from (characters of the chunk that a piece from the left holds) to (characters beyond it that its last piece holds)."""
    width = max(1, pieces.longest)
    best = np.full((end - start + width, width), NONE)
    for r in range(min(width, end - start + width)):
        best[r, r] = 0.0
    for i in range(start, end):
        row = best[i - start]
        if row.max() == NONE:
            continue
        for n, s in pieces.at(text, i):
            at = i - start + n
            np.maximum(best[at], row + s, out=best[at])
    return best[end - start :].T[:, :width]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def trace(text: str, start: int, end: int, enter: int, leave: int, pieces: Pieces) -> list[tuple[int, int]]:
    """Spans of the pieces that begin in the chunk, on the best way between two known states."""
    n = end - start
    best = np.full(n + pieces.longest, NONE)
    back = np.full(n + pieces.longest, -1)
    best[enter] = 0.0
    for i in range(start + enter, end):
        if best[i - start] == NONE:
            continue
        for k, s in pieces.at(text, i):
            if (v := best[i - start] + s) > best[i - start + k]:
                best[i - start + k], back[i - start + k] = v, i - start
    out, at = [], n + leave
    while at > enter:
        out.append((start + int(back[at]), start + at))
        at = int(back[at])
    return out[::-1]


def segment(text: str, pieces: Pieces, chunk: int = 4096) -> list[str]:
    """The pieces of the best segmentation; ties go to the way found first in each chunk, the longer reach last."""
    if not text:
        return []
    chunk = max(chunk, pieces.longest)
    cuts = [*range(0, len(text), chunk)]
    if len(cuts) > 1 and len(text) - cuts[-1] < pieces.longest:
        cuts.pop()  # a piece reaches over one cut at most
    edges = [*cuts, len(text)]
    spans = list(zip(edges[:-1], edges[1:]))
    matrices = [transfer(text, s, e, pieces) for s, e in spans]
    # states at each cut, from the right: the best way to the end
    ahead = [np.where(np.arange(matrices[-1].shape[1]) == 0, 0.0, NONE)]
    for m in reversed(matrices):
        ahead.append((m + ahead[-1][None, :]).max(1))
    ahead.reverse()
    states = [0]
    for k, m in enumerate(matrices):
        states.append(int(np.argmax(m[states[-1]] + ahead[k + 1])))
    out = []
    for (s, e), enter, leave in zip(spans, states, states[1:]):
        out += [text[i:j] for i, j in trace(text, s, e, enter, leave, pieces)]
    return out


def total(text: str, pieces: Pieces, chunk: int) -> float:
    """The best score, by combining the chunks' matrices alone."""
    m = reduce(combine, [transfer(text, s, min(len(text), s + chunk), pieces) for s in range(0, len(text), chunk)])
    return float(m[0, 0])


# pieces that merge by rank

#: A state at a border: how far the piece that holds the character ahead of it reaches back, and beyond.
State = tuple[int, int]
BEGIN: State = (0, 0)


class Ranked:
    """Pieces by score: of all neighbours whose union is a piece, those with the best score merge, the first of equal ones, until none are left."""

    KEPT = 1 << 20

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self._fits: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    def merge(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = NONE, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def whole(self, piece: str) -> bool:
        got = self._whole.get(piece)
        if got is None:
            got = self._whole[piece] = len(piece) == 1 or self.merge(piece) == [piece]
        return got

    def fits(self, a: str, b: str) -> bool:
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) >= self.KEPT:
                self._fits.clear()
            got = self._fits[a, b] = self.merge(a + b) == [a, b]
        return got

    def beginning(self, text: str, i: int) -> list[str]:
        """The pieces that may begin at i; a character alone always may."""
        out = [text[i]]
        for n in range(2, min(self.longest, len(text) - i) + 1):
            t = text[i : i + n]
            if t in self.scores and self.whole(t):
                out.append(t)
        return out


def states_at(text: str, border: int, pieces: Ranked) -> list[State]:
    """The states that the text around a border allows."""
    out = []
    for s in range(max(0, border - pieces.longest), border):
        out += [(border - s, s + len(t) - border) for t in pieces.beginning(text, s) if s + len(t) >= border]
    return out


def reach(text: str, start: int, end: int, seeds: list[tuple[int, str, int]], pieces: Ranked, back: dict | None = None) -> dict[int, list[tuple[str, int]]]:
    """What ends at or beyond ``end``: by its end, (piece, bits of the seeds that lead there).

    ``seeds``: (where it ends, the piece, bits). An empty piece fits all. ``back`` takes
    the piece ahead of each (piece, end).
    """
    ends: dict[int, list[tuple[str, int]]] = {}
    for e, t, bits in seeds:
        ends.setdefault(e, []).append((t, bits))
    fits = pieces.fits
    for p in range(start, end):
        ahead = ends.pop(p, None)
        if ahead:
            for t in pieces.beginning(text, p):
                bits = 0
                for u, b in ahead:
                    if b | bits != bits and (not u or fits(u, t)):
                        bits |= b
                        if back is not None:
                            back[t, p + len(t)] = (u, p)
                if bits:
                    ends.setdefault(p + len(t), []).append((t, bits))
    return ends


def rank_transfer(text: str, start: int, end: int, entries: list[State], pieces: Ranked, safe: tuple[int, int] | None = None) -> dict[State, int]:
    """For each state at ``end`` the bits of ``entries`` at ``start`` that lead to it. The chunk is as long as the longest piece at least.

    ``safe``: two borders in the chunk, first and last, over which no piece ever reaches;
    what lies between them is passed over.
    """
    seeds = [(start + out, text[start - behind : start + out], 1 << i) for i, (behind, out) in enumerate(entries)]
    if safe:
        bits = 0
        for _, b in reach(text, start, safe[0], seeds, pieces).get(safe[0], ()):
            bits |= b
        start, seeds = safe[1], [(safe[1], "", bits)]
    ends = reach(text, start, end, seeds, pieces)
    return {(end - e + len(t), e - end): bits for e, found in ends.items() for t, bits in found}


def rank_combine(left: dict[State, int], middle: list[State], right: dict[State, int]) -> dict[State, int]:
    """The matrix of two chunks; ``middle``: the states at the border between, by the bits of ``right``."""
    out = {}
    for state, bits in right.items():
        got = 0
        for i, m in enumerate(middle):
            if bits >> i & 1:
                got |= left.get(m, 0)
        if got:
            out[state] = got
    return out


def rank_states(chunks: list[tuple[list[State], dict[State, int]]]) -> list[State]:
    """The state at each border of a text, from its beginning to its end, by the chunks' (entries, matrix) in order."""
    forward = [{BEGIN}]
    for entries, matrix in chunks:
        held = sum(1 << i for i, e in enumerate(entries) if e in forward[-1])
        forward.append({s for s, bits in matrix.items() if bits & held})
    now = {s for s in forward[-1] if s[1] == 0}
    out = []
    for (entries, matrix), ahead in zip(reversed(chunks), reversed(forward[:-1])):
        if len(now) != 1:
            raise AssertionError(f"{len(now)} ways through the text")
        out.append(*now)
        bits = matrix[out[-1]]
        now = {e for i, e in enumerate(entries) if bits >> i & 1 and e in ahead}
    return [BEGIN, *reversed(out)]


def rank_trace(text: str, start: int, end: int, enter: State, leave: State, pieces: Ranked) -> list[str]:
    """The pieces that begin in the chunk, between two known states. An ``enter`` of BEGIN fits all."""
    first = text[start - enter[0] : start + enter[1]]
    back: dict = {}
    reach(text, start, end, [(start + enter[1], first, 1)], pieces, back)
    at = (text[end - leave[0] : end + leave[1]], end + leave[1])
    out = []
    while at[1] - len(at[0]) >= start and at[0]:
        out.append(at[0])
        at = back[at]
    return out[::-1]
