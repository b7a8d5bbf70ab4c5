"""Spans of code points as text: kind:start:end, by start and then by kind's place in a list."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

Span = tuple[str, int, int]


def written(spans: Iterable[Span], kinds: Sequence[str]) -> str:
    place = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], place[x[0]], x[2])))


def free(start: int, end: int, spans: Iterable[Span]) -> bool:
    """Whether no span overlaps start..end."""
    return all(end <= s or start >= e for _, s, e in spans)
