"""Secret scans: base patterns, and zstandard novelty of strings in sensitive contexts.

A candidate is what a base pattern found (of an assignment, its value), or a string
without blanks near a sensitive word. Two dictionaries prime the compressor: the
identifiers that the corpus shows around sensitive words and base spans, counted over all
documents, and the text around the candidate, both without any candidate or base span, as
a secret that primes the compressor would hide itself. What the candidate adds to a frame
that both prime, in bytes, is its novelty. A string that hardly compresses is reported as
novel, one that a base pattern found too, besides its base span; words, paths,
placeholders and names that the dictionaries hold are not.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import batch_of, map_arrow, sha256, slices, texts
from folioflow.llm.spans import Span, free, written

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HEX_RUN = b"h" * 32
_TO_HEX = bytes(ord("h") if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Sensitive words of the method, and how far ahead of a candidate they may end, in code points.
_SENSITIVE_BYTES = (*_ASSIGN_WORDS, b"credential", b"private", b"bearer", b"auth", b"access", b"-key", b"_key", b"pwd")
_SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api[_-]?key|credential|private[_ -]?key|access[_-]?key|bearer|authorization|auth[_-]?key", re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]+")
#: Dates, times and email addresses are no secrets, however little they compress, where they are the whole of a string.
_TIME = r"[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
_DATE = re.compile(rf"(?<![A-Za-z0-9])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:T(?:{_TIME}|[0-9]{{2}}))?|[0-9]{{8}}T[0-9]{{6}}(?:[.][0-9]+)?Z?|{_TIME})(?![A-Za-z0-9])")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}")
_HOST = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9.-])")
#: What stands ahead of a string within a URL, from its authority on; or ahead of user info without a scheme.
_IN_URL = re.compile(r"://([^\s\"'<>]*)$")
_USER = re.compile(r"(?:^|[^A-Za-z0-9._-])([A-Za-z0-9._-]+):$")
_LABELS = frozenset("mailto email e-mail mail contact from to cc bcc user username login account".split())
REACH = 40
#: A candidate that no base pattern found has this many characters at least, with a digit and a letter.
MIN_LENGTH = 12
#: Marginal compressed bytes to a character of the candidate, from which it is novel. Random strings take 1, as they don't compress at all; the rest is for a known prefix.
NOVELTY = 0.85
#: Code points of context on each side.
CONTEXT = 256
#: Identifiers that prime the compressor, 31 bytes each at most: what bounds the broadcast and a candidate's cost. Those that most texts show come first.
DICTIONARY_WORDS = 4096
#: Distinct texts that show an identifier before it is one.
LEAST_TEXTS = 2
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,30}")
_WORD_EDGE = re.compile(r"[A-Za-z0-9_]{2}")


def base_spans(text: str) -> list[Span]:
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def worth_scanning(raw: bytes) -> bool:
    """Whether a base pattern or a sensitive word may be there; never wrongly false."""
    low = raw.lower()
    return any(w in low for w in _SENSITIVE_BYTES) or b"AKIA" in raw or _HEX_RUN in raw.translate(_TO_HEX)


def plain(text: str, start: int, end: int) -> bool:
    """Whether the whole of the string is an email address, or lies in a date or time: colons part these."""
    return bool(_EMAIL.fullmatch(text, start, end)) or any(m.start() <= start and end <= m.end() for m in _DATE.finditer(text, max(0, start - 40), min(len(text), end + 40)))


def cut(text: str, start: int, end: int, marks: str) -> list[tuple[int, int]]:
    """The parts of start..end between any of ``marks``; an equals sign at a part's end, as base64 has it, stays."""
    return [m.span() for m in re.compile(rf"(?:[^{marks}=]|=(?=[{marks}=]|$))+" if "&" in marks else rf"[^{marks}]+").finditer(text, start, end)]


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """What of a string may be a secret: of a URL the user info, the steps of its path and the values of its query, of an address with a password that; else the whole.

    Hosts are none. The string may begin anywhere in a URL, as colons and question marks part it.
    """
    before = text[max(0, start - CONTEXT) : start]
    url = _IN_URL.search(before)
    authority = start
    if text.startswith("//", start) and (before.endswith(":") or _HOST.match(text, start + 2, end)):
        authority = start + 2
    elif before.endswith("?") or url and "?" in url[1]:
        return cut(text, start, end, "&;#")
    elif url and re.search("[/#]", url[1]):
        return cut(text, start, end, "/&;#")
    elif not url:
        user = _USER.search(before)
        at = text.rfind("@", start, end)
        if user and user[1].lower() not in _LABELS and at > start and _HOST.match(text, at + 1, end):
            return [(start, at)]
        return [(start, end)]
    path = next((i for i in range(authority, end) if text[i] in "/#"), end)
    at = text.rfind("@", authority, path)
    info = [(authority, at)] if at > authority else [(authority, path)] if authority == start and before[-1:] == ":" and text[end : end + 1] == ":" else []
    return info + cut(text, path, end, "/&;#")


def values(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """What of each base span is the secret: an assignment's value, the whole of others; each place once."""
    return sorted({_ASSIGN.match(text, s).span(2) if kind == "assign" else (s, e) for kind, s, e in base})


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """The values of base spans, and strings that begin within REACH of a sensitive word's end, apart from base spans; in order."""
    return sorted({*values(text, base), *near_sensitive(text, base)})


def near_sensitive(text: str, base: list[Span]) -> list[tuple[int, int]]:
    out, last = [], -1
    for m in _SENSITIVE.finditer(text):
        at = max(m.end(), last)
        while at < len(text) and (c := _CANDIDATE.search(text, at, len(text))) and c.start() <= m.end() + REACH:
            at = last = c.end()
            for start, end in parts(text, c.start(), c.end()):
                s = text[start:end]
                start, end = start + len(s) - len(s.lstrip("=.")), end - len(s) + len(s.rstrip(".!=")) if s.rstrip(".!=") else end
                s = text[start:end]
                if len(s) >= MIN_LENGTH and any(x.isdigit() for x in s) and any(x.isalpha() for x in s) and not plain(text, start, end) and free(start, end, base):
                    out.append((start, end))
    return out


def context(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> str:
    """CONTEXT code points on each side of start..end, with ``spans`` (in order) and every repetition of start..end blank."""
    n, own = end - start, text[start:end]
    low, high = max(0, start - CONTEXT - n), min(len(text), end + CONTEXT + n)
    out, at = [], low
    for s, e in spans[bisect_left(spans, low, key=lambda x: x[1]) :]:
        if s >= high:
            break
        if e > at:
            out += [text[at : max(s, at)], " " * (min(e, high) - max(s, at))]
            at = min(e, high)
    around = "".join(out) + text[at:high]
    before, after = around[: start - low].replace(own, " " * n), around[end - low :].replace(own, " " * n)
    return before[-CONTEXT:] + "\n" + after[:CONTEXT]


def merged(found: list[tuple[int, int]], base: list[Span]) -> list[tuple[int, int]]:
    """Candidates and base spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted([*found, *((s, e) for _, s, e in base)]):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def novelty(text: str, start: int, end: int, identifiers: bytes, spans: list[tuple[int, int]]) -> float:
    """Compressed bytes that the candidate adds, to each of its characters, after the identifiers and the text around it without ``spans``."""
    import zstandard

    around = context(text, start, end, spans).encode()
    known, own = identifiers + b"\n" + around, text[start:end].encode()
    how = zstandard.ZstdCompressionParameters.from_level(9, dict_size=len(known), source_size=len(own), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    primed = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    return (len(primed.compress(own)) - len(primed.compress(b""))) / (end - start)


def context_identifiers(text: str) -> set[str]:
    """The identifiers within CONTEXT of the text's sensitive words, base spans and candidates, without any that a candidate or base span of it holds."""
    base = base_spans(text)
    found = candidates(text, base)
    spans = merged(found, base)
    centres = sorted([*spans, *(m.span() for m in _SENSITIVE.finditer(text))])
    hidden = {w for s, e in spans for w in _IDENTIFIER.findall(text[s:e])}
    out, at = set(), 0
    for s, e in centres:
        low, high = max(at, s - CONTEXT), min(len(text), e + CONTEXT)
        for m in _IDENTIFIER.finditer(text, low, high):
            i = bisect_right(spans, m.start(), key=lambda x: x[0])
            apart = (i == 0 or spans[i - 1][1] <= m.start()) and (i == len(spans) or spans[i][0] >= m.end())
            # a word that the context's edge cuts is not one
            cut = m.start() == low > 0 and _WORD_EDGE.match(text, low - 1) or m.end() == high and _WORD_EDGE.match(text, high - 1)
            if apart and not cut:
                out.add(m[0])
        at = max(at, e)
    return out - hidden


def identifier_dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> bytes:
    """The ``most`` identifiers that most texts have around sensitive words, base spans and candidates, in all of ``docs``, the most frequent last, where zstandard reaches them cheapest.

    Equal texts count once, and one text alone teaches nothing. Candidates and base spans
    are not counted. Identifiers that as many texts show go by their name.
    """

    def run(batches):
        for _, raws in slices(batches):
            found: dict[bytes, list[str]] = {}
            for raw in raws:
                if raw and worth_scanning(raw) and (words := context_identifiers(raw.decode())):
                    found[hashlib.sha256(raw).digest()[:16]] = sorted(words)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.string()))], ["mark", "words"])

    once = map_arrow(texts(docs), run, "mark binary, words array<string>").dropDuplicates(["mark"])
    top = once.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(f"n >= {LEAST_TEXTS}").orderBy(F.desc("n"), "word").limit(most).collect()
    return " ".join([r["word"] for r in reversed(top)] + ["password secret token api_key access_key private_key client_secret authorization bearer example changeme placeholder your_password_here"]).encode()


def spans_of(text: str, identifiers: bytes) -> tuple[list[Span], list[Span]]:
    """(base, added) spans."""
    base = base_spans(text)
    found = candidates(text, base)
    spans = merged(found, base)
    return base, [("novel", s, e) for s, e in found if novelty(text, s, e, identifiers, spans) >= NOVELTY]


_ARROW = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE_KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64())])
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of base spans, and all spans of each row of ``docs``.

    Null and empty texts have none: the digest of the empty string, and empty spans.
    Repeated rows are scanned each, alike, but teach the dictionary once; spans that begin
    together go by their kind's place, then their end. Texts are scanned whole, however
    long, each in memory as one slice. A null doc_id stays null, an empty table gives no
    rows, and other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(docs))

    def run(batches):
        for batch, raws in slices(batches):
            rows = []
            for raw in raws:
                base, more = spans_of(raw.decode(), known.value) if raw and worth_scanning(raw) else ([], [])
                rows.append((*[sum(k == b[0] for b in base) for k in BASE_KINDS], sha256(written(base, KINDS)), written(base + more, KINDS), len(more)))
            yield batch_of(_ARROW, [batch.column(0), *zip(*rows)])

    return map_arrow(texts(docs), run, SCHEMA)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by its first kind's mark; an assignment keeps its name."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if k == "assign" and (m := _ASSIGN.match(text, s)):
            s = m.start(2)
        if s < at:
            if e <= at:
                continue
            s = at
            out.append("")
        else:
            out.append(text[at:s] + f"[{k} removed]")
        at = e
    return "".join(out) + text[at:]


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced in its text, and n_chars, where there is such a column, counted anew. No row goes.

    Null, empty and clean texts stay as they are, as do all other columns, of any name and
    type. Repeated rows are changed alike, of spans that overlap the first goes whole, a
    null doc_id is kept; an empty table gives no rows. Texts are taken whole, however long.
    """
    known = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(docs))
    schema = docs.schema

    def run(batches):
        for batch, raws in slices(batches):
            at = batch.schema.get_field_index("text")
            new = []
            for raw in raws:
                if raw and worth_scanning(raw):
                    text = raw.decode()
                    base, more = spans_of(text, known.value)
                    new.append(redacted(text, base + more) if base or more else text)
                else:
                    new.append(raw.decode() if raw is not None else None)
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            chars = batch.schema.get_field_index("n_chars")
            if chars >= 0 and pa.types.is_integer(batch.schema.field(chars).type):
                changed = pc.not_equal(columns[at], batch.column(at)).fill_null(False)
                columns[chars] = pc.if_else(changed, pc.utf8_length(columns[at]).cast(batch.schema.field(chars).type), batch.column(chars))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, run, schema)
