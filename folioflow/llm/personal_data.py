"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Seeds are the base entities. Around every identifier-like string (seed or not) of the
corpus its lexical patterns are taken: the two words ahead of it, the word ahead, and the
word ahead with the word behind, each with its shape and without, so that what emails or
phones teach finds identifiers of other shapes. Patterns and instances make a bipartite graph of
weighted edges, summed over the whole corpus. Spark scores it in rounds, until nothing
changes: a pattern by the share of its occurrences whose instances are trusted, if it has
enough distinct trusted ones; an instance by its best pattern. The patterns that end
with a high score discover the rest.

Scores are hundredths, rounded down, and a round never lowers one: so the rounds end, by
themselves. Joins of the graph are salted on their far side, as one pattern or one
instance may hold a large share of all edges.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import batch_of, map_arrow, sha256, slices, texts
from folioflow.llm.spans import Span, written
from folioflow.runtime import forget, stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "context")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBERS = bytes(c for c in range(256) if c not in b"0123456789")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: An instance is a string without blanks that looks like an identifier: it has a digit, a mark within, or a capital behind another letter.
_INSTANCE = re.compile(r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._:/@+-])[A-Za-z0-9]++(?:[._:/@+-]++[A-Za-z0-9]++)*+")
_LOOKS = re.compile(r"[0-9]|[A-Za-z][._:/@+-]|[A-Za-z][A-Z]")
_MAY_LOOK = re.compile(rb"[0-9@]|[A-Za-z][._:/+-]++[A-Za-z]|[A-Za-z][A-Z]")
#: Shorter strings (initials, ordinals, list numbers) name nobody.
MIN_LENGTH = 5
#: Code points on each side in which the words of a pattern are looked for.
CONTEXT = 80
#: A pattern must have this many distinct trusted instances, and this share of its occurrences trusted.
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.6
#: Parts into which the far side of a graph join is spread.
SALTS = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        m = _EMAIL_DOMAIN.match(text, at)
        if m:
            s = at
            while s > last and text[s - 1] in _EMAIL_LOCAL:
                s -= 1
            if s < at:
                out.append(("email", s, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m[0]) if len(m[0]) <= 40 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(m[0]) - len(m[0].translate(_DROP_DIGITS)) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


_DROP_DIGITS = {ord(c): None for c in "0123456789"}


def worth_scanning(raw: bytes) -> bool:
    """Whether a base span or an instance may be there; never wrongly false."""
    return _MAY_LOOK.search(raw) is not None


def shape(s: str) -> str:
    """Letters and digits in runs: 'AB-123456' is 'a-9'."""
    return re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", s))


def _word(w: str | None) -> str:
    return re.sub(r"[0-9]+", "9", (w or "").strip("\"'.,;!?()[]<>*#$%&|").lower())


def instances(text: str, base: list[Span]) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is a seed): the base spans, and identifier-like strings apart from them."""
    out = [(s, e, True) for _, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    for m in _INSTANCE.finditer(text):
        s, e = m.span()
        if e - s >= MIN_LENGTH and _LOOKS.search(text, s, e):
            at = bisect_left(taken, (e,))  # base spans of one kind never overlap, so few reach back over this one
            if not any(y > s for _, y in taken[max(0, at - len(BASE_KINDS)) : at]):
                out.append((s, e, False))
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around start..end, each with the shape and without; words are bare of marks, numbers are 9."""
    ahead = text[max(0, start - CONTEXT) : start].split()
    behind = text[end : end + CONTEXT].split(maxsplit=1)
    two, one = (_word(w) for w in ["", "", *ahead][-2:])
    kind = shape(text[start:end])
    out = []
    if one:
        around = [f"L {two} {one} _", f"W {one} _"]
        if behind:
            around.append(f"B {one} _ {_word(behind[0])}")
        for x in around:
            out += [f"{x} {kind}", f"any {x}"]
    return out


def pattern_graph(docs: DataFrame) -> DataFrame:
    """(pattern, instance, seed, n): how often each instance stands in each pattern, over all of ``docs``."""

    def run(batches):
        sums: dict[tuple[str, str], list] = {}

        def rows():
            keys = list(sums)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([sums[k][0] for k in keys], pa.bool_()), pa.array([sums[k][1] for k in keys], pa.int64())], ["pattern", "instance", "seed", "n"])

        for _, raws in slices(batches):
            for raw in raws:
                if raw and worth_scanning(raw):
                    text = raw.decode()
                    for s, e, seed in instances(text, base_spans(text)):
                        for p in patterns(text, s, e):
                            x = sums.setdefault((p, text[s:e]), [seed, 0])
                            x[0] |= seed
                            x[1] += 1
            if len(sums) > 200_000:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    edges = map_arrow(texts(docs), run, "pattern string, instance string, seed boolean, n long")
    return edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))


def confident_patterns(docs: DataFrame) -> DataFrame:
    """(pattern, confidence) of the patterns above both thresholds when a round changes nothing any more."""
    edges = stored(pattern_graph(docs), "pattern-graph")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    by_instance = edges.withColumn("salt", F.pmod(F.xxhash64("pattern"), F.lit(SALTS)).cast("int"))
    by_pattern = edges.filter("not seed").withColumn("salt", F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int"))
    found = None
    while True:
        if found is None:
            scored = edges.withColumn("trust", F.when(F.col("seed"), 100).otherwise(0))
        else:
            # what a round trusts beyond the seeds: instances by their best pattern
            trust = by_pattern.join(found.withColumn("salt", salts), ["pattern", "salt"]).groupBy("instance").agg(F.max("confidence").alias("learned"))
            scored = by_instance.join(trust.withColumn("salt", salts), ["instance", "salt"], "left").withColumn("trust", F.when(F.col("seed"), 100).otherwise(F.coalesce("learned", F.lit(0))))
        best = scored.groupBy("pattern").agg(F.floor(F.sum(F.col("n") * F.col("trust")) / F.sum("n")).cast("int").alias("confidence"), F.count_if(F.col("trust") >= 100 * MIN_CONFIDENCE).alias("support"))
        now = stored(best.filter(f"confidence >= {100 * MIN_CONFIDENCE} and support >= {MIN_SUPPORT}").select("pattern", "confidence"), "patterns")
        if found is not None:
            same = not now.join(found, ["pattern", "confidence"], "left_anti").head(1)  # scores only grow, so nothing is lost
            forget(found)
            if same:
                forget(edges)
                return now
        found = now


#: Patterns held in one broadcast; more of them take a pass each over the documents' instances.
PATTERNS_IN_BLOCK = 200_000
_ARROW = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE_KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_context", pa.int64()), ("n_spans", pa.int64())])
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_context long, n_spans long"


def find_personal_data(docs: DataFrame, block: int = PATTERNS_IN_BLOCK) -> DataFrame:
    """Counts by kind, the digest of base spans, and all spans of each row of ``docs``.

    Null and empty texts have none: the digest of the empty string, and empty spans.
    Repeated rows are scanned each, alike, and count as often in the graph; spans that
    begin together go by their kind's place, then their end. Texts are scanned whole,
    however long, each in memory as one slice. A null doc_id stays null, an empty table
    gives no rows, other columns are not read. Confident patterns are broadcast in blocks of ``block``; a row passes all blocks
    in turn, and its added spans are those of any.
    """
    sc = docs.sparkSession.sparkContext
    blocks, now = [], set()
    for r in confident_patterns(docs).select("pattern").toLocalIterator():
        now.add(r["pattern"])
        if len(now) == block:
            blocks.append(sc.broadcast(now))
            now = set()
    if now or not blocks:
        blocks.append(sc.broadcast(now))
    carried = texts(docs).withColumn("added", F.array().cast("array<long>"))

    def step(known):
        def run(batches):
            keep = known.value
            for batch, raws in slices(batches):
                added = []
                for raw, had in zip(raws, batch.column(2).to_pylist()):
                    if raw and keep and worth_scanning(raw):
                        text = raw.decode()
                        for s, e, seed in instances(text, base_spans(text)):
                            if not seed and not keep.isdisjoint(patterns(text, s, e)):
                                had += [s, e]
                    added.append(had)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(added, pa.list_(pa.int64()))], ["doc_id", "text", "added"])

        return run

    def finish(known):
        def run(batches):
            keep = known.value
            for batch, raws in slices(batches):
                rows = []
                for raw, had in zip(raws, batch.column(2).to_pylist()):
                    base: list[Span] = []
                    more = set(zip(had[::2], had[1::2]))
                    if raw and worth_scanning(raw):
                        text = raw.decode()
                        base = base_spans(text)
                        if keep:
                            more |= {(s, e) for s, e, seed in instances(text, base) if not seed and not keep.isdisjoint(patterns(text, s, e))}
                    rows.append((*[sum(k == b[0] for b in base) for k in BASE_KINDS], sha256(written(base, KINDS)), written([*base, *(("context", s, e) for s, e in more)], KINDS), len(more), len(base) + len(more)))
                yield batch_of(_ARROW, [batch.column(0), *zip(*rows)])

        return run

    for known in blocks[:-1]:
        carried = map_arrow(carried, step(known), carried.schema)
    return map_arrow(carried, finish(blocks[-1]), SCHEMA)
