"""Text functions of layout documents as Column expressions.

White space is Unicode-aware, which Java's plain ``\\s`` and Spark's ``trim`` are not.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: What the layout's own language strips: the separators that Unicode knows, and controls 1C-1F.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
MAX_CONTEXT, MIN_CONTEXT = 300, 200
ELLIPSIS = "…"

TITLE_TYPES = ("title", "doc_title", "paragraph_title")
CONTEXT_TYPES = ("text", "abstract", "list", "index", "ref_text", "aside_text", "page_footnote")
IMAGE_TYPES = ("image", "chart", "seal")

# An unpaired surrogate escape of JSON text, behind an even number of backslashes.
_LONE = r"(?<!\\)((?:\\\\)*)(?:\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_lone_surrogates(raw_json: Column | str) -> Column:
    """JSON text with each unpaired surrogate escape replaced by that of U+FFFD, keys included; twice, as matches may touch.

    Text without any surrogate escape never meets the pattern.
    """
    fix = lambda c: F.regexp_replace(c, _LONE, r"$1\\uFFFD")
    raw = _col(raw_json)
    return F.when(raw.contains("\\uD") | raw.contains("\\ud"), fix(fix(raw))).otherwise(raw)


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), f"^{SPACE}+", ""), f"{SPACE}+$", "")


def collapse_space(c: Column | str) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def without_space(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"{SPACE}+", "")


def by_slices(fn: Callable, kind: pa.DataType = pa.string(), most: int = 1 << 20):
    """An Arrow function of one text column; null stays null. A batch is worked on in slices of some ``most`` bytes, so that its texts are never all Python objects at once."""

    @F.arrow_udf(from_arrow_type(kind))
    def run(a: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(a), 0).cast(pa.int64())).to_pylist()
        parts, at = [], 0
        while at < len(a):
            to, done = at + 1, ends[at - 1] if at else 0
            while to < len(a) and ends[to] - done <= most and to - at < 4096:
                to += 1
            parts.append(pa.array([None if x is None else fn(x) for x in a.slice(at, to - at).to_pylist()], kind))
            at = to
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


_BLANKS = re.compile("[ \t]+")


def normalize(c: Column | str, unicode_forms: bool = True) -> Column:
    """NFKC, ideographic blanks and tabs as blanks, runs of them as one, stripped.

    Spark has no NFKC, so one Arrow function does all of it. ASCII needs none, so
    ``unicode_forms=False`` keeps plain-ASCII columns inside code generation.
    """
    if unicode_forms:
        fold, blanks = unicodedata.normalize, _BLANKS  # nothing of this package is named in the workers

        def one(x: str) -> str:
            return blanks.sub(" ", x if x.isascii() else fold("NFKC", x).replace("\u3000", " ")).strip()

        return by_slices(one)(_col(c))
    return strip(F.regexp_replace(F.replace(_col(c), F.lit("\u3000"), F.lit(" ")), r"[ \t]+", " "))


def bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(c)`` with ``c`` worked out once, however often ``fn`` names it."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def truncate(c: Column | str, most: int = MAX_CONTEXT) -> Column:
    """At most ``most`` code points; longer text is cut one earlier, stripped at its end, and gets an ellipsis."""
    c = _col(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most - 1), f"{SPACE}+$", ""), F.lit(ELLIPSIS)))


def first_texts(texts: Column | str, least: int = MIN_CONTEXT) -> Column:
    """The non-empty texts, in order, up to the one with which their lengths reach ``least``, a line each, truncated; null if none.

    ``texts`` is an array of strings.
    """
    texts = F.filter(_col(texts), lambda t: t.isNotNull() & (t != ""))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("size"))
    step = lambda acc, t: F.when(acc["size"] >= least, acc).otherwise(F.struct(F.concat(acc["kept"], F.array(t)).alias("kept"), (acc["size"] + F.length(t)).cast("int").alias("size")))
    return F.aggregate(texts, start, step, lambda acc: F.when(F.size(acc["kept"]) > 0, truncate(F.array_join(acc["kept"], "\n"))))


def title_level(kind: Column | str, level: Column | str) -> Column:
    """1..6 for titles, by default 1 for that of the document and 2 for others; null for other blocks."""
    kind, level = _col(kind), _col(level)
    default = F.when(kind == "doc_title", 1).otherwise(2)
    given = F.when(level.isNotNull(), F.greatest(F.least(level, F.lit(6)), F.lit(1)))  # least() would skip a null
    return F.when(kind.isin(*TITLE_TYPES), F.coalesce(given, default))


def non_empty(*choices: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in choices])


def rendered_image_path(path: Column | str) -> Column:
    """Unchanged when absolute, a URL or already below images/; else below it."""
    path = _col(path)
    return F.when(path.contains("://") | path.startswith("/") | path.startswith("images/"), path).otherwise(F.concat(F.lit("images/"), path))


def image_file(folder: Column | str, path: Column | str) -> Column:
    """Where an image's file lies: its own path if absolute, else below the folder's images."""
    folder, path = _col(folder), _col(path)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/images/"), path))


def pdf_of(layout_file: Column | str) -> Column:
    """<x>/<name> for <x>/__data/<name>/middle.json, else the file's folder."""
    folder = F.regexp_extract(_col(layout_file), r"^(.*)/[^/]*$", 1)
    return F.when(folder.rlike("/__data/[^/]+$"), F.regexp_replace(folder, "/__data/([^/]+)$", "/$1")).otherwise(folder)


def item_key(layout_file: Column | str, page: Column | str, block: Column | str, image: Column | str) -> Column:
    """What names an image in gold files; a null block index is the word None."""
    return F.concat_ws("::", _col(layout_file), _col(page).cast("string"), F.coalesce(_col(block).cast("string"), F.lit("None")), _col(image))


def html_escaped(c: Column | str, quotes: bool = True) -> Column:
    out = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_lines(c: Column | str) -> Column:
    """Escaped, with line breaks; null as the empty text."""
    return F.coalesce(F.replace(html_escaped(c), F.lit("\n"), F.lit("<br>")), F.lit(""))


def eq_to_mathjax(html: Column | str) -> Column:
    """Each eq element as a span for inline mathematics."""
    return F.regexp_replace(_col(html), rf"(?is)<eq>{SPACE}*(.*?){SPACE}*</eq>", r'<span class="math inline">\\($1\\)</span>')


def cell_text(c: Column | str) -> Column:
    """A table cell's text: white space collapsed, pipes escaped."""
    return F.replace(collapse_space(c), F.lit("|"), F.lit("\\|"))


def span_count(value: Column | str) -> Column:
    """A rowspan or colspan: 1 unless a positive whole number."""
    return F.greatest(F.coalesce(F.try_to_number(strip(value), F.lit("999999999")).cast("int"), F.lit(1)), F.lit(1))


def data_url(name: Column | str, content: Column | str) -> Column:
    """A data URL of a file's bytes, its type by the name's ending."""
    types = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf"}
    ending = F.lower(F.regexp_extract(_col(name), r"\.([A-Za-z0-9]+)$", 1))
    mime = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), ending), F.lit("application/octet-stream"))
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(_col(content)), r"[\r\n]", ""))
