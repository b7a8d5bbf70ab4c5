"""Markdown of layout documents: pages are rendered in tasks, documents are ordered aggregations of them."""

from __future__ import annotations

import html as _html
import json
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.functions.latex import math_string
from folioflow.functions.text import by_slices
from folioflow.operators.tables import tables_markdown
from folioflow.runtime import ship


@dataclass(frozen=True)
class RenderOptions:
    discarded: bool = False
    headers: bool = False
    footers: bool = False
    page_numbers: bool = False
    footnotes: bool = True
    asides: bool = True
    images: bool = True
    source_links: bool = True
    unicode_math: bool = False
    #: None, "html" or "rag": whether and how image descriptions show.
    understanding: str | None = None
    #: "long" or "short": which description comes first.
    detail: str = "long"
    #: "blank", "repeat" or "keep_html".
    multicell: str = "keep_html"
    image_prefix: str | None = None


FOR_RAG = RenderOptions(images=False, source_links=False, unicode_math=True, understanding="rag", multicell="repeat")
FOR_HTML = RenderOptions(unicode_math=True, understanding="html")

_HIDDEN_UNLESS = {"header": "headers", "header_image": "headers", "footer": "footers", "footer_image": "footers", "page_number": "page_numbers", "page_footnote": "footnotes", "aside_text": "asides"}
_TITLES = {"title": 2, "doc_title": 1, "paragraph_title": 2}
_TEXTS = frozenset(
    "abstract algorithm_caption aside_text caption chart_caption chart_footnote code_caption code_footnote footer footnote "
    "header image_caption image_footnote page_footnote page_number phonetic ref_text table_caption table_footnote text vertical_text".split()
)
_MEDIA = frozenset("image image_body chart chart_body seal header_image footer_image".split())
NO_TABLE = "<div>警告: HTMLのないテーブル</div>"


def image_place(path: str) -> str:
    return path if "://" in path or path.startswith(("/", "images/")) else "images/" + path


def _content(span: dict) -> str:
    c = span.get("content")
    return "".join(c) if isinstance(c, list) else c or ""


def _joined(parts) -> str:
    return "\n\n".join(filter(None, parts)).strip()


class Renderer:
    """Renders one tree of dicts; ``opt`` decides what shows."""

    def __init__(self, opt: RenderOptions = RenderOptions()):
        self.opt = opt
        self.by_type = dict.fromkeys(_TEXTS, self.text) | dict.fromkeys(_TITLES, self.title) | dict.fromkeys(_MEDIA, self.media)
        self.by_type |= dict.fromkeys(("list", "index"), self.items) | dict.fromkeys(("code", "algorithm", "code_body"), self.code)
        self.by_type |= dict.fromkeys(("interline_equation", "equation", "formula_number"), self.equation) | dict.fromkeys(("table", "table_body"), self.table)

    # spans and lines

    def math(self, text: str, display: bool) -> str:
        return math_string(text, self.opt.unicode_math, display)

    def span(self, s: dict) -> str:
        kind, text, path = s.get("type"), _content(s), s.get("image_path")
        picture = f"![]({image_place(path)})" if path else ""
        if kind in ("inline_equation", "equation"):
            return self.math(text, False)
        if kind == "interline_equation":
            return self.math(text, True) if text else picture
        if kind in ("image", "chart", "seal") and path:
            return picture
        return s.get("html") or text if kind == "table" else text

    def line(self, line: dict) -> str:
        return "".join(map(self.span, line.get("spans") or ())).strip()

    def lines(self, b: dict) -> list[str]:
        return [x for x in map(self.line, b.get("lines") or ()) if x]

    # blocks

    def block(self, b: dict) -> str:
        kind = b.get("type")
        flag = _HIDDEN_UNLESS.get(kind)
        if flag and not getattr(self.opt, flag):
            return ""
        return self.by_type.get(kind, self.other)(b)

    def text(self, b: dict) -> str:
        return "\n".join(self.lines(b)).strip()

    def other(self, b: dict) -> str:
        return _joined([self.text(b), *self.children(b, ())])

    def children(self, b: dict, but: tuple[str, ...]) -> list[str]:
        return [self.block(c) for c in b.get("blocks") or () if c.get("type") not in but]

    def title(self, b: dict) -> str:
        level = b.get("level")
        level = _TITLES[b["type"]] if level is None else min(6, max(1, level))
        words = self.text(b)
        return "#" * level + " " + words if words else ""

    def items(self, b: dict) -> str:
        found = [self.text(c) or self.block(c).strip() for c in b.get("blocks") or ()]
        return "\n".join("- " + x for x in (list(filter(None, found)) or self.lines(b)))

    def with_link(self, text: str, b: dict) -> str:
        path = first(b, "image_path") if self.opt.source_links else None
        return f"{text}\n{source_link(path)}" if path else text

    def code(self, b: dict) -> str:
        inner = next((c for c in b.get("blocks") or () if c.get("type") == "code_body"), b)
        fence = "```"
        text = f"{fence}{b.get('guess_lang') or ''}\n{self.text(inner) or self.text(b)}\n{fence}"
        return _joined([self.with_link(text.strip(), b), *self.children(b, ("code_body",))])

    def equation(self, b: dict) -> str:
        text = self.text(b)
        if text:
            return self.with_link(self.math(text, True), b)
        path = first(b, "image_path")
        return f"![equation]({path})" if path else ""

    def media(self, b: dict) -> str:
        path, known = first(b, "image_path"), first(b, "image_understanding")
        parts: list[str] = []
        if self.opt.understanding == "html":
            if path and self.opt.images:
                parts.append(f"![]({image_place(path)})")
            parts += filter(None, [self.described_html(known)])
        elif self.opt.understanding == "rag":
            parts += filter(None, [self.described_rag(known, path)])
        parts += self.children(b, ("image_body", "chart_body"))
        return _joined(parts or [self.text(b)])

    def table(self, b: dict) -> str:
        found, path = first(b, "html"), first(b, "image_path")
        if found is None:
            shown = NO_TABLE
        else:
            shown = self.with_link(tables_markdown(found, self.opt.multicell, self.opt.unicode_math), b)
            if self.opt.image_prefix:
                shown = f"<table_summary>\nimage_name='{self.opt.image_prefix}/{path}'\n{shown}</table_summary>\n"
        return _joined([shown, *self.children(b, ("table_body",))])

    # image descriptions

    def description(self, u: dict) -> str | None:
        order = ("long_description", "short_description")
        return next(filter(None, (u.get(k) for k in (order if self.opt.detail == "long" else order[::-1]))), None)

    def described_rag(self, u: dict | None, path: str | None) -> str:
        what = self.description(u) if u else None
        if not what:
            return ""
        rows = ["<image_summary>", f"kind={u.get('kind')}"]
        if self.opt.image_prefix:
            rows.append(f"image_name='{self.opt.image_prefix}/{path}'")
        if u.get("keywords"):
            rows.append('keywords="%s"' % ", ".join(u["keywords"]))
        return "\n".join([*rows, f"description: {what}", "</image_summary>"])

    def described_html(self, u: dict | None) -> str:
        what = self.description(u) if u else None
        if not what:
            return ""
        return '<div class="image-understanding image-understanding--%s"><strong>%s 画像:</strong> %s</div>' % (self.opt.detail, u.get("kind"), _html.escape(what))

    def page(self, page: dict) -> str:
        listed = [*(page.get("para_blocks") or ()), *((page.get("discarded_blocks") or ()) if self.opt.discarded else ())]
        return _joined(map(self.block, listed))


def source_link(path: str) -> str:
    return '<span class="{0}-row"><a href="{1}" class="{0}">👁️‍🗨️</a></span>'.format("source-image-link", image_place(path))


def first(b: dict, field: str):
    """The first non-empty ``field`` of a span, own lines ahead of children; None if there is none."""
    todo = [b]
    while todo:
        now = todo.pop()
        for line in now.get("lines") or ():
            for s in line.get("spans") or ():
                if s.get(field):
                    return s[field]
        todo.extend(reversed(now.get("blocks") or ()))
    return None


def page_markdowns(pages: DataFrame, options: dict[str, RenderOptions], column: str = "page") -> DataFrame:
    """(doc_id, page_pos, and a text for each of ``options``, by its name) of pages held as VARIANT in ``column``; each page is opened once."""
    ship(pages.sparkSession)
    makers = {name: Renderer(o) for name, o in options.items()}

    def render(x: str) -> dict:
        page = json.loads(x)
        return {name: r.page(page) for name, r in makers.items()}

    made = by_slices(render, pa.struct([(name, pa.string()) for name in options]))(F.to_json(F.col(column)))
    return pages.select("doc_id", "page_pos", made.alias("__made")).select("doc_id", "page_pos", *[F.col("__made")[name].alias(name) for name in options])


def page_markdown(pages: DataFrame, options: RenderOptions = RenderOptions(), column: str = "page") -> DataFrame:
    """(doc_id, page_pos, markdown) of pages held as VARIANT in ``column``."""
    return page_markdowns(pages, {"markdown": options}, column)


def document_markdown(page_rows: DataFrame, names: tuple[str, ...] = ("markdown",)) -> DataFrame:
    """(doc_id, and each of ``names``): non-empty pages in order, a blank line between."""
    pages = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("page_pos", c)))), lambda p: p[c])
    return page_rows.groupBy("doc_id").agg(*[F.array_join(pages(c), "\n\n").alias(c) for c in names])


def with_pdf_link(markdown: Column, link: Column) -> Column:
    """A paragraph that links to the original ahead of the text."""
    return F.concat_ws("\n\n", F.concat(F.lit("[original PDF]("), link, F.lit(")")), markdown)


def markdown_to_html(markdown: DataFrame, convert=None) -> DataFrame:
    """Adds ``html`` by an injected converter, with mathematics marked for display; null without one or where it fails."""
    from folioflow.functions.text import eq_to_mathjax

    if convert is None:
        return markdown.withColumn("html", F.lit(None).cast("string"))

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else convert(x)
            except Exception:  # a document that can't be converted has no HTML
                return None

        return s.map(one)

    return markdown.withColumn("html", eq_to_mathjax(run("markdown")))


#: What stands in the head of each page.
PAGE_HEADER = """<style>
body { margin: 2rem auto; max-width: 54rem; padding: 0 1rem; font-family: sans-serif; line-height: 1.6; color: #222; }
img { max-width: 100%; height: auto; }
table { border-collapse: collapse; display: block; overflow-x: auto; margin: 1rem 0; }
th, td { border: 1px solid #bbb; padding: 0.25rem 0.6rem; vertical-align: top; }
pre { background: #f4f4f4; padding: 0.8rem; overflow-x: auto; }
.image-understanding { border-left: 3px solid #8ab; margin: 0.6rem 0; padding: 0.3rem 0.8rem; background: #f2f6fa; }
.source-image-link-row { font-size: 0.8rem; }
.source-image-link { text-decoration: none; }
</style>
"""


def pandoc(header: str | None = PAGE_HEADER):
    """A converter for ``markdown_to_html`` by the pandoc program: a whole page, dollars as mathematics; None where there is no pandoc or it fails."""

    def convert(markdown: str) -> str | None:
        import shutil
        import subprocess
        import tempfile

        program = shutil.which("pandoc")
        if program is None:
            return None
        with tempfile.NamedTemporaryFile("w", suffix=".html", encoding="utf-8") as head:  # of this process alone, gone at the end
            head.write(header or "")
            head.flush()
            more = ["--include-in-header", head.name] if header else []
            got = subprocess.run([program, "--standalone", "--mathjax", "--from", "markdown+tex_math_dollars", *more], input=markdown, capture_output=True, text=True, encoding="utf-8")
        return got.stdout if got.returncode == 0 else None

    return convert


def with_prefix(options: RenderOptions, prefix: str) -> RenderOptions:
    return replace(options, image_prefix=prefix)
