import json
import sys
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.functions.text import by_slices
from folioflow.operators import tables
from folioflow.operators.rendering import FOR_HTML, FOR_RAG, PAGE_HEADER, RenderOptions, Renderer, document_markdown, markdown_to_html, page_markdown, page_markdowns, pandoc, with_prefix
from folioflow.operators.tables import expanded, table_markdown, tables_markdown
from folioflow.sources import layout


def html_table(*cells):
    """Cells as "tag text" or "tag text|rowspan"; None begins a row."""
    out = "<table><tr>"
    for c in cells:
        if c is None:
            out += "</tr><tr>"
            continue
        (tag, _, text), down = c.partition("|")[0].partition(" "), c.partition("|")[2] or "1"
        out += f'<{tag} rowspan="{down}">{text}</{tag}>'
    return out + "</tr></table>"


def sp(kind, content=None, **kw):
    return {"type": kind, "content": content, **kw}


def bl(kind, *spans, **kw):
    return {"type": kind, "lines": [{"spans": list(spans)}] if spans else [], **kw}


def show(*blocks, opt=RenderOptions()):
    return Renderer(opt).page({"para_blocks": list(blocks)})


def test_plain_and_headed_tables():
    assert table_markdown(html_table("td p", "td q")) == "|  |  |\n| --- | --- |\n| p | q |"
    html = html_table("th Item|2", "th May", None, "th June", None, "td Rent", "td 7")
    assert table_markdown(html) == "| Item | May |\n| --- | --- |\n| Item | June |\n| Rent | 7 |"
    assert table_markdown(html, "blank") == "| Item | May |\n| --- | --- |\n|  | June |\n| Rent | 7 |"
    assert table_markdown(html, "keep_html") is None and tables_markdown(html, "keep_html") == html


def test_table_edges():
    assert expanded([[("a", 2, 1), ("b", 1, 2)], [("c", 1, 2)], []], "repeat") == [["a", "b", "b"], ["a", "c", "c"]]
    assert table_markdown("<table></table>") is None
    assert table_markdown("<table><tr></tr><tr><td>x|y\n z</td></tr></table>") == "|  |\n| --- |\n| x\\|y z |"
    assert "α+ β" in table_markdown("<table><tr><td><eq>\\alpha + \\beta</eq></td></tr></table>", as_unicode=True)
    assert tables_markdown("no table") == "no table"
    assert table_markdown("<table><tr><td>a<td>b</tr></table>") is not None


def test_blocks():
    assert show(bl("title", sp("text", "T")), bl("doc_title", sp("text", "D")), bl("title", sp("text", "L"), level=9)) == "## T\n\n# D\n\n###### L"
    assert show(bl("header", sp("text", "h")), bl("page_footnote", sp("text", "f"))) == "f"
    assert show(bl("list", blocks=[bl("text", sp("text", "a")), bl("text")])) == "- a"
    assert show(bl("list", sp("text", "x"))) == "- x"
    assert show(bl("code", guess_lang="py")) == "```py\n\n```"
    assert show(bl("unknown", sp("text", "u"), blocks=[bl("text", sp("text", "v"))])) == "u\n\nv"
    assert show(bl("interline_equation", sp("interline_equation", "x"))) == "$$\nx\n$$"
    assert show(bl("equation", sp("text", "", image_path="e.png"))) == "![equation](e.png)"
    assert show(bl("text", sp("hyperlink", ["a", "b"]), sp("inline_equation", "y"))) == "ab$y$"
    assert show(bl("table")) == "<div>警告: HTMLのないテーブル</div>"


SUMMARY = {"kind": "diagram", "rag_value": "high", "detail_level": "long", "keywords": ["workflow"], "long_description": "a <b>", "short_description": ""}
IMAGE = bl("image", blocks=[bl("image_body", sp("image", image_path="s.png", image_understanding=SUMMARY)), bl("image_caption", sp("text", "c"))])


def test_media():
    assert show(IMAGE) == "c"
    got = show(IMAGE, opt=FOR_HTML)
    assert "![](images/s.png)" in got and "image-understanding--long" in got and "diagram 画像:</strong> a &lt;b&gt;" in got
    assert show(IMAGE, opt=FOR_RAG) == '<image_summary>\nkind=diagram\nkeywords="workflow"\ndescription: a <b>\n</image_summary>\n\nc'
    assert "image_name='pre/s.png'" in show(IMAGE, opt=with_prefix(FOR_RAG, "pre"))


def test_source_links():
    table = bl("table", blocks=[bl("table_body", sp("table", html=html_table("td A"), image_path="t.png"))])
    assert show(table).count("source-image-link\"") == 1
    assert "source-image" not in show(table, opt=RenderOptions(source_links=False))


def test_documents(spark):
    page = lambda i, *b: {"page_idx": i, "page_size": [1, 1], "para_blocks": list(b), "discarded_blocks": [bl("text", sp("text", "gone"))]}
    raw = json.dumps({"pdf_info": [page(0, bl("title", sp("text", "A"))), page(1), page(2, bl("text", sp("text", "B")))]})
    docs = layout.parsed(spark.createDataFrame([("d", raw), ("e", '{"pdf_info": []}')], "doc_id string, raw string"))
    assert [tuple(r) for r in document_markdown(page_markdown(layout.pages(docs))).collect()] == [("d", "## A\n\nB")]
    both = document_markdown(page_markdown(layout.pages(docs), RenderOptions(discarded=True))).head()[1]
    assert both.count("gone") == 3


def test_html_conversion(spark):
    md = spark.createDataFrame([("d", "# hello"), ("e", "bad")], "doc_id string, markdown string")
    assert [r["html"] for r in markdown_to_html(md).collect()] == [None, None]

    def convert(x):
        if x == "bad":
            raise ValueError(x)
        return f"<p>{x}<eq> y </eq></p>"

    got = {r["doc_id"]: r["html"] for r in markdown_to_html(md, convert).collect()}
    assert got["e"] is None and got["d"].endswith('<span class="math inline">\\(y\\)</span></p>')


def test_pandoc_gets_the_page_header(tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", str(tmp_path))
    assert pandoc()("# hello") is None
    program = tmp_path / "pandoc"
    program.write_text(f"#!{sys.executable}\nimport sys\nhead = open(sys.argv[sys.argv.index('--include-in-header') + 1]).read() if '--include-in-header' in sys.argv else ''\ntext = sys.stdin.read()\nsys.exit(3) if 'bad' in text else print(head + text, end='')\n")
    program.chmod(0o755)
    assert pandoc()("# hello") == PAGE_HEADER + "# hello" and pandoc(None)("x") == "x" and pandoc()("bad") is None


@pytest.mark.parametrize("kind", ["caption", "vertical_text", "algorithm_caption"])
def test_text_types(kind):
    assert show(bl(kind, sp("text", "x"))) == "x"


def test_pages_are_opened_once_for_several_options(spark):
    pages = spark.createDataFrame([(1, 1, '{"para_blocks":[{"type":"title","level":9,"lines":[{"spans":[{"type":"inline_equation","content":"\\\\alpha"}]}]}]}'), (1, 0, "{}"), (2, 0, None)], "doc_id int, page_pos int, raw string").select("doc_id", "page_pos", F.parse_json("raw").alias("page"))
    options = {"plain": RenderOptions(), "html": FOR_HTML}
    made = document_markdown(page_markdowns(pages, options), tuple(options))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1 and "Join" not in plan
    assert sorted(map(tuple, made.collect())) == [(1, "###### $\\alpha$", "###### $α$"), (2, "", "")]


def test_texts_are_worked_on_in_slices_of_some_bytes():
    many = pa.array(["\uff41 b" * 20_000] * 300)
    tracemalloc.start()
    try:
        made = by_slices(lambda x: x.replace("\uff41", "a")).func(many)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(made) == 300 and made[299].as_py() == "a b" * 20_000 and peak < 8 << 20 < many.nbytes // 2
    assert by_slices(str.upper).func(pa.array(["a", None, "", "b"])).to_pylist() == ["A", None, "", "B"]


def test_a_table_is_parsed_once_for_all_modes(monkeypatch):
    seen = []
    monkeypatch.setattr(tables, "_Tree", lambda html, old=tables._Tree: seen.append(html) or old(html))
    html = "a " + html_table("th x|2", "td y", None, "td z") + " b"
    assert tables.tables_in_modes(html, tables.MODES) == tuple(tables_markdown(html, m) for m in tables.MODES)
    assert len(seen) == 4
