import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import latex, text
from folioflow.operators import images, merging
from folioflow.sources import layout


def parsed(spark, *docs):
    raw = [(f"d{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return layout.parsed(spark.createDataFrame(raw, "doc_id string, raw string"))


def span(content=None, **kw):
    return {"type": "text", "content": content, **kw}


def block(kind, *texts, **kw):
    return {"type": kind, "lines": [{"spans": [span(t)]} for t in texts], **kw}


def page(i, para=(), discarded=(), **kw):
    return {"page_idx": i, "page_size": [100, 100], "para_blocks": list(para), "discarded_blocks": list(discarded), **kw}


def test_tree_order_owner_and_depth(spark):
    deep = block("a", "x", index=7, blocks=[block("b", blocks=[block("c", index=9, blocks=[block("d")])]), block("e")])
    rows = layout.blocks(parsed(spark, {"pdf_info": [page(0, [deep, block("f")])]})).orderBy("section", "path").collect()
    assert [(r["type"], list(r["path"]), r["owner_index"]) for r in rows] == [("a", [0], 7), ("b", [0, 0], 7), ("c", [0, 0, 0], 9), ("d", [0, 0, 0, 0], 9), ("e", [0, 1], 7), ("f", [1], None)]


def test_too_deep_is_an_error(spark):
    b = block("x")
    for _ in range(260):
        b = block("x", blocks=[b])
    with pytest.raises(Exception, match="deeper"):
        layout.blocks(parsed(spark, {"pdf_info": [page(0, [b])]})).collect()


def test_union_content_and_texts(spark):
    b = {"type": "text", "lines": [{"spans": [span(["a", "b"]), span("c"), span(None)]}, {"spans": [span(None)]}, {"spans": [span("")]}, {"spans": [span([])]}]}
    got = layout.blocks(parsed(spark, {"pdf_info": [page(0, [b])]})).select(layout.slashed_text(F.col("block")), layout.lined_text(F.col("block"))).head()
    assert tuple(got) == ("abc", "abc\n\n")


def test_distinct_paths_follow_sections(spark):
    im = lambda *p: {"type": "image", "lines": [{"spans": [{"type": "image", "image_path": x} for x in p]}]}
    doc = {"pdf_info": [page(0, [im("a", "b"), im("a", "c")], [im("d")], preproc_blocks=[im("c", "e", "", None)])]}
    rows = layout.image_paths(layout.spans(layout.blocks(parsed(spark, doc)))).orderBy("place").collect()
    assert [r["image_path"] for r in rows] == ["a", "b", "c", "d", "e", ""]


def test_validation_and_surrogates(spark):
    lone = json.dumps({"pdf_info": [page(0, [block("text", "\ud840abc")])]})
    p = parsed(spark, {"pdf_info": [page(0, [{"lines": []}])]}, "{broken", {"pdf_info": [{"page_idx": 0, "page_size": [1]}]}, lone, {"middle": {"pdf_info": []}})
    got = {r["doc_id"]: r["problem"] for r in layout.validation(p).collect()}
    assert got["d0"] == "a block lacks its type" and got["d1"] == "not JSON" and "page" in got["d2"] and got["d3"] is None and got["d4"] is None
    assert layout.blocks(p.filter("doc_id = 'd3'")).select(layout.lined_text(F.col("block"))).head()[0] == "\ufffdabc"
    n, failed = layout.validation_summary(layout.validation(p))[0].head()
    assert (n, failed) == (5, 3)


@pytest.mark.parametrize(("length", "want"), [(300, 300), (301, 300)])
def test_truncation(spark, length, want):
    got = spark.range(1).select(text.truncate(F.lit("x" * length))).head()[0]
    assert len(got) == want and got.endswith("…") == (length > 300)


def test_first_texts_budget(spark):
    run = lambda *t: spark.range(1).select(text.first_texts(F.array(*map(F.lit, t)))).head()[0]
    assert run("a" * 199, "b", "c") == "a" * 199 + "\nb"
    assert run("a" * 200, "b") == "a" * 200
    assert run("", "") is None


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(text.normalize(F.lit("\u3000Ａ\t\tb  c\u00a0"))) == "A b c"
    assert [one(text.span_count(F.lit(v))) for v in ("3", " 2 ", "0", "-1", "x")] == [3, 2, 1, 1, 1]
    assert one(text.span_count(F.lit(None).cast("string"))) == 1
    assert one(text.eq_to_mathjax(F.lit("a<EQ> x\n </eq>"))) == 'a<span class="math inline">\\(x\\)</span>'
    assert one(text.non_empty(F.lit(""), F.lit("b"))) == "b"
    assert one(text.html_lines(F.lit(None).cast("string"))) == ""
    assert len(one(text.data_url(F.lit("x.bin"), F.lit(b"0" * 300)))) == len("data:application/octet-stream;base64,") + 400


MATH = [
    (" \\alpha _ { i } ^ { 2 } + \\beta ", True, "$α_i^2+ β$"),
    ("\\alpha_{p r o b}", True, "$α_{prob}$"),
    ("\\alpha_\\mathrm(prob}", True, "$α_\\mathrm(prob}$"),
    ("\\mathit{prob} + \\mathbb{R} + \\alpha", True, "${prob}+ R+ α$"),
    ("e_{x} + f^{y} + g_{prob}", True, "$e_x+ f^y+ g_{prob}$"),
    ("(0 . 6 2 0 . 1 1)", False, "$(0.620.11)$"),
    ("\\leq \\left(", True, "$≤q≤ft($"),
    ("\\subseteq", True, "$⊂eq$"),
    ("$$ x $$", False, "$x$"),
    ("$", False, "$$"),
    ("$$", False, "$$"),
    ("$$$", False, "$$"),
    ("", False, "$$"),
    ("\\alpha \\beta", False, "$\\alpha\\beta$"),
]


@pytest.mark.parametrize(("raw", "as_unicode", "want"), MATH)
def test_math(spark, raw, as_unicode, want):
    assert latex.math_string(raw, as_unicode, False) == want
    assert spark.range(1).select(latex.math_text(F.lit(raw), as_unicode, False)).head()[0] == want


def brute_gap(boxes, box):
    def far(a, b):
        return math.hypot(max(0, b[0] - a[2], a[0] - b[2]), max(0, b[1] - a[3], a[1] - b[3]))

    n, best = len(boxes), None
    for i in range(n + 1):
        left, right = boxes[max(i - 1, 0)], boxes[min(i, n - 1)]
        cost = (math.inf if i != n else 0.0) if None in (box, left, right) else far(left, box) + far(right, box)
        rank = (cost, i in (0, n), i)
        best = rank if best is None else min(best, rank)
    return best[2]


def test_gap_choice_against_brute_force(spark):
    rng = random.Random(4)
    make = lambda: None if rng.random() < 0.15 else [float(x), float(y), float(x + rng.randint(0, 9)), float(y + rng.randint(0, 9))] if (x := rng.randint(0, 30)) is not None and (y := rng.randint(0, 30)) is not None else None
    cases = [([make() for _ in range(rng.randint(1, 5))], make()) for _ in range(300)]
    named = lambda b: None if b is None else dict(zip(("x0", "y0", "x1", "y1"), b))
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    df = spark.createDataFrame([(i, [named(b) for b in bs], named(b)) for i, (bs, b) in enumerate(cases)], f"i int, boxes array<{box}>, box {box}")
    got = {r[0]: r[1] for r in df.select("i", merging.best_gap(F.col("boxes"), F.col("box"))).collect()}
    assert got == {i: brute_gap(*c) for i, c in enumerate(cases)}


def test_merge_of_pages(spark):
    from folioflow.plans.conversion import merged_top

    at = lambda y: [0.0, float(y), 10.0, float(y + 5)]
    doc = {"pdf_info": [
        page(0, [block("text", "a", bbox=at(10)), block("text", "b", bbox=at(50))], [block("header", "Head", bbox=at(0)), block("footer", "3 / 10", bbox=at(90)), block("page_number", "3"), block("aside_text", "note here", bbox=at(30)), block("text", "lost")]),
        page(1, [block("text", "c", bbox=at(10))], [block("header", "Head", bbox=at(0)), block("footer", "Copyright me", bbox=at(90))]),
        page(2, [], [block("header", "Head"), block("page_number", "1")]),
        page(3, [block("text", "z")], []),
    ]}
    rows = merged_top(layout.blocks(parsed(spark, doc))).orderBy("page_pos", "place").collect()
    got = [[r["text"] for r in g] for _, g in itertools.groupby(rows, lambda r: r["page_pos"])]
    assert got == [["Head", "a", "note here", "b", "lost"], ["c"], ["Head", "1"], ["z"]]


def test_first_page_is_first_in_list_order(spark):
    doc = {"pdf_info": [page(-1, [], [block("header", "H")]), page(5, [], [block("header", "H")]), page(2, [], [block("header", "H")])]}
    top = merging.with_slashed_text(layout.blocks(parsed(spark, doc)).filter("depth = 0"))
    assert [r["first_page"] for r in merging.first_pages(top).collect()] == [5]


def test_image_refs(spark):
    image = {"type": "image", "index": 4, "lines": [{"spans": [{"type": "image", "image_path": "own"}]}], "blocks": [{"type": "image_body", "lines": [{"spans": [{"type": "image", "image_path": "p"}, {"type": "image", "image_path": ""}]}]}, block("image_caption", "cap"), block("caption", "tion")]}
    doc = {"pdf_info": [page(0, [block("text", "far"), block("title", "T"), block("text", ""), image, block("text", "z" * 400), block("text", "never")]), page(1, [image])]}
    blocks = layout.blocks(parsed(spark, doc))
    rows = images.image_refs(blocks, layout.spans(blocks)).orderBy("page_pos", "line_no", "span_no").collect()
    assert [(r["page_idx"], r["image_path"], r["block_index"]) for r in rows] == [(0, "p", 4), (0, "", 4), (1, "p", 4), (1, "", 4)]
    r = rows[0]
    # the empty block ahead counts as context, so the walk ends at the title
    assert (r["caption"], r["section_title"], r["nearby_text_before"]) == ("cap\ntion", "T", None)
    assert r["nearby_text_after"] == "z" * 299 + "…"
    assert rows[2]["section_title"] is None and rows[2]["nearby_text_before"] is None
    shown = images.screening_context(F.lit("p"), F.lit("o"))
    assert images.image_refs(blocks, layout.spans(blocks)).filter("page_idx = 1").select(shown).head()[0] == "PDF path: p\nOut directory: o\nPage index: 1\nBlock index: 4\nBlock type: image\nCaption: cap\ntion"
