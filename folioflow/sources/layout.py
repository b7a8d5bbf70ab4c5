"""Layout documents: scan, validation, and flattening into ordered relations.

A document is one JSON object; blocks nest without bound. It is held as VARIANT, and the
tree is opened level by level inside one expression, so a scan needs no recursion of
plans, no Python and no shuffle. Every relation carries the keys that order it:
(page_pos, section, path, line_no, span_no), where a path sorts ahead of those below it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import without_lone_surrogates

#: The traversal order of a page's block lists.
SECTIONS = ("para_blocks", "discarded_blocks", "preproc_blocks")
PARA, DISCARDED, PREPROC = 0, 1, 2
#: Levels of nested blocks that are opened; a deeper tree is an error, not a loss.
MAX_DEPTH = 256

DOMAINS = {
    "block_type": ("image", "chart", "seal"),
    "kind": tuple("arrow_only chart_or_graph code_symbol decorative diagram logo_or_mark other seal table_or_form text_as_image ui_or_screenshot".split()),
    "detail_level": ("skip", "short", "long"),
    "rag_value": ("high", "medium", "low", "none"),
}


#: Results lie below folders of this name, which Spark's listing skips as hidden unless it is named.
DATA_FOLDER = "__data"


def data_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of this name below ``path``, at any depth; what lies below one of them is found through it."""
    start = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = start.getFileSystem(spark._jsc.hadoopConfiguration())
    found, level = [], [start] if fs.exists(start) else []
    while level:
        below = []
        for folder in level:
            for f in fs.listStatus(folder):
                if f.isDirectory():
                    (found if f.getPath().getName() == DATA_FOLDER else below).append(f.getPath())
        level = below
    return [f.toString() for f in found]


def scan(spark: SparkSession, path: str, file_name: str = "middle.json") -> DataFrame:
    """(doc_id, raw) of each layout file below a folder, found recursively; doc_id is the file's path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file_name).text([path, *data_folders(spark, path)], wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("raw"))


def parsed(raw: DataFrame) -> DataFrame:
    """Adds ``doc``: the layout as VARIANT, unpaired surrogates repaired; null where the text is no JSON.

    Both a bare layout and a result file around one are taken.
    """
    # behind a generator, so that no later projection parses again
    whole = raw.select("*", F.explode(F.array(F.try_parse_json(without_lone_surrogates("raw")))).alias("__whole"))
    inner = F.try_variant_get("__whole", "$.middle", "variant")
    return whole.withColumn("doc", F.coalesce(inner, F.col("__whole"))).withColumn("result", F.when(inner.isNotNull(), F.col("__whole"))).drop("__whole")


def validation(parsed_docs: DataFrame) -> DataFrame:
    """(doc_id, problem) of each document; problem is null where its required fields have their types."""
    pages = F.try_variant_get("doc", "$.pdf_info", "array<variant>")
    page_ok = lambda p: F.try_variant_get(p, "$.page_idx", "int").isNotNull() & (F.size(F.try_variant_get(p, "$.page_size", "array<int>")) == 2)
    problem = F.when(F.col("doc").isNull(), "not JSON").when(pages.isNull(), "pdf_info is not a list").when(~F.forall(pages, lambda p: F.coalesce(page_ok(p), F.lit(False))), "a page lacks page_idx or page_size")
    typed = lambda n: F.try_variant_get(n["v"], "$.type", "string").isNotNull()
    roots = lambda p: [F.coalesce(F.try_variant_get(p, f"$.{k}", "array<variant>"), F.array().cast("array<variant>")) for k in SECTIONS]
    problem = problem.when(~F.forall(pages, lambda p: F.forall(tree(F.concat(*roots(p))), typed)), "a block lacks its type")
    return parsed_docs.select("doc_id", problem.alias("problem"))


def validation_summary(checked: DataFrame, shown: int = 10) -> tuple[DataFrame, DataFrame]:
    """((files, failed), the first failures by doc_id)."""
    return checked.agg(F.count("*").alias("files"), F.count("problem").alias("failed")), checked.filter("problem is not null").orderBy("doc_id").limit(shown)


def documents(parsed_docs: DataFrame) -> DataFrame:
    """One row for each document: the metadata, the extractor, the parameters."""
    d = lambda path, t: F.try_variant_get("doc", path, t)
    r = lambda path, t: F.try_variant_get("result", path, t)
    return parsed_docs.select(
        "doc_id",
        r("$.source_path", "string").alias("source_path"),
        r("$.extracted_by", "string").alias("extracted_by"),
        r("$.parameters", "struct<source_checksum string, backend string, method string, lang string, seal_enable boolean, formula_enable boolean, with_image_understanding boolean, image_screening_model string, image_understanding_model string>").alias("parameters"),
        d("$._backend", "string").alias("backend"),
        d("$._version_name", "string").alias("version_name"),
        d("$._ocr_enable", "boolean").alias("ocr_enable"),
        d("$._vlm_ocr_enable", "boolean").alias("vlm_ocr_enable"),
        d("$._header_text_first_page", "map<string,int>").alias("header_first"),
        d("$._footer_text_first_page", "map<string,int>").alias("footer_first"),
        "doc",
    )


def pages(parsed_docs: DataFrame) -> DataFrame:
    """(doc_id, page_pos, page_idx, w, h, page): page_pos is the place in the list."""
    listed = parsed_docs.select("doc_id", F.posexplode(F.try_variant_get("doc", "$.pdf_info", "array<variant>")).alias("page_pos", "page"))
    size = F.try_variant_get("page", "$.page_size", "array<int>")
    return listed.select("doc_id", "page_pos", F.try_variant_get("page", "$.page_idx", "int").alias("page_idx"), F.get(size, 0).alias("w"), F.get(size, 1).alias("h"), "page")


_NODE = "struct<path: array<int>, owner: int, v: variant>"


def _node(path: Column, owner: Column, v: Column) -> Column:
    """A block with the nearest index on the way to it, its own first."""
    return F.struct(path.alias("path"), F.coalesce(F.try_variant_get(v, "$.index", "int"), owner).alias("owner"), v.alias("v"))


def _children(nodes: Column) -> Column:
    below = lambda n: F.transform(F.coalesce(F.try_variant_get(n["v"], "$.blocks", "array<variant>"), F.array().cast("array<variant>")), lambda c, i: _node(F.concat(n["path"], F.array(i)), n["owner"], c))
    return F.flatten(F.transform(nodes, below))


def tree(roots: Column, depth: int = MAX_DEPTH) -> Column:
    """All blocks of a list of VARIANT blocks, with their paths, in one array; ``depth`` is a square number of levels."""
    first = F.transform(roots, lambda v, i: _node(F.array(i), F.lit(None).cast("int"), v))
    start = F.struct(first.alias("all"), first.alias("last"))
    # the next level is bound once, as the one element of an array
    more = lambda acc: F.element_at(F.transform(F.array(_children(acc["last"])), lambda n: F.struct(F.concat(acc["all"], n).alias("all"), n.alias("last"))), 1)
    # an empty level ends the fold: of the outer steps, each of several levels, those left cost nothing
    go = lambda acc, then: F.when(F.size(acc["last"]) == 0, acc).otherwise(then)
    few = math.isqrt(depth)
    step = lambda acc, _: go(acc, F.aggregate(F.sequence(F.lit(1), F.lit(few)), acc, lambda inner, _: go(inner, more(inner))))
    end = lambda acc: F.when(F.size(acc["last"]) > 0, F.raise_error(F.lit(f"blocks nest deeper than {depth}")).cast(f"array<{_NODE}>")).otherwise(acc["all"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth // few)), start, step, end)


def _box(v: Column, path: str = "$.bbox") -> Column:
    b = F.try_variant_get(v, path, "array<double>")
    return F.when(F.size(b) == 4, F.struct(b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1")))


def blocks(parsed_docs: DataFrame, sections: tuple[int, ...] = (PARA, DISCARDED, PREPROC)) -> DataFrame:
    """(doc_id, page_pos, page_idx, section, path, depth, type, bbox, block_index, owner_index, level, guess_lang, block)."""
    listed = F.array(*[F.struct(F.lit(s).alias("section"), F.coalesce(F.try_variant_get("page", f"$.{SECTIONS[s]}", "array<variant>"), F.array().cast("array<variant>")).alias("roots")) for s in sections])
    each = pages(parsed_docs).select("doc_id", "page_pos", "page_idx", F.explode(listed).alias("s"))
    each = each.filter(F.size("s.roots") > 0).select("doc_id", "page_pos", "page_idx", "s.section", F.explode(tree(F.col("s.roots"))).alias("n"))
    v = F.col("n.v")
    return each.select(
        "doc_id",
        "page_pos",
        "page_idx",
        "section",
        F.col("n.path").alias("path"),
        (F.size("n.path") - 1).alias("depth"),
        F.try_variant_get(v, "$.type", "string").alias("type"),
        _box(v).alias("bbox"),
        F.try_variant_get(v, "$.index", "int").alias("block_index"),
        F.col("n.owner").alias("owner_index"),
        F.try_variant_get(v, "$.level", "int").alias("level"),
        F.try_variant_get(v, "$.guess_lang", "string").alias("guess_lang"),
        v.alias("block"),
    )


def _text_or_list(v: Column, path: str) -> Column:
    """A text, or a list of texts as one; null where there is neither."""
    return F.coalesce(F.array_join(F.try_variant_get(v, path, "array<string>"), ""), F.try_variant_get(v, path, "string"))


def content_text(content: Column) -> Column:
    """A content that is a text or a list of texts, as one text; null as the empty one."""
    return F.coalesce(_text_or_list(content, "$"), F.lit(""))


_SUMMARY = "struct<kind string, rag_value string, detail_level string, keywords array<string>, notes string, short_description string, long_description string>"


def spans(block_rows: DataFrame) -> DataFrame:
    """Spans of ``blocks``: its keys, line_no, span_no, span_type, content, has_content, html, image_path, score, understanding."""
    keys = ["doc_id", "page_pos", "page_idx", "section", "path", "owner_index"]
    lines = block_rows.select(*keys, F.col("type").alias("block_type"), F.posexplode(F.try_variant_get("block", "$.lines", "array<variant>")).alias("line_no", "line"))
    each = lines.select(*keys, "block_type", "line_no", F.posexplode(F.try_variant_get("line", "$.spans", "array<variant>")).alias("span_no", "span"))
    content = F.try_variant_get("span", "$.content", "variant")
    return each.select(
        *keys,
        "block_type",
        "line_no",
        "span_no",
        F.try_variant_get("span", "$.type", "string").alias("span_type"),
        content_text(content).alias("content"),
        (content.isNotNull() & ~F.coalesce(F.is_variant_null(content), F.lit(False))).alias("has_content"),
        F.try_variant_get("span", "$.html", "string").alias("html"),
        F.try_variant_get("span", "$.image_path", "string").alias("image_path"),
        F.try_variant_get("span", "$.score", "double").alias("score"),
        F.try_variant_get("span", "$.image_understanding", _SUMMARY).alias("understanding"),
    )


def lines_of(block: Column) -> Column:
    """A block's own lines: for each the texts of its spans, null where a span has no content."""
    line_spans = lambda line: F.coalesce(F.try_variant_get(line, "$.spans", "array<variant>"), F.array().cast("array<variant>"))

    text = lambda span: _text_or_list(span, "$.content")
    return F.transform(F.coalesce(F.try_variant_get(block, "$.lines", "array<variant>"), F.array().cast("array<variant>")), lambda line: F.transform(line_spans(line), text))


def slashed_text(block: Column) -> Column:
    """Own lines with any text, joined by two slashes (not yet normalised)."""
    joined = F.transform(lines_of(block), lambda texts: F.array_join(texts, ""))
    return F.array_join(F.filter(joined, lambda t: t != ""), "//")


def lined_text(block: Column) -> Column:
    """Own lines with any content, even empty, a line each (not yet normalised)."""
    kept = F.filter(lines_of(block), lambda texts: F.exists(texts, lambda t: t.isNotNull()))
    return F.array_join(F.transform(kept, lambda texts: F.array_join(texts, "")), "\n")


def image_paths(span_rows: DataFrame) -> DataFrame:
    """(doc_id, image_path, place): each distinct path once, by where it is first met; the empty path counts."""
    key = F.struct("page_pos", "section", "path", "line_no", "span_no")
    first = span_rows.filter("image_path is not null").groupBy("doc_id", "image_path").agg(F.min(key).alias("place"))
    return first.select("doc_id", "image_path", "place")


def first_of(span_rows: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """(doc_id, page_pos, section, root, value): for each top-level block the first value of ``column`` on the way down."""
    ok = F.col(column).isNotNull()
    if not keep_empty:
        ok = ok & (F.col(column) != "")
    key = F.struct("path", "line_no", "span_no")
    return span_rows.filter(ok).groupBy("doc_id", "page_pos", "section", F.get("path", 0).alias("root")).agg(F.min_by(column, key).alias("value"))
