"""Image references with their reading context, and what enriches them.

The context of an image is found within its page by folds over the page's own blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import CONTEXT_TYPES, IMAGE_TYPES, MAX_CONTEXT, TITLE_TYPES, first_texts, normalize, truncate
from folioflow.sources.layout import PARA, lined_text


def page_arrays(top: DataFrame) -> DataFrame:
    """(doc_id, page_pos, page_idx, items): each page's main blocks in order, as (root, type, text, and ``more``).

    ``top``: top-level blocks with doc_id, page_pos, page_idx, section, root, type, text.
    """
    main = top.filter(F.col("section") == PARA)
    return main.groupBy("doc_id", "page_pos").agg(F.first("page_idx").alias("page_idx"), F.array_sort(F.collect_list(F.struct("root", "type", "text"))).alias("items"))


def reading_context(pages: DataFrame) -> DataFrame:
    """(doc_id, page_pos, page_idx, root, type, section_title, text_before, text_after) of each image, chart and seal.

    The title is the nearest non-empty one ahead. Text ahead begins at the farther of the
    title and the nearest context block (of the page's start, if either is missing); text
    behind begins with the next block. Both are cut by ``first_texts``.
    """
    each = pages.select("*", F.explode(F.filter("items", lambda b: b["type"].isin(*IMAGE_TYPES))).alias("me"))
    ahead = F.filter("items", lambda b: b["root"] < F.col("me.root"))
    behind = F.filter("items", lambda b: b["root"] > F.col("me.root"))
    title = F.try_element_at(F.filter(ahead, lambda b: b["type"].isin(*TITLE_TYPES) & (b["text"] != "")), F.lit(-1))
    near = F.array_max(F.transform(F.filter(ahead, lambda b: b["type"].isin(*CONTEXT_TYPES)), lambda b: b["root"]))
    start = F.coalesce(F.when(title.isNotNull() & near.isNotNull(), F.least(title["root"], near)), F.lit(-1))
    texts = lambda a: F.transform(F.filter(a, lambda b: b["type"].isin(*CONTEXT_TYPES)), lambda b: b["text"])
    before = first_texts(texts(F.filter(ahead, lambda b: b["root"] >= start)))
    return each.select("doc_id", "page_pos", "page_idx", F.col("me.root").alias("root"), F.col("me.type").alias("type"), truncate(title["text"]).alias("section_title"), before.alias("text_before"), first_texts(texts(behind)).alias("text_after"))


def captions(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_pos, root, caption): non-empty texts of an image block's caption children, a line each."""
    kids = blocks.filter((F.col("section") == PARA) & (F.col("depth") == 1) & (F.col("type").endswith("_caption") | (F.col("type") == "caption")))
    texts = kids.select("doc_id", "page_pos", F.get("path", 0).alias("root"), F.get("path", 1).alias("child"), normalize(lined_text(F.col("block"))).alias("text")).filter("text != ''")
    joined = texts.groupBy("doc_id", "page_pos", "root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", "text"))), lambda x: x["text"]), "\n").alias("caption"))
    return joined.withColumn("caption", normalize("caption"))


def image_refs(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each image path in a direct child of an image, chart or seal, with its context, in reading order.

    (doc_id, page_pos, page_idx, root, child, line_no, span_no, block_index, block_type,
    image_path, caption, nearby_text_before, nearby_text_after, section_title)
    """
    top = blocks.filter((F.col("depth") == 0) & (F.col("section") == PARA)).select("doc_id", "page_pos", "page_idx", "section", F.get("path", 0).alias("root"), "type", "block_index", normalize(lined_text(F.col("block"))).alias("text"))
    # a context is MAX_CONTEXT long at most: of a text, one code point more tells that it is cut
    top = top.withColumn("text", F.substring("text", 1, MAX_CONTEXT + 1))
    context = reading_context(page_arrays(top))
    index = top.filter(F.col("type").isin(*IMAGE_TYPES)).select("doc_id", "page_pos", "root", "block_index")
    held = spans.filter((F.col("section") == PARA) & (F.size("path") == 2) & F.col("image_path").isNotNull()).select("doc_id", "page_pos", F.get("path", 0).alias("root"), F.get("path", 1).alias("child"), "line_no", "span_no", "image_path")
    key = ["doc_id", "page_pos", "root"]
    out = held.join(context, key).join(index, key).join(captions(blocks), key, "left")
    return out.select("doc_id", "page_pos", "page_idx", "root", "child", "line_no", "span_no", "block_index", F.col("type").alias("block_type"), "image_path", "caption", F.col("text_before").alias("nearby_text_before"), F.col("text_after").alias("nearby_text_after"), "section_title")


def screening_context(pdf: Column, folder: Column) -> Column:
    """The text that goes with an image to the screening model; lines without a value are left out."""
    line = lambda name, c: F.concat(F.lit(name + ": "), c)
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.concat_ws("\n", line("PDF path", pdf), line("Out directory", folder), line("Page index", word("page_idx")), line("Block index", word("block_index")), line("Block type", word("block_type")), line("Section title", F.col("section_title")), line("Caption", F.col("caption")), line("Nearby text before", F.col("nearby_text_before")), line("Nearby text after", F.col("nearby_text_after")))


def understanding_context(screening_text: Column, kind: Column, rag_value: Column, detail_level: Column, notes: Column) -> Column:
    """The same for the understanding model, with the screening's labels."""
    return F.concat_ws("\n", screening_text, F.lit(""), F.lit("Screening result:"), F.concat(F.lit("- kind: "), kind), F.concat(F.lit("- rag_value: "), rag_value), F.concat(F.lit("- detail_level: "), detail_level), F.concat(F.lit("- screening_notes: "), notes))


def listing(refs: DataFrame, pdf: Column, folder: Column) -> DataFrame:
    """Refs for files and contact sheets: the file's place and the page's number and link besides."""
    from folioflow.functions.text import image_file

    page = F.coalesce(F.col("page_idx") + 1, F.lit(1))
    return refs.select("*", pdf.alias("pdf_path"), folder.alias("outdir"), image_file(folder, F.col("image_path")).alias("image_file_path"), page.alias("page_number"), F.concat(pdf, F.lit("#page="), page.cast("string")).alias("pdf_link"))


def in_list_order(wanted: DataFrame, refs: DataFrame) -> DataFrame:
    """Refs in the order of a list of (place, image_file_path); the last ref of a file wins, and a file without one is an error that names up to 20."""
    order = F.struct("doc_id", "page_pos", "root", "child", "line_no", "span_no")
    last = refs.groupBy("image_file_path").agg(F.max_by(F.struct(*refs.columns), order).alias("ref"))
    missing = wanted.join(last, "image_file_path", "left_anti").orderBy("place").limit(20)
    names = [r["image_file_path"] for r in missing.select("image_file_path").collect()]
    if names:
        raise ValueError(f"images without a reference: {names}")
    return wanted.join(last, "image_file_path").select("place", "ref.*").orderBy("place")


