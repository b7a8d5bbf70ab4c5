"""Salvage of discarded blocks into the reading order of their page.

Everything is local to a document or a page: one aggregation finds the first page of each
header and footer, and each page's own arrays hold the rest, so that placing a block
never joins pages with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import normalize, without_space
from folioflow.sources.layout import DISCARDED, PARA, slashed_text


def with_slashed_text(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("text", normalize(slashed_text(F.col("block"))))


def with_text_that_matters(blocks: DataFrame) -> DataFrame:
    """The same for blocks whose text decides on the order: discarded ones, headers and footers; null for others, the bulk."""
    asked = (F.col("section") != PARA) | F.col("type").isin("header", "footer")
    return blocks.withColumn("text", normalize(F.when(asked, slashed_text(F.col("block")))))


def first_pages(top: DataFrame) -> DataFrame:
    """(doc_id, kind, text, first_page): header and footer texts by the first page, in list order, that shows them.

    ``top``: top-level blocks with doc_id, page_pos, page_idx, section, type and text.
    Pages of index -1 don't count.
    """
    shown = top.filter(F.col("type").isin("header", "footer") & F.col("section").isin(PARA, DISCARDED) & (F.col("page_idx") != -1) & (F.col("text") != ""))
    return shown.groupBy("doc_id", F.col("type").alias("kind"), "text").agg(F.min_by("page_idx", "page_pos").alias("first_page"))


def salvaged(kind: Column, text: Column, page: Column, first_page: Column) -> Column:
    """Whether a discarded block is kept; ``first_page`` is that of its text, null if never shown."""
    bare = without_space(text)
    repeated = F.coalesce(first_page < page, F.lit(False))
    return (
        F.when((kind == "page_number") | (bare == ""), False)
        .when(kind == "header", (F.length(bare) > 1) & ~repeated)
        .when(kind == "footer", ~(bare.rlike("^<?[0-9]{1,3}>?") | F.lower(bare).rlike("allrightsreserved|^copyright") | repeated | (F.length(bare) <= 1)))
        .when(kind == "aside_text", (F.length(bare) > 3) & ~bare.rlike("^([0-9]+//){5}"))
        .otherwise(True)
    )


def box_distance(a: Column, b: Column) -> Column:
    """Euclidean gap of two axis-parallel boxes, 0 where they touch; null if one is missing."""
    dx = F.greatest(F.lit(0.0), b["x0"] - a["x1"], a["x0"] - b["x1"])
    dy = F.greatest(F.lit(0.0), b["y0"] - a["y1"], a["y0"] - b["y1"])
    return F.when(a.isNotNull() & b.isNotNull(), F.sqrt(dx * dx + dy * dy))


def best_gap(boxes: Column, box: Column) -> Column:
    """The gap 0..n among a page's n boxes (an array) in which a block lies best.

    A gap costs the distances to its two neighbours; at an edge the one there counts
    twice. A missing box makes a cost infinite, but that of the last gap 0. Of equal
    costs, inner gaps win, then the first.
    """
    n = F.size(boxes)
    inf = F.lit(float("inf"))

    def cost(i: Column) -> Column:
        left, right = F.get(boxes, F.greatest(i - 1, F.lit(0))), F.get(boxes, F.least(i, n - 1))
        return F.coalesce(box_distance(left, box) + box_distance(right, box), F.when(i == n, F.lit(0.0)).otherwise(inf))

    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(cost(i).alias("cost"), ((i == 0) | (i == n)).alias("edge"), i.alias("gap")))
    return F.array_min(gaps)["gap"]


def merged_order(top: DataFrame) -> DataFrame:
    """Top-level blocks of each page in merged reading order: adds ``place``, from 0 on each page.

    ``top``: doc_id, page_pos, page_idx, section, root (place in its list), type, text,
    bbox, and anything else. A page without main blocks keeps all its discarded ones,
    unfiltered; blocks that are not salvaged go; other sections are not read.
    """
    firsts = first_pages(top)
    both = top.filter(F.col("section").isin(PARA, DISCARDED))
    known = both.join(firsts.withColumnRenamed("kind", "type"), ["doc_id", "type", "text"], "left")
    box = F.struct("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    whole = F.struct(*[F.col(c) for c in known.columns], F.when(F.col("bbox").isNotNull(), box).alias("__box"))
    page = known.groupBy("doc_id", "page_pos").agg(
        F.array_sort(F.collect_list(F.when(F.col("section") == PARA, F.struct(F.col("root"), F.when(F.col("bbox").isNotNull(), box).alias("box"))))).alias("main"),
        F.collect_list(whole).alias("rows"),
    )
    boxes = F.transform("main", lambda m: m["box"])
    each = page.select(boxes.alias("__boxes"), F.explode("rows").alias("r"))
    alone = F.size("__boxes") == 0
    keep = (F.col("r.section") == PARA) | alone | salvaged(F.col("r.type"), F.col("r.text"), F.col("r.page_idx"), F.col("r.first_page"))
    far = F.struct(*[F.lit(1e18).alias(c) for c in ("x0", "y0", "x1", "y1")])
    gap = F.when(F.col("r.section") == PARA, F.col("r.root")).when(alone, F.lit(0)).otherwise(best_gap(F.col("__boxes"), F.col("r.__box")))
    # gap g lies ahead of main block g; without main blocks the list order stays
    order = F.struct((gap * 2 + F.when(F.col("r.section") == PARA, 1).otherwise(0)).alias("a"), F.when(alone, far).otherwise(F.coalesce(F.col("r.__box"), far)).alias("b"), F.col("r.root").alias("c"))
    kept = each.filter(keep).select("r.*", order.alias("__order"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id", "page_pos").orderBy("__order")) - 1
    return kept.withColumn("place", place).drop("__order", "__box", "first_page")
