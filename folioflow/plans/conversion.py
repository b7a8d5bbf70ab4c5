"""The whole way of a document: reuse of earlier results, extraction, merge, enrichment, rendering."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators import enrichment, images, merging, rendering
from folioflow.runtime import ship, stored
from folioflow.sources import files, layout

IMAGE_PARAMETERS = ("with_image_understanding", "image_screening_model", "image_understanding_model")


@dataclass(frozen=True)
class Models:
    """Two injected models and the JSON of their configurations, without secrets."""

    screen: Callable[[dict], str]
    understand: Callable[[dict], str]
    screening_config: str
    understanding_config: str

    @property
    def names(self) -> tuple[str | None, str | None]:
        return json.loads(self.screening_config).get("model"), json.loads(self.understanding_config).get("model")


@dataclass(frozen=True)
class Conversion:
    extract: Callable[[bytes, dict], str]
    options: dict = field(default_factory=dict)
    models: Models | None = None
    render: rendering.RenderOptions = rendering.RenderOptions()
    #: The folder below which each file has one of its own, named like it without its ending; by default that of the file.
    outdir: str | None = None

    def parameters(self) -> Column:
        """What a result is made with; of a file in column ``sha256``."""
        o = {"seal_enable": True, "formula_enable": True} | self.options
        names = self.models.names if self.models else (None, None)
        text = lambda v: F.lit(v).cast("string")
        return F.struct(
            F.col("sha256").alias("source_checksum"),
            *[text(o.get(k)).alias(k) for k in ("backend", "method", "lang")],
            *[F.lit(bool(o[k])).alias(k) for k in ("seal_enable", "formula_enable")],
            F.lit(self.models is not None).alias("with_image_understanding"),
            *[text(n).alias(k) for k, n in zip(IMAGE_PARAMETERS[1:], names)],
        )


def without_image_parameters(parameters: Column) -> Column:
    """Parameters with those of images neutral, to compare what extraction depends on."""
    return parameters.withField("with_image_understanding", F.lit(False)).withField("image_screening_model", F.lit(None).cast("string")).withField("image_understanding_model", F.lit(None).cast("string"))


def reuse(wanted: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``wanted`` (source_path, parameters) as (those saved alike, those whose extraction can be reused, those to extract)."""
    more = [c for c in ("extracted_by",) if c in saved.columns]
    w, s = wanted.alias("w"), saved.select("source_path", "parameters", "raw", *more).alias("s")
    same = (F.col("w.source_path") == F.col("s.source_path")) & F.to_json("w.parameters").eqNullSafe(F.to_json("s.parameters"))
    done = w.join(s, same).select("w.*", "s.raw", *[f"s.{c}" for c in more])
    left = w.join(s, same, "left_anti").alias("w")
    alike = (F.col("w.source_path") == F.col("s.source_path")) & F.to_json(without_image_parameters(F.col("w.parameters"))).eqNullSafe(F.to_json(without_image_parameters(F.col("s.parameters"))))
    one = s.groupBy("source_path", F.to_json(without_image_parameters(F.col("parameters"))).alias("key")).agg(F.min(F.struct("raw", *more)).alias("kept"))
    partly = left.join(one.alias("o"), (F.col("w.source_path") == F.col("o.source_path")) & (F.to_json(without_image_parameters(F.col("w.parameters"))) == F.col("o.key"))).select("w.*", "o.kept.*")
    return done, partly, left.join(s, alike, "left_anti")


def merged_top(blocks: DataFrame) -> DataFrame:
    """Merged reading order of top-level blocks, ``place`` on each page."""
    top = merging.with_slashed_text(blocks.filter("depth = 0")).withColumn("root", F.get("path", 0))
    return merging.merged_order(top)


RESULT = "doc_id string, outdir string, source_path string, extracted_by string, raw string"


def saved_results(parsed: DataFrame) -> DataFrame:
    """(source_path, parameters, extracted_by, raw) of result files, for ``reuse``; bare layouts are none."""
    d = layout.documents(parsed).filter("source_path is not null")
    return d.select("source_path", "parameters", "extracted_by", F.to_json("doc").alias("raw"))


def results(pdfs: DataFrame, job: Conversion, saved: DataFrame | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(results, new cache rows, files that failed) of ``files.pdf_files``.

    results: doc_id (the file), outdir, source_path, parameters, extracted_by, raw (the
    layout). A file whose saved result has the same parameters keeps it; one that differs
    in images alone keeps its extraction. With models, discarded blocks are merged, then
    images are described, each at most once, and the layout carries both.
    """
    path = F.regexp_replace("path", "^file:/+", "/")
    wanted = pdfs.select("path", "content", path.alias("source_path"), job.parameters().alias("parameters"))
    name = F.regexp_replace("source_path", r"\.[^./]*$", "")
    wanted = wanted.withColumn("outdir", F.concat(F.lit(job.outdir.rstrip("/") + "/"), F.regexp_extract(name, "([^/]*)$", 1)) if job.outdir else name)
    columns = [F.col("path").alias("doc_id"), "outdir", "source_path", "parameters", "extracted_by", "raw"]
    if saved is None:
        fresh, done, partly = wanted, None, None
    else:
        done, partly, fresh = reuse(wanted, saved)
    tag = files.backend_options(**job.options)["tag"]
    # what is extracted is read several times; the extractor runs once
    got = stored(files.extracted(fresh, job.extract, job.options).drop("content").withColumn("extracted_by", F.lit(tag)), "extracted")
    base = got.filter("error is null").select(*columns)
    if partly is not None:
        base = base.unionByName(partly.select(*columns))
    new = None
    if job.models:
        base, new = with_images(base, cache, job.models)
        base = stored(base, "described")  # results are read for Markdown, files and more
    if done is not None:
        base = base.unionByName(done.select(*columns))
    return base, new, got.filter("error is not null").select("path", "error")


def convert(pdfs: DataFrame, job: Conversion, saved: DataFrame | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(Markdown by document, files that failed)."""
    made, _, failed = results(pdfs, job, saved, cache)
    return markdown(made, job.render), failed


def markdown(made: DataFrame, options: rendering.RenderOptions) -> DataFrame:
    return rendering.document_markdown(rendering.page_markdown(layout.pages(layout.parsed(made.select("doc_id", "raw"))), options))


def save(made: DataFrame, new: DataFrame | None, options: rendering.RenderOptions, html=None) -> int:
    """Writes each result's middle.json, text.md and, where ``html`` gives one, text.html into its folder, and appends new answers to their folders' caches; the number of files."""
    body = F.to_json(F.struct(F.parse_json("raw").alias("middle"), "source_path", "extracted_by", "parameters"))
    out = made.select(F.concat("outdir", F.lit("/middle.json")).alias("path"), body.alias("text"))
    text = markdown(made, options).join(made.select("doc_id", "outdir"), "doc_id")
    page = rendering.markdown_to_html(text, html)
    for name, column in (("text.md", "markdown"), ("text.html", "html")):
        out = out.unionByName(page.filter(F.col(column).isNotNull()).select(F.concat("outdir", F.lit("/" + name)).alias("path"), F.col(column).alias("text")))
    written = files.write_each(out)
    if new is not None:
        lines = enrichment.cache_lines(new, "outdir").groupBy("outdir").agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("lines"))
        written += files.write_each(lines.select(F.concat("outdir", F.lit("/" + enrichment.CACHE_FILE)).alias("path"), F.concat("lines", F.lit("\n")).alias("text")), append=True)
    return written


def rewritten(docs: DataFrame, change: Callable[[dict, dict], None], *given: str) -> DataFrame:
    """``docs`` with ``raw`` changed in place, as a tree, by ``change(layout, the given columns)``; the rest as it is, without the given columns."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in given]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = []
            for row in pdf.to_dict("records"):
                tree = json.loads(row["raw"])
                change(tree.get("middle", tree), {k: json.loads(row[k]) if row[k] else [] for k in given})
                raw.append(json.dumps(tree.get("middle", tree), ensure_ascii=False))
            yield pdf[keep].assign(raw=raw)

    as_text = docs.select(*keep, *[F.to_json(c).alias(c) for c in given])
    return as_text.mapInPandas(run, docs.select(*keep).schema)


def _merge(tree: dict, given: dict) -> None:
    order: dict[int, list] = {}
    for o in given["order"]:
        order.setdefault(o["page_pos"], []).append((o["place"], layout.SECTIONS[o["section"]], o["root"]))
    for i, page in enumerate(tree.get("pdf_info") or ()):
        page["para_blocks"] = [page[section][root] for _, section, root in sorted(order.get(i, ()))]
    for kind in ("header", "footer"):
        tree[f"_{kind}_text_first_page"] = {f["text"]: f["first_page"] for f in given["firsts"] if f["kind"] == kind}


def merged_layouts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, raw and more), their discarded blocks merged into the main ones, with the maps of headers and footers."""
    top = merging.with_text_that_matters(layout.blocks(layout.parsed(docs.select("doc_id", "raw")), (layout.PARA, layout.DISCARDED)).filter("depth = 0")).withColumn("root", F.get("path", 0)).drop("block")
    order = merging.merged_order(top).groupBy("doc_id").agg(F.collect_list(F.struct("page_pos", "place", "section", "root")).alias("order"))
    firsts = merging.first_pages(top).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "text", "first_page")).alias("firsts"))
    return rewritten(docs.join(order, "doc_id", "left").join(firsts, "doc_id", "left"), _merge, "order", "firsts")


def _embed(tree: dict, given: dict) -> None:
    known = {(a["page_idx"], a.get("block_index"), a["image_path"]): a["summary"] for a in sorted(given["answers"], key=lambda a: [a["place"][k] for k in ("page_pos", "root", "child", "line_no", "span_no")])}

    def visit(block: dict, page: int, owner: int | None) -> None:
        owner = block["index"] if block.get("index") is not None else owner
        for line in block.get("lines") or ():
            for span in line.get("spans") or ():
                found = known.get((page, owner, span.get("image_path")))
                if found is not None:
                    span["image_understanding"] = found
        for child in block.get("blocks") or ():
            visit(child, page, owner)

    if known:
        for page in tree.get("pdf_info") or ():
            for section in layout.SECTIONS:
                for block in page.get(section) or ():
                    visit(block, page.get("page_idx"), None)


def with_images(docs: DataFrame, cache: DataFrame | None, models: Models) -> tuple[DataFrame, DataFrame]:
    """(``docs`` merged and with their images described, new cache rows)."""
    docs = stored(merged_layouts(docs), "merged")
    if cache is None:
        cache = enrichment.load_cache(docs.sparkSession.createDataFrame([], "outdir string, line_no long, value string"))
    parsed = layout.parsed(docs.select("doc_id", "outdir", "source_path", "raw"))
    blocks = layout.blocks(parsed)
    where = docs.select("doc_id", F.col("source_path").alias("pdf_path"), "outdir")
    answers, new = _answers(images.image_refs(blocks, layout.spans(blocks)).join(where, "doc_id"), cache, models)
    each = answers.groupBy("doc_id").agg(F.collect_list(F.struct("page_idx", "block_index", "image_path", "place", enrichment.summary(F.col("screening"), F.col("understanding")).alias("summary"))).alias("answers"))
    return rewritten(docs.join(each, "doc_id", "left"), _embed, "answers"), new


def _answers(refs: DataFrame, cache: DataFrame, models: Models) -> tuple[DataFrame, DataFrame]:
    """(answers by document and place, new cache rows) of image references with pdf_path and outdir."""
    refs = refs.withColumns({"screening_config": F.lit(models.screening_config), "understanding_config": F.lit(models.understanding_config)})
    all_answers, new = enrichment.answered(refs, cache, models.screen, models.understand)
    r, a = refs.alias("r"), all_answers.alias("a")
    on = F.lit(True)
    for c in enrichment.CACHE_KEY:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}"))
    place = F.struct("r.page_pos", "r.root", "r.child", "r.line_no", "r.span_no").alias("place")
    return r.join(a, on).select("r.doc_id", "r.page_idx", "r.block_index", "r.image_path", place, "a.screening", "a.understanding"), new


def enrich(parsed: DataFrame, cache: DataFrame, models: Models, pdf: Column, folder: Column) -> tuple[DataFrame, DataFrame]:
    """(spans with descriptions, new cache rows) of parsed documents."""
    blocks = layout.blocks(parsed)
    spans = layout.spans(blocks)
    answers, new = _answers(images.image_refs(blocks, spans).withColumns({"pdf_path": pdf, "outdir": folder}), cache, models)
    return enrichment.embedded(spans, answers), new
