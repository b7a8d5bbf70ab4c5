"""Command lines: convert, render, merge-render, refs, gold-report, understanding-report, annotate, view, validate.

Models, extractors and HTML converters are named as ``module:function``.
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import image_file, item_key, pdf_of
from folioflow.operators import enrichment, evaluation, images, rendering, reports
from folioflow.plans import conversion
from folioflow.runtime import stored
from folioflow.sources import files, layout


def _load(name: str | None):
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _models(a: argparse.Namespace) -> conversion.Models | None:
    """The two models of the command line; their configurations go without keys."""
    if not a.with_image_understanding:
        return None
    made, configs = [], []
    for kind, role in (("screening", "screen"), ("understanding", "understand")):
        model, url, key = (getattr(a, f"image_{kind}_{x}") for x in ("model", "base_url", "api_key"))
        if not model:
            raise ValueError(f"--with-image-understanding needs --image-{kind}-model")
        rate = enrichment.price_table().get(model)
        config = {"model": model, "thinking": False, "base_url": url, "pricing": rate and dict(zip(("input_per_million_usd", "output_per_million_usd"), rate))}
        configs.append(json.dumps({k: v for k, v in config.items() if v is not None}, separators=(",", ":")))
        made.append((_load(a.clients), role, model, url, key))
    if not a.clients:
        raise ValueError("--with-image-understanding needs --clients")
    return conversion.Models(*(make(role, model, url, key) for make, role, model, url, key in made), *configs)


def _write(path: str | None, text: str) -> None:
    if path is None:
        print(text, end="")
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioflow")
    sub = p.add_subparsers(dest="command", required=True)

    c = sub.add_parser("convert", help="PDF files of a folder to Markdown")
    c.add_argument("folder")
    c.add_argument("--outdir", required=True)
    c.add_argument("--extractor", required=True)
    for name in ("backend", "method", "lang", "server-url"):
        c.add_argument(f"--{name}")
    c.add_argument("--with-image-understanding", action="store_true", help="merge discarded blocks, and describe images by models")
    c.add_argument("--clients", help="makes a model's client: of (screen or understand, model, base URL, API key) a function from an image's columns to JSON text")
    for kind in ("screening", "understanding"):
        c.add_argument(f"--image-{kind}-model")
        c.add_argument(f"--image-{kind}-base-url")
        c.add_argument(f"--image-{kind}-api-key")
    c.add_argument("--html-converter", help="by default pandoc, where it is installed")
    c.add_argument("--resume", action="store_true", help="keep results that the folder holds for the same file and options")
    c.add_argument("--limit", type=int, help="only the first files by path")
    for name, text in (("disable-seal", None), ("disable-formula", None), ("keep-going", "report failed files and go on")):
        c.add_argument(f"--{name}", action="store_true", help=text)

    r = sub.add_parser("render", help="layout files below a folder to Markdown and HTML")
    r.add_argument("folder")
    r.add_argument("--outdir", required=True)
    r.add_argument("--preset", choices=["plain", "rag", "html"], default="plain")
    r.add_argument("--detail", choices=["short", "long"], default="long")
    r.add_argument("--html-converter")
    r.add_argument("--link-pdf", action="store_true", help="a link to the original ahead of the text")

    s = sub.add_parser("refs", help="image references below a folder")
    s.add_argument("folder")
    s.add_argument("--out", required=True)
    s.add_argument("--format", choices=["txt", "json", "html"], default="txt")
    s.add_argument("--list", help="only the images of this list, in its order")

    g = sub.add_parser("gold-report", help="model runs against gold labels")
    g.add_argument("runs")
    g.add_argument("gold")
    g.add_argument("--out")
    g.add_argument("--html")
    g.add_argument("--charts", help="folder for SVG charts")

    u = sub.add_parser("understanding-report", help="summary of model runs by variant")
    u.add_argument("runs")
    u.add_argument("--out")

    for name, text in (("annotate", "labelling page"), ("view", "result page")):
        a = sub.add_parser(name, help=text)
        a.add_argument("runs")
        a.add_argument("--out", required=True)
        a.add_argument("--model", default="gpt-5.4" if name == "annotate" else None)
        if name == "annotate":
            a.add_argument("--seed", help="gold labels to start from")

    v = sub.add_parser("validate", help="checks every layout file below a folder")
    v.add_argument("folder")
    return p


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return layout.parsed(layout.scan(spark, folder)).withColumn("doc_id", F.regexp_replace("doc_id", "^file:/+", "/"))


def _flat(runs: DataFrame) -> DataFrame:
    r = evaluation.labels(runs)
    folder = F.regexp_extract("ref.middle_json_path", "^(.*)/[^/]*$", 1)
    key = item_key("ref.middle_json_path", "ref.page_idx", "ref.block_index", "ref.image_path")
    return r.select(F.col("pos").alias("place"), key.alias("item_key"), "ref.*", F.col("ref.middle_json_path").alias("layout_path"), image_file(folder, "ref.image_path").alias("image_file_path"), "model", "latency_sec", F.col("status.ok").alias("ok"), F.col("status.error").alias("error"), "run.kind", "run.rag_value", "run.detail_level", "run.notes", "run.raw_text")


def _refs(spark: SparkSession, folder: str) -> DataFrame:
    blocks = layout.blocks(_parsed(spark, folder), (layout.PARA,))
    return images.listing(images.image_refs(blocks, layout.spans(blocks)), pdf_of("doc_id"), F.regexp_extract("doc_id", "^(.*)/[^/]*$", 1))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "convert":
        options = {"backend": a.backend, "method": a.method, "lang": a.lang, "server_url": a.server_url, "seal_enable": not a.disable_seal, "formula_enable": not a.disable_formula}
        pdfs = files.pdf_files(spark, a.folder, a.limit)
        out = a.outdir.rstrip("/")
        there = a.resume and Path(out).exists()
        saved = conversion.saved_results(_parsed(spark, out)) if there else None
        cache = enrichment.load_cache(enrichment.read_cache(spark, out)) if there else None
        job = conversion.Conversion(_load(a.extractor), {k: v for k, v in options.items() if v is not None}, _models(a), rendering.FOR_RAG if a.with_image_understanding else rendering.RenderOptions(), out)
        made, new, failed = conversion.results(pdfs, job, saved, cache)
        bad = failed.orderBy("path").collect()
        for r in bad:
            print(f"failed: {r['path']}: {r['error']}")
        if bad and not a.keep_going:
            return 1
        # kept results are read from the files that are about to be written
        conversion.save(stored(made, "converted"), new, job.render, _load(a.html_converter) or rendering.pandoc())
        return int(bool(bad))
    if a.command == "render":
        preset = {"plain": rendering.RenderOptions(), "rag": rendering.FOR_RAG, "html": rendering.FOR_HTML}[a.preset]
        options = rendering.RenderOptions(**{**preset.__dict__, "detail": a.detail})
        md = rendering.document_markdown(rendering.page_markdown(layout.pages(_parsed(spark, a.folder)), options))
        if a.link_pdf:
            md = md.withColumn("markdown", rendering.with_pdf_link(F.col("markdown"), pdf_of("doc_id")))
        files.write_text_files(rendering.markdown_to_html(md, _load(a.html_converter) or rendering.pandoc()), a.outdir)
        return 0
    if a.command == "refs":
        refs = _refs(spark, a.folder)
        if a.list:
            wanted = files.text_list(spark, a.list).withColumnRenamed("value", "image_file_path")
            refs = images.in_list_order(wanted, refs)
        else:
            refs = refs.withColumn("place", F.struct("doc_id", "page_pos", "root", "child", "line_no", "span_no")).orderBy("place")
        if a.format == "json":
            refs.select(F.to_json(F.struct(*[c for c in refs.columns if c != "place"]), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(a.out)
        elif a.format == "txt":
            refs.select(F.col("image_file_path").alias("value")).write.mode("overwrite").text(a.out)
        else:
            numbered = refs if a.list else refs.withColumn("place", F.monotonically_increasing_id())
            files.write_lines(reports.contact_sheet(numbered, Path(a.folder).name).select("line"), a.out)
        return 0
    if a.command == "gold-report":
        scores = evaluation.scored(evaluation.labels(files.runs(spark, a.runs)), files.gold(spark, a.gold))
        metrics = evaluation.gold_metrics(scores)
        text = reports.gold_report(metrics, evaluation.confusions(scores))
        _write(a.out, text)
        if a.html:
            _write(a.html, reports.report_html(text))
        if a.charts:
            label = evaluation.variant_label(F.col("model"), F.col("thinking"), short=True)
            rows = metrics.select(label.alias("label"), "*").collect()
            _write(f"{a.charts}/cost.svg", reports.scatter_chart([(r["label"], r["avg_latency_sec"], r["avg_cost_usd"]) for r in rows], "latency and cost"))
            _write(f"{a.charts}/overall.svg", reports.bar_chart([(r["label"], [r["overall_score"]]) for r in rows], "overall score", ["overall"]))
            _write(f"{a.charts}/scores.svg", reports.bar_chart([(r["label"], [r["kind_accuracy"], r["rag_distance_score"], r["detail_distance_score"]]) for r in rows], "scores", ["kind", "rag", "detail"]))
        return 0
    if a.command == "understanding-report":
        runs = evaluation.labels(files.runs(spark, a.runs))
        ok = F.coalesce(F.col("status.ok"), F.lit(False))
        details = evaluation.value_counts(runs, F.when(ok, F.col("run.detail_level")))
        errors = evaluation.value_counts(runs, F.when(~ok, F.col("status.error")), most=5)
        _write(a.out, reports.understanding_report(evaluation.variant_summary(runs), details, errors))
        return 0
    if a.command in ("annotate", "view"):
        runs = files.only_model(files.runs(spark, a.runs), a.model, ok_only=a.command == "annotate")
        flat = _flat(runs)
        if a.command == "view":
            page = reports.result_viewer(flat, Path(a.runs).name)
        else:
            if a.seed:
                labels = evaluation.seed_overlay(flat.select("item_key", "kind", "rag_value", "detail_level", "notes"), files.gold(spark, a.seed))
                flat = flat.drop("kind", "rag_value", "detail_level", "notes").join(labels, "item_key")
            page = reports.annotation_page(flat, a.model)
        files.write_lines(page.select("line"), a.out)
        return 0
    summary, first = layout.validation_summary(layout.validation(_parsed(spark, a.folder)))
    n, failed = summary.head()
    print(f"files={n} failed={failed}")
    for r in first.collect():
        print(f"{r['doc_id']}: {r['problem']}")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
