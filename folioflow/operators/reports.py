"""Pages and reports over results.

Pages with a section for each item are frames of text lines in order, one row a section,
so a page of any length is written by the executors. Reports have a row for each model
variant; these few rows alone come to the driver.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import html_escaped, html_lines
from folioflow.operators import evaluation

FIELDS = tuple("pdf_path layout_path page_idx block_index block_type image_path caption nearby_text_before nearby_text_after section_title".split())
_HEAD = '<!doctype html>\n<html lang="ja"><head><meta charset="utf-8"><title>{0}</title><style>section{{border-bottom:1px solid #bbb;margin:2em}}img{{max-width:50vw}}b{{margin-right:.5em}}</style></head><body><h1>{0}</h1>'
_TAIL = "</body></html>"


def _page(sections: DataFrame, title: str) -> DataFrame:
    """(place, line) from (place, line): a head ahead of the sections and a tail behind."""
    spark = sections.sparkSession
    edge = spark.createDataFrame([(None, _HEAD.format(html.escape(title))), (1 << 62, _TAIL)], "place long, line string")
    return edge.union(sections.select(F.col("place").cast("long"), "line")).orderBy(F.asc_nulls_first("place"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<div><b>{name}</b>"), value, F.lit("</div>"))


def _link(href: Column, shown: Column) -> Column:
    return F.concat(F.lit('<a target="_blank" rel="noopener noreferrer" href="'), html_escaped(href), F.lit('">'), html_escaped(shown), F.lit("</a>"))


def _fields(refs: DataFrame) -> list[Column]:
    out = []
    for name in FIELDS:
        if name not in refs.columns:
            continue
        c = F.col(name).cast("string")
        if name == "pdf_path":
            value = _link(F.concat(c, F.lit("#page="), F.coalesce(F.col("page_idx") + 1, F.lit(1)).cast("string")), c)
        else:
            value = _link(c, c) if name == "layout_path" else html_lines(c)
        out.append(_field(name, F.coalesce(value, F.lit(""))))
    return out


def _picture(refs: DataFrame) -> Column:
    src = F.col("image_file_path" if "image_file_path" in refs.columns else "image_path")
    return F.concat(F.lit('<img src="'), html_escaped(src), F.lit('" alt="'), html_escaped("image_path"), F.lit('">'))


def contact_sheet(refs: DataFrame, title: str) -> DataFrame:
    """A section for each reference (with ``place``), its fields in a fixed order and its image."""
    number = F.concat(F.lit("<section><h2>"), (F.col("place") + 1).cast("string"), F.lit("</h2>"))
    return _page(refs.select("place", F.concat(number, *_fields(refs), _picture(refs), F.lit("</section>")).alias("line")), title)


def result_viewer(runs: DataFrame, title: str) -> DataFrame:
    """A section for each run (with ``place``): fields, image, model, status, latency, and what the model answered; the models are listed first."""
    models = runs.agg(F.array_join(F.sort_array(F.collect_set("model")), ", ")).head()[0] or ""
    status = F.when(F.col("ok"), "ok").otherwise(F.concat(F.lit("failed: "), F.coalesce("error", F.lit(""))))
    more = [_field("model", html_lines("model")), _field("status", html_lines(status)), _field("latency", F.coalesce(F.format_string("%.2fs", "latency_sec"), F.lit("-")))]
    answer = F.concat(F.lit("<pre>"), F.coalesce(html_escaped("raw_text"), F.lit("-")), F.lit("</pre>"))
    return _page(runs.select("place", F.concat(F.lit("<section>"), *_fields(runs), _picture(runs), *more, answer, F.lit("</section>")).alias("line")), f"{title}: {models}")


def annotation_page(items: DataFrame, title: str) -> DataFrame:
    """A form for each item (with ``place`` and item_key) with its labels as they stand; a button saves all as gold labels."""
    from folioflow.sources.layout import DOMAINS

    def choice(name: str) -> Column:
        options = [F.concat(F.lit("<option"), F.when(F.col(name) == v, " selected").otherwise(""), F.lit(f">{v}</option>")) for v in (*DOMAINS[name], *(("extract_text",) if name == "detail_level" else ()))]
        return F.concat(F.lit(f'<label>{name} <select data-f="{name}">'), *options, F.lit("</select></label>"))

    start = F.concat(F.lit('<section data-item="'), html_escaped("item_key"), F.lit('">'))
    notes = F.concat(F.lit('<textarea data-f="notes">'), F.coalesce(html_escaped("notes"), F.lit("")), F.lit("</textarea></section>"))
    form = items.select("place", F.concat(start, *_fields(items), _picture(items), choice("kind"), choice("rag_value"), choice("detail_level"), notes).alias("line"))
    save = (
        "<script>function gold(){const items=[...document.querySelectorAll('[data-item]')].map(s=>Object.assign({item_key:s.dataset.item},"
        "...[...s.querySelectorAll('[data-f]')].map(x=>({[x.dataset.f]:x.value}))));const a=document.createElement('a');"
        "a.href=URL.createObjectURL(new Blob([JSON.stringify({items})]));a.download='gold.json';a.click()}</script><button onclick=\"gold()\">save</button>"
    )
    last = items.sparkSession.createDataFrame([((1 << 62) - 1, save)], "place long, line string")
    return _page(form.select(F.col("place").cast("long").alias("place"), "line").union(last), title)


# numbers


def percent(x: float | None) -> str:
    return "-" if x is None else f"{100 * x:.1f}%"


def seconds(x: float | None) -> str:
    return "-" if x is None else f"{x:.2f}s"


def dollars(x: float | None) -> str:
    return "-" if x is None else f"${x:.4f}" if x < 0.01 else f"${x:.3f}"


# charts


def _svg(width: int, height: int, title: str, body: list[str]) -> str:
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" font-family="sans-serif" font-size="12">', f'<text x="{width // 2}" y="24" font-size="18" text-anchor="middle">{html.escape(title)}</text>', *body, "</svg>"])


def scatter_chart(points: list[tuple[str, float, float]], title: str, size: tuple[int, int] = (1000, 560)) -> str:
    """(label, x, y) points; axes from 0 to 8 % beyond the largest x and 15 % beyond the largest y; six grid lines each."""
    w, h, pad = *size, 60
    x1 = max((p[1] for p in points), default=0) * 1.08 or 1.0
    y1 = max((p[2] for p in points), default=0) * 1.15 or 1.0
    sx, sy = (lambda x: pad + x / x1 * (w - 2 * pad)), (lambda y: h - pad - y / y1 * (h - 2 * pad))
    body = []
    for i in range(6):
        x, y = x1 * i / 5, y1 * i / 5
        body += [f'<path stroke="#ddd" d="M{pad} {sy(y):.1f}H{w - pad}"/>', f'<text x="{pad - 6}" y="{sy(y):.1f}" text-anchor="end">{y:.4g}</text>', f'<text x="{sx(x):.1f}" y="{h - pad + 18}" text-anchor="middle">{x:.4g}</text>']
    for label, x, y in points:
        body += [f'<circle cx="{sx(x):.1f}" cy="{sy(y):.1f}" r="5" fill="#2f6db3"/>', f'<text x="{sx(x) + 8:.1f}" y="{sy(y) - 6:.1f}">{html.escape(label)}</text>']
    return _svg(w, h, title, body)


def bar_chart(rows: list[tuple[str, list[float]]], title: str, names: list[str], most: float = 1.0, width: int = 1100) -> str:
    """Horizontal bars: (label, values) rows, one bar for each name; a bar's width is its value's share of ``most``."""
    colors, bar, left = ("#4c78a8", "#f58518", "#54a24b"), 18, 320
    body, y = [], 44
    for label, values in rows:
        body.append(f'<text x="{left - 8}" y="{y + bar - 4}" text-anchor="end">{html.escape(label)}</text>')
        for k, v in enumerate(values):
            full = (width - left - 80) * v / most
            body += [f'<rect x="{left}" y="{y}" width="{full:.1f}" height="{bar - 3}" fill="{colors[k % 3]}"><title>{html.escape(names[k])}</title></rect>', f'<text x="{left + full + 5:.1f}" y="{y + bar - 5}">{v:.3f}</text>']
            y += bar
        y += 8
    return _svg(width, y + 20, title, body)


# reports


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(head), line(["---"] * len(head)), *map(line, rows)]


def gold_report(metrics: DataFrame, confusions: DataFrame, images: int = 3985) -> str:
    """Markdown of the gold evaluation: by score and by variant, the best and the fastest, confusions, and what ``images`` images would take.

    Reads one row for each variant, and five confusions for each, at most.
    """
    label = evaluation.variant_label(F.col("model"), F.col("thinking")).alias("label")
    rows = [r.asDict() for r in metrics.select("*", label, evaluation.thinking_rank(F.col("thinking")).alias("rank")).collect()]
    wrong: dict[str, list[str]] = {}
    for r in confusions.select("*", label).orderBy("model", "rank").collect():
        wrong.setdefault(r["label"], []).append(f"`{r['gold_kind']}` → `{r['kind']}` ({r['n']})")
    if not rows:
        return "# Image screening\n\nNo item was answered by every variant.\n"
    by_variant = sorted(rows, key=lambda r: (r["model"], r["rank"]))
    by_score = sorted(by_variant, key=lambda r: -r["overall_score"])
    fastest = min(by_variant, key=lambda r: r["avg_latency_sec"])
    out = ["# Image screening", "", f"Items: {rows[0]['items']}", "", f"Best: {by_score[0]['label']} ({by_score[0]['overall_score']:.3f})", f"Fastest: {fastest['label']} ({seconds(fastest['avg_latency_sec'])})", "", "## Scores", ""]
    out += _table(["variant", "overall", "kind", "rag score", "detail score", "all exact"], [[r["label"], f"{r['overall_score']:.3f}", percent(r["kind_accuracy"]), f"{r['rag_distance_score']:.3f}", f"{r['detail_distance_score']:.3f}", percent(r["all_exact_accuracy"])] for r in by_score])
    out += ["", "## Time and cost", ""]
    out += _table(["variant", "mean", "median", "an image", f"{images} images", "hours"], [[r["label"], seconds(r["avg_latency_sec"]), seconds(r["median_latency_sec"]), dollars(r["avg_cost_usd"]), f"${r['avg_cost_usd'] * images:.2f}", f"{r['avg_latency_sec'] * images / 3600:.1f}"] for r in by_variant])
    out += ["", "## Most frequent confusions", ""]
    out += _table(["variant", "gold → answer"], [[r["label"], "<br>".join(wrong.get(r["label"], ["-"]))] for r in by_variant])
    return "\n".join(out) + "\n"


def understanding_report(summary: DataFrame, details: DataFrame, errors: DataFrame) -> str:
    """Markdown of ``evaluation.variant_summary``: highlights, then a row for each variant with its detail levels and errors."""
    rows = [r.asDict() for r in summary.collect()]
    name = lambda r: f"{r['model']} [thinking={str(r['thinking']).lower() if r['thinking'] is not None else 'null'}]"
    counts: list[dict[str, list[str]]] = [{}, {}]
    for held, df in zip(counts, (details, errors)):
        for r in df.orderBy("rank").collect():
            held.setdefault(name(r), []).append(f"{r['value']} ({r['n']})")
    out = ["# Image descriptions", ""]
    if rows:
        best = max(rows, key=lambda r: (r["ok_rate"], -r["failed"]))
        timed = [r for r in rows if r["avg_latency_sec"] is not None]
        out += [f"Most reliable: {name(best)} ({percent(best['ok_rate'])})"]
        if timed:
            fast = min(timed, key=lambda r: r["avg_latency_sec"])
            out += [f"Fastest: {name(fast)} ({seconds(fast['avg_latency_sec'])})"]
        cheap = min(rows, key=lambda r: r["avg_cost_usd"])
        out += [f"Cheapest: {name(cheap)} ({dollars(cheap['avg_cost_usd'])})", ""]
    out += _table(
        ["variant", "runs", "ok", "failed", "rate", "mean", "median", "longest", "an image", "in all", "tokens in", "out", "detail", "errors"],
        [[name(r), str(r["total"]), str(r["ok"]), str(r["failed"]), percent(r["ok_rate"]), seconds(r["avg_latency_sec"]), seconds(r["median_latency_sec"]), seconds(r["max_latency_sec"]), dollars(r["avg_cost_usd"]), dollars(r["total_cost_usd"]), str(r["total_input_tokens"]), str(r["total_output_tokens"]), ", ".join(counts[0].get(name(r), ["-"])), "<br>".join(counts[1].get(name(r), ["-"]))] for r in rows],
    )
    return "\n".join(out) + "\n"


_BLOCK = re.compile(r"^(?:(?P<h>#{1,3}) (?P<title>.*)|- (?P<ul>.*)|\d+\. (?P<ol>.*)|!\[[^\]]*\]\((?P<img>.*)\)|(?P<row>\|.*))$")


def report_html(markdown: str, title: str = "report") -> str:
    """The reports' Markdown as HTML: headings, lists, tables, images and paragraphs, line by line."""
    out, now, rows = [], "", 0
    for line in [*markdown.splitlines(), ""]:
        m = _BLOCK.match(line)
        kind = m.lastgroup if m else ""
        kind = "h" if kind == "title" else kind
        if now and kind != now:
            out.append({"ul": "</ul>", "ol": "</ol>", "row": "</table>"}[now])
            now = ""
        if kind in ("ul", "ol", "row") and not now:
            out.append({"ul": "<ul>", "ol": "<ol>", "row": "<table>"}[kind])
            now, rows = kind, 0
        if kind == "h":
            n = len(m["h"])
            out.append(f"<h{n}>{html.escape(m['title'])}</h{n}>")
        elif kind in ("ul", "ol"):
            out.append(f"<li>{html.escape(m[kind])}</li>")
        elif kind == "img":
            out.append(f'<p><img src="{html.escape(m["img"])}" alt="chart"></p>')
        elif kind == "row":
            if rows != 1:
                tag = "td" if rows else "th"
                out.append("<tr>" + "".join(f"<{tag}>{c.strip()}</{tag}>" for c in line.strip("|").split("|")) + "</tr>")
            rows += 1
        elif line:
            out.append(f"<p>{line}</p>")
    return _HEAD.format(html.escape(title)) + "\n".join(out) + _TAIL
