"""More queries of the registry: rendering, conversion with stub models, requests, sinks and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import latex, text
from folioflow.operators import enrichment, evaluation, images, rendering, tables
from folioflow.plans import conversion
from folioflow.plans.registry import _CUT, _LINES, _MACRO_SQL, _MODELS, _SCORED, _gold, _layouts, _pick, _query, _read, _rounded, _spread, _sql_pick, event_runs
from folioflow.sources import files, layout

_ROOM = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# LaTeX

_TIGHT = r"regexp_replace(trim(regexp_replace('\alpha _ { i } ( 0 . 5 ) { a b c } ' || text, '\s+', ' ', 'g')), ' ?([_^{}()]) ?', '\1', 'g')"
for _ in range(2):  # what a match takes up can't begin the next
    _TIGHT = rf"regexp_replace({_TIGHT}, '([0-9.,]) ([0-9.,])', '\1\2', 'g')"
for _ in range(2):
    _TIGHT = rf"regexp_replace({_TIGHT}, '(\\[A-Za-z]+) ([^A-Za-z ])', '\1\2', 'g')"
_GROUP = r"'\{[A-Za-z0-9]( [A-Za-z0-9])+\}'"


@_query(rf"""
WITH x AS (SELECT doc_id, {_TIGHT} AS t FROM documents),
p AS (SELECT doc_id, string_split_regex(t, {_GROUP}) AS a, list_append(list_transform(regexp_extract_all(t, {_GROUP}), lambda g: replace(g, ' ', '')), '') AS b FROM x),
j AS (SELECT doc_id, array_to_string(list_transform(list_zip(a, b), lambda z: z[1] || z[2]), '') AS e FROM p)
SELECT doc_id, '$' || regexp_replace(regexp_replace({_MACRO_SQL}, '\{{\{{([^{{}}]+)\}}\}}', '{{\1}}', 'g'), '\{{([A-Za-z0-9])\}}', '\1', 'g') || '$' AS shown FROM j
""")
def latex_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents")
    return docs.select("doc_id", latex.math_text(F.concat(F.lit("\\alpha _ { i } ( 0 . 5 ) { a b c } "), "text"), True, False).alias("shown"))


# tables


@_query(r"""
SELECT c_custkey, chr(10) || '| a' || c_custkey || ' | ' || c_name || ' |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '|  | x\|y | ' || c_nationkey || ' |' || chr(10) || '| $\beta_1$ |  |  |' || chr(10) AS blank,
  chr(10) || '| a' || c_custkey || ' | ' || c_name || ' | ' || c_name || ' |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| a' || c_custkey || ' | x\|y | ' || c_nationkey || ' |' || chr(10) || '| $\beta_1$ |  |  |' || chr(10) AS repeated,
  '<table><tr><th rowspan="2">a' || c_custkey || '</th><th colspan="2"> ' || c_name || '</th></tr><tr><td>x|y</td><td rowspan="x">' || c_nationkey || '</td></tr><tr><td><eq> \beta _ 1 </eq></td></tr></table>' AS kept,
  '<table><tr><th rowspan="2">a' || c_custkey || '</th><th colspan="2"> ' || c_name || '</th></tr><tr><td>x|y</td><td rowspan="x">' || c_nationkey || '</td></tr><tr><td><span class="math inline">\(\beta _ 1\)</span></td></tr></table>' AS shown
FROM customer
""")
def spanning_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit('<table><tr><th rowspan="2">a'), F.col("c_custkey").cast("string"), F.lit('</th><th colspan="2"> '), F.col("c_name"), F.lit('</th></tr><tr><td>x|y</td><td rowspan="x">'), F.col("c_nationkey").cast("string"), F.lit("</td></tr><tr><td><eq> \\beta _ 1 </eq></td></tr></table>"))
    c = _spread(spark, sf_dir, "customer").select("c_custkey", html.alias("html"))
    made = c.select("c_custkey", "html", tables.html_tables_in_modes(F.col("html"), tables.MODES).alias("made"))
    return made.select("c_custkey", F.col("made.blank").alias("blank"), F.col("made.repeat").alias("repeated"), F.col("made.keep_html").alias("kept"), text.eq_to_mathjax("html").alias("shown"))


# rendering of every kind of block


def _line(*spans) -> F.Column:
    return F.array(F.struct(F.array(*[F.to_variant_object(s) for s in spans]).alias("spans")))


def _span(kind: str, **fields) -> F.Column:
    return F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in fields.items()])


def _block(kind: str, **fields) -> F.Column:
    return F.to_variant_object(F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in fields.items()]))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): a page of all kinds of blocks for each part."""
    lit, key, name = F.lit, F.col("p_partkey").cast("string"), F.col("p_name")
    words = lambda c: _span("text", content=c)
    of = lambda *spans: _line(*spans)
    known = F.struct(_pick(layout.DOMAINS["kind"], F.col("p_partkey")).alias("kind"), F.array(name, lit("k")).alias("keywords"), F.when(F.col("p_size") % 3 != 0, F.concat(lit("short <"), key, lit(">"))).alias("short_description"), F.when(F.col("p_size") % 2 == 0, F.concat(lit("long "), name)).alias("long_description"))
    described = F.struct(lit("image").alias("type"), F.concat(key, lit(".png")).alias("image_path"), known.alias("image_understanding"))
    blocks = [
        _block("doc_title", lines=of(words(name))),
        _block("title", level=F.col("p_size"), lines=of(words(key))),
        _block("text", lines=of(words(lit("see ")), _span("inline_equation", content=F.concat(lit("\\alpha _ "), F.col("p_size").cast("string"))), words(lit(" now ")))),
        _block("header", lines=of(words(lit("a header")))),
        _block("page_footnote", lines=of(words(F.concat(lit("note "), key)))),
        _block("list", blocks=F.array(_block("text", lines=of(words(name))), _block("text", lines=of(words(lit("two")))))),
        _block("code", guess_lang=lit("sql"), blocks=F.array(_block("code_caption", lines=of(words(F.concat(lit("code "), key)))), _block("code_body", lines=of(words(lit("select 1")))))),
        _block("interline_equation", lines=of(_span("interline_equation", content=F.concat(lit("x ^ { "), key, lit(" }")), image_path=F.concat(key, lit("-eq.png"))))),
        _block("equation", lines=of(_span("text", image_path=F.concat(key, lit("-only.png"))))),
        _block("image", blocks=F.array(_block("image_body", lines=of(described)), _block("image_caption", lines=of(words(F.concat(lit("caption of "), name)))))),
        _block("table", blocks=F.array(_block("table_caption", lines=of(words(lit("a table")))), _block("table_body", lines=of(_span("table", html=F.concat(lit("<table><tr><td>"), key, lit("</td></tr></table>"))))))),
        _block("something", lines=of(words(lit("other"))), blocks=F.array(_block("text", lines=of(words(key))))),
    ]
    page = F.struct(lit(0).alias("page_idx"), F.array(lit(9), lit(9)).alias("page_size"), F.array(*blocks).alias("para_blocks"), F.array(_block("aside_text", lines=of(words(lit("aside"))))).alias("discarded_blocks"))
    return _spread(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.to_json(F.struct(F.array(page).alias("pdf_info"))).alias("raw"))


_G = "chr(10) || chr(10)"
_LINK = "'<span class=\"source-image-link-row\"><a href=\"images/' || {0} || '\" class=\"source-image-link\">👁️‍🗨️</a></span>'"
_TABLE_MD = "'|  |' || chr(10) || '| --- |' || chr(10) || '| ' || k || ' |' || chr(10)"
_WHAT = "coalesce(CASE WHEN p_size % 2 = 0 THEN 'long ' || p_name END, CASE WHEN p_size % 3 <> 0 THEN 'short <' || k || '>' END)"
_ESCAPED = "replace(replace(" + _WHAT + ", '<', '&lt;'), '>', '&gt;')"


def _rendered_sql(rag: bool, html: bool) -> str:
    alpha = "α" if rag or html else "\\alpha"
    link = lambda path: "" if rag else " || chr(10) || " + _LINK.format(path)
    if rag:
        image = f"coalesce('<image_summary>' || chr(10) || 'kind=' || kind || chr(10) || 'keywords=\"' || p_name || ', k\"' || chr(10) || 'description: ' || {_WHAT} || chr(10) || '</image_summary>' || {_G}, '')"
    elif html:
        image = f"'![](images/' || k || '.png)' || {_G} || coalesce('<div class=\"image-understanding image-understanding--long\"><strong>' || kind || ' 画像:</strong> ' || {_ESCAPED} || '</div>' || {_G}, '')"
    else:
        image = "''"
    power = "CASE WHEN length(k) = 1 THEN 'x^' || k ELSE 'x^{' || k || '}' END" if rag or html else "'x^{' || k || '}'"
    parts = [
        f"'# ' || p_name || {_G}",
        f"repeat('#', least(greatest(p_size, 1), 6)::INTEGER) || ' ' || k || {_G}",
        f"'see ${alpha}_' || p_size || '$ now' || {_G}",
        f"'note ' || k || {_G}",
        f"'- ' || p_name || chr(10) || '- two' || {_G}",
        f"'```sql' || chr(10) || 'select 1' || chr(10) || '```' || {_G} || 'code ' || k || {_G}",
        f"'$$' || chr(10) || {power} || chr(10) || '$$'{link('k || ' + repr('-eq.png'))} || {_G}",
        f"'![equation](' || k || '-only.png)' || {_G}",
        f"{image} || 'caption of ' || p_name || {_G}",
        f"{_TABLE_MD} || {_G} || 'a table' || {_G}",
        f"'other' || {_G} || k",
    ]
    return " || ".join(parts)


@_query(f"""
WITH p AS (SELECT p_partkey AS doc_id, p_partkey::VARCHAR AS k, p_name, p_size, {_sql_pick(layout.DOMAINS["kind"], "p_partkey")} AS kind FROM part)
SELECT doc_id, {_rendered_sql(False, False)} AS plain, {_rendered_sql(True, False)} AS rag, {_rendered_sql(False, True)} AS html,
  '[original PDF](x/' || k || '.pdf)' || {_G} || '# ' || p_name AS linked FROM p
""")
def rendered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = layout.pages(layout.parsed(part_pages(spark, sf_dir)))
    options = {"plain": rendering.RenderOptions(), "rag": rendering.FOR_RAG, "html": rendering.FOR_HTML}
    shown = rendering.document_markdown(rendering.page_markdowns(pages, options), tuple(options))
    title = F.substring_index("plain", "\n", 1)
    return shown.withColumn("linked", rendering.with_pdf_link(title, F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit(".pdf"))))


# conversion with stub models


def _extract(raw: bytes, options: dict) -> str:
    lines = [x for x in raw.decode().split("\n") if x.strip(" \t\r\x0b\x0c")]
    page = {"page_idx": 0, "page_size": [9, 9], "para_blocks": [{"type": "text", "lines": [{"spans": [{"type": "text", "content": x}]}]} for x in lines]}
    for i in range(2):
        body = {"type": "image_body", "lines": [{"spans": [{"type": "image", "image_path": f"{len(lines) + i}.png"}]}]}
        page["para_blocks"].append({"type": "image", "index": 100 + i, "blocks": [body]})
    page["discarded_blocks"] = [{"type": "page_number", "lines": [{"spans": [{"type": "text", "content": "7"}]}]}]
    return json.dumps({"pdf_info": [page]})


def _screen(row: dict) -> str:
    n = int(row["image_path"][:-4])
    return json.dumps({"kind": "seal", "rag_value": "low", "detail_level": "skip" if n % 2 else "short", "notes": "no"})


def _understand(row: dict) -> str:
    return json.dumps({"keywords": ["k"], "short_description": "seen " + row["image_path"]})


_STUBS = conversion.Models(_screen, _understand, '{"model":"a","thinking":false}', '{"model":"b","thinking":false}')


@_query(f"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, {_ROOM}) <> '') AS ls FROM documents),
m AS (SELECT doc_id, len(ls) AS n, len(ls) + len(ls) % 2 AS seen, list_transform(ls, lambda x: trim(x, {_ROOM})) AS ls FROM l)
SELECT doc_id, array_to_string(list_append(ls, '<image_summary>' || chr(10) || 'kind=seal' || chr(10) || 'keywords="k"' || chr(10) || 'description: seen ' || seen || '.png' || chr(10) || '</image_summary>'), {_G}) AS markdown,
  'pipeline' AS extracted_by, 'b' AS model, n + 2 AS blocks FROM m
""")
def converted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as files: extraction, merge, screening and description by stubs, embedding, Markdown for retrieval."""
    docs = _spread(spark, sf_dir, "documents")
    pdfs = docs.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.col("text").cast("binary").alias("content"), F.sha2("text", 256).alias("sha256"))
    made, _, _ = conversion.results(pdfs, conversion.Conversion(_extract, models=_STUBS, outdir="/out"))
    md = conversion.markdown(made, rendering.FOR_RAG)
    blocks = layout.pages(layout.parsed(made)).select("doc_id", F.size(F.try_variant_get("page", "$.para_blocks", "array<variant>")).cast("long").alias("blocks"))
    key = F.regexp_extract("doc_id", "([0-9]+)[.]pdf$", 1).cast("long")
    return made.join(md, "doc_id").join(blocks, "doc_id").select(key.alias("doc_id"), "markdown", "extracted_by", F.col("parameters.image_understanding_model").alias("model"), "blocks")


@_query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'kept' WHEN 2 THEN 'extraction kept' ELSE 'extracted' END AS way FROM documents
""")
def reused_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of earlier results each document can keep: all, the extraction where images alone differ, or nothing."""
    docs = _read(spark, sf_dir, "documents")
    params = lambda lang, with_images: F.struct(F.sha2("text", 256).alias("source_checksum"), F.lit(None).cast("string").alias("backend"), F.lit(None).cast("string").alias("method"), lang.alias("lang"), F.lit(True).alias("seal_enable"), F.lit(True).alias("formula_enable"), with_images.alias("with_image_understanding"), F.when(with_images, "m").alias("image_screening_model"), F.when(with_images, "n").alias("image_understanding_model"))
    i = F.col("doc_id") % 4
    wanted = docs.select("doc_id", F.col("doc_id").cast("string").alias("source_path"), params(F.col("lang"), F.lit(True)).alias("parameters"))
    saved = docs.select(F.col("doc_id").cast("string").alias("source_path"), params(F.when(i == 3, "other").otherwise(F.col("lang")), i != 2).alias("parameters"), F.lit("{}").alias("raw"))
    ways = conversion.reuse(wanted, saved)
    out = None
    for way, df in zip(("kept", "extraction kept", "extracted"), ways):
        part = df.select("doc_id", F.lit(way).alias("way"))
        out = part if out is None else out.union(part)
    return out


# references of images with captions


@_query(f"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), {_ROOM}) AS t, lang, source FROM documents)
SELECT doc_id, '/x/f' || doc_id || '.pdf' AS pdf_path, '/x/__data/f' || doc_id || '.pdf/images/' || doc_id || '.png' AS image_file_path, 4 AS page_number, '/x/f' || doc_id || '.pdf#page=4' AS pdf_link,
  7 AS block_index, 'chart' AS block_type, source || chr(10) || 'more' AS caption, lang AS section_title, nullif({_CUT.format("t")}, '') AS nearby_text_before, CASE WHEN doc_id % 2 = 0 THEN 'behind' END AS nearby_text_after FROM d
""")
def image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents")
    words = lambda c: F.array(F.struct(F.array(F.struct(F.lit("text").alias("type"), c.alias("content"))).alias("spans")))
    block = lambda kind, **f: F.to_variant_object(F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in f.items()]))
    body = block("chart_body", lines=F.array(F.struct(F.array(F.struct(F.lit("chart").alias("type"), F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("image_path"))).alias("spans"))))
    chart = block("chart", index=F.lit(7), blocks=F.array(body, block("chart_caption", lines=words(F.col("source"))), block("caption", lines=words(F.lit("more ")))))
    listed = F.array(block("title", lines=words(F.col("lang"))), block("text", lines=words(F.col("text"))), chart, block(
        "text", lines=words(F.when(F.col("doc_id") % 2 == 0, "behind").otherwise(""))))
    page = F.struct(F.lit(3).alias("page_idx"), F.array(F.lit(1), F.lit(1)).alias("page_size"), listed.alias("para_blocks"))
    name = F.concat(F.lit("/x/__data/f"), F.col("doc_id").cast("string"), F.lit(".pdf/middle.json"))
    blocks = layout.blocks(layout.parsed(docs.select(name.alias("doc_id"), F.to_json(F.struct(F.array(page).alias("pdf_info"))).alias("raw"))), (layout.PARA,))
    refs = images.listing(images.image_refs(blocks, layout.spans(blocks)), text.pdf_of("doc_id"), F.regexp_extract("doc_id", "^(.*)/[^/]*$", 1))
    return refs.select(F.regexp_extract("doc_id", "/f([0-9]+)", 1).cast("long").alias("doc_id"), "pdf_path", "image_file_path", "page_number", "pdf_link", "block_index", "block_type", "caption", "section_title", "nearby_text_before", "nearby_text_after")


@_query("""
WITH r AS (SELECT 'f' || (o_custkey % 50) AS f, o_orderkey FROM orders)
SELECT k::INTEGER AS place, 'f' || (49 - k) AS image_file_path, max(o_orderkey) AS last FROM (SELECT unnest(range(50)) AS k) JOIN r ON f = 'f' || (49 - k) GROUP BY k
""")
def listed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of files in its order, each with its last reference."""
    o = _read(spark, sf_dir, "orders")
    refs = o.select(F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("image_file_path"), F.col("o_orderkey").alias("doc_id"), *[F.lit(0).alias(c) for c in ("page_pos", "root", "child", "line_no", "span_no")])
    wanted = spark.range(50).select(F.col("id").cast("int").alias("place"), F.concat(F.lit("f"), (49 - F.col("id")).cast("string")).alias("image_file_path"))
    wanted = wanted.join(refs.select("image_file_path").distinct(), "image_file_path")
    return images.in_list_order(wanted, refs).select("place", "image_file_path", F.col("doc_id").alias("last"))


# texts and fields of layouts


@_query(f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(ls, lambda x: x <> ''), '//'), '[ \\t]+', ' ', 'g'), {_ROOM}) AS slashed, trim(regexp_replace(array_to_string(ls, chr(10)), '[ \\t]+', ' ', 'g'), {_ROOM}) AS lined,
  CASE WHEN doc_id % 3 <> 0 THEN '<table>' || doc_id || '</table>' END AS table_html FROM d
""")
def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block's lines joined, contents being texts or lists of texts, and the first table on the way down."""
    docs = _spread(spark, sf_dir, "documents")
    half = lambda x: F.array(F.substring(x, F.lit(1), F.floor(F.length(x) / 2).cast("int")), F.substring(x, F.floor(F.length(x) / 2).cast("int") + 1, F.length(x)))
    line = lambda x, i: F.struct(F.array(F.when(i % 2 == 0, F.to_variant_object(F.struct(F.lit("text").alias("type"), x.alias("content")))).otherwise(F.to_variant_object(F.struct(F.lit("text").alias("type"), half(x).alias("content"))))).alias("spans"))
    lines = F.transform(F.split("text", "\n"), line)
    table = F.struct(F.lit("table_body").alias("type"), F.array(F.struct(F.array(F.struct(F.lit("table").alias("type"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("<table>"), F.col("doc_id").cast("string"), F.lit("</table>"))).alias("html"))).alias("spans"))).alias("lines"))
    block = F.struct(F.lit("table").alias("type"), lines.alias("lines"), F.array(table).alias("blocks"))
    raw = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("page_idx"), F.array(F.lit(1), F.lit(1)).alias("page_size"), F.array(block).alias("para_blocks"))).alias("pdf_info")))
    parsed = layout.parsed(docs.select("doc_id", raw.alias("raw")))
    blocks = layout.blocks(parsed, (layout.PARA,))
    texts = blocks.filter("depth = 0").select("doc_id", text.normalize(layout.slashed_text(F.col("block"))).alias("slashed"), text.normalize(layout.lined_text(F.col("block"))).alias("lined"))
    return texts.join(layout.first_of(layout.spans(blocks), "html").select("doc_id", F.col("value").alias("table_html")), "doc_id", "left")


@_query("""
SELECT doc_id, '/p/' || doc_id AS source_path, 'vlm:x' AS extracted_by, lang AS language, doc_id % 2 = 0 AS seal, lang AS backend, source AS version, doc_id % 3 = 0 AS ocr, doc_id::INTEGER AS first_head FROM documents
""")
def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    head = F.create_map(F.lit("head"), i.cast("int"))
    middle = F.struct(F.array().cast("array<string>").alias("pdf_info"), F.col("lang").alias("_backend"), F.col("source").alias("_version_name"), (i % 3 == 0).alias("_ocr_enable"), head.alias("_header_text_first_page"), F.lit("kept").alias("unknown"))
    parameters = F.struct(F.col("lang").alias("lang"), (i % 2 == 0).alias("seal_enable"), F.lit(True).alias("formula_enable"))
    raw = F.to_json(F.struct(middle.alias("middle"), F.concat(F.lit("/p/"), i.cast("string")).alias("source_path"), F.lit("vlm:x").alias("extracted_by"), parameters.alias("parameters")))
    d = layout.documents(layout.parsed(_read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))))
    return d.select("doc_id", "source_path", "extracted_by", F.col("parameters.lang").alias("language"), F.col("parameters.seal_enable").alias("seal"), "backend", F.col("version_name").alias("version"), F.col("ocr_enable").alias("ocr"), F.col("header_first")["head"].alias("first_head"))


@_query("""
WITH b AS (SELECT doc_id, doc_id % 7 = 0 AS bad FROM documents)
SELECT count(*) AS files, count(*) FILTER (bad) AS failed, (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM b WHERE bad ORDER BY doc_id LIMIT 10)) AS shown FROM b
""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many layouts fail, and the first ten: the report's own limit."""
    raw = _layouts(spark, sf_dir).withColumn("raw", F.when(F.col("doc_id") % 7 == 0, F.replace("raw", F.lit('"page_idx":0'), F.lit('"page_idx":"x"'))).otherwise(F.col("raw")))
    counts, first = layout.validation_summary(layout.validation(layout.parsed(raw)))
    shown = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("shown"))
    return counts.crossJoin(F.broadcast(shown))  # one row each


# requests, usage, prompts


@_query(f"""
WITH r AS (SELECT doc_id, {_sql_pick(_MODELS, "doc_id")} AS m, doc_id % 2 = 0 AS t, text FROM documents)
SELECT doc_id, m AS model, 'screening' AS schema_name, 'true' AS strict, 'high' AS first_rag, 'P' AS prompt, text AS context, 'data:image/png;base64,' || doc_id AS url,
  CASE WHEN m LIKE 'gpt-5%' THEN CASE WHEN t THEN 'low' WHEN m LIKE 'gpt-5.4%' THEN 'none' ELSE 'minimal' END END AS effort, CASE WHEN m LIKE 'Qwen/%' OR m LIKE 'google/gemma-4%' THEN t::VARCHAR END AS template FROM r
""")
def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    body = enrichment.request(_pick(_MODELS, F.col("doc_id")), F.col("doc_id") % 2 == 0, F.lit("P"), F.col("text"), F.concat(F.lit("data:image/png;base64,"), F.col("doc_id").cast("string")), F.lit("screening"), enrichment.SCREENING_SCHEMA)
    r = docs.select("doc_id", F.parse_json(body).alias("v"))
    get = lambda path: F.try_variant_get("v", path, "string")
    form = "$.response_format.json_schema"
    return r.select("doc_id", get("$.model").alias("model"), get(f"{form}.name").alias("schema_name"), get(f"{form}.strict").alias("strict"), get(f"{form}.schema.properties.rag_value.enum[0]").alias("first_rag"), get("$.messages[0].content[0].text").alias("prompt"), get("$.messages[1].content[0].text").alias("context"), get("$.messages[1].content[1].image_url.url").alias("url"), get("$.reasoning_effort").alias("effort"), get("$.extra_body.chat_template_kwargs.enable_thinking").alias("template"))


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 900 END AS input_tokens, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderkey % 70 END AS output_tokens, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5000 END AS total_tokens FROM orders
""")
def usage_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    usage = F.struct((k % 900).alias("prompt_tokens"), F.when(k % 3 != 0, k % 70).alias("completion_tokens"), (k % 5000).alias("total_tokens"))
    body = F.parse_json(F.to_json(F.struct(F.lit("x").alias("id"), F.when(k % 4 != 0, usage).alias("usage"))))
    return _read(spark, sf_dir, "orders").select("o_orderkey", enrichment.usage_of(body).alias("u")).select("o_orderkey", "u.*")


_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
_HEADS = "CASE d " + " ".join(f"WHEN '{k}' THEN {_QUOTED(v)}" for k, v in enrichment.PROMPTS.items()) + f" ELSE {_QUOTED(enrichment.DEFAULT_PROMPT)} END"
_GUIDES = "CASE k " + " ".join(f"WHEN '{k}' THEN {_QUOTED(v)}" for k, v in enrichment.GUIDANCE.items()) + f" ELSE {_QUOTED(enrichment.DEFAULT_GUIDANCE)} END"


@_query(f"""
SELECT p_partkey, {_HEADS} || chr(10) || {_GUIDES} AS prompt FROM (SELECT p_partkey, {_sql_pick(layout.DOMAINS["kind"], "p_partkey")} AS k, {_sql_pick(layout.DOMAINS["detail_level"], "p_size")} AS d FROM part)
""")
def understanding_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", enrichment.understanding_prompt(_pick(layout.DOMAINS["kind"], F.col("p_partkey")), _pick(layout.DOMAINS["detail_level"], F.col("p_size"))).alias("prompt"))


# sinks and reports


@_query("""
SELECT c_custkey, '{"c_custkey":' || c_custkey || CASE WHEN c_nationkey <> 0 THEN ',"c_nationkey":' || c_nationkey ELSE '' END || CASE WHEN c_custkey % 3 <> 0 THEN ',"c_name":"' || c_name || '"' ELSE '' END || '}' AS line FROM customer
""")
def json_without_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"))
    return c.select("c_custkey", files.to_json(c, {"c_nationkey": 0}).alias("line"))


@_query(f"""
WITH {_SCORED}, m AS (SELECT model, thinking, avg(latency) AS lat, avg(coalesce(cost, 0.0)) AS usd,
  0.4::DOUBLE * avg((kind = gold_kind)::INTEGER) + 0.3::DOUBLE * avg(1 - abs(rag - gold_rag) / 3.0::DOUBLE) + 0.3::DOUBLE * avg(1 - abs(detail - gold_detail) / 3.0::DOUBLE) AS overall FROM s GROUP BY model, thinking),
o AS (SELECT *, CASE WHEN thinking IS NULL THEN 0 WHEN NOT thinking THEN 1 ELSE 2 END AS t FROM m)
SELECT model, thinking, CASE WHEN thinking IS NULL THEN model ELSE model || ' [thinking=' || thinking || ']' END AS label, round(lat * 3985 / 3600, 6) AS hours, round(usd * 3985, 6) AS usd,
  row_number() OVER (ORDER BY overall DESC, model, t) = 1 AS best, row_number() OVER (ORDER BY lat, model, t) = 1 AS fastest FROM o
""")
def extrapolations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each variant would take for a whole corpus, and which is best and which is fastest."""
    metrics = evaluation.gold_metrics(evaluation.scored(event_runs(spark, sf_dir), _gold(spark, sf_dir)))
    top = F.broadcast(evaluation.highlights(metrics))  # one row
    label = evaluation.variant_label(F.col("model"), F.col("thinking"))
    is_it = lambda c: (F.col("model") == F.col(f"{c}.model")) & F.col("thinking").eqNullSafe(F.col(f"{c}.thinking"))
    got = _rounded(evaluation.extrapolated(metrics)).crossJoin(top)
    return got.select("model", "thinking", label.alias("label"), "hours", "usd", is_it("best").alias("best"), is_it("fastest").alias("fastest"))


@_query(f"""
WITH {_LINES}, p AS (SELECT doc_id, i, j, length(part) || '.png' AS image_path FROM kids)
SELECT doc_id, count(*) AS spans, count(DISTINCT image_path) AS paths, max(i)::INTEGER AS last_root FROM p GROUP BY doc_id
""")
def spans_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = layout.spans(layout.blocks(layout.parsed(_layouts(spark, sf_dir)), (layout.PARA,))).filter("image_path is not null")
    return s.groupBy("doc_id").agg(F.count("*").alias("spans"), F.count_distinct("image_path").alias("paths"), F.max(F.get("path", 0)).alias("last_root"))
