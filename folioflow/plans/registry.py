"""Named queries over a folder of tables, and the SQL that says the same.

The tables hold no layout documents, so queries build some from what there is: the lines
of ``documents`` become blocks of pages of twelve, and ``events`` become model runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import latex, text
from folioflow.operators import enrichment, evaluation, images, merging, rendering, tables
from folioflow.sources import layout

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of columns, uncompressed, for which a spread table has a partition, if these are more than the cores.
_SPREAD_BYTES = 32 << 20


def _row_groups(spark: SparkSession, names: list[str]) -> tuple[list[int], int]:
    """(rows of each row group, bytes of all) of Parquet files, by their footers."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows, size = [], 0
    for name in names:
        found = jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter(conf, jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))).getBlocks()
        for g in found:
            rows.append(g.getRowCount())
            size += g.getTotalByteSize()
    return rows, size


def _spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table for work that costs much more than reading it: where its row groups, which one task reads each, leave cores idle, it is spread over them.

    Partitions don't tell: a file of one row group is cut into many, of which one has all rows.
    A table of many files is never shuffled.
    """
    df, cores = _read(spark, sf_dir, table), spark.sparkContext.defaultParallelism
    names = df.inputFiles()
    if len(names) >= 4 * cores:
        return df
    rows, size = _row_groups(spark, names)
    if sum(rows) >= cores * max(rows, default=0):
        return df
    return df.repartition(max(cores, -(-size // _SPREAD_BYTES)))


# layout blocks out of lines

PAGE_LINES = 12


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level blocks: doc_id, page_pos, page_idx, section, root, type, text, bbox."""
    lines = _spread(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    at = F.col("i") % PAGE_LINES
    kind = F.when(at == 0, "title").when(at.isin(3, 8), "image").when(at == 9, "aside_text").when(at == 10, "header").when(at == 11, "footer").otherwise("text")
    box = F.struct((at * 7 % 5 * 20.0).alias("x0"), (at * 11 % 12 * 10.0).alias("y0"), (at * 7 % 5 * 20.0 + 15).alias("x1"), (at * 11 % 12 * 10.0 + 8).alias("y1"))
    page = F.floor(F.col("i") / PAGE_LINES).cast("int")
    return lines.select("doc_id", page.alias("page_pos"), page.alias("page_idx"), F.when(at >= 9, layout.DISCARDED).otherwise(layout.PARA).alias("section"), F.when(at >= 9, at - 9).otherwise(at).alias("root"), kind.alias("type"), text.normalize("line", unicode_forms=False).alias("text"), F.when(at != 5, box).alias("bbox"))


_BLOCKS = r"""
lines AS (SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
b AS (SELECT doc_id, i // 12 AS page, CASE WHEN i % 12 >= 9 THEN 1 ELSE 0 END AS section, CASE WHEN i % 12 >= 9 THEN i % 12 - 9 ELSE i % 12 END AS root,
  CASE WHEN i % 12 = 0 THEN 'title' WHEN i % 12 IN (3, 8) THEN 'image' WHEN i % 12 = 9 THEN 'aside_text' WHEN i % 12 = 10 THEN 'header' WHEN i % 12 = 11 THEN 'footer' ELSE 'text' END AS type,
  trim(regexp_replace(line, '[ \t]+', ' ', 'g')) AS text, i % 12 <> 5 AS has_box,
  ((i % 12) * 7 % 5) * 20.0 AS x0, ((i % 12) * 11 % 12) * 10.0 AS y0, ((i % 12) * 7 % 5) * 20.0 + 15 AS x1, ((i % 12) * 11 % 12) * 10.0 + 8 AS y1
  FROM lines)
"""

_CUT = "CASE WHEN length({0}) <= 300 THEN {0} ELSE regexp_replace(substr({0}, 1, 299), '\\s+$', '') || '…' END"


@_query(f"""
WITH {_BLOCKS},
img AS (SELECT doc_id, page, root FROM b WHERE section = 0 AND type = 'image'),
near AS (SELECT i.doc_id, i.page, i.root, max(CASE WHEN b.type = 'title' AND b.text <> '' THEN b.root END) AS t, max(CASE WHEN b.type = 'text' THEN b.root END) AS c
  FROM img i LEFT JOIN b ON b.doc_id = i.doc_id AND b.page = i.page AND b.section = 0 AND b.root < i.root GROUP BY ALL),
ctx AS (
  SELECT n.doc_id, n.page, n.root, 'a' AS side, b.root AS r, b.text FROM near n JOIN b ON b.doc_id = n.doc_id AND b.page = n.page AND b.section = 0 AND b.root < n.root AND b.type = 'text' AND b.text <> ''
    AND b.root >= CASE WHEN t IS NULL OR c IS NULL THEN -1 ELSE least(t, c) END
  UNION ALL
  SELECT n.doc_id, n.page, n.root, 'z', b.root, b.text FROM near n JOIN b ON b.doc_id = n.doc_id AND b.page = n.page AND b.section = 0 AND b.root > n.root AND b.type = 'text' AND b.text <> ''),
cum AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, page, root, side ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM ctx),
j AS (SELECT doc_id, page, root, side, string_agg(text, chr(10) ORDER BY r) AS s FROM cum WHERE had < 200 GROUP BY ALL),
t AS (SELECT n.doc_id, n.page, n.root, b.text AS title FROM near n LEFT JOIN b ON b.doc_id = n.doc_id AND b.page = n.page AND b.section = 0 AND b.root = n.t)
SELECT t.doc_id, t.page::INTEGER AS page_pos, t.root::INTEGER AS root, {_CUT.format("t.title")} AS section_title, {_CUT.format("x.s")} AS text_before, {_CUT.format("y.s")} AS text_after
FROM t LEFT JOIN j x ON x.doc_id = t.doc_id AND x.page = t.page AND x.root = t.root AND x.side = 'a' LEFT JOIN j y ON y.doc_id = t.doc_id AND y.page = t.page AND y.root = t.root AND y.side = 'z'
""")
def reading_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = images.reading_context(images.page_arrays(line_blocks(spark, sf_dir)))
    return got.select("doc_id", "page_pos", F.col("root").cast("int").alias("root"), "section_title", "text_before", "text_after")


@_query(f"""
WITH {_BLOCKS}
SELECT doc_id, type AS kind, text, min(page)::INTEGER AS first_page FROM b WHERE type IN ('header', 'footer') AND text <> '' GROUP BY doc_id, type, text
""")
def first_header_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.first_pages(line_blocks(spark, sf_dir))


_MERGED = f"""
{_BLOCKS},
firsts AS (SELECT doc_id, type, text, min(page) AS first_page FROM b WHERE type IN ('header', 'footer') AND text <> '' GROUP BY doc_id, type, text),
d AS (SELECT b.*, regexp_replace(b.text, '\\s+', '', 'g') AS bare, coalesce(f.first_page < b.page, false) AS again FROM b LEFT JOIN firsts f ON f.doc_id = b.doc_id AND f.type = b.type AND f.text = b.text WHERE section = 1),
main AS (SELECT * FROM b WHERE section = 0),
n AS (SELECT doc_id, page, count(*) AS n FROM main GROUP BY ALL),
kept AS (SELECT d.* FROM d JOIN n ON n.doc_id = d.doc_id AND n.page = d.page WHERE bare <> '' AND CASE type
  WHEN 'header' THEN length(bare) > 1 AND NOT again
  WHEN 'footer' THEN NOT (regexp_matches(bare, '^<?[0-9]{{1,3}}>?') OR regexp_matches(lower(bare), 'allrightsreserved|^copyright') OR again OR length(bare) <= 1)
  ELSE length(bare) > 3 AND NOT regexp_matches(bare, '^([0-9]+//){{5}}') END),
gap AS (SELECT k.doc_id, k.page, k.root, n.n, unnest(generate_series(0, n.n)) AS g FROM kept k JOIN n ON n.doc_id = k.doc_id AND n.page = k.page),
cost AS (SELECT g.doc_id, g.page, g.root, g.g, g.g = 0 OR g.g = g.n AS edge,
  CASE WHEN l.has_box AND r.has_box THEN
    sqrt(power(greatest(0.0, k.x0 - l.x1, l.x0 - k.x1), 2) + power(greatest(0.0, k.y0 - l.y1, l.y0 - k.y1), 2)) + sqrt(power(greatest(0.0, k.x0 - r.x1, r.x0 - k.x1), 2) + power(greatest(0.0, k.y0 - r.y1, r.y0 - k.y1), 2))
  WHEN g.g = g.n THEN 0.0 ELSE 1e300 END AS cost
  FROM gap g JOIN kept k ON k.doc_id = g.doc_id AND k.page = g.page AND k.root = g.root
  JOIN main l ON l.doc_id = g.doc_id AND l.page = g.page AND l.root = greatest(g.g - 1, 0) JOIN main r ON r.doc_id = g.doc_id AND r.page = g.page AND r.root = least(g.g, g.n - 1)),
best AS (SELECT doc_id, page, root, g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, root ORDER BY cost, edge, g) AS k FROM cost) WHERE k = 1),
placed AS (
  SELECT doc_id, page, section, root, type, root * 2 + 1 AS a, x0, y0, x1, y1 FROM main
  UNION ALL
  SELECT k.doc_id, k.page, k.section, k.root, k.type, best.g * 2, k.x0, k.y0, k.x1, k.y1 FROM kept k JOIN best ON best.doc_id = k.doc_id AND best.page = k.page AND best.root = k.root
  UNION ALL
  SELECT d.doc_id, d.page, d.section, d.root, d.type, 0, 1e18, 1e18, 1e18, 1e18 FROM d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = d.doc_id AND n.page = d.page))
"""


@_query(f"""
WITH {_MERGED}
SELECT doc_id, page::INTEGER AS page_pos, section::INTEGER AS section, root::INTEGER AS root, type, (row_number() OVER (PARTITION BY doc_id, page ORDER BY a, x0, y0, x1, y1, root) - 1)::INTEGER AS place FROM placed
""")
def merged_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = merging.merged_order(line_blocks(spark, sf_dir))
    return got.select("doc_id", "page_pos", "section", F.col("root").cast("int").alias("root"), "type", "place")


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): a layout of one page for each document: a block for each line, a child for each of its sentences."""
    docs = _spread(spark, sf_dir, "documents")
    sentence = lambda s: F.struct(F.lit("sentence").alias("type"), F.array(F.struct(F.array(F.struct(F.lit("text").alias("type"), s.alias("content"), F.concat(F.length(s).cast("string"), F.lit(".png")).alias("image_path"))).alias("spans"))).alias("lines"))
    kind = lambda i: F.when(i % 4 == 0, "title").when(i % 4 == 1, "list").otherwise("text")
    block = lambda line, i: F.struct(kind(i).alias("type"), i.alias("index"), F.array(F.struct(F.array(F.struct(F.lit("text").alias("type"), line.alias("content"))).alias("spans"))).alias("lines"), F.when(kind(i) == "text", F.transform(F.split(line, r"\. "), sentence)).alias("blocks"))
    page = F.struct(F.lit(0).alias("page_idx"), F.array(F.lit(100), F.lit(100)).alias("page_size"), F.transform(F.split("text", "\n"), block).alias("para_blocks"))
    return docs.select("doc_id", F.to_json(F.struct(F.array(page).alias("pdf_info"))).alias("raw"))


_LINES = """
lines AS (SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
kids AS (SELECT doc_id, i, unnest(generate_series(0, len(s) - 1)) AS j, unnest(s) AS part FROM (SELECT doc_id, i, string_split(line, '. ') AS s FROM lines WHERE i % 4 > 1))
"""


@_query(f"""
WITH {_LINES}
SELECT doc_id, i::INTEGER AS root, NULL::INTEGER AS child, 0 AS depth, i::INTEGER AS owner_index, length(line)::INTEGER AS chars FROM lines
UNION ALL SELECT doc_id, i::INTEGER, j::INTEGER, 1, i::INTEGER, length(part)::INTEGER FROM kids
""")
def tree_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = layout.blocks(layout.parsed(_layouts(spark, sf_dir)))
    return got.select("doc_id", F.get("path", 0).alias("root"), F.get("path", 1).alias("child"), "depth", "owner_index", F.length(layout.lined_text(F.col("block"))).alias("chars"))


@_query(f"""
WITH {_LINES}, p AS (SELECT doc_id, length(part) || '.png' AS image_path, i * 100000 + j AS place FROM kids)
SELECT doc_id, image_path, min(place)::BIGINT AS first_at FROM p GROUP BY doc_id, image_path
""")
def distinct_image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = layout.image_paths(layout.spans(layout.blocks(layout.parsed(_layouts(spark, sf_dir)))))
    return got.select("doc_id", "image_path", (F.get("place.path", 0).cast("long") * 100000 + F.get("place.path", 1)).alias("first_at"))


@_query(f"""
WITH {_LINES}
SELECT doc_id, i::INTEGER AS root, arg_min(length(part) || '.png', j) AS first_image FROM kids GROUP BY doc_id, i
""")
def first_image_of_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = layout.first_of(layout.spans(layout.blocks(layout.parsed(_layouts(spark, sf_dir)))), "image_path")
    return got.select("doc_id", "root", F.col("value").alias("first_image"))


@_query(r"""
WITH l AS (SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
m AS (SELECT doc_id, i, CASE i % 4 WHEN 0 THEN '## ' WHEN 1 THEN '- ' ELSE '' END || trim(line) AS md FROM l WHERE trim(line) <> '')
SELECT d.doc_id, coalesce(trim(string_agg(m.md, chr(10) || chr(10) ORDER BY m.i)), '') AS markdown FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id
""")
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = layout.pages(layout.parsed(_layouts(spark, sf_dir)))
    return rendering.document_markdown(rendering.page_markdown(pages, rendering.RenderOptions()))


@_query("""
SELECT doc_id, doc_id % 7 = 0 AS broken FROM documents
""")
def layout_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _layouts(spark, sf_dir).withColumn("raw", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{"), F.col("raw"))).otherwise(F.col("raw")))
    return layout.validation(layout.parsed(raw)).select("doc_id", F.col("problem").isNotNull().alias("broken"))


@_query("""
SELECT doc_id, lang || chr(65533) || 'x' || chr(128512) || source || chr(65533) AS fixed, '\\ud840' || doc_id AS spelled FROM documents
""")
def lone_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lone, pair, low = "\\ud840", "\\ud83d\\ude00", "\\udc00"
    key = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{"t' + low + '": "'), F.col("lang"), F.lit(lone + "x" + pair), F.col("source"), F.lit(low + '", "s": "\\\\ud840'), key, F.lit('"}'))
    raw = _read(spark, sf_dir, "documents").select("doc_id", F.try_parse_json(text.without_lone_surrogates(body)).alias("v"))
    return raw.select("doc_id", F.try_variant_get("v", "$.t\ufffd", "string").alias("fixed"), F.try_variant_get("v", "$.s", "string").alias("spelled"))


# text functions


@_query(rf"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS n, text FROM documents)
SELECT doc_id, n AS normalized, {_CUT.format("n")} AS cut, replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '|', '\|') AS cell,
  replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM t
""")
def text_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents")
    # wide digits and blanks are folded to plain ones
    n = text.normalize(F.translate("text", "0123456789 ", "\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19\u3000"))
    return docs.select("doc_id", n.alias("normalized"), text.truncate(n).alias("cut"), text.cell_text("text").alias("cell"), text.html_escaped("text").alias("escaped"))


@_query("""
WITH p AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/abs/' || page_id || '.png' WHEN 2 THEN 'images/' || page_id || '.png' ELSE page_id || '.png' END AS path,
  CASE WHEN page_id % 2 = 0 THEN '/x/__data/f' || page_id || '.pdf/middle.json' ELSE '/x/y' || page_id || '/middle.json' END AS f FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'images/' || path ELSE path END AS rendered, CASE WHEN path LIKE '/%' THEN path ELSE '/out/images/' || path END AS file,
  CASE WHEN page_id % 2 = 0 THEN '/x/f' || page_id || '.pdf' ELSE '/x/y' || page_id END AS pdf,
  f || '::' || (page_id % 9) || '::' || coalesce(nullif(page_id % 5, 0)::VARCHAR, 'None') || '::' || path AS key FROM p
""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    path = F.when(i % 4 == 0, F.col("url")).when(i % 4 == 1, F.concat(F.lit("/abs/"), i, F.lit(".png"))).when(i % 4 == 2, F.concat(F.lit("images/"), i, F.lit(".png"))).otherwise(F.concat(i, F.lit(".png")))
    f = F.when(i % 2 == 0, F.concat(F.lit("/x/__data/f"), i, F.lit(".pdf/middle.json"))).otherwise(F.concat(F.lit("/x/y"), i, F.lit("/middle.json")))
    p = _read(spark, sf_dir, "pages").select("page_id", path.alias("path"), f.alias("f"))
    return p.select("page_id", text.rendered_image_path("path").alias("rendered"), text.image_file(F.lit("/out"), "path").alias("file"), text.pdf_of("f").alias("pdf"), text.item_key("f", F.col("page_id") % 9, F.nullif(F.col("page_id") % 5, F.lit(0)), "path").alias("key"))


@_query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size % 3 = 0 THEN 1 ELSE greatest(least(p_size - 20, 6), 1) END WHEN 1 THEN CASE WHEN p_size % 3 = 0 THEN 2 ELSE greatest(least(p_size - 20, 6), 1) END WHEN 2 THEN CASE WHEN p_size % 3 = 0 THEN 2 ELSE greatest(least(p_size - 20, 6), 1) END END AS level FROM part
""")
def title_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "doc_title").when(size % 4 == 1, "paragraph_title").when(size % 4 == 2, "title").otherwise("text")
    return _read(spark, sf_dir, "part").select("p_partkey", text.title_level(kind, F.when(size % 3 != 0, size - 20)).alias("level"))


_MACRO_SQL = r"regexp_replace(regexp_replace(regexp_replace(e, '\\mathrm\{([^{}]+)\}', '{\1}', 'g'), '\\mathit\{([^{}]+)\}', '{\1}', 'g'), '\\mathbb\{([^{}]+)\}', '{\1}', 'g')"
for _macro, _sign in latex.MACROS:
    _MACRO_SQL = f"replace({_MACRO_SQL}, '{_macro}', '{_sign}')"


@_query(rf"""
WITH x AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '\alpha_{{' || p_size || '}} \leq \mathrm{{' || p_brand || '}}' WHEN 1 THEN '{{{{x}}}}\times{{y}}\subseteq\Omega' WHEN 2 THEN p_name || '\leftarrow\notin' ELSE '\sum_{{i}}\infty' || p_size END AS e FROM part)
SELECT p_partkey, regexp_replace(regexp_replace({_MACRO_SQL}, '\{{\{{([^{{}}]+)\}}\}}', '{{\1}}', 'g'), '\{{([A-Za-z0-9])\}}', '\1', 'g') AS shown FROM x
""")
def latex_to_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    e = F.when(size % 5 == 0, F.concat(F.lit("\\alpha_{"), size.cast("string"), F.lit("} \\leq \\mathrm{"), F.col("p_brand"), F.lit("}"))).when(size % 5 == 1, F.lit("{{x}}\\times{y}\\subseteq\\Omega")).when(size % 5 == 2, F.concat(F.col("p_name"), F.lit("\\leftarrow\\notin"))).otherwise(F.concat(F.lit("\\sum_{i}\\infty"), size.cast("string")))
    return _read(spark, sf_dir, "part").select("p_partkey", latex.to_unicode(e).alias("shown"))


@_query("""
SELECT n_regionkey, chr(10) || '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM nation GROUP BY n_regionkey
""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("n_nationkey", F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>")).alias("row"))
    html = F.concat(F.lit("<table><tr><th>nation</th><th>key</th></tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"]), ""), F.lit("</table>"))
    return _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(html.alias("html")).select("n_regionkey", tables.html_tables_to_markdown(F.col("html")).alias("markdown"))


@_query("""
SELECT doc_id, 'data:image/png;base64,' || base64(encode(text)) AS url, sha256(text) AS digest FROM documents
""")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.data_url(F.lit("a.PNG"), F.col("text").cast("binary")).alias("url"), F.sha2("text", 256).alias("digest"))


# model runs out of events

_KINDS = layout.DOMAINS["kind"]
_RAGS, _DETAILS = ("none", "low", "medium", "high"), ("skip", "short", "long", "extract_text")


def _pick(names: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))


def _sql_pick(names: tuple[str, ...], i: str) -> str:
    return "([" + ", ".join(f"'{n}'" for n in names) + f"])[(({i}) % {len(names)}) + 1]"


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    ref = F.struct(F.concat(F.lit("/m/"), (F.col("user_id") % 40).cast("string")).alias("middle_json_path"), F.lit("p").alias("pdf_path"), F.lit("o").alias("outdir"), (F.col("user_id") % 3).cast("int").alias("page_idx"), F.lit(None).cast("int").alias("block_index"), F.lit("image").alias("block_type"), F.lit("i.png").alias("image_path"))
    usage = F.struct(F.when(e % 7 != 0, e % 1000).cast("long").alias("input_tokens"), (e % 300).cast("long").alias("output_tokens"), F.lit(None).cast("long").alias("total_tokens"))
    price = F.struct(F.lit(None).cast("double").alias("input_cost_usd"), F.lit(None).cast("double").alias("output_cost_usd"), F.when(e % 11 != 0, (e % 16) / F.lit(1024)).alias("total_cost_usd"))
    run = F.struct(_pick(_KINDS, e * 7).alias("kind"), _pick(_RAGS, e * 3).alias("rag_value"), _pick(_DETAILS, e * 5).alias("detail_level"), usage.alias("usage"), price.alias("price"))
    return _read(spark, sf_dir, "events").select(e.alias("pos"), ref.alias("ref"), F.col("event_type").alias("model"), F.when(e % 3 == 1, False).when(e % 3 == 2, True).alias("thinking"), F.floor(F.col("value") * 64).cast("double").alias("latency_sec"), F.struct((e % 10 != 0).alias("ok"), F.when(e % 10 == 0, F.concat(F.lit("e"), (e % 30).cast("string"))).alias("error")).alias("status"), F.when(e % 10 != 0, run).alias("run"))


_RUNS = f"""r AS (SELECT event_id AS pos, '/m/' || (user_id % 40) || '::' || (user_id % 3) || '::None::i.png' AS item_key, user_id % 40 AS item, event_type AS model, CASE event_id % 3 WHEN 1 THEN false WHEN 2 THEN true END AS thinking,
  floor(value * 64)::DOUBLE AS latency, event_id % 10 <> 0 AS ok, CASE WHEN event_id % 10 = 0 THEN 'e' || (event_id % 30) END AS error, CASE WHEN event_id % 7 <> 0 THEN event_id % 1000 END AS tin, event_id % 300 AS tout,
  CASE WHEN event_id % 11 <> 0 THEN (event_id % 16) / 1024.0::DOUBLE END AS cost, {_sql_pick(_KINDS, "event_id * 7")} AS kind, (event_id * 3) % 4 AS rag, (event_id * 5) % 4 AS detail FROM events)"""


@_query(f"""
WITH {_RUNS}
SELECT model, min(pos) AS first_pos, count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, round(avg(latency) FILTER (ok), 6) AS avg_latency_sec,
  coalesce(sum(tin) FILTER (ok), 0)::BIGINT AS input_tokens, coalesce(sum(tout) FILTER (ok), 0)::BIGINT AS output_tokens, round(coalesce(sum(cost) FILTER (ok), 0.0), 6) AS total_cost_usd FROM r GROUP BY model
""")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.model_summary(event_runs(spark, sf_dir)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@_query(f"""
WITH {_RUNS}
SELECT model, thinking, count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, round(avg(ok::INTEGER), 6) AS ok_rate, round(avg(latency) FILTER (ok), 6) AS avg_latency_sec, round(median(latency) FILTER (ok), 6) AS median_latency_sec,
  round(max(latency) FILTER (ok), 6) AS max_latency_sec, sum(coalesce(tin, 0)) FILTER (ok)::BIGINT AS total_input_tokens, sum(tout) FILTER (ok)::BIGINT AS total_output_tokens, round(avg(coalesce(tin, 0)) FILTER (ok), 6) AS avg_input_tokens, round(avg(tout) FILTER (ok), 6) AS avg_output_tokens,
  round(sum(coalesce(cost, 0.0)) FILTER (ok), 6) AS total_cost_usd, round(avg(coalesce(cost, 0.0)) FILTER (ok), 6) AS avg_cost_usd FROM r GROUP BY model, thinking
""")
def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.variant_summary(event_runs(spark, sf_dir)))


@_query(f"""
WITH {_RUNS}, c AS (SELECT model, thinking, error AS value, count(*) AS n, min(pos) AS f FROM r WHERE error IS NOT NULL GROUP BY ALL)
SELECT model, thinking, value, n, (row_number() OVER (PARTITION BY model, thinking ORDER BY n DESC, f))::INTEGER AS rank FROM c QUALIFY row_number() OVER (PARTITION BY model, thinking ORDER BY n DESC, f) <= 5
""")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.value_counts(event_runs(spark, sf_dir), F.col("status.error"), most=5)


_SCORED = f"""{_RUNS}, v AS (SELECT count(*) AS n FROM (SELECT DISTINCT model, thinking FROM r WHERE ok)),
full_items AS (SELECT item_key FROM (SELECT DISTINCT item_key, model, thinking FROM r WHERE ok) GROUP BY item_key HAVING count(*) = (SELECT n FROM v)),
s AS (SELECT r.*, {_sql_pick(_KINDS, "item * 3")} AS gold_kind, (item * 5) % 4 AS gold_rag, (item * 7) % 4 AS gold_detail FROM r WHERE ok AND item_key IN (SELECT item_key FROM full_items))"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _read(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("item"), (F.col("user_id") % 3).alias("page")).distinct()
    i = F.col("item")
    return users.select(F.concat(F.lit("/m/"), i.cast("string"), F.lit("::"), F.col("page").cast("string"), F.lit("::None::i.png")).alias("item_key"), _pick(_KINDS, i * 3).alias("kind"), _pick(_RAGS, i * 5).alias("rag_value"), _pick(_DETAILS, i * 7).alias("detail_level"))


@_query(f"""
WITH {_SCORED}, m AS (SELECT model, thinking, count(*) AS items, avg(latency) AS avg_latency_sec, median(latency) AS median_latency_sec, avg(coalesce(cost, 0.0)) AS avg_cost_usd, sum(coalesce(cost, 0.0)) AS total_cost_usd, avg((kind = gold_kind)::INTEGER) AS kind_accuracy,
  avg(abs(rag - gold_rag)) AS rag_mean_distance, avg(1 - abs(rag - gold_rag) / 3.0::DOUBLE) AS rag_distance_score, avg(abs(detail - gold_detail)) AS detail_mean_distance, avg(1 - abs(detail - gold_detail) / 3.0::DOUBLE) AS detail_distance_score,
  avg((kind = gold_kind AND rag = gold_rag AND detail = gold_detail)::INTEGER) AS all_exact_accuracy FROM s GROUP BY model, thinking)
SELECT model, thinking, items, round(avg_latency_sec, 6) AS avg_latency_sec, round(median_latency_sec, 6) AS median_latency_sec, round(avg_cost_usd, 6) AS avg_cost_usd, round(total_cost_usd, 6) AS total_cost_usd, round(kind_accuracy, 6) AS kind_accuracy, round(rag_mean_distance, 6) AS rag_mean_distance, round(rag_distance_score, 6) AS rag_distance_score,
  round(detail_mean_distance, 6) AS detail_mean_distance, round(detail_distance_score, 6) AS detail_distance_score, round(all_exact_accuracy, 6) AS all_exact_accuracy, round(0.4::DOUBLE * kind_accuracy + 0.3::DOUBLE * rag_distance_score + 0.3::DOUBLE * detail_distance_score, 6) AS overall_score FROM m
""")
def gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.gold_metrics(evaluation.scored(event_runs(spark, sf_dir), _gold(spark, sf_dir))))


@_query(f"""
WITH {_SCORED}, c AS (SELECT model, thinking, gold_kind, kind, count(*) AS n, min(pos) AS f FROM s WHERE kind <> gold_kind GROUP BY ALL)
SELECT model, thinking, gold_kind, kind, n, (row_number() OVER (PARTITION BY model, thinking ORDER BY n DESC, f))::INTEGER AS rank FROM c QUALIFY row_number() OVER (PARTITION BY model, thinking ORDER BY n DESC, f) <= 5
""")
def kind_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusions(evaluation.scored(event_runs(spark, sf_dir), _gold(spark, sf_dir)))


_MODELS = tuple(enrichment.PRICES)
_PRICE_ROWS = ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in enrichment.PRICES.items())


@_query(f"""
WITH p(model, i, o) AS (VALUES {_PRICE_ROWS}), u AS (SELECT o_orderkey, {_sql_pick(_MODELS, "o_orderkey")} AS model, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 5000 END AS a, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 700 END AS b FROM orders)
SELECT o_orderkey, u.model, round(a * i / 1000000, 12) AS input_usd, round(b * o / 1000000, 12) AS output_usd, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN round(coalesce(a * i / 1000000, 0) + coalesce(b * o / 1000000, 0), 12) END AS total_usd FROM u JOIN p ON p.model = u.model
""")
def price_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    u = _read(spark, sf_dir, "orders").select("o_orderkey", _pick(_MODELS, k).alias("model"), F.struct(F.when(k % 5 != 0, k % 5000).alias("input_tokens"), F.when(k % 10 != 0, k % 700).alias("output_tokens")).alias("usage"))
    cost = u.withColumn("p", enrichment.price(F.col("usage"), enrichment.pricing(F.col("model"))))
    return cost.select("o_orderkey", "model", F.round("p.input_cost_usd", 12).alias("input_usd"), F.round("p.output_cost_usd", 12).alias("output_usd"), F.round("p.total_cost_usd", 12).alias("total_usd"))


@_query("""
SELECT o_orderkey, CASE WHEN m LIKE 'gpt-5%' THEN CASE WHEN t THEN 'low' WHEN m LIKE 'gpt-5.4%' THEN 'none' ELSE 'minimal' END END AS effort, CASE WHEN m LIKE 'Qwen/%' OR m LIKE 'google/gemma-4%' THEN t END AS template
FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS t, """ + _sql_pick(_MODELS, "o_orderkey") + """ AS m FROM orders)
""")
def reasoning_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, t = _pick(_MODELS, F.col("o_orderkey")), F.col("o_orderkey") % 2 == 0
    return _read(spark, sf_dir, "orders").select("o_orderkey", enrichment.reasoning_effort(m, t).alias("effort"), enrichment.template_thinking(m, t).alias("template"))


@_query("""
SELECT 'i' || (user_id % 200) AS image_path, arg_max('note ' || event_id, event_id) AS notes FROM events WHERE event_type <> 'error' GROUP BY 1
""")
def cache_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = '{"model":"m","thinking":false}'
    ref = F.to_json(F.struct(F.lit("p").alias("pdf_path"), F.lit("o").alias("outdir"), F.lit(0).alias("page_idx"), F.lit("image").alias("block_type"), F.concat(F.lit("i"), (F.col("user_id") % 200).cast("string")).alias("image_path")))
    screening, understanding = F.lit('{"kind":"seal","rag_value":"low","detail_level":"short"}'), F.to_json(F.struct(F.array(F.lit("k")).alias("keywords"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("notes")))
    line = F.concat(F.lit("["), F.concat_ws(",", F.lit(config), F.lit(config), ref, screening, understanding), F.lit("]"))
    lines = _spread(spark, sf_dir, "events").filter("event_type <> 'error'").select(F.lit("o").alias("outdir"), F.col("event_id").alias("line_no"), line.alias("value"))
    return enrichment.load_cache(lines).select("image_path", F.col("understanding.notes").alias("notes"))


@_query(f"""
WITH {_LINES}, p AS (SELECT doc_id, i, j, length(part) || '.png' AS image_path FROM kids)
SELECT doc_id, i::INTEGER AS root, j::INTEGER AS child, image_path, CASE WHEN length(image_path) > 6 THEN 'seen ' || image_path END AS short_description FROM p
""")
def understanding_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = layout.spans(layout.blocks(layout.parsed(_layouts(spark, sf_dir))))
    refs = spans.filter("image_path is not null").select("doc_id", "page_idx", F.col("owner_index").alias("block_index"), "image_path").distinct().filter(F.length("image_path") > 6)
    n = F.lit(None).cast("string")
    answers = refs.withColumns({"place": F.lit(0), "screening": F.struct(F.lit("seal").alias("kind"), F.lit("low").alias("rag_value"), F.lit("short").alias("detail_level"), n.alias("notes")), "understanding": F.struct(F.array().cast("array<string>").alias("keywords"), F.concat(F.lit("seen "), F.col("image_path")).alias("short_description"), n.alias("long_description"), n.alias("notes"))})
    got = enrichment.embedded(spans, answers).filter("image_path is not null")
    return got.select("doc_id", F.get("path", 0).alias("root"), F.get("path", 1).alias("child"), "image_path", F.col("understanding.short_description").alias("short_description"))


@_query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'seed' ELSE c_mktsegment END AS kind, coalesce(CASE WHEN c_custkey % 6 = 0 THEN 'x' END, c_name) AS notes FROM customer
""")
def seed_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    key, n = F.col("c_custkey").cast("string").alias("item_key"), F.lit(None).cast("string")
    model = c.select(key, F.col("c_mktsegment").alias("kind"), F.lit("low").alias("rag_value"), F.lit("skip").alias("detail_level"), F.col("c_name").alias("notes"))
    seeds = c.filter("c_custkey % 3 = 0").select(key, F.lit("seed").alias("kind"), n.alias("rag_value"), n.alias("detail_level"), F.when(F.col("c_custkey") % 6 == 0, "x").alias("notes"))
    return evaluation.seed_overlay(model, seeds).select(F.col("item_key").cast("long").alias("c_custkey"), "kind", "notes")


@_query("""
SELECT doc_id, screened || chr(10) || chr(10) || 'Screening result:' || chr(10) || '- kind: seal' || chr(10) || '- rag_value: low' || chr(10) || '- detail_level: short' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '- screening_notes: ' || lang ELSE '' END AS context FROM (
  SELECT doc_id, lang, 'PDF path: p.pdf' || chr(10) || 'Out directory: out' || chr(10) || 'Page index: ' || (doc_id % 5) || chr(10) || 'Block index: ' || coalesce(nullif(doc_id % 4, 0)::VARCHAR, 'None') || chr(10) || 'Block type: image' || CASE WHEN lang = 'en' THEN chr(10) || 'Section title: ' || source ELSE '' END
    || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Caption: ' || source ELSE '' END || CASE WHEN doc_id % 7 <> 0 THEN chr(10) || 'Nearby text before: ' || text ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'Nearby text after: ' || lang ELSE '' END AS screened FROM documents)
""")
def prompt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    near = {"section_title": F.when(F.col("lang") == "en", F.col("source")), "caption": F.when(i % 2 == 0, F.col("source")), "nearby_text_before": F.when(i % 7 != 0, F.col("text")), "nearby_text_after": F.when(i % 5 == 0, F.col("lang"))}
    refs = _read(spark, sf_dir, "documents").select("doc_id", (i % 5).alias("page_idx"), F.nullif(i % 4, F.lit(0)).alias("block_index"), F.lit("image").alias("block_type"), F.when(i % 3 == 0, F.col("lang")).alias("notes"), *[c.alias(k) for k, c in near.items()])
    shown = images.screening_context(F.lit("p.pdf"), F.lit("out"))
    return refs.select("doc_id", images.understanding_context(shown, F.lit("seal"), F.lit("low"), F.lit("short"), F.col("notes")).alias("context"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_reading_order(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from folioflow.plans import document_queries  # noqa: E402, F401  (registers its queries; it needs the helpers above)
