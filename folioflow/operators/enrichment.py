"""Enrichment of images by models: requests, prices, the result cache, and embedding.

Models are functions that the caller injects; each image that the cache lacks is sent
once, in Arrow batches, and rows that need no model never reach Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.runtime import forget, ship, stored
from folioflow.sources.layout import DOMAINS, data_folders

PRICES = {
    "Qwen/Qwen3.6-35B-A3B-FP8": (0.0, 0.0),
    "Qwen/Qwen3.6-27B-FP8": (0.0, 0.0),
    "google/gemma-4-26B-A4B-it": (0.0, 0.0),
    "gpt-5.4": (2.5, 15.0),
    "gpt-5.4-mini": (0.75, 4.5),
    "gpt-5.4-nano": (0.2, 1.25),
    "gpt-5.2": (1.75, 14.0),
    "gpt-5": (1.25, 10.0),
    "gpt-5-mini": (0.25, 2.0),
    "gpt-5-nano": (0.05, 0.4),
    "gpt-4.1": (2.0, 8.0),
    "gpt-4.1-mini": (0.4, 1.6),
    "gpt-4o": (2.5, 10.0),
    "gpt-4o-mini": (0.15, 0.6),
}


def price_table(overrides: dict[str, tuple[float, float]] | None = None) -> dict[str, tuple[float, float]]:
    """USD for a million (input, output) tokens by model; overrides come first."""
    return PRICES | (overrides or {})


def pricing(model: Column, overrides: dict[str, tuple[float, float]] | None = None, strict: bool = True) -> Column:
    """(input, output) prices of a model, from a table small enough to be a literal; an unknown model is an error, or null."""
    table = F.create_map(*[x for m, (i, o) in price_table(overrides).items() for x in (F.lit(m), F.struct(F.lit(float(i)).alias("input"), F.lit(float(o)).alias("output")))])
    found = F.try_element_at(table, model)
    if not strict:
        return found
    unknown = F.raise_error(F.concat(F.lit("no price is known for the model "), model)).cast("struct<input: double, output: double>")
    return F.when(model.isNull() | found.isNotNull(), found).otherwise(unknown)


def price(usage: Column, rate: Column) -> Column:
    """(input, output, total) USD of token counts; a missing side counts 0 in the total, and null if both or the rate are missing."""
    side = lambda n, r: n * r / F.lit(1_000_000)
    i, o = side(usage["input_tokens"], rate["input"]), side(usage["output_tokens"], rate["output"])
    total = F.coalesce(i, F.lit(0.0)) + F.coalesce(o, F.lit(0.0))
    return F.when(rate.isNotNull() & (i.isNotNull() | o.isNotNull()), F.struct(i.alias("input_cost_usd"), o.alias("output_cost_usd"), total.alias("total_cost_usd")))


def usage_of(completion: Column) -> Column:
    """Token counts of a chat completion held as VARIANT; null without a usage."""
    n = lambda k: F.try_variant_get(completion, f"$.usage.{k}", "long")
    return F.when(F.try_variant_get(completion, "$.usage", "variant").isNotNull(), F.struct(n("prompt_tokens").alias("input_tokens"), n("completion_tokens").alias("output_tokens"), n("total_tokens").alias("total_tokens")))


def reasoning_effort(model: Column, thinking: Column) -> Column:
    """The effort that a model's request names; null where it has none."""
    off = F.when(model.rlike(r"^gpt-5\.[451]"), F.lit("none")).otherwise(F.lit("minimal"))
    return F.when(model.startswith("gpt-5"), F.when(thinking, F.lit("low")).otherwise(off))


def template_thinking(model: Column, thinking: Column) -> Column:
    """The chat template's switch, for the models that have one; null otherwise."""
    return F.when(model.startswith("Qwen/") | model.startswith("google/gemma-4"), thinking)


def strict_schema(fields: dict[str, dict]) -> dict:
    """A JSON schema of an object in which every property is required."""
    return {"type": "object", "properties": fields, "required": list(fields)}


_TEXT, _MAYBE = {"type": "string"}, {"anyOf": [{"type": "string"}, {"type": "null"}], "default": None}
SCREENING_SCHEMA = strict_schema({k: {"type": "string", "enum": list(DOMAINS[k])} for k in ("kind", "rag_value", "detail_level")} | {"notes": _MAYBE})
UNDERSTANDING_SCHEMA = strict_schema({"keywords": {"type": "array", "items": _TEXT}, "short_description": _MAYBE, "long_description": _MAYBE, "notes": _MAYBE})


def request(model: Column, thinking: Column, prompt: Column, context: Column, image_url: Column, schema_name: Column, schema: dict) -> Column:
    """A chat request with a strict schema, as JSON text; switches that a model lacks are left out."""
    part = lambda kind, **v: F.struct(F.lit(kind).alias("type"), *[x.alias(k) for k, x in v.items()])
    body = F.struct(
        model.alias("model"),
        F.struct(F.lit("json_schema").alias("type"), F.struct(schema_name.alias("name"), F.lit(True).alias("strict"), F.parse_json(F.lit(json.dumps(schema))).alias("schema")).alias("json_schema")).alias("response_format"),
        F.array(
            F.struct(F.lit("system").alias("role"), F.to_variant_object(F.array(part("text", text=prompt))).alias("content")),
            F.struct(F.lit("user").alias("role"), F.parse_json(F.concat(F.lit("["), F.to_json(part("text", text=context)), F.lit(","), F.to_json(part("image_url", image_url=F.struct(image_url.alias("url")))), F.lit("]"))).alias("content")),
        ).alias("messages"),
        reasoning_effort(model, thinking).alias("reasoning_effort"),
        F.when(template_thinking(model, thinking).isNotNull(), F.struct(F.struct(thinking.alias("enable_thinking")).alias("chat_template_kwargs"))).alias("extra_body"),
    )
    return F.to_json(body)


SCREENING_PROMPT = """Classify one image of a document, for retrieval.
Answer with JSON alone: kind, rag_value, detail_level and notes.
kind: diagram (processes, relations, schematics), table_or_form, chart_or_graph (quantities), ui_or_screenshot, code_symbol (QR and bar codes), seal (stamps), text_as_image (mostly text), arrow_only, logo_or_mark, decorative (photographs, ornaments), and other only if none fits.
rag_value: high, medium, low or none. detail_level: skip where nothing is worth retrieving, else short or long; long includes short.
notes: the reason in at most 40 characters, or null where it is plain."""

GUIDANCE = {
    "diagram": "Explain the structure: steps in order, branches, and the names of people or units that can be read. Leave out small labels.",
    "chart_or_graph": "Name the topic, axes, units and series, and the comparisons or trends that matter; give values only where they are legible.",
    "table_or_form": "Say what it is for, and its main columns, rows or fields with their key values.",
    "ui_or_screenshot": "Say what the screen is for, its main elements, and what a user does there.",
    "text_as_image": "Say what kind of text it is, its topic, and its main points.",
    "code_symbol": "Say that it is a machine-readable code and what surrounds it; never guess its content.",
}
for _k in ("seal", "logo_or_mark", "decorative", "arrow_only"):
    GUIDANCE[_k] = "Keep it short: what the image shows or marks, no interpretation of detail."
DEFAULT_GUIDANCE = "Prefer what helps retrieval and a reader who can't see the image."

_RULES = "Keywords are the distinctive terms, names, titles and labels, none twice. notes hold caveats such as unreadable or cropped parts, or null."
PROMPTS = {
    "short": "Describe one image of a document in Japanese. Answer with JSON alone: keywords, short_description (120 characters at most) and notes. " + _RULES,
    "long": "Describe one image of a document in Japanese. Answer with JSON alone: keywords, short_description (120 characters at most), long_description (about 400, enough to do without the image) and notes. Don't transcribe everything. " + _RULES,
}
DEFAULT_PROMPT = "Describe one image of a document in Japanese. Answer with JSON alone: keywords, short_description (120 characters at most), long_description (about 400) and notes. " + _RULES


def guidance(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GUIDANCE.items() for x in kv]), kind), F.lit(DEFAULT_GUIDANCE))


def understanding_prompt(kind: Column, detail_level: Column) -> Column:
    head = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROMPTS.items() for x in kv]), detail_level), F.lit(DEFAULT_PROMPT))
    return F.concat(head, F.lit("\n"), guidance(kind))


#: What names an answer: both configurations and the whole reference.
CACHE_KEY = ("screening_config", "understanding_config", "pdf_path", "outdir", "page_idx", "block_index", "block_type", "image_path", "caption", "nearby_text_before", "nearby_text_after", "section_title")
_CONFIG = "struct<model string, thinking boolean, base_url string, pricing struct<input_per_million_usd double, output_per_million_usd double>>"
_REF = "struct<pdf_path string, outdir string, page_idx int, block_index int, block_type string, image_path string, caption string, nearby_text_before string, nearby_text_after string, section_title string>"
SCREENING = "struct<kind string, rag_value string, detail_level string, notes string>"
UNDERSTANDING = "struct<keywords array<string>, short_description string, long_description string, notes string>"
CACHE_FILE = "image_understanding_cache.jsonl"


def cache_file(outdir: str) -> str:
    return f"{outdir}/{CACHE_FILE}"


def load_cache(lines: DataFrame) -> DataFrame:
    """(key columns, screening, understanding) of the cache's lines, (outdir, line_no, value); of equal keys the last line.

    A cache with any malformed line counts as empty. Keys of configurations are JSON
    texts without secrets.
    """
    v = F.try_parse_json("value")
    part = lambda i, t: F.try_variant_get("v", f"$[{i}]", t)
    read = lines.filter(~F.col("value").rlike(r"^\s*$")).select("outdir", "line_no", v.alias("v")).select("outdir", "line_no", part(0, _CONFIG).alias("c0"), part(1, _CONFIG).alias("c1"), part(2, _REF).alias("ref"), part(3, SCREENING).alias("screening"), part(4, UNDERSTANDING).alias("understanding"))
    bad = F.col("c0.model").isNull() | F.col("c1.model").isNull() | F.col("ref.image_path").isNull() | F.col("screening.kind").isNull() | F.col("understanding.keywords").isNull()
    broken = read.filter(bad).select("outdir").distinct()
    good = read.join(broken, "outdir", "left_anti")
    keyed = good.select("line_no", F.to_json("c0").alias("screening_config"), F.to_json("c1").alias("understanding_config"), *[F.col(f"ref.{c}") for c in CACHE_KEY[2:]], "screening", "understanding")
    last = keyed.groupBy(*CACHE_KEY).agg(F.max_by(F.struct("screening", "understanding"), "line_no").alias("last"))
    return last.select(*CACHE_KEY, "last.screening", "last.understanding")


def cache_lines(answers: DataFrame, *more: str) -> DataFrame:
    """``answers`` (key columns, screening, understanding) as lines to append: an array of five each; ``more`` of their columns ahead."""
    ref = F.to_json(F.struct(*CACHE_KEY[2:]))
    return answers.select(*more, F.concat(F.lit("["), F.concat_ws(",", "screening_config", "understanding_config", ref, F.to_json("screening"), F.to_json("understanding")), F.lit("]")).alias("value"))


def valid_screening(s: Column) -> Column:
    return s["kind"].isin(*DOMAINS["kind"]) & s["rag_value"].isin(*DOMAINS["rag_value"]) & s["detail_level"].isin(*DOMAINS["detail_level"])


def _ask(rows: DataFrame, ask: Callable[[dict], str], name: str, unless: str | None = None) -> DataFrame:
    """``rows`` with what ``ask`` answers to each (as a dict of its columns), a JSON text, in column ``name``; null, and not asked, where column ``unless`` is true."""
    ship(rows.sparkSession)
    columns = rows.columns
    skip = None if unless is None else columns.index(unless)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: [None if skip is not None and r[skip] else ask(dict(zip(columns, r))) for r in pdf.itertuples(index=False, name=None)]})

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def screened(refs: DataFrame, ask: Callable[[dict], str]) -> DataFrame:
    """``refs`` with ``screening``, from an injected model; an answer outside the closed sets is an error."""
    got = _ask(refs, ask, "__raw").withColumn("screening", F.from_json("__raw", SCREENING))
    bad = F.raise_error(F.concat(F.lit("not a screening: "), F.col("__raw"))).cast(SCREENING)
    return got.withColumn("screening", F.when(F.coalesce(valid_screening(F.col("screening")), F.lit(False)), F.col("screening")).otherwise(bad)).drop("__raw")


def understood(screened_refs: DataFrame, ask: Callable[[dict], str]) -> DataFrame:
    """``screened_refs`` with ``understanding``, in one pass; images to skip take the screening's notes and no model sees them."""
    plain = F.struct(F.array().cast("array<string>").alias("keywords"), F.lit(None).cast("string").alias("short_description"), F.lit(None).cast("string").alias("long_description"), F.col("screening.notes").alias("notes")).cast(UNDERSTANDING)
    asked = _ask(screened_refs.withColumn("__skip", F.col("screening.detail_level") == "skip"), ask, "__raw", unless="__skip").withColumn("understanding", F.from_json("__raw", UNDERSTANDING))
    bad = F.raise_error(F.concat(F.lit("not a description: "), F.col("__raw"))).cast(UNDERSTANDING)
    return asked.withColumn("understanding", F.when(F.col("__skip"), plain).when(F.col("understanding.keywords").isNotNull(), F.col("understanding")).otherwise(bad)).drop("__raw", "__skip")


def answered(refs: DataFrame, cache: DataFrame, screen: Callable[[dict], str], understand: Callable[[dict], str]) -> tuple[DataFrame, DataFrame]:
    """(all refs with screening and understanding, what is new to the cache). ``refs`` holds the key columns; equal refs are asked once.

    Screenings and then new answers are stored ahead of any use, so that however often the
    results are read, a model sees an image once (twice only where its task is lost).
    """
    mark = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in CACHE_KEY])
    wanted = refs.select(*CACHE_KEY).distinct().withColumn("__mark", mark)
    known = cache.withColumn("__mark", mark)
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("__mark", *CACHE_KEY)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    w, k = wanted.alias("w"), known.alias("k")
    hits = w.join(k, on, "inner").select("w.*", "k.screening", "k.understanding").drop("__mark")
    misses = w.join(k, on, "left_anti").drop("__mark")
    shown = stored(screened(misses, screen), "screenings")
    new = stored(understood(shown, understand), "answers")
    forget(shown)
    return hits.unionByName(new), new


def summary(screening: Column, understanding: Column) -> Column:
    """What a span carries: labels of the screening, texts of the description."""
    return F.struct(*[screening[k].alias(k) for k in ("kind", "rag_value", "detail_level")], *[understanding[k].alias(k) for k in ("keywords", "notes", "short_description", "long_description")])


def embedded(spans: DataFrame, answers: DataFrame) -> DataFrame:
    """``spans`` with ``understanding`` set where (document, page index, nearest block index, path) was answered; the rest as before.

    ``answers``: doc_id, page_idx, block_index, image_path, place (the last wins), screening,
    understanding. The join is left to the optimizer, which broadcasts small sides itself.
    """
    rows = answers.groupBy("doc_id", "page_idx", "block_index", "image_path").agg(F.max_by(summary(F.col("screening"), F.col("understanding")), "place").alias("__summary"))
    s, r = spans.alias("s"), rows.alias("r")
    on = (F.col("s.doc_id") == F.col("r.doc_id")) & (F.col("s.page_idx") == F.col("r.page_idx")) & (F.col("s.image_path") == F.col("r.image_path")) & F.col("s.owner_index").eqNullSafe(F.col("r.block_index"))
    return s.join(r, on, "left").select(*[F.col(f"s.{c}") for c in spans.columns if c != "understanding"], F.coalesce(F.col("__summary"), F.col("s.understanding")).alias("understanding"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The lines of cache files below ``path`` as (outdir, line_no, value), read line by line, so that a file of any size is split; none where there is no file.

    ``line_no`` orders the lines of a file: by the block they are in, then by their place there.
    """
    try:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", CACHE_FILE).text([path, *data_folders(spark, path)])
    except AnalysisException as e:  # a folder that isn't there is an empty cache
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "outdir string, line_no long, value string")
    folder = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1), "^file:/+", "/")
    # splits of a file lie in separate partitions or follow each other in one; the low bits count within a partition
    block, here = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    return lines.select(folder.alias("outdir"), (block * (1 << 20) + here % (1 << 33)).alias("line_no"), "value")
