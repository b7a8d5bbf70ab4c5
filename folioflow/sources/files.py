"""Other sources and sinks: binary files, checksums, lists, JSON lines, prices, gold labels, Markdown and HTML."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.evaluation import RUN_SCHEMA
from folioflow.runtime import ship

GOLD_SCHEMA = "item_key string, kind string, rag_value string, detail_level string, notes string"


def binary_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, name, size, content, sha256) of files; the digest is of the bytes, lower-case hex."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("sha256"))


def pdf_files(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """PDF files of one folder, whatever the ending's case, by path; ``limit`` keeps the first."""
    found = binary_files(spark, folder).filter(F.lower("name").endswith(".pdf")).orderBy("path")
    return found if limit is None else found.limit(limit)


def extracted(pdfs: DataFrame, extract: Callable[[bytes, dict], str], options: dict | None = None) -> DataFrame:
    """``pdfs`` with ``raw``: the layout JSON that an injected extractor gives for the bytes, and ``error`` where it fails.

    ``options``: backend (pipeline, vlm-<engine> or hybrid-<engine>), method, lang,
    server_url, seal_enable, formula_enable. They are handed on as ``backend_options`` says.
    """
    ship(pdfs.sparkSession)
    chosen = backend_options(**(options or {}))
    at = pdfs.columns.index("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw, error = [], []
            for row in pdf.itertuples(index=False, name=None):
                try:
                    raw.append(extract(bytes(row[at]), chosen))
                    error.append(None)
                except Exception as e:  # one bad file must not end the job
                    raw.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(raw=raw, error=error)

    schema = T.StructType([*pdfs.schema.fields, T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())])
    return pdfs.mapInPandas(run, schema)


def backend_options(backend=None, method=None, lang=None, server_url=None, seal_enable=True, formula_enable=True, detect_engine=lambda: "transformers") -> dict:
    """What goes to the extractor, and its tag. vlm backends take no method, language or formula switch; hybrid ones a prefixed method."""
    backend, method, lang = backend or "pipeline", method or "auto", lang or "japan"
    kind, _, engine = backend.partition("-")
    if engine == "auto-engine":
        engine = detect_engine()
    if backend == "pipeline":
        return {"tag": "pipeline", "method": method, "lang": lang, "seal_enable": seal_enable, "formula_enable": formula_enable}
    if kind == "vlm" and engine:
        return {"tag": f"vlm:{engine}", "engine": engine, "server_url": server_url}
    if kind == "hybrid" and engine:
        return {"tag": f"hybrid:{engine}", "engine": engine, "method": f"hybrid_{method}", "lang": lang, "server_url": server_url, "formula_enable": formula_enable}
    raise ValueError(f"unknown backend: {backend}")


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): non-blank lines of a file, stripped, in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("place", "value"))
    return lines.select("place", F.trim("value").alias("value")).filter("value != ''")


def typed_json(spark: SparkSession, wanted: DataFrame, path: str, schema: str) -> DataFrame:
    """(path, value) of each wanted file (column ``path``) below ``path``, read by ``schema``; value is null where the file is missing, and a file that doesn't fit is an error."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    value = F.from_json("raw", schema, {"mode": "FAILFAST"})
    clean = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return wanted.select("path", clean(F.col("path")).alias("__p")).join(raw.select(clean(F.col("path")).alias("__p"), value.alias("value")), "__p", "left").drop("__p")


def existing(spark: SparkSession, wanted: DataFrame, path: str) -> DataFrame:
    """Which of the wanted paths (column ``path``) aren't there."""
    return wanted.join(binary_files(spark, path, recursive=True).select("path"), "path", "left_anti")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines by a schema, blank ones skipped; ``strict`` fails on a malformed one."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def runs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Model runs of a JSON-lines file, with ``pos``, an ordinal that follows the file's order."""
    return json_lines(spark, path, RUN_SCHEMA, strict).withColumn("pos", F.monotonically_increasing_id())


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels of {"items": [...]}; of equal keys the last; fields that are no text are null; a wrong shape is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.try_variant_get("v", "$.items", "array<variant>")
    listed = whole.select(F.posexplode(F.coalesce(items, F.raise_error(F.lit("gold labels must be an object with a list of items")).cast("array<variant>"))).alias("place", "i"))
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get("i", f"$.{k}", "variant")) == "STRING", F.try_variant_get("i", f"$.{k}", "string"))
    key = F.coalesce(text("item_key"), F.raise_error(F.lit("an item lacks its item_key")))
    rows = listed.select("place", key.alias("item_key"), *[text(k).alias(k) for k in ("kind", "rag_value", "detail_level", "notes")])
    last = rows.groupBy("item_key").agg(F.max_by(F.struct("kind", "rag_value", "detail_level", "notes"), "place").alias("x"))
    return last.select("item_key", "x.*")


def price_overrides(path: str | None) -> dict[str, tuple[float, float]]:
    """{model: (input, output)} of a small JSON object; none without a path."""
    if path is None:
        return {}
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ValueError(f"prices must be a JSON object: {path}")
    return {m: (float(v["input_per_million_usd"]), float(v["output_per_million_usd"])) for m, v in data.items()}


def only_model(run_rows: DataFrame, model: str | None, ok_only: bool = False) -> DataFrame:
    """Runs of one model (all without one); none is an error."""
    found = run_rows if model is None else run_rows.filter(F.col("model") == model)
    if ok_only:
        found = found.filter(F.coalesce(F.col("status.ok"), F.lit(False)) & F.col("run").isNotNull())
    if not found.head(1):
        raise ValueError(f"no run of the model {model!r}")
    return found


def to_json(df: DataFrame, defaults: dict[str, object] | None = None) -> Column:
    """A row as JSON without nulls and without values that equal their default."""
    cols = [F.nullif(F.col(c), F.lit(defaults[c])).alias(c) if defaults and c in defaults else F.col(c) for c in df.columns]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "true"})


def _write_one(path: str, text: str, append: bool) -> None:
    """A whole file by a name of its own that is then moved, so that no reader and no lost task sees a part."""
    import uuid

    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    data = text.encode()
    if append and system.get_file_info(place).type == fs.FileType.File:
        with system.open_input_stream(place) as f:
            old = f.read()
        if old.endswith(data):  # a task that ran again
            return
        data = old + data
    part = f"{place}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, place)


def write_each(rows: DataFrame, append: bool = False) -> int:
    """Writes each row (path, text) as a file of its own from the task that holds it, whole or not at all; the number of files. ``append`` puts the text behind what is there."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["text"]):
                _write_one(path, text, append)
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.select("path", "text").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]


def write_text_files(rows: DataFrame, folder: str) -> int:
    """``<folder>/<name>/text.md`` and, where there is one, ``text.html`` of each row (doc_id, markdown, html); ``name`` is the document's own folder or file name, with a digest where names are equal."""
    path = F.regexp_replace("doc_id", "^[a-z]+:/+", "/")
    own = F.when(path.endswith("/middle.json"), F.regexp_replace(path, "/middle.json$", "")).otherwise(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""))
    named = rows.withColumn("__own", own).withColumn("__name", F.regexp_extract("__own", "([^/]*)$", 1))
    again = named.groupBy("__name").agg((F.count_distinct("__own") > 1).alias("__again"))
    named = named.join(again, "__name").withColumn("__to", F.concat(F.lit(folder.rstrip("/") + "/"), "__name", F.when(F.col("__again"), F.concat(F.lit("-"), F.substring(F.sha2("__own", 256), 1, 12))).otherwise("")))
    out = None
    for name, column in (("text.md", "markdown"), ("text.html", "html")):
        if column in rows.columns:
            part = named.filter(F.col(column).isNotNull()).select(F.concat("__to", F.lit("/" + name)).alias("path"), F.col(column).alias("text"))
            out = part if out is None else out.unionByName(part)
    return write_each(out)


def write_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-column text frame as lines; ``append`` adds files and leaves the old."""
    rows.write.mode(mode).text(path)
