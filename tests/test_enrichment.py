import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioflow.operators import enrichment as E
from folioflow.operators import evaluation, merging
from folioflow.plans import conversion
from folioflow.sources import files, layout
from folioflow.streaming.enrichment import enrich_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])
CONFIG = '{"model":"m","thinking":false}'


def screen(row):
    return json.dumps({"kind": "seal", "rag_value": "low", "detail_level": "skip" if row["image_path"] == "s" else "short", "notes": "n"})


def understand(row):
    return json.dumps({"keywords": ["k"], "short_description": "d " + row["image_path"]})


def refs(spark, *paths):
    none = {c: None for c in E.CACHE_KEY}
    rows = [tuple((none | {"screening_config": CONFIG, "understanding_config": CONFIG, "pdf_path": "p", "outdir": "o", "page_idx": 0, "block_type": "image", "image_path": x})[c] for c in E.CACHE_KEY) for x in paths]
    kinds = {"page_idx": "int", "block_index": "int"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in E.CACHE_KEY))


def no_cache(spark):
    return E.load_cache(spark.createDataFrame([], "outdir string, line_no int, value string"))


def test_answers_and_cache(spark, tmp_path):
    got, new = E.answered(refs(spark, "a", "s", "a"), no_cache(spark), screen, understand)
    rows = {r["image_path"]: r for r in got.collect()}
    assert rows["a"]["understanding"]["short_description"] == "d a"
    assert rows["s"]["understanding"]["keywords"] == [] and rows["s"]["understanding"]["notes"] == "n"
    files.write_lines(E.cache_lines(new), str(tmp_path / "o"))
    lines = spark.read.text(str(tmp_path / "o")).select(F.lit("o").alias("outdir"), F.monotonically_increasing_id().cast("int").alias("line_no"), "value")

    def never(row):
        raise AssertionError("asked again")

    again, new = E.answered(refs(spark, "a", "s"), E.load_cache(lines), never, never)
    assert again.count() == 2 and new.count() == 0
    broken = lines.union(spark.createDataFrame([("o", 99, "[1,")], "outdir string, line_no int, value string"))
    assert E.load_cache(broken).count() == 0


def test_models_see_an_image_once(spark, tmp_path):
    """However often both results are read; skipped images are not described."""
    shown, told = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(f, acc):
        def ask(row):
            acc.add(1)
            return f(row)

        return ask

    got, new = E.answered(refs(spark, *"abcdefghis"), no_cache(spark), counted(screen, shown), counted(understand, told))
    for df in (new, got, new, got.filter("image_path = 'a'")):
        df.write.mode("overwrite").parquet(str(tmp_path / "o"))
    assert (shown.value, told.value) == (10, 9) and got.count() == new.count() == 10


def test_cache_files_are_read_by_lines(spark, tmp_path):
    for k in ("a", "__data/b"):
        (tmp_path / k).mkdir(parents=True)
        (tmp_path / k / E.CACHE_FILE).write_text("\n".join(f"{k} {i}" for i in range(2000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = E.read_cache(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        got = [r["value"] for r in lines.filter(F.col("outdir").endswith("/b")).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"__data/b {i}" for i in range(2000)] and lines.count() == 4000
    assert E.read_cache(spark, str(tmp_path / "none")).count() == 0


def test_typed_json_with_missing_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 3}')
    wanted = spark.createDataFrame([(str(tmp_path / "x.json"),), (str(tmp_path / "y.json"),)], "path string")
    got = {r["path"][-6:]: r["value"] for r in files.typed_json(spark, wanted, str(tmp_path), "a int").collect()}
    assert got["x.json"]["a"] == 3 and got["y.json"] is None
    (tmp_path / "y.json").write_text('{"a": "x')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.typed_json(spark, wanted, str(tmp_path), "a int").collect()


def test_answers_outside_the_sets_fail(spark):
    with pytest.raises(Exception, match="not a screening"):
        E.screened(refs(spark, "a"), lambda r: '{"kind": "cat", "rag_value": "low", "detail_level": "short"}').collect()


def test_prices_and_switches(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    usage = F.struct(F.lit(1_000_000).alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"))
    assert one(E.price(usage, E.pricing(F.lit("gpt-5.4"))))["total_cost_usd"] == 2.5
    assert one(E.price(usage, E.pricing(F.lit("gpt-5.4"), {"gpt-5.4": (1.0, 1.0)})))["total_cost_usd"] == 1.0
    assert one(E.price(usage, E.pricing(F.lit("x"), strict=False))) is None
    with pytest.raises(Exception, match="no price"):
        one(E.pricing(F.lit("x")))
    assert [one(E.reasoning_effort(F.lit(m), F.lit(False))) for m in ("gpt-5.4-mini", "gpt-5.2", "gpt-4o")] == ["none", "minimal", None]
    body = json.loads(one(E.request(F.lit("Qwen/x"), F.lit(True), F.lit("p"), F.lit("c"), F.lit("u"), F.lit("n"), E.SCREENING_SCHEMA)))
    assert body["extra_body"]["chat_template_kwargs"]["enable_thinking"] is True and body["response_format"]["json_schema"]["schema"]["required"] == ["kind", "rag_value", "detail_level", "notes"]
    assert body["messages"][1]["content"][1]["image_url"]["url"] == "u" and "reasoning_effort" not in body
    used = one(E.usage_of(F.parse_json(F.lit('{"usage": {"prompt_tokens": 3}}'))))
    assert (used["input_tokens"], used["output_tokens"]) == (3, None)
    assert one(E.usage_of(F.parse_json(F.lit("{}")))) is None
    assert E.DEFAULT_GUIDANCE in one(E.understanding_prompt(F.lit("other"), F.lit("skip")))


def test_child_with_its_own_index_is_missed(spark):
    im = lambda **kw: {"type": "image_body", "lines": [{"spans": [{"type": "image", "image_path": "p"}]}], **kw}
    doc = {"pdf_info": [{"page_idx": 0, "page_size": [1, 1], "para_blocks": [{"type": "image", "index": 1, "blocks": [im(), im(index=5)]}]}]}
    parsed = layout.parsed(spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, raw string"))
    models = conversion.Models(screen, understand, CONFIG, CONFIG)
    spans, new = conversion.enrich(parsed, no_cache(spark), models, F.lit("p"), F.lit("o"))
    got = {tuple(r["path"]): r["understanding"] for r in spans.collect()}
    assert got[(0, 0)]["short_description"] == "d p" and got[(0, 1)] is None
    assert new.count() == 1


def test_conversion_reports_failures(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.PDF").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"")

    def extract(raw, options):
        assert options["tag"] == "vlm:e"
        if raw == b"bad":
            raise ValueError("no pages")
        return json.dumps({"pdf_info": [{"page_idx": 0, "page_size": [1, 1], "para_blocks": [{"type": "text", "lines": [{"spans": [{"type": "text", "content": raw.decode()}]}]}]}]})

    md, failed = conversion.convert(files.pdf_files(spark, str(tmp_path)), conversion.Conversion(extract, {"backend": "vlm-e"}))
    assert [r["markdown"] for r in md.collect()] == ["good"]
    assert [r["error"] for r in failed.collect()] == ["ValueError: no pages"]
    assert files.pdf_files(spark, str(tmp_path), limit=1).count() == 1
    with pytest.raises(ValueError, match="unknown backend"):
        files.backend_options("other")
    assert files.backend_options("hybrid-x", "ocr")["method"] == "hybrid_ocr"


def test_described_results_are_made_once(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x\ny")
    from folioflow.plans import document_queries as Q

    job = conversion.Conversion(Q._extract, models=Q._STUBS, outdir="/out")
    made, _, _ = conversion.results(files.pdf_files(spark, str(tmp_path)), job)
    assert "MapInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [r["markdown"].count("<image_summary>") for r in conversion.markdown(made, Q.rendering.FOR_RAG).collect()] == [1]


def test_order_needs_the_texts_of_few_blocks(spark):
    page = {"page_idx": 0, "page_size": [9, 9], "para_blocks": [], "discarded_blocks": []}
    line = lambda kind, text, at: {"type": kind, "bbox": [0, at, 9, at + 1], "lines": [{"spans": [{"type": "text", "content": text}]}]}
    first = page | {"para_blocks": [line("text", "a", 1), line("header", "h one", 0), line("text", "b", 5)], "discarded_blocks": [line("header", "h two", 0), line("aside_text", "xy", 2), line("aside_text", "long one", 3)]}
    second = page | {"page_idx": 1, "para_blocks": [line("text", "c", 2)], "discarded_blocks": [line("header", "h one", 0), line("header", "h two", 0), line("footer", "new", 8)]}
    raw = spark.createDataFrame([(1, json.dumps({"pdf_info": [first, second]}))], "doc_id int, raw string")
    blocks = layout.blocks(layout.parsed(raw), (layout.PARA, layout.DISCARDED)).filter("depth = 0").withColumn("root", F.get("path", 0))
    assert {"a", "b", "c"} == {r["text"] for r in merging.with_slashed_text(blocks).collect()} - {r["text"] for r in merging.with_text_that_matters(blocks).collect()}
    order = lambda with_text: sorted(tuple(r) for r in merging.merged_order(with_text(blocks).drop("block")).select("page_pos", "place", "section", "root").collect())
    assert order(merging.with_text_that_matters) == order(merging.with_slashed_text) and len(order(merging.with_slashed_text)) == 7


def test_reuse(spark):
    p = lambda lang, images: {"lang": lang, "with_image_understanding": images, "image_screening_model": "m" if images else None, "image_understanding_model": None}
    kind = "struct<lang: string, with_image_understanding: boolean, image_screening_model: string, image_understanding_model: string>"
    saved = spark.createDataFrame([("a", p("x", True), "ra"), ("b", p("x", True), "rb")], f"source_path string, parameters {kind}, raw string")
    wanted = spark.createDataFrame([("a", p("x", True)), ("b", p("x", False)), ("c", p("x", True)), ("b", p("y", True))], f"source_path string, parameters {kind}")
    got = [sorted((r["source_path"], r["parameters"]["lang"]) for r in x.collect()) for x in conversion.reuse(wanted, saved)]
    assert got == [[("a", "x")], [("b", "x")], [("b", "y"), ("c", "x")]]


def test_gold_and_lists(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"items": [{"item_key": "a", "kind": "x"}, {"item_key": "a", "kind": "y", "notes": 3}]}))
    assert [tuple(r) for r in files.gold(spark, str(tmp_path / "g.json")).collect()] == [("a", "y", None, None, None)]
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(Exception, match="list of items"):
        files.gold(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "l.txt").write_text(" b \n\n a\n")
    assert [tuple(r) for r in files.text_list(spark, str(tmp_path / "l.txt")).orderBy("place").collect()] == [(0, "b"), (2, "a")]
    assert files.price_overrides(None) == {}
    assert spark.createDataFrame([(1, None)], "a int, b string").select(files.to_json(spark.createDataFrame([], "a int, b string"), {"a": 1})).head()[0] == "{}"


def test_missing_gold_is_an_error(spark):
    run = {"kind": "seal", "rag_value": "low", "detail_level": "skip"}
    line = json.dumps({"ref": {"middle_json_path": "m", "page_idx": 0, "image_path": "i"}, "model": "x", "latency_sec": 1.0, "status": {"ok": True}, "run": {"result": run}})
    runs = evaluation.labels(spark.createDataFrame([(line,)], "v string").select(F.from_json("v", evaluation.RUN_SCHEMA).alias("r")).select("r.*").withColumn("pos", F.lit(0)))
    gold = lambda key: spark.createDataFrame([(key, "seal", "high", "skip")], "item_key string, kind string, rag_value string, detail_level string")
    m = evaluation.gold_metrics(evaluation.scored(runs, gold("m::0::None::i"))).head()
    assert m["kind_accuracy"] == 1.0 and abs(m["overall_score"] - (0.4 + 0.3 / 3 + 0.3)) < 1e-12
    with pytest.raises(Exception, match="no gold label"):
        evaluation.scored(runs, gold("other")).collect()


def test_stream_asks_once(spark, tmp_path):
    src, table, state = (str(tmp_path / x) for x in ("in", "answers", "state"))
    refs(spark, "a", "b").write.parquet(src)
    stream = lambda: spark.readStream.schema(refs(spark, "a").schema).parquet(src)
    enrich_stream(stream(), table, state, screen, understand).awaitTermination(60)
    refs(spark, "a", "c").write.mode("append").parquet(src)
    enrich_stream(stream(), table, state, screen, understand).awaitTermination(60)
    assert sorted(r["image_path"] for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]
