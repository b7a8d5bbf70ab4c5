"""Scoring of model runs: summaries by model and variant, and accuracy against gold labels.

Runs are (pos, ref, model, thinking, latency_sec, status, run). A variant is a model with
its three-valued thinking; null ranks first, then false, then true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import item_key

RUN_SCHEMA = (
    "ref struct<middle_json_path string, pdf_path string, outdir string, page_idx int, block_index int, block_type string, image_path string>, model string, thinking boolean, base_url string, started_at string, latency_sec double, "
    "status struct<ok boolean, error string>, run struct<kind string, rag_value string, detail_level string, notes string, raw_text string, result struct<kind string, rag_value string, detail_level string, notes string>, "
    "usage struct<input_tokens bigint, output_tokens bigint, total_tokens bigint>, price struct<input_cost_usd double, output_cost_usd double, total_cost_usd double>>"
)
RAG = dict(zip("none low medium high".split(), range(4)))
DETAIL = dict(zip("skip short long extract_text".split(), range(4)))


def labels(runs: DataFrame) -> DataFrame:
    """Runs with labels at ``run.kind`` and the like, wherever the file had them."""
    inner = F.col("run").withField("kind", F.coalesce("run.kind", "run.result.kind")).withField("rag_value", F.coalesce("run.rag_value", "run.result.rag_value")).withField("detail_level", F.coalesce("run.detail_level", "run.result.detail_level")).withField("notes", F.coalesce("run.notes", "run.result.notes"))
    return runs.withColumn("run", F.when(F.col("run").isNotNull(), inner))


def thinking_rank(thinking: Column) -> Column:
    return F.when(thinking.isNull(), 0).when(~thinking, 1).otherwise(2)


def variant_label(model: Column, thinking: Column, short: bool = False) -> Column:
    base = F.when(model.startswith("Qwen/"), F.regexp_extract(model, "([^/]*)$", 1)).otherwise(model) if short else model
    return F.when(thinking.isNull(), base).otherwise(F.concat(base, F.lit(" [thinking="), thinking.cast("string"), F.lit("]")))


def ordinal(value: Column, ranks: dict[str, int]) -> Column:
    """The rank of a label; an unknown one is an error."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), value)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(value, F.lit("null")))).cast("int"))


def distance_score(a: Column, b: Column) -> Column:
    return 1 - F.abs(a - b) / 3


def model_summary(runs: DataFrame) -> DataFrame:
    """By model, in order of first appearance: total, ok, failed, avg_latency_sec of the ok ones, and sums in which null counts 0."""
    ok = F.coalesce(F.col("status.ok"), F.lit(False))
    some = lambda c, zero: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(zero))
    out = runs.groupBy("model").agg(
        F.min("pos").alias("first_pos"),
        F.count("*").alias("total"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("failed"),
        F.avg(F.when(ok, F.col("latency_sec"))).alias("avg_latency_sec"),
        some("run.usage.input_tokens", 0).alias("input_tokens"),
        some("run.usage.output_tokens", 0).alias("output_tokens"),
        some("run.price.total_cost_usd", 0.0).alias("total_cost_usd"),
    )
    return out.orderBy("first_pos")


def variant_summary(runs: DataFrame) -> DataFrame:
    """By variant: counts, ok_rate, average, median and largest latency, token and cost totals and averages of ok runs; null counts as 0."""
    ok = F.coalesce(F.col("status.ok"), F.lit(False))
    of = lambda c, zero=0: F.when(ok, F.coalesce(F.col(c), F.lit(zero)))
    lat = of("latency_sec", 0.0)
    cost = of("run.price.total_cost_usd", 0.0)
    out = runs.groupBy("model", "thinking").agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("failed"),
        F.avg(ok.cast("double")).alias("ok_rate"),
        F.avg(lat).alias("avg_latency_sec"),
        F.median(lat).alias("median_latency_sec"),
        F.max(lat).alias("max_latency_sec"),
        F.coalesce(F.sum(of("run.usage.input_tokens")), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum(of("run.usage.output_tokens")), F.lit(0)).alias("total_output_tokens"),
        F.avg(of("run.usage.input_tokens")).alias("avg_input_tokens"),
        F.avg(of("run.usage.output_tokens")).alias("avg_output_tokens"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.avg(cost), F.lit(0.0)).alias("avg_cost_usd"),
    )
    return out.orderBy("model", thinking_rank(F.col("thinking")))


def value_counts(runs: DataFrame, value: Column, most: int | None = None) -> DataFrame:
    """(model, thinking, value, n, rank) of non-null values; ties go to the one met first; ``most`` keeps the first ranks."""
    counted = runs.select("model", "thinking", "pos", value.alias("value")).filter("value is not null").groupBy("model", "thinking", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("model", "thinking").orderBy(F.desc("n"), "first_pos")))
    return (ranked.filter(F.col("rank") <= most) if most else ranked).drop("first_pos")


def ok_runs(runs: DataFrame) -> DataFrame:
    key = item_key("ref.middle_json_path", "ref.page_idx", "ref.block_index", "ref.image_path")
    return runs.filter(F.coalesce(F.col("status.ok"), F.lit(False)) & F.col("run").isNotNull()).withColumn("item_key", key)


def complete_items(ok: DataFrame) -> DataFrame:
    """(item_key) of items that every variant has an ok run of. Variants are counted, never collected."""
    seen = ok.groupBy("item_key", "model", "thinking").agg(F.count("*").alias("__n")).groupBy("item_key").agg(F.count("*").alias("seen"))
    variants = ok.select("model", "thinking").distinct().agg(F.count("*").alias("variants"))
    return seen.crossJoin(F.broadcast(variants)).filter("seen = variants").select("item_key")  # one row


def scored(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """Runs of complete items beside their gold labels: hit, distances, scores and exact. A run without gold is an error."""
    ok = ok_runs(runs)
    kept = ok.join(complete_items(ok), "item_key", "left_semi")
    g = gold.select("item_key", F.col("kind").alias("gold_kind"), F.col("rag_value").alias("gold_rag"), F.col("detail_level").alias("gold_detail"), F.lit(True).alias("__has"))
    both = kept.join(g, "item_key", "left")
    both = both.withColumn("gold_kind", F.when(F.col("__has"), F.col("gold_kind")).otherwise(F.raise_error(F.concat(F.lit("no gold label for "), F.col("item_key"))).cast("string")))
    rag, gold_rag = ordinal(F.col("run.rag_value"), RAG), ordinal(F.col("gold_rag"), RAG)
    detail, gold_detail = ordinal(F.col("run.detail_level"), DETAIL), ordinal(F.col("gold_detail"), DETAIL)
    hit = F.col("run.kind") == F.col("gold_kind")
    return both.select(
        "pos", "item_key", "model", "thinking", "latency_sec",
        F.coalesce("run.price.total_cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.col("run.kind").alias("kind"), "gold_kind", hit.alias("hit"),
        F.abs(rag - gold_rag).alias("rag_distance"), F.abs(detail - gold_detail).alias("detail_distance"),
        distance_score(rag, gold_rag).alias("rag_score"), distance_score(detail, gold_detail).alias("detail_score"),
        (hit & (F.col("run.rag_value") == F.col("gold_rag")) & (F.col("run.detail_level") == F.col("gold_detail"))).alias("exact"),
    )


def gold_metrics(scores: DataFrame) -> DataFrame:
    """By variant, best overall score first: latency, cost, accuracy of kind, distances and scores of both axes, exact rate."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    out = scores.groupBy("model", "thinking").agg(
        F.count("*").alias("items"),
        F.avg("latency_sec").alias("avg_latency_sec"),
        F.median("latency_sec").alias("median_latency_sec"),
        F.avg("cost_usd").alias("avg_cost_usd"),
        F.sum("cost_usd").alias("total_cost_usd"),
        share("hit").alias("kind_accuracy"),
        F.avg("rag_distance").alias("rag_mean_distance"),
        F.avg("rag_score").alias("rag_distance_score"),
        F.avg("detail_distance").alias("detail_mean_distance"),
        F.avg("detail_score").alias("detail_distance_score"),
        share("exact").alias("all_exact_accuracy"),
    )
    out = out.withColumn("overall_score", 0.4 * F.col("kind_accuracy") + 0.3 * F.col("rag_distance_score") + 0.3 * F.col("detail_distance_score"))
    return out.orderBy(F.desc("overall_score"), "model", thinking_rank(F.col("thinking")))


def confusions(scores: DataFrame, most: int = 5) -> DataFrame:
    """(model, thinking, gold_kind, kind, n, rank): the most frequent wrong kinds of each variant; ties by first run."""
    counted = scores.filter("not hit").groupBy("model", "thinking", "gold_kind", "kind").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    rank = F.row_number().over(Window.partitionBy("model", "thinking").orderBy(F.desc("n"), "first_pos"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= most).drop("first_pos")


def highlights(metrics: DataFrame) -> DataFrame:
    """One row: the best variant overall and the fastest on average; the first in variant order wins ties."""
    v = F.struct("model", "thinking")
    place = F.struct(F.col("model"), thinking_rank(F.col("thinking")))
    return metrics.agg(F.min_by(v, F.struct((-F.col("overall_score")).alias("a"), place.alias("b"))).alias("best"), F.min_by(v, F.struct(F.col("avg_latency_sec").alias("a"), place.alias("b"))).alias("fastest"))


def extrapolated(metrics: DataFrame, images: int = 3985) -> DataFrame:
    """What a corpus of so many images would take: hours and USD by variant."""
    return metrics.select("model", "thinking", (F.col("avg_latency_sec") * images / 3600).alias("hours"), (F.col("avg_cost_usd") * images).alias("usd"))


def seed_overlay(predicted: DataFrame, seeds: DataFrame) -> DataFrame:
    """Labels to start annotation from: a seed's where there is one, field by field, else the model's."""
    fields = ("kind", "rag_value", "detail_level", "notes")
    s = seeds.select("item_key", *[F.col(f).alias(f"seed_{f}") for f in fields])
    return predicted.join(s, "item_key", "left").select("item_key", *[F.coalesce(f"seed_{f}", f).alias(f) for f in fields])
