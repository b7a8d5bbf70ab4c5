"""A stream of image references against an append-only answer table.

Each micro-batch asks models only for what the table lacks, and appends the answers. A
batch that is run again finds its own answers there, so nothing is asked or kept twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import enrichment

ANSWERS = "screening_config string, understanding_config string, pdf_path string, outdir string, page_idx int, block_index int, block_type string, image_path string, caption string, nearby_text_before string, nearby_text_after string, section_title string, screening " + enrichment.SCREENING + ", understanding " + enrichment.UNDERSTANDING


def enrich_stream(refs: DataFrame, table: str, checkpoint: str, screen: Callable[[dict], str], understand: Callable[[dict], str], once: bool = True):
    """Starts the query; ``refs`` is a stream with the cache's key columns, ``table`` a Parquet folder."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        known = spark.read.schema(ANSWERS).parquet(table) if _there(spark, table) else spark.createDataFrame([], ANSWERS)
        _, new = enrichment.answered(df, known, screen, understand)
        new.select(*[c.split()[0] for c in enrichment.CACHE_KEY], "screening", "understanding").write.mode("append").parquet(table)

    writer = refs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals_by_window(refs: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """References by arrival window and block type; ``ts`` is their time, and what is later than ``late`` is left out."""
    return refs.withWatermark("ts", late).groupBy(F.window("ts", width), "block_type").agg(F.count("*").alias("n"))


def _there(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(f.isFile() for f in fs.listStatus(p))
