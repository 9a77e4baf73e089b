"""Detection on a stream of pages: every page stands alone, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lethe.operators.detect import entities
from lethe.sources.tables import document_pages


def page_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files_at_a_time: int = 64) -> DataFrame:
    return document_pages(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(folder))


def entity_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the entities of all pages that are there and stop; run again, it goes on where it stopped."""
    return entities(pages).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
