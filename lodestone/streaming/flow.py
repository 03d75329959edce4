"""Streams of texts: sources, micro-batch embedding, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..models import Embedder, embed


def texts(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear at path; files_per_trigger bounds a micro-batch, which is Spark's back-pressure."""
    reader = spark.readStream.format("parquet").schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def embed_stream(stream: DataFrame, model: Embedder, sink: Callable[[DataFrame, int], None], checkpoint: str, batch: int = 32, id_col: str = "doc_id", text_col: str = "text", once: bool = True) -> StreamingQuery:
    """Embeds each micro-batch and hands it to sink(df, epoch); the checkpoint makes it go on where it stopped."""
    writer = embed(stream, model, id_col, text_col, batch).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(query: StreamingQuery) -> list[dict]:
    """Rows, rows a second and duration of each recent micro-batch."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"], "milliseconds": p["durationMs"].get("triggerExecution")} for p in query.recentProgress]
