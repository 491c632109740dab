"""Diagrams of a stream of images: each content is solved once, over all batches and restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lattica.sources.diagrams import fill_diagrams


def stream_diagrams(images: DataFrame, store: str, checkpoint: str, filtration: str = "sublevel", available_now: bool = True) -> StreamingQuery:
    """Starts a stream over images(image_id, pixels ARRAY<DOUBLE>, width) that adds the diagrams of new contents to the store.

    The checkpoint remembers which files were read; a batch that failed half way is run again and finds what it stored,
    so nothing is solved twice. With available_now the stream ends when it has read what is there."""
    def body(batch: DataFrame, number: int) -> None:
        fill_diagrams(batch, store, filtration)

    writer = images.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def image_stream(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    """A file stream of a folder, or of the files that a pattern names, at most `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
