"""Image files as pixel tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.views import minmax_normalize


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, height, width, n_channels, mode, data) of the image files below a folder; image_id is the file's path.
    Files that are no images are left out. Spark deals the files to tasks, so no task holds more than its own batch."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return images.select(F.col("image.origin").alias("image_id"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.mode", "image.data")


def image_pixels(images: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(image_id, channel, r, c, v) of images as `read_images` gives them: bytes 0 to 255. Bytes lie row by row, blue first;
    a single channel is called L, and an alpha channel is left out. A large image leaves in slices of about `most` pixels."""
    schema = pa.schema([("image_id", pa.string()), ("channel", pa.string()), ("r", pa.int32()), ("c", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in range(batch.num_rows):
                image_id, height, width, many, data = (batch.column(k)[image].as_py() for k in range(5))
                value = np.frombuffer(data, np.uint8).reshape(height, width, many)
                step = max(1, most // max(width, 1))
                for k, name in enumerate("L" if many == 1 else "BGR"):
                    for top in range(0, height, step):
                        part = value[top : top + step, :, k]
                        r, c = (x.ravel().astype(np.int32) for x in np.indices(part.shape))
                        own = [pa.repeat(pa.scalar(x, pa.string()), part.size) for x in (image_id, name)]
                        yield pa.RecordBatch.from_arrays([*own, pa.array(r + np.int32(top)), pa.array(c), pa.array(part.ravel().astype(float))], schema=schema)

    return images.select("image_id", "height", "width", "n_channels", "data").mapInArrow(run, "image_id string, channel string, r int, c int, v double")


def gray_grids(pixels: DataFrame) -> DataFrame:
    """(image_id, r, c, v): the mean of the channels, scaled to 0 .. 1 in each image; an image of one value becomes 0."""
    return minmax_normalize(pixels.groupBy("image_id", "r", "c").agg(F.avg("v").alias("v")))
