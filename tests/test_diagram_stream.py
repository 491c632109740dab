"""A stream of images that is stopped and started again solves no content twice."""

import tempfile

from pyspark.sql import functions as F

from lattica.operators import persistence
from lattica.sources import diagrams
from lattica.streaming.diagrams import image_stream, stream_diagrams

SCHEMA = "image_id long, pixels array<double>, width int"


def test_stream_restarts_and_solves_once(spark, monkeypatch):
    top = tempfile.mkdtemp()
    source, store, mark = f"{top}/in", f"{top}/store", f"{top}/mark"
    solved = []
    own = persistence.persistence

    def counted(grid, *more):
        solved.append(grid.select("image_id").distinct().count())
        return own(grid, *more)

    monkeypatch.setattr(diagrams.persistence, "persistence", counted)

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        query = stream_diagrams(image_stream(spark, source, SCHEMA, 1), store, mark)
        query.awaitTermination()
        assert query.exception() is None

    image = lambda k: [float((k * p * 7) % 11) for p in range(12)]
    put([(1, image(1), 4), (2, image(2), 4)])
    put([(3, image(1), 4), (4, image(3), 4)])  # 3 has the content of 1
    run()
    assert sum(solved) == 3 and len(solved) == 2
    put([(5, image(2), 4), (6, image(4), 4)])
    run()  # from the checkpoint: only the new file, and of it only the new content
    assert sum(solved) == 4 and len(solved) == 3
    run()
    assert len(solved) == 3
    held = spark.read.schema(diagrams.STORED).parquet(store)
    assert held.select("content").distinct().count() == 4
    grid = spark.createDataFrame([(6, p // 4, p % 4, v) for p, v in enumerate(image(4))], "image_id long, r int, c int, v double")
    want = sorted(((r.hdim, r.birth, r.death) for r in own(grid).collect()), key=str)
    key = diagrams.content_key(F.array(*[F.lit(x) for x in image(4)]), F.lit(4), "sublevel")
    assert sorted(((r.hdim, r.birth, r.death) for r in held.where(F.col("content") == key).collect()), key=str) == want
