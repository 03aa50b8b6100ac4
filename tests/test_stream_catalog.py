"""The number of batches does not grow with the number of files that lie there."""

from pyspark.sql import functions as F

from rasterecho.plans.workspace import new_folder
from rasterecho.streaming.feedback import stream_catalog


def test_files_that_are_there_are_one_batch(spark):
    root, sizes = new_folder(spark, "landing"), []
    spark.range(150).repartition(150).write.parquet(root)
    n = len(spark.read.parquet(root).inputFiles())
    stream = stream_catalog(spark, root, "*.parquet").writeStream.foreachBatch(lambda batch, i: sizes.append(batch.count())).option(
        "checkpointLocation", new_folder(spark, "checkpoint")).trigger(availableNow=True).start()
    stream.awaitTermination()
    assert n > 100 and sizes == [n]


def test_query_writes_few_files_and_lists_every_image(spark, monkeypatch):
    """The query made a file and two folders for each sequence and frame."""
    from rasterecho.sources import catalog
    from rasterecho.suite import load
    from rasterecho.suite import stream_queries as Q

    monkeypatch.setattr(catalog, "PIXELS_PER_ARCHIVE", 20_000)
    roots, make = {}, Q.new_folder
    monkeypatch.setattr(Q, "new_folder", lambda s, name: roots.setdefault(name, make(s, name)))
    sf = "/root/testdata/sf0.001"
    rows = {r.frame: r.sequences for r in load().QUERIES["j5_stream_catalog"](spark, sf).collect()}
    frames = Q.px(spark, sf).select("seq", "frame").distinct().collect()
    assert rows == {n: sum(r.frame == n for r in frames) for n in {r.frame for r in frames}}
    # 171,360 pixels fill nine files, and an image lies in one of them.
    strips = spark.read.parquet(roots["landing"])
    assert 1 < len(strips.inputFiles()) <= 9 < len(frames)
    per_image = strips.withColumn("file", F.input_file_name()).groupBy("path").agg(F.count_distinct("file").alias("files"), F.count("*").alias("lines"))
    assert {(r.files, r.lines) for r in per_image.collect()} == {(1, 30)}
    listed = spark.read.parquet(roots["listed"])
    assert listed.count() == len(frames) and {r["size"] for r in listed.select("size").collect()} == {30 * 34 * 4}
