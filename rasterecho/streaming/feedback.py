"""Frames that arrive over time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import PX_SCHEMA
from ..operators.quality import complete_prefix
from ..plans.scan import feedback_scan
from ..plans.workspace import existing


def frame_stream(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """Pixels of newly arrived frame files, all that are there or at most ``max_files`` in a trigger."""
    reader = spark.readStream.schema(PX_SCHEMA)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


@dataclass(frozen=True)
class StreamTables:
    """Where a stream keeps its work, all in shared storage.

    ``arrived``: pixels in order of arrival, one folder per batch. ``batches``: the finished frames and the
    state after each batch, one folder per batch id, so a repeated batch replaces its own rows only.
    ``failures``: what stood still after each batch, and why, in folders of the same kind.
    """

    root: str

    @property
    def arrived(self) -> str:
        return f"{self.root}/arrived"

    def batch(self, batch_id: int) -> str:
        return f"{self.root}/batches/batch={batch_id}"

    @property
    def batches(self) -> str:
        return f"{self.root}/batches"

    def seen(self, batch_id: int) -> str:
        """The frames that pixels of a batch belong to."""
        return f"{self.root}/seen/batch={batch_id}"

    def ends(self, batch_id: int) -> str:
        """The newest frame that a batch finished of each run and sequence."""
        return f"{self.root}/ends/batch={batch_id}"

    def plan(self, batch_id: int, name: str) -> str:
        """Frame-level tables that a batch works with."""
        return f"{self.root}/plan/{name}/batch={batch_id}"

    def failed(self, batch_id: int) -> str:
        return f"{self.root}/failures/batch={batch_id}"

    @property
    def failures(self) -> str:
        return f"{self.root}/failures"

    @property
    def log(self) -> str:
        """One row for each batch that is finished."""
        return f"{self.root}/log"


def stream_feedback(
    frames: DataFrame, tables: StreamTables, runs: list[dict[str, object]], checkpoint: str,
    *, first_frame: int = 1, trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Each trigger advances every sequence over the frames that are now contiguous.

    A frame that arrives after a gap waits until the gap is filled. State lives in files, so the stream
    can stop and start again from its checkpoint. Each batch also writes a row for every sequence that
    stands still: at a bad frame or an invalid run as the scan gives them, at a gap, and at a first frame
    other than ``first_frame`` (``failed_sequences``). A bad frame is looked at again in each batch, as
    the rest of its pixels may have arrived.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{tables.arrived}/batch={batch_id}")
        step(spark, tables, runs, batch_id, first_frame)

    return (
        frames.writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def finished_frames(spark: SparkSession, tables: StreamTables, before: int | None = None) -> DataFrame | None:
    """Lines of all finished frames; ``before`` leaves out the given batch and later ones."""
    done = existing(spark, tables.batches)
    return done if done is None or before is None else done.where(F.col("batch") < before)


FAILURE = "run_id string, seq string, frame int, reason string"


def failed_sequences(spark: SparkSession, tables: StreamTables, batch_id: int | None = None) -> DataFrame:
    """(run_id, seq, frame, reason) of each sequence that stands still after the given batch, or after the newest."""
    log = existing(spark, tables.log, "batch int")
    if log is None:
        return spark.createDataFrame([], FAILURE)
    # A batch without failures has no row to tell it from one not run; the log does.
    batch_id = log.agg(F.max("batch")).first()[0] if batch_id is None else batch_id
    found = spark.read.schema(f"{FAILURE}, batch int").parquet(tables.failures)
    return found.where(F.col("batch") == batch_id).drop("batch")


def _waiting(ready: DataFrame, runs: list[dict[str, object]], first_frame: int) -> DataFrame:
    """A row per run for each sequence with arrived frames beyond those that are ready."""
    early = F.format_string(f"frame %d lies before the first frame {first_frame}", "stray_frame")
    gap = F.format_string("frame %d has not arrived, later ones wait", F.col("_ready") + 1)
    names = F.explode(F.array(*[F.lit(r["run_id"]) for r in runs]))
    return ready.where(F.col("stray_frame").isNotNull()).select(
        names.alias("run_id"), "seq", F.col("stray_frame").cast("int").alias("frame"),
        F.when(F.col("stray_frame") < first_frame, early).otherwise(gap).alias("reason"),
    )


def _batches(rows: DataFrame) -> list[int]:
    """The batches that rows lie in: one number each, as a list of folders to read."""
    return sorted(r.batch for r in rows.select("batch").distinct().collect())


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def step(spark: SparkSession, tables: StreamTables, runs: list[dict[str, object]], batch_id: int, first_frame: int) -> None:
    """One trigger: find the ready frames, continue from the stored state, write this batch's frames.

    What is ready follows from tables of frames, which each batch writes for its own pixels and results. Pixels and lines are
    read of those batches alone that hold a frame to be done now, or the newest state of a sequence.
    """
    arrived = spark.read.schema(f"{PX_SCHEMA.simpleString()[7:-1].replace(':', ' ')}, batch int").parquet(tables.arrived)
    arrived.where(F.col("batch") == batch_id).select("seq", "frame").distinct().write.mode("overwrite").parquet(tables.seen(batch_id))
    seen = spark.read.schema("seq string, frame int, batch int").parquet(f"{tables.root}/seen").where(F.col("batch") <= batch_id)
    ready = _kept(complete_prefix(as_catalog(seen.select("seq", "frame").distinct()), first_frame).select(
        "seq", (F.col("prefix_length") + first_frame - 1).cast("int").alias("_ready"), "stray_frame"
    ), tables.plan(batch_id, "ready"))
    ends = existing(spark, f"{tables.root}/ends", "run_id string, seq string, frame int, batch int")
    if ends is None:
        ends = spark.createDataFrame([], "run_id string, seq string, frame int, batch int")
    newest = ends.where(F.col("batch") < batch_id).groupBy("run_id", "seq").agg(F.max_by("batch", "frame").alias("batch"), F.max("frame").alias("frame"))
    newest = _kept(newest, tables.plan(batch_id, "newest"))
    reached = newest.groupBy("seq").agg(F.max("frame").alias("_reached"))
    todo = seen.join(ready, "seq").join(reached, "seq", "left").where(
        F.col("frame").between(first_frame, F.col("_ready")) & (F.col("_reached").isNull() | (F.col("frame") > F.col("_reached")))
    )
    todo = _kept(todo.select("seq", "frame", "batch", F.col("_reached").isNull().alias("fresh")), tables.plan(batch_id, "todo"))

    def pixels(frames: DataFrame) -> DataFrame | None:
        among = _batches(frames)
        found = arrived.where(F.col("batch").isin(among)).drop("batch")
        return found.join(frames.select("seq", "frame").distinct(), ["seq", "frame"], "left_semi") if among else None

    later, fresh = (pixels(todo.where(F.col("fresh") == flag)) for flag in (False, True))
    parts = []
    if later is not None:
        done = finished_frames(spark, tables).where(F.col("batch").isin(_batches(newest)))
        last = done.join(newest.drop("batch"), ["run_id", "seq", "frame"], "left_semi").select(
            "run_id", "seq", "frame", "y", "w", "h", "r", "g", "b", "a", "k"
        )
        parts.append(feedback_scan(later, runs, state=last))
    if fresh is not None or not parts and newest.isEmpty():
        # With nothing done and nothing to do, an empty scan gives the tables their schema.
        parts.append(feedback_scan(arrived.drop("batch").where(F.lit(False)) if fresh is None else fresh, runs))
    failures = _waiting(ready, runs, first_frame)
    for part in parts:
        failures = failures.unionByName(part.failures.select(*failures.columns))
    # The failures first: once the lines are there, the frames count as done.
    failures.write.mode("overwrite").parquet(tables.failed(batch_id))
    for i, part in enumerate(parts):
        part.lines.write.mode("overwrite" if i == 0 else "append").parquet(tables.batch(batch_id))
    finished = finished_frames(spark, tables)
    if parts:
        reached_now = finished.where(F.col("batch") == batch_id).groupBy("run_id", "seq").agg(F.max("frame").alias("frame"))
        reached_now.write.mode("overwrite").parquet(tables.ends(batch_id))
    spark.range(1).select(F.lit(batch_id).cast("int").alias("batch")).coalesce(1).write.mode("append").parquet(tables.log)


def as_catalog(frames: DataFrame) -> DataFrame:
    """Pixels carry all passes, so an arrived frame is complete."""
    passes = F.array(F.lit("beauty"), F.lit("vector"), F.lit("matte"))
    return frames.select("seq", "frame", F.explode(passes).alias("pass"))


def stream_totals(diag: DataFrame) -> DataFrame:
    """Running totals per run and sequence of a stream of frame counters."""
    kept = ~F.col("reset")
    return diag.groupBy("run_id", "seq").agg(
        F.count_if(kept).alias("eligible_frame_count"),
        *[
            F.coalesce(F.sum(F.when(kept, F.col(c))), F.lit(0).cast("bigint")).alias(c)
            for c in ("pixel_count", "target_matte_pixels", "primary_history_attempts", "historical_blend_pixels",
                      "changed_output_pixels")
        ],
    )


def stream_catalog(spark: SparkSession, root: str, glob: str, *, max_files: int | None = None) -> DataFrame:
    """Files as they appear, once each, without their contents: all that are there, or at most ``max_files`` in a trigger."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
    )
    files = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).load(root)
    return files.select("path", "modificationTime", "length")
