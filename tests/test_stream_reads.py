"""A trigger reads the pixels and lines it needs, not all that have arrived."""

import glob
import shutil

import numpy as np
from rasters import gray, px_frame, px_rows

from rasterecho.model import EXTREME, run_row
from rasterecho.plans.scan import feedback_scan
from rasterecho.streaming.feedback import StreamTables, finished_frames, step


def frame(seq, number):
    return px_rows(seq, number, gray(2, 4, 0.125 * number), matte=np.full((2, 4), 0.5, np.float32))


def test_old_batches_are_not_read_again(spark, tmp_path):
    """The data in files of batches whose frames are done is broken before the next trigger."""
    tables, runs = StreamTables(str(tmp_path)), [run_row("a", **EXTREME)]
    given = {0: [frame("s", 1), frame("s", 2)], 1: [frame("s", 3), frame("t", 2)], 2: [frame("s", 4), frame("t", 1)], 3: [frame("s", 5)]}
    for batch_id, frames in given.items():
        px_frame(spark, *frames).write.parquet(f"{tables.arrived}/batch={batch_id}")
        if batch_id == 3:
            shutil.copytree(tables.arrived, f"{tmp_path}/copy")
            # Frame 2 of t waited in batch 1; by now all of these are done.
            for path in [p for n in (0, 1) for p in glob.glob(f"{tables.arrived}/batch={n}/*.parquet") + glob.glob(f"{tables.batch(n)}/*.parquet")]:
                with open(path, "r+b") as file:
                    file.write(b"broken" * 20)
        step(spark, tables, runs, batch_id, 1)
    done = finished_frames(spark, tables).where("batch >= 2")
    got = {(r.seq, r.frame, r.y): (r.r, r.k) for r in done.collect()}
    whole = feedback_scan(spark.read.parquet(f"{tmp_path}/copy").drop("batch"), runs).lines.where("seq = 't' OR frame > 3")
    assert got == {(r.seq, r.frame, r.y): (r.r, r.k) for r in whole.collect()} and len(got) == 8
