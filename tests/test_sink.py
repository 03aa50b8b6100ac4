"""Outputs are never replaced without permission, and shared storage is required on a cluster."""

import glob
from types import SimpleNamespace

import pytest
from rasters import gray, px_frame, px_rows

from rasterecho.plans.workspace import new_folder, shared_root
from rasterecho.sources import catalog
from rasterecho.sources.catalog import sink_frames


def test_existing_frames_need_overwrite(spark):
    path = new_folder(spark, "sink")
    px = px_frame(spark, px_rows("s", 1, gray(2, 2, 1.0)), px_rows("s", 2, gray(2, 2, 1.0))).select("seq", "frame", "y", "x", "r")
    sink_frames(px, path)
    with pytest.raises(FileExistsError, match="s/1"):
        sink_frames(px.where("frame = 1"), path)
    sink_frames(px.where("frame = 1").selectExpr("seq", "frame", "y", "x", "CAST(0.5 AS FLOAT) AS r"), path, overwrite=True)
    got = {(r.frame, r.r) for r in spark.read.parquet(path).select("frame", "r").distinct().collect()}
    assert got == {(1, 0.5), (2, 1.0)}


def test_cluster_without_shared_folder_is_refused():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(session)


def test_folders_and_files_do_not_grow_with_frames(spark, monkeypatch):
    """Each sequence and frame had a folder, all of which the driver kept."""
    path = new_folder(spark, "sink")
    px = px_frame(spark, *[px_rows(s, n, gray(1, 2, 0.5)) for s in ("a", "", "b/1") for n in range(-20, 80)]).select("seq", "frame", "y", "x", "r")
    monkeypatch.setattr(catalog, "SINK_PARTS", 4)
    sink_frames(px, path)
    folders = glob.glob(f"{path}/*=*")
    assert len(folders) == 4 and len(glob.glob(f"{path}/**/*.parquet", recursive=True)) <= 8
    # The frames beside a replaced one stay, in its folder and in others.
    given = px.where("frame IN (-3, 5) AND seq <> 'a'").selectExpr("seq", "frame", "y", "x", "CAST(0.25 AS FLOAT) AS r")
    sink_frames(given.unionByName(given.limit(1).selectExpr("'new' AS seq", "frame", "0 AS y", "0 AS x", "r")), path, overwrite=True)
    got = {(r.seq, r.frame, r.y, r.x): r.r for r in spark.read.parquet(path).collect()}
    want = {(r.seq, r.frame, r.y, r.x): 0.25 if r.frame in (-3, 5) and r.seq != "a" else 0.5 for r in px.collect()}
    extra = {k: v for k, v in got.items() if k[0] == "new"}
    assert list(extra.values()) == [0.25] and {k: v for k, v in got.items() if k not in extra} == want
    with pytest.raises(FileExistsError, match="b/1/79"):
        sink_frames(px.where("seq = 'b/1' AND frame = 79"), path)
