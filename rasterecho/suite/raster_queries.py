"""A6, A7, A11, A12, C1-C9, D1-D6, E1-E10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import assign_runs, run_row
from ..operators import blocks as B
from ..operators import gather as G
from ..operators.segments import frame_dims
from ..operators.step import KEY, Semantics, advance, clean_start, pack_lines, step_lines, step_pixels, unpack_lines
from ..sources.raster import array_to_raster, matte_red, orient, raster_to_array
from . import sqlgen as S
from .fixtures import BLOCK, HEIGHT, RASTER_CTE, WIDTH, table
from .registry import query
from .shared import px, px_jobs

PIXEL = ("seq", "frame", "y", "x")
W = f"WITH {RASTER_CTE}"


def doubles(df, *names):
    """Floats as doubles, so both engines report the same type."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])


def sql_doubles(*names: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in names)


# --- rasters -----------------------------------------------------------------------------------

@query("a6_matte_red", f"{W} SELECT seq, frame, y, x, CAST(r AS DOUBLE) AS m FROM px")
def a6(spark, sf):
    return doubles(matte_red(px(spark, sf)), "m")


@query("a7_orient_top_left",
       f"{W} SELECT seq, frame, {HEIGHT - 1} - y AS y, x, {sql_doubles('r', 'm')} FROM px")
def a7(spark, sf):
    raster = px(spark, sf).select(*PIXEL, "r", "m")
    return doubles(orient(raster, frame_dims(px(spark, sf))).select(*PIXEL, "r", "m"), "r", "m")


CHANNELS = ("r", "g", "b", "a", "vr", "vg", "vb", "va", "m")


@query("a11_rasterize_table", f"{W} SELECT seq, frame, y, x, {sql_doubles(*CHANNELS)} FROM px")
def a11(spark, sf):
    from .fixtures import raster

    return doubles(raster(spark, sf), *CHANNELS)


EMBEDDED = """WITH e AS (SELECT vec_id, label, 'e' || label AS seq,
   CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) AS frame, embedding FROM embeddings),
 pix AS (SELECT seq, frame, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS FLOAT) AS r
   FROM e, range(1, 65) t(i))"""


def embedded(spark, sf):
    """One 8x8 raster per vector; vectors of a label form a sequence in id order."""
    from pyspark.sql import Window

    rows = table(spark, sf, "embeddings").select(
        F.concat(F.lit("e"), F.col("label").cast("string")).alias("seq"),
        F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("frame"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    return array_to_raster(rows, "embedding", 8)


@query("a12_array_to_raster", f"{EMBEDDED} SELECT seq, frame, y, x, CAST(r AS DOUBLE) AS r FROM pix")
def a12(spark, sf):
    return doubles(embedded(spark, sf), "r")


@query("a12_raster_to_array", """SELECT 'e' || label AS seq,
   CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) AS frame,
   CAST(len(embedding) AS INT) AS n, CAST(CAST(embedding[1] AS FLOAT) AS DOUBLE) AS first_value,
   CAST(CAST(embedding[len(embedding)] AS FLOAT) AS DOUBLE) AS last_value FROM embeddings""")
def a12_back(spark, sf):
    back = raster_to_array(embedded(spark, sf), ("seq", "frame"), "r", "v")
    return back.select(
        "seq", "frame", F.size("v").alias("n"), F.element_at("v", 1).cast("double").alias("first_value"),
        F.element_at("v", -1).cast("double").alias("last_value"),
    )


# --- motion and blocks -------------------------------------------------------------------------

DECODE = run_row("decode", motion_channels="BA", reverse_motion=True, flip_x=True, motion_gain=2.0,
                 motion_clamp=1.5, block_size=BLOCK)
MIXED = run_row("mixed", block_size=BLOCK, motion_quantization=0.25, diffusion=0.25, refresh_probability=0.35, seed=23)


def jobs_for(spark, sf, run):
    base = px(spark, sf)
    return base.join(assign_runs(base, [run]), "seq")


@query("c1_motion_decode", f"{W} SELECT seq, frame, y, x, ux, uy FROM ({S.decode_sql(DECODE)})")
def c1(spark, sf):
    return B.motion_decode(jobs_for(spark, sf, DECODE)).select(*PIXEL, "ux", "uy")


@query("c2_motion_clamp", f"{W}, mv AS ({S.decode_sql(DECODE)}) SELECT seq, frame, y, x, {sql_doubles('du', 'dv')} "
       f"FROM ({S.clamp_sql(DECODE, 'mv')})")
def c2(spark, sf):
    moved = B.motion_clamp(B.motion_decode(jobs_for(spark, sf, DECODE)))
    return doubles(moved.select(*PIXEL, "du", "dv"), "du", "dv")


BLOCK_OUT = ("seq", "frame", "by", "bx")


@query("c3_block_mean", f"{W}, {S.blocks_cte(MIXED)} SELECT seq, frame, by, bx, {sql_doubles('dx', 'dy')} FROM bm")
def c3(spark, sf):
    means = B.block_mean(B.motion_clamp(B.motion_decode(jobs_for(spark, sf, MIXED))))
    return doubles(means.select(*BLOCK_OUT, "dx", "dy"), "dx", "dy")


def _quantized(spark, sf):
    settings = ("motion_quantization", "diffusion", "refresh_probability", "seed")
    moved = B.motion_clamp(B.motion_decode(jobs_for(spark, sf, MIXED)))
    return B.block_quantize(B.block_mean(moved, settings))


@query("c4_block_quantize", f"{W}, {S.blocks_cte(MIXED)} SELECT seq, frame, by, bx, {sql_doubles('dx', 'dy')} FROM bq")
def c4(spark, sf):
    return doubles(_quantized(spark, sf).select(*BLOCK_OUT, "dx", "dy"), "dx", "dy")


HASH_SOURCE = """SELECT CAST(l_partkey AS BIGINT) AS seed, CAST(l_linenumber AS INT) - 3 AS frame,
 CAST(l_suppkey AS INT) AS by, CAST(l_orderkey % 1000 AS INT) AS bx FROM lineitem"""


@query("c5_block_hash", f"""WITH src AS (SELECT seed, frame, by, bx FROM ({HASH_SOURCE.replace('- 3', '+ 0')})),
{S.hash_cte('src', 'seed')} SELECT seed, frame, by, bx, u0, u1, u2 FROM hs""")
def c5(spark, sf):
    from ..functions.hashing import with_unit_random

    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("bigint").alias("seed"), F.col("l_linenumber").cast("int").alias("frame"),
        F.col("l_suppkey").cast("int").alias("by"), (F.col("l_orderkey") % 1000).cast("int").alias("bx"),
    )
    return with_unit_random(rows, {"u0": 0, "u1": 1, "u2": 2})


@query("c6_block_diffuse", f"{W}, {S.blocks_cte(MIXED)} SELECT seq, frame, by, bx, {sql_doubles('dx', 'dy')} FROM bl")
def c6(spark, sf):
    return doubles(B.block_diffuse(_quantized(spark, sf)).select(*BLOCK_OUT, "dx", "dy"), "dx", "dy")


@query("c7_block_refresh", f"{W}, {S.blocks_cte(MIXED)} SELECT seq, frame, by, bx, refresh FROM bl")
def c7(spark, sf):
    return B.block_refresh(_quantized(spark, sf)).select(*BLOCK_OUT, "refresh")


@query("c8_prepare_blocks", f"{W}, {S.blocks_cte(MIXED)} SELECT 'mixed' AS run_id, seq, frame, by, bx, "
       f"{sql_doubles('dx', 'dy')}, refresh FROM bl")
def c8(spark, sf):
    return doubles(B.prepare_blocks(jobs_for(spark, sf, MIXED)), "dx", "dy")


@query("c9_expand_blocks", f"""{W}, {S.blocks_cte(MIXED)} SELECT px.seq, px.frame, px.y, px.x,
 {sql_doubles('dx', 'dy')}, refresh FROM px JOIN bl ON px.seq = bl.seq AND px.frame = bl.frame
 AND px.y // {BLOCK} = by AND px.x // {BLOCK} = bx""")
def c9(spark, sf):
    jobs = jobs_for(spark, sf, MIXED)
    spread = B.expand_blocks(jobs.select("run_id", *PIXEL, "block_size"), B.prepare_blocks(jobs))
    return doubles(spread.select(*PIXEL, "dx", "dy", "refresh"), "dx", "dy")


# --- sampling: every pixel reads its own position of the frame before ----------------------------

def _targets(spark, sf):
    """Positions from the raw vectors, some of them off the raster."""
    base = px(spark, sf).where(F.col("frame") > 1)
    return base.select(
        *PIXEL,
        (F.col("x").cast("float") - F.col("vr") * F.lit(1.25).cast("float")).alias("sx"),
        (F.col("y").cast("float") - F.col("vg") * F.lit(1.25).cast("float")).alias("sy"),
        F.lit(WIDTH).alias("w"), F.lit(HEIGHT).alias("h"),
    )


def _source(spark, sf):
    base = px(spark, sf)
    return base.select("seq", (F.col("frame") + 1).alias("frame"), "y", "x", "r", "g", "b", "a", F.col("m").alias("k"))


TARGETS = f"""tg0 AS (SELECT seq, frame, y, x, CAST(x AS FLOAT) - vr * CAST(1.25 AS FLOAT) AS sx,
   CAST(y AS FLOAT) - vg * CAST(1.25 AS FLOAT) AS sy FROM px WHERE frame > 1),
tg1 AS (SELECT *, sx >= 0 AND sx <= {WIDTH - 1} AND sy >= 0 AND sy <= {HEIGHT - 1} AS valid,
   least(greatest(sx, 0::FLOAT), {WIDTH - 1}::FLOAT) AS cx, least(greatest(sy, 0::FLOAT), {HEIGHT - 1}::FLOAT) AS cy FROM tg0),
tg2 AS (SELECT *, CAST(floor(cx) AS INT) AS x0, CAST(floor(cy) AS INT) AS y0, least(CAST(floor(cx) AS INT) + 1, {WIDTH - 1}) AS x1,
   least(CAST(floor(cy) AS INT) + 1, {HEIGHT - 1}) AS y1, cx - CAST(floor(cx) AS FLOAT) AS wx, cy - CAST(floor(cy) AS FLOAT) AS wy FROM tg1),
p AS (SELECT *, {S.TAP_KEYS} FROM tg2),
prv AS MATERIALIZED {S.keyed('SELECT seq, frame + 1 AS frame, y, x, r, g, b, a, m AS k FROM px')}"""
TAP_JOIN = "p " + " ".join(f"JOIN prv t{i}{j} ON t{i}{j}.pk = p.k{i}{j}" for i in (0, 1) for j in (0, 1))
AT = "p.seq, p.frame, p.y, p.x"
KEYS = ("seq", "frame")


def _sampled(c: str) -> str:
    return f"CAST(CASE WHEN valid THEN {S.bil(c)} ELSE 0::FLOAT END AS DOUBLE) AS {c}"


@query("d1_bilinear_scalar", f"{W}, {TARGETS} SELECT {AT}, valid, {_sampled('k')} FROM {TAP_JOIN}")
def d1(spark, sf):
    got = G.bilinear(_targets(spark, sf), _source(spark, sf), ("k",), KEYS)
    return doubles(got.select(*PIXEL, "valid", "k"), "k")


@query("d2_bilinear_rgba", f"{W}, {TARGETS} SELECT {AT}, {', '.join(_sampled(c) for c in 'rgba')} FROM {TAP_JOIN}")
def d2(spark, sf):
    got = G.bilinear(_targets(spark, sf), _source(spark, sf), ("r", "g", "b", "a"), KEYS)
    return doubles(got.select(*PIXEL, "r", "g", "b", "a"), "r", "g", "b", "a")


@query("d3_sample_valid", f"{W}, {TARGETS} SELECT {AT}, valid FROM p")
def d3(spark, sf):
    return G.sample_valid(_targets(spark, sf)).select(*PIXEL, "valid")


_Q = f"(CASE WHEN valid THEN {S.bil('k')} ELSE 0::FLOAT END)"
_REC = ", ".join(
    "CAST(CAST((CASE WHEN valid THEN " + S.bil_of("({t}." + c + " * {t}.k)") + " ELSE 0::FLOAT END) / "
    f"(CASE WHEN valid AND {_Q} > 0 THEN {_Q} ELSE 1::FLOAT END) AS FLOAT) AS DOUBLE) AS {c}" for c in "rgba")


@query("d4_premultiplied_sample", f"{W}, {TARGETS} SELECT {AT}, {_REC}, CAST({_Q} AS DOUBLE) AS q, "
       f"valid AND {_Q} > 0 AS covered FROM {TAP_JOIN}")
def d4(spark, sf):
    got = G.premultiplied(_targets(spark, sf), _source(spark, sf), KEYS)
    return doubles(got.select(*PIXEL, "r", "g", "b", "a", "q", "covered"), "r", "g", "b", "a", "q")


@query("d5_contamination", f"""{W}, {TARGETS} SELECT {AT}, valid AND {S.bil_of(
    '(CASE WHEN {t}.b > 0.9 OR {t}.g > 0.9 THEN 1::FLOAT ELSE 0::FLOAT END)')} = 0 AS clean FROM {TAP_JOIN}""")
def d5(spark, sf):
    # Bright pixels become bad history: non-finite color or illegal coverage.
    bad = _source(spark, sf).withColumns(
        {
            "r": F.when(F.col("b") > 0.9, F.lit(float("nan")).cast("float")).otherwise(F.col("r")),
            "k": F.when(F.col("g") > 0.9, F.lit(1.5).cast("float")).otherwise(F.col("k")),
        }
    )
    return G.contamination(_targets(spark, sf), bad, KEYS).select(*PIXEL, "clean")


@query("d6_same_pixel_history", f"""{W}, {TARGETS} SELECT {AT}, NOT valid AS from_screen, {', '.join(
    f'CAST(CASE WHEN valid THEN {S.bil(c)} ELSE h.{c} END AS DOUBLE) AS {c}' for c in 'rgba')}
 FROM {TAP_JOIN} JOIN prv h ON h.pk = p.kk""")
def d6(spark, sf):
    source = _source(spark, sf)
    got = G.same_pixel_history(G.bilinear(_targets(spark, sf), source, ("r", "g", "b", "a"), KEYS), source, KEYS)
    return doubles(got.select(*PIXEL, "from_screen", "r", "g", "b", "a"), "r", "g", "b", "a")


# --- one step: every frame over the clean state of the frame before --------------------------------

def step_inputs(spark, sf, run):
    """Lines, history and blocks in which each frame after the first is its own segment."""
    base = px(spark, sf)
    jobs = assign_runs(base, [run])
    lines = pack_lines(base, ("r", "g", "b", "a", "m"))
    live = frame_dims(base).select("seq", "frame", "h", F.col("has_matte").alias("live"))
    later = lines.where(F.col("frame") > 1).join(live, ["seq", "frame"]).join(jobs, "seq")
    cur = later.withColumn("seg", F.col("frame"))
    prev = lines.withColumnRenamed("m", "k").join(jobs.select("seq", "run_id"), "seq").withColumn(
        "seg", F.col("frame") + 1
    )
    blocks = B.prepare_blocks(base.where(F.col("frame") > 1).join(jobs, "seq")).withColumn("seg", F.col("frame"))
    return cur, prev.select(*KEY, "y", "r", "g", "b", "a", "k"), blocks


STEP_OUT = {"r": "r", "g": "g", "b": "b", "a": "a", "k": "cov"}
STEP_SELECT = ("SELECT seq, frame, y, x, CAST(o_r AS DOUBLE) AS r, CAST(o_g AS DOUBLE) AS g, CAST(o_b AS DOUBLE) AS b, "
               "CAST(o_a AS DOUBLE) AS a, CAST(k AS DOUBLE) AS cov FROM st")


def one_step(spark, sf, run, *, live_trail=True):
    cur, prev, blocks = step_inputs(spark, sf, run)
    semantics = Semantics.of(run)
    if semantics.trail:
        cur = cur.withColumn("live", F.lit(live_trail))
    out = advance(cur, prev, blocks, semantics, counters=False)
    return doubles(unpack_lines(out, STEP_OUT, ("seq", "frame")), *STEP_OUT.values())


@query("e1_step_reset", f"{W} SELECT seq, frame, y, x, {sql_doubles('r', 'g', 'b', 'a')}, CAST(m AS DOUBLE) AS cov "
       "FROM px WHERE frame > 1")
def e1(spark, sf):
    cur, _, _ = step_inputs(spark, sf, S.RUNS["hard_target"])
    return doubles(unpack_lines(clean_start(cur), STEP_OUT, ("seq", "frame")), *STEP_OUT.values())


@query("e2_step_target_hard", S.pair_step_sql(S.RUNS["hard_target"], STEP_SELECT))
def e2(spark, sf):
    return one_step(spark, sf, S.RUNS["hard_target"])


@query("e3_step_target_trail", S.pair_step_sql(S.RUNS["trail_target"], STEP_SELECT))
def e3(spark, sf):
    return one_step(spark, sf, S.RUNS["trail_target"])


@query("e4_step_full_hard", S.pair_step_sql(S.RUNS["hard_full"], STEP_SELECT))
def e4(spark, sf):
    return one_step(spark, sf, S.RUNS["hard_full"])


@query("e5_step_full_trail", S.pair_step_sql(S.RUNS["trail_full"], STEP_SELECT))
def e5(spark, sf):
    return one_step(spark, sf, S.RUNS["trail_full"])


def step_facts(spark, sf, run):
    cur, prev, blocks = step_inputs(spark, sf, run)
    return step_pixels(cur, prev, blocks, Semantics.of(run))


@query("e6_fallback_beauty", S.pair_step_sql(S.RUNS["hard_full"],
       "SELECT seq, frame, count(*) FILTER (effect > 0) AS attempts, count(*) FILTER (effect > 0 AND covered) AS valid_uses, "
       "count(*) FILTER (effect > 0 AND NOT covered AND NOT own_used) AS beauty_fallback FROM st GROUP BY seq, frame"))
def e6(spark, sf):
    facts = step_facts(spark, sf, S.RUNS["hard_full"])
    missed = (F.col("effect") > 0) & ~F.col("covered")
    return facts.groupBy("seq", "frame").agg(
        F.count_if(F.col("effect") > 0).alias("attempts"),
        F.count_if((F.col("effect") > 0) & F.col("covered")).alias("valid_uses"),
        F.count_if(missed & ~F.col("own_used")).alias("beauty_fallback"),
    )


@query("e7_refresh_blend", S.pair_step_sql(S.RUNS["refresh"],
       "SELECT seq, frame, y, x, refresh, CAST(full_weight AS DOUBLE) AS full_weight, CAST(blend AS DOUBLE) AS blend FROM st"))
def e7(spark, sf):
    facts = step_facts(spark, sf, S.RUNS["refresh"])
    return doubles(facts.select(*PIXEL, "refresh", "full_weight", "blend"), "full_weight", "blend")


@query("e8_blend", S.pair_step_sql(S.RUNS["refresh"], STEP_SELECT.replace(", CAST(k AS DOUBLE) AS cov", "")))
def e8(spark, sf):
    facts = step_facts(spark, sf, S.RUNS["refresh"])
    return doubles(facts.select(*PIXEL, *[F.col(f"o_{c}").alias(c) for c in "rgba"]), *"rgba")


# Mattes are emptied on odd frames, so half the frames cannot hold effect.
EMPTY = RASTER_CTE.replace("px AS MATERIALIZED", "full_px AS MATERIALIZED") + (
    ",\npx AS MATERIALIZED (SELECT * REPLACE (CASE WHEN frame % 2 = 1 THEN 0::FLOAT ELSE m END AS m) FROM full_px)")


@query("e9_empty_effect", f"{W} SELECT seq, frame, bool_or(m > 0 AND frame % 2 = 0) AS live_hard, "
       "bool_or(max(CASE WHEN m > 0 AND frame % 2 = 0 THEN 1 ELSE 0 END) = 1) "
       "OVER (PARTITION BY seq ORDER BY frame) AS live_trail FROM px GROUP BY seq, frame")
def e9(spark, sf):
    from ..operators.segments import segments, with_live

    emptied = px(spark, sf).withColumn("m", F.when(F.col("frame") % 2 == 1, F.lit(0.0)).otherwise(F.col("m")).cast("float"))
    return with_live(segments(frame_dims(emptied))).select("seq", "frame", "live_hard", "live_trail")


@query("e10_next_state", S.pair_step_sql(S.RUNS["trail_target"],
       "SELECT seq, frame, y, x, CAST(o_r AS DOUBLE) AS r, CAST(k AS DOUBLE) AS cov FROM st WHERE k > 0 OR effect > 0"))
def e10(spark, sf):
    facts = step_facts(spark, sf, S.RUNS["trail_target"])
    kept = facts.where((F.col("k") > 0) | (F.col("effect") > 0))
    return doubles(kept.select(*PIXEL, F.col("o_r").alias("r"), F.col("k").alias("cov")), "r", "cov")
