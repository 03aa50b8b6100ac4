"""SQL texts of the same computations, written pixel by pixel for a single-node engine.

They share nothing with the Spark code: four explicit tap joins, one query block per frame.
"""

from __future__ import annotations

from ..model import run_row
from .fixtures import BLOCK, FRAMES, HEIGHT, RASTER_CTE, WIDTH

RUNS = {
    "hard_target": run_row("hard_target", block_size=BLOCK),
    "trail_target": run_row("trail_target", mode="TRAIL", trail_decay=0.5, block_size=BLOCK),
    "hard_full": run_row("hard_full", history_source="FULL_FRAME", block_size=BLOCK),
    "trail_full": run_row(
        "trail_full", mode="TRAIL", history_source="FULL_FRAME", trail_decay=0.75, trail_motion_mix=0.25,
        invalid_history_fallback="SAME_PIXEL_HISTORY", block_size=BLOCK,
    ),
    "refresh": run_row(
        "refresh", mode="TRAIL", history_source="FULL_FRAME", trail_decay=0.75, trail_motion_mix=0.25,
        invalid_history_fallback="SAME_PIXEL_HISTORY", block_size=BLOCK, refresh_probability=0.25,
        diffusion=0.25, seed=73079,
    ),
}
RESETS = (3, 5)


def lit(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return f"CAST({value!r} AS DOUBLE)" if isinstance(value, float) else repr(value)


def f(value: float) -> str:
    return f"CAST({value!r} AS FLOAT)"


def mul64(a: str, b: int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * CAST('{b}' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT)"


def add64(a: str, b: int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) + CAST('{b}' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT)"


def hash_cte(source: str, seed: str, name: str = "hs") -> str:
    """``name``: the rows of ``source`` (with frame, by, bx) plus u0, u1, u2."""
    first = {}
    for stream in range(3):
        mixed = f"CAST({seed} AS UBIGINT)"
        for part, factor in (("frame", 0xD6E8FEB86659FD93), ("by", 0xA5A3564E27F8862F), ("bx", 0x9E3779B97F4A7C15)):
            mixed = f"xor({mixed}, {mul64(part, factor)})"
        constant = (stream * 0x94D049BB133111EB) % 2**64
        first[stream] = add64(f"xor({mixed}, CAST('{constant}' AS UBIGINT))", 0x9E3779B97F4A7C15)
    cols = [f"{e} AS h{i}" for i, e in first.items()]
    def again(shift: int, factor: int) -> str:
        return ", ".join(f"{mul64(f'xor(h{i}, h{i} >> {shift})', factor)} AS h{i}" for i in range(3))
    return f"""{name}0 AS (SELECT *, {', '.join(cols)} FROM {source}),
{name}1 AS (SELECT * EXCLUDE (h0, h1, h2), {again(30, 0xBF58476D1CE4E5B9)} FROM {name}0),
{name}2 AS (SELECT * EXCLUDE (h0, h1, h2), {again(27, 0x94D049BB133111EB)} FROM {name}1),
{name} AS (SELECT * EXCLUDE (h0, h1, h2), {', '.join(
        f'CAST(xor(h{i}, h{i} >> 31) >> 11 AS DOUBLE) / 9007199254740992.0::DOUBLE AS u{i}' for i in range(3))} FROM {name}2)"""


def decode_sql(run: dict, source: str = "px") -> str:
    pair = ("vr", "vg") if run["motion_channels"] == "RG" else ("vb", "va")
    sign_x = (-1 if run["reverse_motion"] else 1) * (-1 if run["flip_x"] else 1)
    sign_y = (-1 if run["reverse_motion"] else 1) * (-1 if run["flip_y"] else 1)
    return (f"SELECT seq, frame, y, x, m, CAST({pair[0]} AS DOUBLE) * {sign_x} AS ux, "
            f"CAST({pair[1]} AS DOUBLE) * {sign_y} AS uy FROM {source}")


def clamp_sql(run: dict, source: str) -> str:
    gain, clamp = lit(float(run["motion_gain"])), lit(float(run["motion_clamp"]))
    scale = (f"CASE WHEN sqrt(ux * ux + uy * uy) > 0 THEN least({gain}, {clamp} / sqrt(ux * ux + uy * uy)) "
             f"ELSE {gain} END")
    return (f"SELECT *, CAST(ux * sc AS FLOAT) AS du, CAST(uy * sc AS FLOAT) AS dv "
            f"FROM (SELECT *, {scale} AS sc FROM {source})")


def blocks_cte(run: dict, tag: str = "") -> str:
    """``bl{tag}``: seq, frame, by, bx, dx, dy, refresh."""
    size, step = run["block_size"], float(run["motion_quantization"])
    diffusion, refresh = float(run["diffusion"]), float(run["refresh_probability"])

    def mean(c: str) -> str:
        return (f"CASE WHEN sum(CAST(m AS DOUBLE)) > 0 THEN CAST(sum(CAST({c} AS DOUBLE) * CAST(m AS DOUBLE)) "
                f"/ sum(CAST(m AS DOUBLE)) AS FLOAT) ELSE {f(0.0)} END")

    def quantized(c: str) -> str:
        return f"CAST(round_even(CAST({c} AS DOUBLE) / {lit(step)}, 0) * {lit(step)} AS FLOAT)" if step > 0 else c

    def jitter(c: str, i: int) -> str:
        return f"CAST(CAST({c} AS DOUBLE) + (2 * u{i} - 1) * {lit(diffusion)} AS FLOAT)" if diffusion > 0 else c

    chosen = f"(u2 < {lit(refresh)})" if refresh > 0 else "false"
    return f"""mv{tag} AS ({decode_sql(run)}),
cl{tag} AS ({clamp_sql(run, f'mv{tag}')}),
bm{tag} AS (SELECT seq, frame, CAST(y // {size} AS INT) AS by, CAST(x // {size} AS INT) AS bx,
  {mean('du')} AS dx, {mean('dv')} AS dy FROM cl{tag} GROUP BY ALL),
bq{tag} AS (SELECT seq, frame, by, bx, {quantized('dx')} AS dx, {quantized('dy')} AS dy FROM bm{tag}),
{hash_cte(f'bq{tag}', str(run['seed']), f'hs{tag}')},
bl{tag} AS MATERIALIZED (SELECT seq, frame, by, bx, {jitter('dx', 0)} AS dx, {jitter('dy', 1)} AS dy,
  {chosen} AS refresh FROM hs{tag})"""


def place(y: str, x: str, alias: str = "") -> str:
    """One key per pixel. With a single key per tap the engine cannot derive a join between two taps."""
    return f"{alias}seq || '|' || CAST({alias}frame * 1000000 + {alias}{y} * 1000 + {alias}{x} AS VARCHAR)"


def keyed(select: str) -> str:
    return f"(SELECT *, {place('y', 'x')} AS pk FROM ({select}))"


TAP_KEYS = ", ".join(f"{place(f'y{i}', f'x{j}')} AS k{i}{j}" for i in (0, 1) for j in (0, 1)) + f", {place('y', 'x')} AS kk"


def lerp(a: str, b: str, w: str) -> str:
    return f"({a} * (1::FLOAT - {w}) + {b} * {w})"


def bil(c: str) -> str:
    return lerp(lerp(f"t00.{c}", f"t01.{c}", "wx"), lerp(f"t10.{c}", f"t11.{c}", "wx"), "wy")


def bil_of(fmt: str) -> str:
    """Interpolate an expression with ``{t}`` for the tap alias."""
    t = [fmt.format(t=n) for n in ("t00", "t01", "t10", "t11")]
    return lerp(lerp(t[0], t[1], "wx"), lerp(t[2], t[3], "wx"), "wy")


def position_cte(name: str, cur: str, tag: str, size: int, h: int = HEIGHT, w: int = WIDTH) -> str:
    """``name``: pixels of ``cur`` with block motion, tap coordinates and weights."""
    return f"""{name}a AS (SELECT c.*, b.by, b.bx, b.dx, b.dy, b.refresh, CAST(c.x AS FLOAT) - b.dx AS sx, CAST(c.y AS FLOAT) - b.dy AS sy
  FROM {cur} c JOIN bl{tag} b ON c.seq = b.seq AND c.frame = b.frame AND c.y // {size} = b.by AND c.x // {size} = b.bx),
{name}b AS (SELECT *, sx >= 0 AND sx <= {w - 1} AND sy >= 0 AND sy <= {h - 1} AS valid,
  least(greatest(sx, {f(0.0)}), {f(float(w - 1))}) AS cx, least(greatest(sy, {f(0.0)}), {f(float(h - 1))}) AS cy FROM {name}a),
{name} AS (SELECT *, CAST(floor(cx) AS INT) AS x0, CAST(floor(cy) AS INT) AS y0,
  least(CAST(floor(cx) AS INT) + 1, {w - 1}) AS x1, least(CAST(floor(cy) AS INT) + 1, {h - 1}) AS y1,
  cx - CAST(floor(cx) AS FLOAT) AS wx, cy - CAST(floor(cy) AS FLOAT) AS wy FROM {name}b),
{name}k AS (SELECT *, {TAP_KEYS} FROM {name})"""


def step_cte(name: str, cur: str, prev: str, run: dict, tag: str = "") -> str:
    """``name``: one feedback step of pixels ``cur`` over ``prev`` (same seq, frame already shifted)."""
    full, trail = run["history_source"] == "FULL_FRAME", run["mode"] == "TRAIL"
    same = full and run["invalid_history_fallback"] == "SAME_PIXEL_HISTORY"
    decay, mix = f(run["trail_decay"]), float(run["trail_motion_mix"])
    joins = "\n".join(f"  JOIN {prev} t{i}{j} ON t{i}{j}.pk = p.k{i}{j}" for i in (0, 1) for j in (0, 1))
    joins += f"\n  JOIN {prev} h ON h.pk = p.kk"
    zero = f(0.0)
    if full:
        base = ", ".join(f"CASE WHEN valid THEN {bil(c)} ELSE {zero} END AS g_{c}" for c in "rgba")
        seen = (f"SELECT p.*, h.r AS h_r, h.g AS h_g, h.b AS h_b, h.a AS h_a, h.k AS h_k, {base}, "
                f"CASE WHEN valid THEN {bil('k')} ELSE {zero} END AS q, valid AS covered FROM {name}pk p\n{joins}")
        kept = f"CAST(1.0::DOUBLE - {lit(mix)} AS FLOAT) * h_k + {f(mix)} * q"
        k = f"least(greatest(greatest(m, {decay} * least(greatest({kept}, {zero}), 1::FLOAT)), {zero}), 1::FLOAT)" if trail else "m"
        moved = (f"SELECT *, {k} AS k, {k} AS effect, {'NOT covered' if same else 'false'} AS own_used, "
                 f"{'true' if same else 'covered'} AS used, "
                 + ", ".join(f"{f'CASE WHEN covered THEN g_{c} ELSE h_{c} END' if same else f'g_{c}'} AS s_{c}" for c in "rgba")
                 + f" FROM {name}s")
    else:
        tap = "CASE WHEN {t}.k > 0 THEN {t}.k ELSE 0::FLOAT END"
        base = ", ".join(
            "CASE WHEN valid THEN " + bil_of("CASE WHEN {t}.k > 0 THEN {t}." + c + " * {t}.k ELSE 0::FLOAT END")
            + f" ELSE {zero} END AS g_{c}" for c in "rgba")
        seen = (f"SELECT *, valid AND q > 0 AS covered FROM (SELECT p.*, {base}, "
                f"CASE WHEN valid THEN {bil_of(tap)} ELSE {zero} END AS q FROM {name}pk p\n{joins})")
        d = f"(CASE WHEN covered THEN {decay} * q ELSE {zero} END)"
        k = f"greatest(m, {d})" if trail else "m"
        effect = f"m * q + (1::FLOAT - m) * {d}" if trail else "m * q"
        moved = (f"SELECT *, {k} AS k, {effect} AS effect, false AS own_used, covered AS used, "
                 + ", ".join(f"CAST(g_{c} / (CASE WHEN covered THEN q ELSE 1::FLOAT END) AS FLOAT) AS s_{c}" for c in "rgba")
                 + f" FROM {name}s")
    persistence = f(run["persistence"])
    out = ", ".join(f"r_.{c} * (1::FLOAT - blend) + s_{c} * blend AS o_{c}".replace("r_.", "") for c in "rgba")
    return f"""{position_cte(f'{name}p', cur, tag, run['block_size'])},
{name}s AS ({seen}),
{name}m AS ({moved}),
{name}w AS (SELECT *, CASE WHEN used THEN {persistence} * effect ELSE {zero} END AS full_weight FROM {name}m),
{name}x AS (SELECT *, CASE WHEN refresh THEN {zero} ELSE full_weight END AS blend FROM {name}w),
{name} AS MATERIALIZED (SELECT *, {out} FROM {name}x)"""


def pair_step_sql(run: dict, select: str) -> str:
    """A single step for every frame after the first, over the clean state of the frame before."""
    return f"""WITH {RASTER_CTE}, {blocks_cte(run)},
cur AS (SELECT * FROM px WHERE frame > 1),
prv AS MATERIALIZED {keyed('SELECT seq, frame + 1 AS frame, y, x, r, g, b, a, m AS k FROM px')},
{step_cte('st', 'cur', 'prv', run)}
{select}"""


STATE = "seq, frame, y, x, o_r, o_g, o_b, o_a, k"


def scan_cte(run: dict, tag: str, resets: tuple[int, ...] = (), last: int = FRAMES, raster: str = "px") -> str:
    """``sc{tag}``: seq, frame, y, x, o_r .. o_a, k of all frames, one query block per frame."""
    parts = [blocks_cte(run, tag)]
    selects = []
    for frame in range(1, last + 1):
        name, before = f"f{tag}{frame}", f"f{tag}{frame - 1}"
        cur = f"(SELECT * FROM {raster} WHERE frame = {frame})"
        if frame == 1 or frame in resets:
            parts.append(f"{name} AS MATERIALIZED (SELECT seq, frame, y, x, r AS o_r, g AS o_g, b AS o_b, a AS o_a, m AS k FROM {cur})")
        else:
            before_state = f"SELECT seq, frame + 1 AS frame, y, x, o_r AS r, o_g AS g, o_b AS b, o_a AS a, k FROM {before}"
            parts.append(f"v{name} AS MATERIALIZED {keyed(before_state)}")
            parts.append(step_cte(name, cur, f"v{name}", run, tag))
        selects.append(f"SELECT {STATE} FROM {name}")
    parts.append(f"sc{tag} AS ({' UNION ALL '.join(selects)})")
    return ",\n".join(parts)


def diag_frames_cte(run: dict, tag: str, resets: tuple[int, ...] = ()) -> str:
    """``dg{tag}``: the counters of each frame of a scan made by ``scan_cte``."""
    change = "greatest(abs(o_r - r), abs(o_g - g), abs(o_b - b))"
    own = run["invalid_history_fallback"] == "SAME_PIXEL_HISTORY"
    selects = []
    for frame in range(1, FRAMES + 1):
        name = f"f{tag}{frame}"
        if frame == 1 or frame in resets:
            selects.append(f"""SELECT seq, frame AS frame_number, true AS reset, count(*) AS pixel_count,
 count(*) FILTER (m > 0) AS target_matte_pixels, avg(CAST(m AS DOUBLE)) AS target_matte_coverage,
 count(*) FILTER (m > 0) AS effect_matte_pixels, avg(CAST(m AS DOUBLE)) AS effect_matte_coverage,
 0 AS primary_history_attempts, 0 AS primary_history_valid_uses, 0 AS primary_history_invalid_samples,
 0 AS same_pixel_fallback_attempts, 0 AS same_pixel_fallback_valid_uses, 0 AS current_beauty_fallback_pixels,
 0 AS refresh_restored_pixels, 0 AS refresh_restored_blocks, 0 AS historical_blend_pixels,
 0::DOUBLE AS historical_blend_weight, 0 AS changed_output_pixels, 0::DOUBLE AS changed_output_ratio,
 0::DOUBLE AS changed_output_mean_absolute, 0::DOUBLE AS changed_output_max_absolute
 FROM px WHERE frame = {frame} GROUP BY seq, frame""")
        else:
            selects.append(f"""SELECT seq, frame, false, count(*), count(*) FILTER (m > 0), avg(CAST(m AS DOUBLE)),
 count(*) FILTER (effect > 0), avg(CAST(effect AS DOUBLE)), count(*) FILTER (effect > 0),
 count(*) FILTER (effect > 0 AND covered), count(*) FILTER (effect > 0 AND NOT covered),
 {'count(*) FILTER (effect > 0 AND NOT covered)' if own else '0'}, count(*) FILTER (effect > 0 AND own_used),
 count(*) FILTER (effect > 0 AND NOT covered AND NOT own_used),
 count(*) FILTER (refresh AND full_weight > 0),
 count(DISTINCT CASE WHEN refresh AND effect > 0 AND used THEN by * 10000 + bx END),
 count(*) FILTER (blend > 0), sum(CAST(blend AS DOUBLE)), count(*) FILTER ({change} > {f(1e-6)}),
 count(*) FILTER ({change} > {f(1e-6)}) / CAST(count(*) AS DOUBLE),
 avg(CAST({change} AS DOUBLE)), max(CAST({change} AS DOUBLE)) FROM {name} GROUP BY seq, frame""")
    return f"dg{tag} AS MATERIALIZED ({' UNION ALL '.join(selects)})"
