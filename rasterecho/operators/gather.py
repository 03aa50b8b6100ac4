"""Sampling a raster at arbitrary per-pixel positions.

Used where each pixel has its own position; the scan has a faster way for whole blocks. The source is packed into
rows, and each target meets one pair of rows instead of four taps, so targets are shuffled once and not grouped again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as P
from .step import pack_lines


def sample_valid(targets: DataFrame) -> DataFrame:
    """D3: add ``valid``; needs sx, sy, w, h."""
    return targets.selectExpr("*", f"{P.inside('sx', 'w')} AND {P.inside('sy', 'h')} AS valid")


def taps(targets: DataFrame, source: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Attach the four taps of each column as ``t0_* .. t3_*``, with ``wx, wy, valid``.

    ``targets``: keys, y, x, sx, sy, w, h and anything to keep; ``source``: keys, y, x and the columns.
    """
    kept = targets.columns
    at = targets.selectExpr(
        "*", f"{P.inside('sx', 'w')} AND {P.inside('sy', 'h')} AS valid",
        f"{P.on_grid('sx', 'w')} AS _cx", f"{P.on_grid('sy', 'h')} AS _cy",
    ).selectExpr("*", "CAST(_cx AS INT) AS _x0", "CAST(_cy AS INT) AS _y0")
    asked = at.selectExpr(
        *kept, "valid", "_x0", "least(_x0 + 1, w - 1) AS _x1", "_y0", "_y0 + 1 > h - 1 AS _last",
        "_cx - CAST(_x0 AS FLOAT) AS wx", "_cy - CAST(_y0 AS FLOAT) AS wy",
    )
    rows = pack_lines(source, columns, keys)
    upper = rows.select(*keys, F.col("y").alias("_y0"), *[F.col(c).alias(f"_u_{c}") for c in columns])
    lower = rows.select(*keys, (F.col("y") - 1).alias("_y0"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    # A row may lack the one above or below it; the last row of a raster is its own lower row.
    met = asked.join(upper.join(lower, [*keys, "_y0"], "full_outer"), [*keys, "_y0"]).where(
        f"_u_{columns[0]} IS NOT NULL OR NOT _last"
    )
    sides = {"u": "_u_{c}", "l": "IF(_last, _u_{c}, _l_{c})"}
    return met.selectExpr(
        *kept, "valid", "wx", "wy",
        *[
            f"get({sides['ul'[tap // 2]].format(c=c)}, _x{tap % 2}) AS t{tap}_{c}"
            for tap in range(4) for c in columns
        ],
    )


def bilinear(targets: DataFrame, source: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Add each column interpolated at (sx, sy), 0 where the position is off the raster."""
    kept = targets.columns
    four = taps(targets, source, columns, keys)
    samples = [
        f"{P.pick('valid', P.bilinear([f't{i}_{c}' for i in range(4)]))} AS {c}" for c in columns
    ]
    return four.selectExpr(*kept, "valid", *samples)


def premultiplied(targets: DataFrame, source: DataFrame, keys: tuple[str, ...], *, checked: bool = True) -> DataFrame:
    """Target-only color ``r g b a`` and coverage ``q``; background beside the target has no say."""
    kept = targets.columns
    four = P.taps(checked)
    at = taps(targets, source, ("r", "g", "b", "a", "k"), keys)
    at = at.selectExpr("*", f"{P.target_cover(four)} AS q").selectExpr(
        "*", f"{P.target_usable(four, 'q')} AS covered"
    )
    return at.selectExpr(
        *kept, "q", "covered", *[f"{P.target_color(four, c, 'q', 'covered')} AS {c}" for c in P.COLOR]
    )


def contamination(targets: DataFrame, source: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Add ``clean``: no contributing tap of the source has a non-finite color or illegal coverage."""
    kept = targets.columns
    four = P.taps(False)
    at = taps(targets, source, ("r", "g", "b", "a", "k"), keys)
    bad = P.contaminated(four, lambda t: f"NOT ({t.color_ok} AND {t.cover_ok})")
    return at.selectExpr(*kept, "valid", f"(valid AND NOT {bad}) AS clean")


def same_pixel_history(sampled: DataFrame, source: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Where a sample is not valid, take the same pixel of the source instead."""
    here = source.select(*keys, "y", "x", *[F.col(c).alias(f"p_{c}") for c in P.COLOR])
    joined = sampled.join(here, [*keys, "y", "x"])
    kept = [c for c in sampled.columns if c not in P.COLOR]
    finite = P.Tap("p", checked=False).color_ok
    return joined.selectExpr(
        *kept, *[f"{P.pick('valid', c, P.pick(finite, f'p_{c}'))} AS {c}" for c in P.COLOR],
        f"(NOT valid AND {finite}) AS from_screen",
    )
