"""SQL expressions for one pixel: interpolation, validity, coverage and blending.

They are text because a step holds about a thousand operators: one parse in the JVM replaces a
thousand calls from Python. ``F`` marks single-precision literals, so arithmetic stays in float.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

COLOR = ("r", "g", "b", "a")
CHANGE_EPSILON = "1.0E-6F"


def finite(value: str) -> str:
    """NaN is tested first: Spark orders it above every number."""
    return f"(NOT isnan({value}) AND abs({value}) < CAST('Infinity' AS FLOAT))"


def inside(value: str, size: str) -> str:
    """Whether a sample coordinate lies on the pixel grid of the given size."""
    return f"({finite(value)} AND {value} >= 0F AND {value} <= CAST({size} - 1 AS FLOAT))"


def on_grid(value: str, size: str) -> str:
    """The coordinate moved onto the grid; a non-finite one becomes 0."""
    return f"(CASE WHEN {finite(value)} THEN greatest(least({value}, CAST({size} - 1 AS FLOAT)), 0F) ELSE 0F END)"


def inside_finite(value: str, size: str) -> str:
    """``inside`` for a coordinate that is known to be finite; block displacements always are."""
    return f"({value} >= 0F AND {value} <= CAST({size} - 1 AS FLOAT))"


def on_grid_finite(value: str, size: str) -> str:
    return f"greatest(least({value}, CAST({size} - 1 AS FLOAT)), 0F)"


def unit(value: str) -> str:
    return f"greatest(least({value}, 1F), 0F)"


def lerp(low: str, high: str, weight: str) -> str:
    return f"({low} * (1F - {weight}) + {high} * {weight})"


def bilinear(taps: list[str]) -> str:
    """Interpolate (top-left, top-right, bottom-left, bottom-right) with columns ``wx, wy``."""
    return lerp(lerp(taps[0], taps[1], "wx"), lerp(taps[2], taps[3], "wx"), "wy")


def valid_coverage(value: str) -> str:
    return f"(NOT isnan({value}) AND {value} >= 0F AND {value} <= 1F)"


def pick(condition: str, value: str, otherwise: str = "0F") -> str:
    return f"(CASE WHEN {condition} THEN {value} ELSE {otherwise} END)"


@dataclass(frozen=True)
class Tap:
    """One history pixel held in columns ``{name}_r .. {name}_a`` and coverage ``{name}_k``.

    ``checked`` says the history was validated when it was stored, so nothing is tested again.
    """

    name: str
    checked: bool = True

    def color(self, channel: str) -> str:
        return f"{self.name}_{channel}"

    @property
    def cover(self) -> str:
        return f"{self.name}_k"

    @property
    def color_ok(self) -> str:
        return "true" if self.checked else "(" + " AND ".join(finite(self.color(c)) for c in COLOR) + ")"

    @property
    def cover_ok(self) -> str:
        return "true" if self.checked else valid_coverage(self.cover)

    @property
    def weight(self) -> str:
        """The coverage a target-only sample may use; checked coverage is never negative."""
        return self.cover if self.checked else pick(self.legal, self.cover)

    def weighted(self, channel: str) -> str:
        product = f"{self.color(channel)} * {self.cover}"
        return product if self.checked else pick(self.legal, product)

    @property
    def legal(self) -> str:
        """Coverage that may lend its color to a target-only sample."""
        return f"({self.cover_ok} AND {self.color_ok} AND {self.cover} > 0F)"

    @property
    def spoiled(self) -> str:
        return f"(NOT {self.cover_ok} OR ({self.cover} > 0F AND NOT {self.color_ok}))"


TAPS = ("t0", "t1", "t2", "t3")


def taps(checked: bool) -> list[Tap]:
    return [Tap(n, checked) for n in TAPS]


def gather(four: list[Tap], value: Callable[[Tap], str]) -> str:
    return bilinear([value(t) for t in four])


def full_color(four: list[Tap], channel: str) -> str:
    """A color sample of the whole previous frame."""
    if four[0].checked:
        return gather(four, lambda t: t.color(channel))
    return gather(four, lambda t: pick(t.color_ok, t.color(channel)))


def full_cover(four: list[Tap]) -> str:
    if four[0].checked:
        return gather(four, lambda t: t.cover)
    return gather(four, lambda t: pick(t.cover_ok, t.cover))


def contaminated(four: list[Tap], bad: Callable[[Tap], str]) -> str:
    """Whether any tap that contributes, however little, is bad."""
    return f"({gather(four, lambda t: pick(bad(t), '1F'))} <> 0F)"


def full_usable(four: list[Tap]) -> str:
    if four[0].checked:
        return "valid"
    colors = " AND ".join(finite(full_color(four, c)) for c in COLOR)
    return f"(valid AND NOT {contaminated(four, lambda t: f'NOT {t.color_ok}')} AND {colors})"


def full_cover_usable(four: list[Tap]) -> str:
    if four[0].checked:
        return "valid"
    spoiled = contaminated(four, lambda t: f"NOT {t.cover_ok}")
    return f"(valid AND NOT {spoiled} AND {finite(full_cover(four))})"


def target_cover(four: list[Tap]) -> str:
    """Sampled coverage of the target only."""
    return pick("valid", gather(four, lambda t: t.weight))


def target_usable(four: list[Tap], cover: str) -> str:
    usable = f"valid AND {cover} > 0F"
    return f"({usable})" if four[0].checked else f"({usable} AND NOT {contaminated(four, lambda t: t.spoiled)})"


def target_color(four: list[Tap], channel: str, cover: str, usable: str) -> str:
    """Color weighted by coverage and divided back, so background beside the target has no say.

    Spark divides floats as doubles; rounding the quotient gives the exact float quotient.
    """
    weighted = gather(four, lambda t: t.weighted(channel))
    return f"CAST({pick('valid', weighted)} / {pick(usable, cover, '1F')} AS FLOAT)"


def trail_full(own: str, sampled: str, usable: str) -> str:
    """Coverage of a whole-frame trail: kept in place and carried by motion in the set mix."""
    moved = pick(usable, sampled)
    spread = unit(f"CAST(1D - trail_motion_mix AS FLOAT) * {own} + CAST(trail_motion_mix AS FLOAT) * {moved}")
    return unit(f"greatest(m, CAST(trail_decay AS FLOAT) * {spread})")


def trail_target(sampled: str, usable: str) -> str:
    """The decayed coverage that moved onto a pixel of a target-only trail."""
    return pick(usable, f"CAST(trail_decay AS FLOAT) * {sampled}")


def blend(current: str, history: str, weight: str) -> str:
    return f"({current} * (1F - {weight}) + {history} * {weight})"


def change() -> str:
    """The largest absolute change of the three color channels; alpha does not count."""
    return "greatest(" + ", ".join(f"abs(o_{c} - b_{c})" for c in COLOR[:3]) + ")"
