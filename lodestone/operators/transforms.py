"""Filters and recolouring of points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from .stats import value_range

Mutator = Callable[[DataFrame], DataFrame]


def pipeline(points: DataFrame, steps: list[Mutator]) -> DataFrame:
    for step in steps:
        points = points.transform(step)
    return points


def z_offset(offset: float) -> Mutator:
    """Raise points by an offset, in single precision."""
    return lambda df: df.withColumn("z", (F.col("z").cast("float") + F.lit(offset).cast("float")).cast("float"))


def drop_withheld(df: DataFrame) -> DataFrame:
    """Without withheld points; all of them where nothing says which those are."""
    return df.filter(~F.coalesce(F.col("withheld").cast("boolean"), F.lit(False))) if "withheld" in df.columns else df


@dataclass(frozen=True)
class Colouring:
    """``attribute:gradient[:modifier]...``; modifiers are reverse, steps=N, stretch=minmax or lo,hi (percent), blend=a."""

    attribute: str
    gradient: str
    reverse: bool = False
    steps: int = 0
    stretch: tuple[float, float] | None = (2.0, 98.0)
    blend: float = 1.0

    @classmethod
    def parse(cls, text: str) -> Colouring:
        attribute, _, rest = text.partition(":")
        gradient, *modifiers = rest.split(":")
        if not attribute or not gradient:
            raise ValueError(f"{text!r}: attribute:gradient is asked for")
        if gradient not in colour.GRADIENTS:
            raise ValueError(f"no gradient {gradient!r}")
        more: dict = {}
        for m in modifiers:
            name, _, value = m.partition("=")
            if name == "reverse" and not value:
                more["reverse"] = True
            elif name == "steps" and value.isdigit() and int(value) >= 1:
                more["steps"] = int(value)
            elif name == "stretch" and value == "minmax":
                more["stretch"] = None
            elif name == "stretch" and value.count(",") == 1:
                low, high = map(float, value.split(","))
                if not 0 <= low < high <= 100:
                    raise ValueError(f"{m!r}: percentages rise from 0 to 100")
                more["stretch"] = (low, high)
            elif name == "blend" and 0 <= float(value or "nan") <= 1:
                more["blend"] = float(value)
            else:
                raise ValueError(f"no modifier {m!r}")
        return cls(attribute.strip().lower(), gradient, **more)

    def ramp(self) -> colour.Gradient:
        g = colour.GRADIENTS[self.gradient]
        g = g.reverse() if self.reverse else g
        return g.steps(self.steps) if self.steps else g

    def span(self, points: DataFrame) -> tuple[float, float]:
        """The values at both ends of the ramp; one aggregate over the points unless the ramp has its own."""
        g = self.ramp()
        if g.span:
            return g.span
        low, high = self.stretch or (0.0, 100.0)
        return value_range(points, self.attribute, low / 100, high / 100)

    def apply(self, points: DataFrame, span: tuple[float, float] | None = None) -> DataFrame:
        """Points without a finite value keep their colour."""
        low, high = span or self.span(points)
        v = F.col(self.attribute).cast("double")
        t = colour.normalised(v, low, high)
        known = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        new = {}
        for name, ramp in zip("rgb", self.ramp().columns(t), strict=True):
            mixed = ramp if self.blend == 1 else colour.blended(F.col(name), ramp, self.blend)
            new[name] = F.when(known, mixed).otherwise(F.col(name)).cast("short")
        return points.withColumns(new)


def finite_positions(df: DataFrame) -> DataFrame:
    ok = [F.col(a).isNotNull() & ~F.isnan(F.col(a)) & (F.abs(F.col(a)) < float("inf")) for a in "xyz"]
    return df.filter(ok[0] & ok[1] & ok[2])
