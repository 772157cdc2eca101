"""Colour ramps and colour arithmetic."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

Rgb = tuple[int, int, int]


@dataclass(frozen=True)
class Gradient:
    """Stops from 0 to 1 and their colours; flat ramps keep the colour of the stop below.

    span: values that 0 and 1 stand for, if they don't follow the data.
    """

    stops: tuple[float, ...]
    colours: tuple[Rgb, ...]
    flat: bool = False
    span: tuple[float, float] | None = None

    def __post_init__(self):
        s = self.stops
        if len(s) < 2 or len(s) != len(self.colours):
            raise ValueError("a gradient has two stops or more, and a colour for each")
        if s[0] != 0 or s[-1] != 1 or any(not a < b for a, b in zip(s, s[1:], strict=False)):
            raise ValueError("stops rise from 0 to 1")
        if self.span and not self.span[0] < self.span[1]:
            raise ValueError("the span must have a width")

    def at(self, t: float) -> Rgb:
        if t <= 0:
            return self.colours[0]
        if t >= 1:
            return self.colours[-1]
        i = max(k for k, s in enumerate(self.stops) if s <= t)
        if self.flat:
            return self.colours[i]
        u = (t - self.stops[i]) / (self.stops[i + 1] - self.stops[i])
        return tuple(min(255, max(0, int(a + (b - a) * u + 0.5))) for a, b in zip(self.colours[i], self.colours[i + 1], strict=True))

    def reverse(self) -> Gradient:
        if not self.flat:
            return replace(self, stops=tuple(1 - s for s in reversed(self.stops)), colours=tuple(reversed(self.colours)))
        bands = [1 - s for s in reversed(self.stops)]
        return replace(self, stops=tuple(bands), colours=(*reversed(self.colours[:-1]), self.colours[0]))

    def steps(self, n: int) -> Gradient:
        """n flat bands, each of the colour in its middle."""
        if n < 1:
            raise ValueError("steps must be positive")
        bands = [self.at((k + 0.5) / n) for k in range(n)]
        return Gradient(tuple(k / n for k in range(n)) + (1.0,), (*bands, bands[-1]), True, self.span)

    def columns(self, t: Column) -> tuple[Column, Column, Column]:
        """Red, green and blue for t, saturated at both ends; one pass over the stops, innermost first."""
        out = []
        for c in range(3):
            value = F.lit(self.colours[-1][c])
            for i in range(len(self.stops) - 2, -1, -1):
                a, b = self.colours[i][c], self.colours[i + 1][c]
                if self.flat or a == b:
                    here = F.lit(a)
                else:
                    u = (t - self.stops[i]) / (self.stops[i + 1] - self.stops[i])
                    here = F.floor(F.lit(float(a)) + F.lit(float(b - a)) * u + F.lit(0.5)).cast("int")
                value = F.when(t < self.stops[i + 1], here).otherwise(value)
            out.append(F.when(t <= 0, F.lit(self.colours[0][c])).otherwise(value))
        return tuple(out)


# LAS classes 0 to 18 and, from 19 on, the reserved ones (fixed values)
LAS_CLASSES: tuple[Rgb, ...] = (
    (180, 180, 180),
    (220, 220, 220),
    (139, 100, 60),
    (170, 220, 120),
    (80, 180, 80),
    (20, 120, 40),
    (210, 70, 60),
    (220, 0, 220),
    (0, 200, 200),
    (40, 120, 230),
    (90, 90, 90),
    (55, 55, 55),
    (255, 210, 0),
    (255, 150, 60),
    (255, 235, 80),
    (150, 80, 200),
    (255, 180, 120),
    (180, 140, 90),
    (255, 60, 180),
    (120, 120, 120),
)


def _ramp(*hex_colours: str) -> Gradient:
    n = len(hex_colours) - 1
    return Gradient(tuple(i / n for i in range(n)) + (1.0,), tuple(tuple(bytes.fromhex(h)) for h in hex_colours))


#: Named ramps: published palettes, sampled at even steps.
GRADIENTS: dict[str, Gradient] = {
    "grayscale": Gradient((0.0, 1.0), ((0, 0, 0), (255, 255, 255))),
    "heat": Gradient((0.0, 0.33, 0.66, 1.0), ((0, 0, 0), (220, 0, 0), (255, 220, 0), (255, 255, 255))),
    "las-classification": Gradient(tuple(i / 255 for i in range(20)) + (1.0,), (*LAS_CLASSES, LAS_CLASSES[-1]), True, (0.0, 255.0)),
    "viridis": _ramp("440154", "482878", "3e4989", "31688e", "26828e", "1f9e89", "35b779", "6ece58", "b5de2b", "fde725"),
    "magma": _ramp("000004", "180f3d", "440f76", "721f81", "9e2f7f", "cd4071", "f1605d", "fd9668", "feca8d", "fcfdbf"),
    "inferno": _ramp("000004", "1b0c41", "4a0c6b", "781c6d", "a52c60", "cf4446", "ed6925", "fb9b06", "f7d13d", "fcffa4"),
    "plasma": _ramp("0d0887", "46039f", "7201a8", "9c179e", "bd3786", "d8576b", "ed7953", "fb9f3a", "fdca26", "f0f921"),
    "cividis": _ramp("00224e", "123570", "3b496c", "575d6d", "707173", "8a8678", "a59c74", "c3b369", "e1cc55", "fee838"),
    "turbo": _ramp("30123b", "4662d7", "36aaf9", "1ae4b6", "72fe5e", "c7ef34", "faba39", "f66b19", "cb2a04", "7a0403"),
    # ColorBrewer
    "blues": _ramp("f7fbff", "deebf7", "c6dbef", "9ecae1", "6baed6", "4292c6", "2171b5", "08519c", "08306b"),
    "greens": _ramp("f7fcf5", "e5f5e0", "c7e9c0", "a1d99b", "74c476", "41ab5d", "238b45", "006d2c", "00441b"),
    "greys": _ramp("ffffff", "f0f0f0", "d9d9d9", "bdbdbd", "969696", "737373", "525252", "252525", "000000"),
    "oranges": _ramp("fff5eb", "fee6ce", "fdd0a2", "fdae6b", "fd8d3c", "f16913", "d94801", "a63603", "7f2704"),
    "purples": _ramp("fcfbfd", "efedf5", "dadaeb", "bcbddc", "9e9ac8", "807dba", "6a51a3", "54278f", "3f007d"),
    "reds": _ramp("fff5f0", "fee0d2", "fcbba1", "fc9272", "fb6a4a", "ef3b2c", "cb181d", "a50f15", "67000d"),
    "ylgnbu": _ramp("ffffd9", "edf8b1", "c7e9b4", "7fcdbb", "41b6c4", "1d91c0", "225ea8", "253494", "081d58"),
    "ylorrd": _ramp("ffffcc", "ffeda0", "fed976", "feb24c", "fd8d3c", "fc4e2a", "e31a1c", "bd0026", "800026"),
    "spectral": _ramp("9e0142", "d53e4f", "f46d43", "fdae61", "fee08b", "ffffbf", "e6f598", "abdda4", "66c2a5", "3288bd", "5e4fa2"),
    "rdylgn": _ramp("a50026", "d73027", "f46d43", "fdae61", "fee08b", "ffffbf", "d9ef8b", "a6d96a", "66bd63", "1a9850", "006837"),
    "rdylbu": _ramp("a50026", "d73027", "f46d43", "fdae61", "fee090", "ffffbf", "e0f3f8", "abd9e9", "74add1", "4575b4", "313695"),
    "rdbu": _ramp("67001f", "b2182b", "d6604d", "f4a582", "fddbc7", "f7f7f7", "d1e5f0", "92c5de", "4393c3", "2166ac", "053061"),
    "brbg": _ramp("543005", "8c510a", "bf812d", "dfc27d", "f6e8c3", "f5f5f5", "c7eae5", "80cdc1", "35978f", "01665e", "003c30"),
    "piyg": _ramp("8e0152", "c51b7d", "de77ae", "f1b6da", "fde0ef", "f7f7f7", "e6f5d0", "b8e186", "7fbc41", "4d9221", "276419"),
    "puor": _ramp("7f3b08", "b35806", "e08214", "fdb863", "fee0b6", "f7f7f7", "d8daeb", "b2abd2", "8073ac", "542788", "2d004b"),
    "coolwarm": _ramp("3b4cc0", "6788ee", "9abbff", "c9d7f0", "edd1c2", "f7a889", "e26952", "b40426"),
    "jet": _ramp("000080", "0000ff", "0080ff", "00ffff", "80ff80", "ffff00", "ff8000", "ff0000", "800000"),
    "rainbow": _ramp("ff0000", "ffff00", "00ff00", "00ffff", "0000ff", "ff00ff"),
    "terrain": _ramp("333399", "0098ff", "00cc66", "66dd78", "fffe98", "b6a171", "8c7b6f", "ffffff"),
    "hot": _ramp("0b0000", "8a0000", "ff0d00", "ff8c00", "ffff17", "ffffff"),
    "cool": _ramp("00ffff", "ff00ff"),
    "spring": _ramp("ff00ff", "ffff00"),
    "summer": _ramp("008066", "ffff66"),
    "autumn": _ramp("ff0000", "ffff00"),
    "winter": _ramp("0000ff", "00ff80"),
    "bone": _ramp("000000", "38384d", "707a90", "a6c6c6", "ffffff"),
    "copper": _ramp("000000", "50321f", "9e643f", "ed965f", "ffc77f"),
}


def register_gradient(name: str, gradient: Gradient) -> None:
    GRADIENTS[name] = gradient


def normalised(value: Column, low: float, high: float) -> Column:
    """Where a value stands in a range; in one without width, in the middle."""
    return (value - low) / (high - low) if high > low else F.when(value.isNotNull(), F.lit(0.5))


def blended(original: Column, ramp: Column, alpha: float) -> Column:
    mixed = F.floor(original * (1 - alpha) + ramp * alpha + 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(255), mixed)).cast("int")


def srgb_to_linear(c: Column) -> Column:
    """Eight-bit sRGB to linear, with a gamma of 2.2 and truncated."""
    return F.floor(F.pow(c / 255.0, F.lit(2.2)) * 255.0).cast("int")


def eight_bit(c: Column) -> Column:
    """Sixteen-bit colour to eight bits."""
    return F.shiftright(c.cast("int"), 8)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    clip = lambda v: F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.lit(255)).cast("int")
    return clip(y + 1.402 * (cr - 128)), clip(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)), clip(y + 1.772 * (cb - 128))
