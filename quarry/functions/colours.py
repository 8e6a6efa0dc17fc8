"""Colours of backdrops: words to RGB, hue arithmetic on the circle, and the two stops of a gradient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colour words and their RGB.
COLOR_WORDS = {
    "black": (26, 26, 30), "white": (232, 233, 236), "silver": (188, 190, 195), "platinum": (198, 200, 204), "gray": (124, 127, 132), "grey": (124, 127, 132),
    "charcoal": (62, 64, 69), "graphite": (78, 81, 86), "carbonized": (88, 91, 96), "gunmetal": (84, 88, 94), "slate": (98, 106, 118), "steel": (110, 122, 138),
    "navy": (26, 42, 88), "blue": (38, 84, 168), "teal": (30, 118, 128), "turquoise": (48, 150, 156), "aqua": (60, 150, 160), "cyan": (50, 150, 170),
    "green": (40, 112, 72), "olive": (98, 104, 60), "lime": (120, 160, 60), "red": (168, 34, 44), "maroon": (108, 30, 46), "burgundy": (100, 28, 48),
    "crimson": (152, 28, 48), "ruby": (150, 30, 52), "rose": (180, 90, 105), "pink": (198, 110, 140), "purple": (96, 60, 142), "violet": (104, 66, 150),
    "orange": (206, 108, 38), "amber": (198, 140, 46), "gold": (176, 144, 70), "yellow": (214, 184, 56), "bronze": (136, 98, 60), "copper": (166, 100, 58),
    "brown": (92, 64, 46), "espresso": (72, 52, 42), "chestnut": (110, 70, 50), "tan": (188, 160, 124), "beige": (196, 178, 148), "sand": (196, 180, 150),
    "stone": (168, 164, 154), "cream": (218, 208, 186), "ivory": (222, 214, 196),
}
# Bands and thresholds.
VALUE_LOW, VALUE_HIGH, SEPARATION = 0.10, 0.52, 0.14
SATURATION_LOW, SATURATION_HIGH, NEUTRAL = 0.28, 0.78, 0.10
HUE_SHIFT, TINT_HUE, TINT_SATURATION = 0.055, 0.60, 0.30


def _rgb(r: int, g: int, b: int) -> Column:
    return F.struct(*(F.lit(float(v)).alias(n) for n, v in zip("rgb", (r, g, b), strict=True)))


def named(name: Column) -> Column:
    """RGB of the longest colour word in a name (of equally long ones the first above); null if there is none."""
    low, cases = F.lower(name), None
    for word in sorted(COLOR_WORDS, key=len, reverse=True):
        cases = (F if cases is None else cases).when(low.contains(word), _rgb(*COLOR_WORDS[word]))
    return cases


def with_hsv(df: DataFrame, rgb: str, name: str) -> DataFrame:
    """Adds hue, saturation and value (0 to 1) of RGB bytes as `name`_h, `name`_s and `name`_v."""
    r, g, b = (F.col(f"{rgb}.{c}") / 255 for c in "rgb")
    df = df.withColumns({f"{name}_v": F.greatest(r, g, b), f"{name}_d": F.greatest(r, g, b) - F.least(r, g, b)})
    top, span = F.col(f"{name}_v"), F.col(f"{name}_d")
    sixths = F.when(r == top, (g - b) / span).when(g == top, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    df = df.withColumns({f"{name}_h": F.when(span == 0, 0.0).otherwise(F.pmod(sixths / 6, F.lit(1.0))), f"{name}_s": F.when(span == 0, 0.0).otherwise(span / top)})
    return df.drop(f"{name}_d")


def channel(h: Column, s: Column, v: Column, at: int) -> Column:
    """One of the RGB bytes (0, 1, 2) of hue (any number of turns), saturation and value; halves go to even. Around the circle of six sectors a channel
    lies at full value for two, at the least value for two, and goes straight between."""
    k = F.pmod(F.lit(float((5, 3, 1)[at])) + F.pmod(h, F.lit(1.0)) * 6, F.lit(6.0))
    return F.bround((v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * 255, 0).cast("int")


def rgb_bytes(h: Column, s: Column, v: Column) -> Column:
    return F.struct(*(channel(h, s, v, at).alias(c) for at, c in enumerate("rgb")))


def hue_distance(a: Column, b: Column) -> Column:
    """The way between two hues on the circle, the shorter one."""
    return F.abs(F.pmod(a - b + 0.5, F.lit(1.0)) - 0.5)


def _clamped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def with_stops(df: DataFrame, exterior: str, interior: str) -> DataFrame:
    """Adds first and second: the stops (RGB bytes) of a gradient from two RGB columns, pressed into the backdrop's bands, apart in value, and of different tint
    where the hues are alike. Steps are columns of their own, so that no expression is computed twice."""
    keep = df.columns
    df = with_hsv(with_hsv(df, exterior, "_a"), interior, "_b")
    c = F.col
    df = df.withColumn("_neutral", F.greatest("_a_s", "_b_s") <= NEUTRAL * 1.5)
    for side in ("_a", "_b"):  # a neutral colour keeps its saturation
        df = df.withColumns({f"{side}_s": F.when(c(f"{side}_s") > NEUTRAL, _clamped(c(f"{side}_s"), SATURATION_LOW, SATURATION_HIGH)).otherwise(c(f"{side}_s")), f"{side}_v": VALUE_LOW + c(f"{side}_v") * (VALUE_HIGH - VALUE_LOW)})
    df = df.withColumns({"_near": F.abs(c("_a_v") - c("_b_v")) < SEPARATION, "_mid": (c("_a_v") + c("_b_v")) / 2, "_half": F.when(c("_a_v") >= c("_b_v"), SEPARATION / 2).otherwise(-SEPARATION / 2)})
    df = df.withColumns({f"{side}_v": F.when(c("_near"), _clamped(c("_mid") + sign * c("_half"), VALUE_LOW, VALUE_HIGH)).otherwise(c(f"{side}_v")) for side, sign in (("_a", 1), ("_b", -1))})
    df = df.withColumn("_alike", (hue_distance(c("_a_h"), c("_b_h")) < 0.02) & (F.abs(c("_a_s") - c("_b_s")) < 0.05))
    tint = c("_alike") & c("_neutral")  # of the lighter stop: a hue doesn't show on the darker
    df = df.withColumns({"_ta": tint & (c("_a_v") >= c("_b_v")), "_tb": tint & (c("_a_v") < c("_b_v"))})
    df = df.withColumns(
        {
            "_a_h": F.when(c("_ta"), TINT_HUE).otherwise(c("_a_h")),
            "_b_h": F.when(c("_tb"), TINT_HUE).when(c("_alike") & ~c("_neutral"), c("_b_h") + HUE_SHIFT).otherwise(c("_b_h")),
            "_a_s": F.when(c("_ta"), TINT_SATURATION).otherwise(c("_a_s")),
            "_b_s": F.when(c("_tb"), TINT_SATURATION).otherwise(c("_b_s")),
        }
    )
    made = {name: rgb_bytes(c(f"{side}_h"), c(f"{side}_s"), c(f"{side}_v")).alias(name) for name, side in (("first", "_a"), ("second", "_b"))}
    return df.select(*(k for k in keep if k not in made), *made.values())


def with_gradient(df: DataFrame, exterior: str, interior: str, sample: str) -> DataFrame:
    """Adds first and second from two colour names; without a colour word the exterior is the sampled RGB, else steel, and the interior black."""
    named_a, named_b = F.coalesce(named(F.col(exterior)), F.col(sample), _rgb(*COLOR_WORDS["steel"])), F.coalesce(named(F.col(interior)), _rgb(*COLOR_WORDS["black"]))
    return with_stops(df.withColumns({"_exterior": named_a, "_interior": named_b}), "_exterior", "_interior").drop("_exterior", "_interior")
