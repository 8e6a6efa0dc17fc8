"""Money, vectors, timing and layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    """Text to a number: `$`, `,` and a leading `+` go; null where nothing numeric is left."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[$,]", ""), r"^\+", "").try_cast("double")


def bare_price(c: Column) -> Column:
    """A whole number as text, halves to even."""
    return F.bround(money(c), 0).cast("long").cast("string")


def cents(amount: Column) -> Column:
    """A double to two places as SQL engines round doubles: the amount times 100, halves away from zero. `round(amount, 2)` rounds the number's shortest
    text instead, which differs where the product reaches a half that the text doesn't show."""
    return F.round(amount * 100, 0) / 100


def truthy(c: Column) -> Column:
    """Non-zero number, or text that is neither empty nor a number."""
    text = c.cast("string")
    return F.coalesce(text.try_cast("double") != 0, text != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def sign_bits(vector: Column, bits: int) -> Column:
    """The signs of the first components as the bits of a number (up to 63)."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda s, i: s * 2 + F.when(F.get(vector, i) > 0, 1).otherwise(0).cast("long"))


def bitrate(budget_mb: Column, seconds: Column, low: int = 4000, high: int = 20000) -> Column:
    """Kilobits a second that fill the budget, within limits."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(budget_mb * 8000 / seconds))).cast("int")


def ease_out(t: Column) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return 1 - F.pow(1 - clamped, F.lit(3))


def beat_pulse(t: Column, beat: Column, strength: float = 0.03, decay: float = 0.18) -> Column:
    return 1 + strength * F.exp(-F.pmod(t, beat) / beat / decay)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def fitted(width: Column, height: Column, box_w: float, box_h: float, margin: float = 0.0) -> tuple[Column, Column]:
    """Size of a picture that fits a box, proportions kept."""
    scale = F.least(box_w * (1 - margin) / width, box_h * (1 - margin) / height)
    return F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
