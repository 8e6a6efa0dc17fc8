"""Where likeness stops being genuine: Beta fits of two populations and the crossing of their densities.

A Beta fit by maximum likelihood needs three sums (how many, log x, log (1 - x)), so a population of any
size is one aggregate, and so are its bootstrap resamples: each row counts in resample b as often as a
Poisson variable drawn from the hash of its id says. Only 3 numbers per resample come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quarry.functions.numbers import dot, norm
from quarry.operators.gallery import likeness

#: Expected share of foreign members, resamples, the percentile that is taken, least populations.
PRIOR, RESAMPLES, PERCENTILE = 0.01, 60, 10
MIN_MEMBERS, MIN_GALLERIES, MIN_GENUINE, MIN_IMPOSTOR = 4, 4, 20, 100


def _times(ident: Column, resample: Column) -> Column:
    """A Poisson(1) number of times, from a hash."""
    u = F.pmod(F.xxhash64(ident, resample), F.lit(1 << 31)) / float(1 << 31)
    reached, p, out = 0.0, math.exp(-1), F.lit(0)
    for k in range(8):
        reached += p
        out = out + F.when(u >= reached, 1).otherwise(0)
        p /= k + 1
    return out


def _sums(population: DataFrame) -> tuple[int, float, np.ndarray]:
    """Size, least value, and for each resample its three sums. population: id, x. Rows are multiplied
    inside a task and summed there, before anything is shuffled."""
    x = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("x")))
    rows = population.select("id", "x", F.log(x).alias("low"), F.log(1 - x).alias("high"), F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1))).alias("resample"))
    rows = rows.withColumn("times", _times(F.col("id"), F.col("resample")))
    sums = rows.groupBy("resample").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.sum("times").alias("times"), F.sum(F.col("times") * F.col("low")).alias("low"), F.sum(F.col("times") * F.col("high")).alias("high")).orderBy("resample").collect()
    if not sums:
        return 0, 0.0, np.zeros((RESAMPLES, 3))
    return sums[0].n, sums[0].least, np.array([(r.times, r.low, r.high) for r in sums], float)


def _digamma(x: float, order: int = 0) -> float:
    """The first (order 0) or second derivative of log gamma: recurrence up to 12, then the asymptotic series."""
    out = 0.0
    while x < 12:
        out += -1 / x if order == 0 else 1 / x**2
        x += 1
    if order == 0:
        return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


def fit_beta(mean_log: float, mean_log_rest: float) -> tuple[float, float]:
    """The most likely Beta from the means of log x and log (1 - x), by damped Newton steps on log parameters."""

    def gain(a: float, b: float) -> float:
        return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * mean_log + (b - 1) * mean_log_rest

    a, b = 5.0, 2.0
    for _ in range(200):
        both = _digamma(a + b)
        slope = np.array([a * (both - _digamma(a) + mean_log), b * (both - _digamma(b) + mean_log_rest)])
        if np.abs(slope).max() < 1e-9:
            break
        curve = _digamma(a + b, 1)
        bend = np.array([[a * a * (curve - _digamma(a, 1)) + slope[0], a * b * curve], [a * b * curve, b * b * (curve - _digamma(b, 1)) + slope[1]]])
        step = -np.linalg.solve(bend, slope) if np.all(np.linalg.eigvalsh(bend) < 0) else slope
        scale = 1.0
        while scale > 1e-9:
            try:
                na, nb = a * math.exp(scale * step[0]), b * math.exp(scale * step[1])
                if gain(na, nb) > gain(a, b):
                    a, b = na, nb
                    break
            except OverflowError:
                pass
            scale /= 2
        else:
            break
    return a, b


def density_crossing(genuine: tuple[float, float], impostor: tuple[float, float], prior: float = PRIOR) -> float:
    """The largest similarity at which a member is likelier foreign than genuine."""
    grid = np.linspace(0.002, 0.998, 6000)
    density = lambda a, b: math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid)
    foreign = grid[density(*impostor) + math.log(prior) >= density(*genuine) + math.log(1 - prior)]
    return float(foreign.max()) if len(foreign) else 0.0


def calibrate(members: DataFrame, key: str, ident: str, vector: str, dim: int, kin: Column | None = None, galleries: int = 200) -> Row | None:
    """certain_similarity and what it rests on; None without enough galleries or members.

    Genuine: each member's likeness to its gallery's others. Impostor: all members against the means of at
    most `galleries` other galleries (those with the smallest hashes of their keys, a documented sample), but
    for ones of the same kin (a column of members, compared with the gallery's)."""
    with_kin = members.withColumn("_kin", kin if kin is not None else F.col(key))
    large = likeness(with_kin, key, vector, dim).where(F.col("members") >= MIN_MEMBERS)
    genuine = _sums(large.select(F.col(ident).alias("id"), F.col("similarity").alias("x")))
    means = large.groupBy(key).agg(F.min("_kin").alias("kin"), *(F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dim)))
    n_galleries = means.count()
    chosen = means.select(F.col(key).alias("gallery"), "kin", F.array(*(F.col(f"m{i}") for i in range(dim))).alias("mean")).orderBy(F.xxhash64("gallery"), "gallery").limit(galleries)
    # At most `galleries` rows of `dim` numbers.
    pairs = large.join(F.broadcast(chosen), (F.col(key) != F.col("gallery")) & (F.col("_kin") != F.col("kin")))
    likenesses = dot(F.col("mean"), F.col(vector)) / (norm(F.col("mean")) * norm(F.col(vector)))
    impostor = _sums(pairs.select(F.xxhash64(ident, "gallery").alias("id"), likenesses.alias("x")))
    if n_galleries < MIN_GALLERIES or genuine[0] < MIN_GENUINE or impostor[0] < MIN_IMPOSTOR:
        return None
    fits = [[fit_beta(s[1] / s[0], s[2] / s[0]) for s in sums] for sums in (genuine[2], impostor[2])]
    floors = np.array([density_crossing(g, i) for g, i in zip(*fits, strict=True)])
    floor = float(np.percentile(floors, PERCENTILE))
    return Row(certain_similarity=round(floor, 4), bootstrap_mean=round(float(floors.mean()), 4), bootstrap_sd=round(float(floors.std()), 4), n_galleries=n_galleries, n_genuine=genuine[0], n_impostor=impostor[0], worst_genuine=round(genuine[1], 4), margin=round(genuine[1] - floor, 4))
