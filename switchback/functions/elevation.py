"""Elevation profiles as folds over arrays: one pass, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEAD_BAND_M = 4.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _fold(profile: Column, band: float) -> Column:
    """(gain, loss) by reversals: a run counts when it is over the band; a zero step continues a run."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("gain"), zero.alias("loss"), zero.alias("run"), F.element_at(profile, 1).alias("last"))

    def settle(s, run):
        gain = s["gain"] + F.when(run > band, run).otherwise(0.0)
        loss = s["loss"] + F.when(run < -band, -run).otherwise(0.0)
        return gain, loss

    def step(s, z):
        d = z - s["last"]
        on = ((s["run"] >= 0) & (d >= 0)) | ((s["run"] <= 0) & (d <= 0))
        gain, loss = settle(s, s["run"])
        return F.struct(F.when(on, s["gain"]).otherwise(gain).alias("gain"), F.when(on, s["loss"]).otherwise(loss).alias("loss"), F.when(on, s["run"] + d).otherwise(d).alias("run"), z.alias("last"))

    def finish(s):
        gain, loss = settle(s, s["run"])
        return F.struct(gain.alias("gain"), loss.alias("loss"))

    return F.aggregate(F.slice(profile, 2, F.greatest(F.size(profile) - 1, F.lit(0))), start, step, finish)


def gain_loss(profile, band: float = DEAD_BAND_M) -> Column:
    """Struct (gain, loss); null for under two points or any point that isn't finite."""
    p = _c(profile)
    bad = F.exists(p, lambda z: z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")))
    return F.when(p.isNotNull() & (F.size(p) >= 2) & ~bad, _fold(p, band))


def smooth(profile, alpha: float = 0.3) -> Column:
    """Exponential mean forwards, then backwards over it; the ends stay as they are."""
    p = _c(profile)
    n = F.size(p)

    def ema(values: Column, first: Column) -> Column:
        return F.aggregate(values, F.array(first), lambda s, z: F.concat(s, F.array(alpha * z + (1 - alpha) * F.element_at(s, -1))))

    forth = ema(F.slice(p, 2, F.greatest(n - 1, F.lit(0))), F.element_at(p, 1))
    back = ema(F.slice(F.reverse(forth), 2, F.greatest(n - 1, F.lit(0))), F.element_at(p, -1))
    mid = F.slice(F.reverse(back), 2, F.greatest(n - 2, F.lit(0)))
    return F.when(n > 2, F.concat(F.slice(p, 1, 1), mid, F.slice(p, -1, 1))).otherwise(p)


def smoothed_stats(profile, band: float = DEAD_BAND_M) -> Column:
    """Struct (gain, loss, min, max) of the smoothed profile; zeros for an empty one."""
    s = smooth(profile)
    some = F.size(_c(profile)) > 0
    g = _fold(s, band)
    return F.struct(*[F.when(some, x).otherwise(0.0).alias(k) for k, x in (("gain", g["gain"]), ("loss", g["loss"]), ("min", F.array_min(s)), ("max", F.array_max(s)))])


def _held(x: Column, f) -> Column:
    """f of x, with x computed once: an expression that a lambda names is else computed for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _window(p: Column, width: int, f) -> Column:
    """f of the values around each element; they are got one by one, since a slice copies the whole array first."""
    half = width // 2
    return _held(p, lambda v: F.transform(v, lambda _, i: f(F.transform(F.sequence(F.greatest(i - half, F.lit(0)), F.least(i + half, F.size(v) - 1)), lambda k: F.get(v, k)))))


def median_filter(profile, width: int = 5) -> Column:
    return _window(_c(profile), width, lambda w: _held(F.array_sort(w), lambda s: F.element_at(s, (F.size(s) / 2).cast("int") + 1)))


def moving_average(profile, width: int = 7) -> Column:
    return _window(_c(profile), width, lambda w: _held(w, lambda v: F.aggregate(v, F.lit(0.0), lambda s, z: s + z) / F.size(v)))


def anchored_gain(profile, step: float = 3.0) -> Column:
    """Gain of the profile after a median of 5 and a mean of 7, counted from anchors `step` metres apart."""
    smoothed = moving_average(median_filter(profile))

    def move(a, z):
        d = z - a["anchor"]
        return F.struct((a["gain"] + F.when(d >= step, d).otherwise(0.0)).alias("gain"), F.when(F.abs(d) >= step, z).otherwise(a["anchor"]).alias("anchor"))

    gain = _held(smoothed, lambda s: F.aggregate(s, F.struct(F.lit(0.0).alias("gain"), F.element_at(s, 1).alias("anchor")), move, lambda a: a["gain"]))
    return F.when(F.size(_c(profile)) > 0, gain).otherwise(0.0)


def with_z(path, z) -> Column:
    """A line with its heights replaced by vertex number."""
    return F.zip_with(_c(path), _c(z), lambda p, h: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"), h.alias("z")))
