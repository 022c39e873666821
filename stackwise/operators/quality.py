"""Background estimates and frame quality."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.functions.numerics import neumaier_sum
from stackwise.schema import IMAGE, MISSING, count_of, eligible, masked, non_finite, or_flags, require
from stackwise.scratch import cut

# The ratio of sigma and median absolute deviation of a normal distribution, and FWHM over sigma.
MAD_SCALE = 1.482602218505602
FWHM_SCALE = 2.3548200450309493


@dataclass(frozen=True)
class Background:
    clipping_sigma: float = 3.0
    maximum_iterations: int = 8
    minimum_samples: int = 100

    def __post_init__(self) -> None:
        require(0 < self.clipping_sigma < float("inf"), "clipping_sigma must be finite and positive")
        require(self.maximum_iterations >= 1 and self.minimum_samples >= 1, "iterations and samples must be positive")


#: Usable samples of an image up to which it is one Arrow group (256 MB of values); larger ones are clipped in joins.
GROUPED_SAMPLES = 1 << 25


def _median(values: np.ndarray, ordered: bool = False) -> float:
    """The exact median; of two middle values their mean."""
    half = len(values) // 2
    if not ordered:
        values = np.partition(values, (max(half - 1, 0), half))
    return float(values[half]) if len(values) % 2 else float(0.5 * values[half - 1] + 0.5 * values[half])


def clipped_background(values: np.ndarray, parameters: Background) -> tuple[float, float, int, int, bool]:
    """Location, MAD, samples held, passes and whether they came to rest, for the values of one image."""
    v, lo, hi, held, converged, passes = np.sort(values), 0, len(values), len(values), False, 0
    while passes < parameters.maximum_iterations and not converged:
        location = _median(v[lo:hi], ordered=True)
        mad = _median(np.abs(v[lo:hi] - location))
        radius = parameters.clipping_sigma * (mad * MAD_SCALE)
        low = max(lo, int(np.searchsorted(v, location - radius, "left")))
        high = min(hi, int(np.searchsorted(v, location + radius, "right")))
        passes += 1
        converged = mad == 0 or high - low == hi - lo
        if not converged:
            lo, hi = low, high
        held = hi - lo
    location = _median(v[lo:hi], ordered=True)
    return location, _median(np.abs(v[lo:hi] - location)), held, passes, converged


def _grouped_background(good: DataFrame, p: Background, keys: list[str]) -> DataFrame:
    """``keys, location, mad, held, iterations, converged``, one Arrow group for each image."""

    def run(table: pa.Table) -> pa.Table:
        found = clipped_background(table["value"].combine_chunks().to_numpy(zero_copy_only=False), p)
        return pa.table([*(table[k].slice(0, 1) for k in keys), *(pa.array([x]) for x in found)], names=[*keys, "location", "mad", "held", "iterations", "converged"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema if f.name in keys)
    return good.groupBy(*keys).applyInArrow(run, schema + ", location double, mad double, held long, iterations long, converged boolean")


def _joined_background(good: DataFrame, p: Background, keys: list[str]) -> DataFrame:
    """The same in two exact medians per image and pass, over all images at once; no image meets in one task.

    The outcome of a pass, one row per image, is cut off from its plan.
    """
    state = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("held")).select(
        *keys, F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), "held", F.lit(False).alias("converged"), F.lit(0).alias("iterations")
    )

    def estimates(state: DataFrame) -> DataFrame:
        inside = good.join(state.select(*keys, "lo", "hi"), keys).filter("value >= lo AND value <= hi")
        located = inside.groupBy(*keys).agg(F.median("value").alias("location"), F.count(F.lit(1)).alias("n"))
        apart = inside.join(located.select(*keys, "location"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("value") - F.col("location"))).alias("mad"))
        return located.join(apart, keys)

    for _ in range(p.maximum_iterations):
        edges = state.join(estimates(state), keys)
        radius = p.clipping_sigma * (F.col("mad") * MAD_SCALE)
        edges = edges.withColumns({"_lo": F.greatest("lo", F.col("location") - radius), "_hi": F.least("hi", F.col("location") + radius)})
        left = good.join(edges.select(*keys, "_lo", "_hi"), keys).filter("value >= _lo AND value <= _hi")
        joined = edges.join(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_left")), keys)
        stop = F.col("converged") | (F.col("mad") == 0) | (F.col("_left") == F.col("n"))
        state = cut(joined.select(
            *keys, F.when(stop, F.col("lo")).otherwise(F.col("_lo")).alias("lo"), F.when(stop, F.col("hi")).otherwise(F.col("_hi")).alias("hi"),
            F.when(stop, F.col("n")).otherwise(F.col("_left")).alias("held"), stop.alias("converged"), (F.col("iterations") + (~F.col("converged")).cast("int")).alias("iterations"),
        ))
        if state.filter("NOT converged").isEmpty():
            break
    return state.join(estimates(state).select(*keys, "location", "mad"), keys).select(*keys, "location", "mad", "held", F.col("iterations").cast("long").alias("iterations"), "converged")


def estimate_background(samples: DataFrame, parameters: Background | None = None, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Location, MAD and noise of each image by iterated median and MAD clipping.

    An image is one Arrow group; if any has more than ``GROUPED_SAMPLES`` usable samples, all are clipped in joins, with
    the same result.  An image without usable samples has no passes.
    """
    p, keys = parameters or Background(), list(keys)
    base = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_samples"), count_of(eligible()).alias("initial_usable_samples"),
        count_of(masked()).alias("masked_samples"), count_of(non_finite()).alias("non_finite_samples"),
    )
    good = samples.filter(eligible()).select(*keys, "value")
    most = base.agg(F.max("initial_usable_samples")).first()[0] or 0
    found = (_grouped_background if most <= GROUPED_SAMPLES else _joined_background)(good, p, keys)
    out = base.join(found, keys, "left").withColumns({"held": F.coalesce("held", F.lit(0)), "iterations": F.coalesce("iterations", F.lit(0)), "converged": F.coalesce("converged", F.lit(False))})
    enough = F.col("held") >= p.minimum_samples
    return out.select(
        *keys,
        F.when(enough, F.col("location") + 0.0).alias("location"),
        F.when(enough, F.col("mad") + 0.0).alias("median_absolute_deviation"),
        F.when(enough, F.col("mad") * MAD_SCALE + 0.0).alias("noise_sigma"),
        "total_samples", "initial_usable_samples", F.col("held").alias("retained_samples"), "masked_samples", "non_finite_samples",
        (F.col("initial_usable_samples") - F.col("held")).alias("clipped_samples"), "iterations", "converged",
        F.when(~enough, "insufficient_samples").alias("failure"),
    )


OFFSETS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def local_maxima(samples: DataFrame, thresholds: DataFrame, border: int = 0) -> DataFrame:
    """Samples above the image's ``threshold`` that no clear, finite neighbour exceeds.

    Of equal neighbours the first in reading order stays.  Each sample is sent once to each of the eight positions
    around it, and one aggregation finds what rivals it there: no image is gathered, and no window spans a row.
    """
    keys = list(IMAGE)
    good = samples.filter(eligible())
    sent = good.select(
        *keys, F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit((-dy, -dx) < (0, 0)).alias("earlier")) for dy, dx in OFFSETS])).alias("at"), "value"
    )
    rival = sent.select(*keys, "at.y", "at.x", F.col("value").alias("rival"), F.col("at.earlier").alias("earlier"))
    rival = rival.groupBy(*keys, "y", "x").agg(F.max("rival").alias("rival"), F.max(F.when(F.col("earlier"), F.col("rival"))).alias("before"))
    size = samples.groupBy(*keys).agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    found = good.join(rival, [*keys, "y", "x"], "left").join(thresholds.select(*keys, "threshold"), keys).join(size, keys)
    inside = F.col("y").between(border, F.col("_h") - border) & F.col("x").between(border, F.col("_w") - border)
    top = (F.col("value") >= F.coalesce("rival", F.col("value"))) & (F.col("before").isNull() | (F.col("value") > F.col("before")))
    return found.filter((F.col("value") > F.col("threshold")) & inside & top).select(*keys, "y", "x", F.col("value").alias("peak"))


def cfa_cell_mean(samples: DataFrame) -> DataFrame:
    """Means of 2 x 2 cells of a mosaic; one bad sample voids its cell."""
    keys = [*IMAGE, (F.floor(F.col("y") / 2)).cast("int").alias("y"), (F.floor(F.col("x") / 2)).cast("int").alias("x")]
    cells = samples.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(eligible(), F.col("value")))).alias("values"),
        F.count(F.lit(1)).alias("n"), or_flags().alias("seen"), count_of(non_finite()).alias("bad"),
    ).filter("n = 4")
    whole = F.size("values") == 4
    flags = F.when(whole, 0).otherwise(F.col("seen").bitwiseOR(F.when(F.col("bad") > 0, 32).otherwise(0)))
    value = F.when(whole, neumaier_sum(F.transform("values", lambda v: v / 4))).otherwise(float("nan"))
    return cells.select(*IMAGE, "y", "x", value.alias("value"), flags.cast("short").alias("flags"))


# Luminance weights of red, green and blue.
LUMINANCE = (0.2126, 0.7152, 0.0722)


def rgb_luminance(samples: DataFrame) -> DataFrame:
    """One plane of luminance from planes 0, 1 and 2; all three must be there and usable."""
    keys = ["stack_id", "frame_id", "y", "x"]
    parts = [F.max(F.when(eligible() & (F.col("plane") == p), F.col("value"))).alias(f"c{p}") for p in range(3)]
    found = samples.groupBy(*keys).agg(*parts, or_flags().alias("seen"), count_of(non_finite()).alias("bad"))
    value = F.col("c0") * LUMINANCE[0] + F.col("c1") * LUMINANCE[1] + F.col("c2") * LUMINANCE[2]
    flags = F.when(value.isNotNull(), 0).otherwise(F.col("seen").bitwiseOR(F.lit(MISSING)).bitwiseOR(F.when(F.col("bad") > 0, 32).otherwise(0)))
    return found.select("stack_id", "frame_id", F.lit(0).alias("plane"), "y", "x", F.coalesce(value, F.lit(float("nan"))).alias("value"), flags.cast("short").alias("flags"))


@dataclass(frozen=True)
class StarMeasurement:
    background: Background = field(default_factory=Background)
    detection_sigma: float = 6.0
    floor_sigma: float = 2.0
    radius: int = 8
    separation: int = 4
    minimum_pixels: int = 6
    maximum_candidates: int = 100_000
    saturation_level: float | None = None

    def __post_init__(self) -> None:
        require(self.detection_sigma > 0 and self.floor_sigma >= 0, "sigmas must not be negative")
        require(self.radius >= 1 and self.separation >= 1 and self.minimum_pixels >= 3, "radius, separation and pixels are too small")


def variance_fraction(u: np.ndarray) -> np.ndarray:
    """Part of a Gaussian's variance that is left when its outer parts, beyond exp(-u) of the peak, are cut off."""
    u = np.asarray(u, np.float64)
    small = u / 2 - u * u / 12
    with np.errstate(invalid="ignore", divide="ignore"):
        e = np.exp(-u)
        whole = (1 - e - u * e) / (1 - e)
    return np.where(u < 1e-4, small, whole)



def measure_image(image: np.ndarray, flags: np.ndarray, location: float, noise: float, p: StarMeasurement) -> pd.DataFrame:
    """The stars of one plane: brightest first, each suppressing fainter candidates nearby."""
    height, width = image.shape
    ok = (flags == 0) & np.isfinite(image)
    value = np.where(ok, image, -np.inf)
    peak = ok & (image > location + p.detection_sigma * noise)
    r = p.radius
    border = np.zeros_like(peak)
    border[r : height - r, r : width - r] = True
    peak &= border
    wide = np.pad(value, 1, constant_values=-np.inf)
    for dy, dx in OFFSETS:
        other = wide[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width]
        peak &= (value > other) if (dy, dx) < (0, 0) else (value >= other)
    ys, xs = np.nonzero(peak)
    if len(ys) > p.maximum_candidates:
        raise ValueError(f"more than {p.maximum_candidates} candidates")
    order = np.lexsort((ys * width + xs, -image[ys, xs]))
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    disk = dy * dy + dx * dx <= r * r
    s = p.separation
    sy, sx = np.mgrid[-s : s + 1, -s : s + 1]
    near = sy * sy + sx * sx <= s * s
    gone = np.zeros((height + 2 * s, width + 2 * s), bool)
    rows = []
    for k in order:
        y, x = int(ys[k]), int(xs[k])
        if gone[y + s, x + s]:
            continue
        gone[y : y + 2 * s + 1, x : x + 2 * s + 1] |= near
        part = image[y - r : y + r + 1, x - r : x + r + 1]
        weight = np.where(ok[y - r : y + r + 1, x - r : x + r + 1] & disk, part - location, 0.0)
        used = weight > p.floor_sigma * noise
        n = int(used.sum())
        if n < p.minimum_pixels:
            continue
        w, wy, wx = weight[used], dy[used], dx[used]
        flux = w.sum()
        cy, cx = (w * wy).sum() / flux, (w * wx).sum() / flux
        xx, yy, xy = ((w * (a - ca) * (b - cb)).sum() / flux for a, ca, b, cb in ((wx, cx, wx, cx), (wy, cy, wy, cy), (wx, cx, wy, cy)))
        spread = np.hypot((xx - yy) / 2, xy)
        major, minor = (xx + yy) / 2 + spread, (xx + yy) / 2 - spread
        if not (major > 0 and minor > 0):
            continue
        floor = p.floor_sigma * noise
        top = image[y, x] - location
        left = float(variance_fraction(np.log(top / floor))) if floor > 0 and top > floor else 1.0
        left = left if left > 0 else 1.0
        rows.append(
            (y + cy, x + cx, float(image[y, x]), float(flux), n, float(flux / (noise * np.sqrt(n))),
             FWHM_SCALE * np.sqrt(major / left), FWHM_SCALE * np.sqrt(minor / left), float(np.sqrt(max(0.0, 1 - minor / major))),
             bool(p.saturation_level is not None and (part[used] >= p.saturation_level).any()))
        )
    return pd.DataFrame(rows, columns=["y", "x", "peak", "flux", "pixels", "snr", "fwhm_major", "fwhm_minor", "eccentricity", "saturated"])


STARS = "y double, x double, peak double, flux double, pixels long, snr double, fwhm_major double, fwhm_minor double, eccentricity double, saturated boolean"


def as_image(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Dense values and flags of one plane in long form."""
    height, width = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
    values, flags = np.full((height, width), np.nan), np.ones((height, width), np.int64)
    y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
    values[y, x], flags[y, x] = pdf["value"].to_numpy(), pdf["flags"].fillna(0).to_numpy()
    return values, flags


def measure_stars(samples: DataFrame, parameters: StarMeasurement | None = None) -> DataFrame:
    """Star tables of all planes: suppression is sequential, so one plane is the unit of work and of parallelism."""
    p = parameters or StarMeasurement()
    background = estimate_background(samples, p.background).select(*IMAGE, "location", "noise_sigma").filter("noise_sigma > 0")
    joined = samples.join(background, list(IMAGE))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image, flags = as_image(pdf)
        found = measure_image(image, flags, float(pdf["location"].iloc[0]), float(pdf["noise_sigma"].iloc[0]), p)
        for k, v in zip(IMAGE, key, strict=True):
            found.insert(0, k, v)
        return found[[*IMAGE, *found.columns[len(IMAGE):]]]

    return joined.groupBy(*IMAGE).applyInPandas(run, "stack_id int, frame_id long, plane int, " + STARS)


def frame_quality(stars: DataFrame, background: DataFrame) -> DataFrame:
    """Medians over the unsaturated stars of each plane next to its background."""
    good = ~F.col("saturated")
    found = stars.groupBy(*IMAGE).agg(
        F.count(F.lit(1)).alias("stars"), count_of(F.col("saturated")).alias("saturated_stars"),
        F.median(F.when(good, F.col("snr"))).alias("median_snr"), F.median(F.when(good, F.col("fwhm_major"))).alias("median_fwhm"),
        F.median(F.when(good, F.col("eccentricity"))).alias("median_eccentricity"),
    )
    return background.select(*IMAGE, "location", "noise_sigma").join(found, list(IMAGE), "left").fillna(0, ["stars", "saturated_stars"])


