"""Per-position integration of aligned frames: strict, weighted and robust estimators with full evidence.

One shuffle on the position key gathers its samples (as many as there are frames, never more).  The estimators run in
Arrow batches on the gathered, sorted arrays, over many positions at a time.  Every result row says how many samples were accepted, masked, non-finite, rejected low and rejected high; they add up to the input.
The final value is always the strict mean of the original samples that were kept, except for the median.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwise.schema import PIXEL, count_of, eligible, masked, non_finite, or_flags, require, unsupported_flags

from . import kernels

NAN = float("nan")


@dataclass(frozen=True)
class PercentileClip:
    """Parts of the samples to drop at either end."""

    low: float = 0.2
    high: float = 0.1
    minimum_retained: int = 3
    algorithm_id = "percentile-clip-v1"

    def __post_init__(self) -> None:
        require(0 <= self.low < 1 and 0 <= self.high < 1 and self.low + self.high < 1, "percentile fractions must be in [0, 1) and leave samples")
        require(self.minimum_retained >= 1, "minimum_retained must be positive")


@dataclass(frozen=True)
class SigmaClip:
    low_sigma: float = 4.0
    high_sigma: float = 3.0
    maximum_iterations: int = 8
    minimum_retained: int = 3
    winsorized: bool = False

    def __post_init__(self) -> None:
        require(0 < self.low_sigma < float("inf") and 0 < self.high_sigma < float("inf"), "sigma limits must be finite and positive")
        require(self.maximum_iterations >= 1 and self.minimum_retained >= 1, "iterations and minimum_retained must be positive")

    @property
    def algorithm_id(self) -> str:
        return "winsorized-sigma-clip-v1" if self.winsorized else "sigma-clip-v1"


@dataclass(frozen=True)
class LinearFitClip:
    low_sigma: float = 4.0
    high_sigma: float = 3.0
    minimum_retained: int = 3
    algorithm_id = "linear-fit-clip-v1"

    def __post_init__(self) -> None:
        require(0 < self.low_sigma < float("inf") and 0 < self.high_sigma < float("inf"), "sigma limits must be finite and positive")
        require(self.minimum_retained >= 3, "a line needs at least three retained samples")


@dataclass(frozen=True)
class GeneralizedEsd:
    maximum_outlier_fraction: float = 0.3
    significance: float = 0.05
    minimum_retained: int = 3
    algorithm_id = "generalized-esd-v1"

    def __post_init__(self) -> None:
        require(0 < self.maximum_outlier_fraction <= 0.5, "outlier fraction must be in (0, 0.5]")
        require(0 < self.significance < 1, "significance must be in (0, 1)")
        require(self.minimum_retained >= 3, "minimum_retained must be at least three")


def crop(samples: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """A region, as a filter: it reaches the scan of a table of samples (not the decoding of image files)."""
    require(height > 0 and width > 0, "a region needs a positive size")
    return samples.filter(F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1))


def gather(samples: DataFrame, keys: tuple[str, ...] = PIXEL, by_frame: bool = False) -> DataFrame:
    """Positions with their eligible samples, sorted by value (or by frame, for strict sums in canonical order)."""
    order = F.struct("frame_id", "value") if by_frame else F.struct("value", "frame_id")
    return samples.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(eligible(), order))).alias("samples"),
        count_of(masked()).alias("masked"),
        count_of(non_finite()).alias("non_finite"),
        or_flags().alias("seen_flags"),
    )


def _finish(gathered: DataFrame, keys: tuple[str, ...], n: Column, value: Column, low: Column, high: Column) -> DataFrame:
    return gathered.select(
        *keys,
        F.when(n == 0, F.lit(NAN)).otherwise(value).alias("value"),
        F.when(n == 0, unsupported_flags(F.col("seen_flags"), F.col("non_finite") > 0)).otherwise(F.lit(0).cast("short")).alias("flags"),
        (n - low - high).cast("long").alias("accepted"),
        "masked",
        "non_finite",
        low.cast("long").alias("low_rejected"),
        high.cast("long").alias("high_rejected"),
    )


#: Cells of a matrix of positions and samples.
MOST_CELLS = 1 << 22


def _sent(gathered: DataFrame, kept: list[str], estimate: Callable[..., tuple], fields: tuple[str, ...]) -> DataFrame:
    """The columns ``kept`` of positions with ``_n, _value, _low, _high``, which ``estimate`` makes of blocks of them.

    Only the named fields of the samples leave the JVM, and one number for each position comes back.
    """
    sent = gathered.select(*kept, *[F.col(f"samples.{f}").alias(f"_{f}") for f in fields])
    added = ["_n", "_value", "_low", "_high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, whole.column(f"_{fields[0]}").offsets.to_numpy()):
                held = [batch.column(f"_{f}") for f in fields]
                offsets = [x.offsets.to_numpy() for x in held]
                n = np.diff(offsets[0])
                value, low, high = estimate(*[kernels.padded(x.values.to_numpy(zero_copy_only=False), o)[0] for x, o in zip(held, offsets, strict=True)], n)
                columns = [*(batch.column(c) for c in kept), pa.array(n.astype(np.int32)), pa.array(value)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], [*kept, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema if f.name in kept)
    return sent.mapInArrow(run, schema + ", _n int, _value double, _low int, _high int")


def blocks(batch: pa.RecordBatch, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose padded matrix has at most ``MOST_CELLS`` cells, or one row."""
    n, at = np.diff(offsets), 0
    if not len(n):
        yield batch
    while at < len(n):
        cells = np.maximum.accumulate(n[at:]) * np.arange(1, len(n) - at + 1)
        rows = max(1, int(np.searchsorted(cells, MOST_CELLS, side="right")))
        yield batch.slice(at, rows)
        at += rows


def _estimated(gathered: DataFrame, keys: tuple[str, ...], estimate: Callable[..., tuple], fields: tuple[str, ...] = ("value",)) -> DataFrame:
    """Positions with the result of ``estimate(matrix of each field, counts)``: values and the numbers rejected low and high."""
    out = _sent(gathered, [*keys, "masked", "non_finite", "seen_flags"], estimate, fields)
    return _finish(out, keys, *[F.col(c) for c in ("_n", "_value", "_low", "_high")])


def integrate_mean(samples: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Strict unweighted mean in canonical frame order."""
    return _estimated(gather(samples, keys, by_frame=True), keys, kernels.mean)


def integrate_median(samples: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Exact median."""
    return _estimated(gather(samples, keys), keys, kernels.median)


def integrate_weighted_mean(samples: DataFrame, weights: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Mean with one positive weight per frame; ``weights``: (frame_id, weight).

    Numerator and denominator leave out the same samples.  A frame without a weight is an error.
    """
    held = weights.select(F.col("frame_id").alias("_frame"), F.col("weight").cast("double").alias("weight"))
    joined = samples.join(held, F.col("frame_id") == F.col("_frame"), "left")
    missing = F.raise_error(F.concat(F.lit("no weight for frame "), F.col("frame_id").cast("string"))).cast("double")
    joined = joined.withColumn("weight", F.when(F.col("_frame").isNull(), missing).otherwise(F.col("weight")))
    gathered = joined.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(eligible(), F.struct("frame_id", "value", "weight")))).alias("samples"),
        count_of(masked()).alias("masked"),
        count_of(non_finite()).alias("non_finite"),
        or_flags().alias("seen_flags"),
    )
    return _estimated(gathered, keys, kernels.weighted_mean, ("value", "weight"))


def integrate_percentile(samples: DataFrame, clip: PercentileClip, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Mean without the lowest ``floor(n * low)`` and highest ``floor(n * high)`` samples."""
    low, high, floor = float(clip.low), float(clip.high), clip.minimum_retained
    return _estimated(gather(samples, keys), keys, lambda matrix, n: kernels.percentile_clip(matrix, n, low, high, floor))


def integrate_linear_fit(samples: DataFrame, clip: LinearFitClip, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Mean of the samples near one least-squares line through the sorted samples over their ranks."""
    low, high, floor = float(clip.low_sigma), float(clip.high_sigma), clip.minimum_retained
    return _estimated(gather(samples, keys), keys, lambda matrix, n: kernels.linear_fit_clip(matrix, n, low, high, floor))


def sides(matrix: np.ndarray, n: np.ndarray, clip: SigmaClip | GeneralizedEsd) -> np.ndarray:
    """-1, 0 or 1 for each sample of the sorted rows."""
    if isinstance(clip, GeneralizedEsd):
        return kernels.generalized_esd(matrix, n, clip.maximum_outlier_fraction, clip.significance, clip.minimum_retained)
    kept = kernels.sigma_clip(matrix, n, clip.low_sigma, clip.high_sigma, clip.maximum_iterations, clip.minimum_retained, clip.winsorized)
    first = np.argmax(kept, axis=1)[:, None]
    place = np.arange(matrix.shape[1])[None, :]
    return np.where(kept | (place >= n[:, None]), 0, np.where(place < first, -1, 1)).astype(np.int8)


def classify(samples: DataFrame, clip: SigmaClip | GeneralizedEsd, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Gathered positions with ``side``: the disposition of each of the sorted samples, and the mean of the kept ones."""
    gathered = gather(samples, keys)
    names = gathered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, whole.column("samples").offsets.to_numpy()):
                lists = batch.column("samples")
                offsets = lists.offsets.to_numpy()
                values = lists.values.field("value").to_numpy(zero_copy_only=False)
                matrix, n = kernels.padded(values, offsets)
                side = sides(matrix, n, clip) if matrix.size else np.zeros(matrix.shape, np.int8)
                real = np.arange(matrix.shape[1])[None, :] < n[:, None]
                mean = kernels.strict_means(matrix, real & (side == 0))
                flat = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(side[real].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(mean)], [*names, "side", "mean"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in gathered.schema)
    return gathered.mapInArrow(run, schema + ", side array<int>, mean double")


def integrate_clipped(samples: DataFrame, clip: SigmaClip | GeneralizedEsd, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Iterative sigma clipping, its winsorized form, or the generalized ESD test."""
    found = classify(samples, clip, keys)
    return _finish(found, keys, F.size("samples"), F.col("mean"), F.size(F.filter("side", lambda s: s == -1)), F.size(F.filter("side", lambda s: s == 1)))


DISPOSITIONS = ("accepted", "masked", "non_finite", "rejected_low", "rejected_high")


def dispositions(samples: DataFrame, clip: SigmaClip | GeneralizedEsd, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Every sample with what became of it: (keys, frame_id, value, flags, disposition)."""
    kept = classify(samples, clip, keys).select(*keys, F.explode(F.arrays_zip("samples", "side")).alias("s"))
    name = F.when(F.col("s.side") == 0, "accepted").when(F.col("s.side") < 0, "rejected_low").otherwise("rejected_high")
    kept = kept.select(*keys, F.col("s.samples.frame_id").alias("frame_id"), F.col("s.samples.value").alias("value"), F.lit(0).cast("short").alias("flags"), name.alias("disposition"))
    rest = samples.filter(~eligible()).select(
        *keys, "frame_id", "value", "flags", F.when(masked(), "masked").otherwise("non_finite").alias("disposition")
    )
    return kept.unionByName(rest)


def source_counts(found: DataFrame) -> DataFrame:
    """Totals of the five dispositions for each frame."""
    return found.groupBy("frame_id").agg(*[count_of(F.col("disposition") == d).alias(d) for d in DISPOSITIONS])


def promotions(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Accepted samples that became rejected, per frame, and changes of any other kind, which must not be."""
    on = [*keys, "frame_id"]
    both = before.select(*on, F.col("disposition").alias("was")).join(after.select(*on, F.col("disposition").alias("now")), on)
    changed = F.col("was") != F.col("now")
    promoted = (F.col("was") == "accepted") & F.col("now").isin("rejected_low", "rejected_high")
    return both.groupBy("frame_id").agg(
        count_of(promoted & (F.col("now") == "rejected_low")).alias("promoted_low"),
        count_of(promoted & (F.col("now") == "rejected_high")).alias("promoted_high"),
        count_of(changed & ~promoted).alias("invalid_changes"),
    )


def rebuild(found: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Value and support from dispositions: the strict mean of the accepted samples."""
    d = F.col("disposition")
    gathered = found.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(d == "accepted", F.struct("value")))).alias("samples"),
        *[count_of(d == name).alias(name) for name in DISPOSITIONS],
        or_flags().alias("seen_flags"),
    )
    out = _sent(gathered, [*keys, *DISPOSITIONS, "seen_flags"], kernels.mean, ("value",))
    none = F.col("accepted") == 0
    return out.select(
        *keys,
        F.when(none, F.lit(NAN)).otherwise(F.col("_value")).alias("value"),
        F.when(none, unsupported_flags(F.col("seen_flags"), F.col("non_finite") > 0)).otherwise(F.lit(0).cast("short")).alias("flags"),
        "accepted", "masked", "non_finite",
        F.col("rejected_low").alias("low_rejected"), F.col("rejected_high").alias("high_rejected"),
    )


def support_map(integrated: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Accepted counts as an image."""
    return integrated.select(*keys, F.col("accepted").cast("double").alias("value"), F.lit(0).cast("short").alias("flags"))


def rejection_maps(integrated: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Counts of low and high rejections as two images."""
    return integrated.select(*keys, F.col("low_rejected").cast("double").alias("low"), F.col("high_rejected").cast("double").alias("high"))


def balanced_psf_weight(frames: DataFrame, reference: DataFrame) -> DataFrame:
    """``frame_id, weight`` from signal to noise, sharpness and roundness relative to one reference row.

    Both have (frame_id, snr, fwhm, eccentricity).  Evaluated in logarithms and kept within the positive doubles.
    """
    ref = F.broadcast(reference.limit(1).select(F.col("snr").alias("r_snr"), F.col("fwhm").alias("r_fwhm"), F.col("eccentricity").alias("r_ecc")))
    round_ = 1 - F.col("eccentricity") * F.col("eccentricity")
    round_ref = 1 - F.col("r_ecc") * F.col("r_ecc")
    log_weight = 2 * F.ln(F.col("snr") / F.col("r_snr")) + 2 * F.ln(F.col("r_fwhm") / F.col("fwhm")) + F.ln(round_ / round_ref)
    same = (F.col("snr") == F.col("r_snr")) & (F.col("fwhm") == F.col("r_fwhm")) & (F.col("eccentricity") == F.col("r_ecc"))
    bounded = F.least(F.greatest(log_weight, F.lit(-708.3964185322641)), F.lit(709.782712893384))
    return frames.crossJoin(ref).select("frame_id", F.when(same, 1.0).otherwise(F.exp(bounded)).alias("weight"))  # one reference row


def automatic_plan(population: Column) -> Column:
    """Estimator and parameters for a number of frames."""
    tier = F.when(population < 3, "minimal").when(population < 8, "small").when(population < 15, "medium").otherwise("large")
    name = F.when(population < 3, "strict_mean").when(population < 8, "median").when(population < 15, "winsorized_sigma_clip").otherwise("generalized_esd")
    return F.struct(
        tier.alias("tier"), name.alias("estimator"), F.lit(4.0).alias("low_sigma"), F.lit(3.0).alias("high_sigma"),
        F.lit(0.30).alias("esd_outlier_fraction"), F.lit(0.05).alias("esd_significance"), F.lit(8).alias("maximum_iterations"),
        F.least(F.lit(3), population).cast("int").alias("minimum_retained"),
        (population >= 8).alias("rejection_maps"), F.lit(True).alias("support_map"),
    )


def integrate(samples: DataFrame, estimator: str, **parameters) -> DataFrame:
    """Dispatch by name: the closed set of estimators."""
    known = {
        "strict_mean": lambda: integrate_mean(samples),
        "median": lambda: integrate_median(samples),
        "weighted_mean": lambda: integrate_weighted_mean(samples, **parameters),
        "percentile_clip": lambda: integrate_percentile(samples, PercentileClip(**parameters)),
        "sigma_clip": lambda: integrate_clipped(samples, SigmaClip(**parameters)),
        "winsorized_sigma_clip": lambda: integrate_clipped(samples, SigmaClip(winsorized=True, **parameters)),
        "linear_fit_clip": lambda: integrate_linear_fit(samples, LinearFitClip(**parameters)),
        "generalized_esd": lambda: integrate_clipped(samples, GeneralizedEsd(**parameters)),
    }
    require(estimator in known, f"unknown estimator {estimator}")
    return known[estimator]()


