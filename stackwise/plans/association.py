"""Association of calibration masters: exact keys and tolerances, unique best match, ambiguity instead of guesses.

Candidates meet on exact equi-keys (camera, size, binning), never as a product; tolerances are conditions on top.  A tie
of the best score is ambiguous and stays so.  Associations join conditions, each with the number of its masters;
``pedestal_candidates`` and ``light_candidates`` list every pair, which is what they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwise.schema import require

HARD = ("camera", "width", "height", "x_binning", "y_binning")
#: What every master must share with its target besides.
FITTING = (*HARD, "gain", "offset")
#: Tolerances of temperature from which bins are used.
LEAST_BIN = 1e-6
POLICIES = ("require_matched_dark", "require_bias", "prefer_matched_dark_then_bias")


@dataclass(frozen=True)
class Tolerances:
    exposure: float = 0.0
    temperature: float = 1.0
    policy: str = "prefer_matched_dark_then_bias"

    def __post_init__(self) -> None:
        require(self.exposure >= 0 and self.temperature >= 0, "tolerances must not be negative")
        require(self.policy in POLICIES, f"unknown policy {self.policy}")


def temperature_delta(target: str, candidate: str) -> Column:
    """Measured temperatures if the target has one, else both set points; null if they can't be compared."""
    t = lambda who, c: F.col(f"{who}_{c}")
    measured = F.abs(t(target, "sensor_temperature") - t(candidate, "sensor_temperature"))
    return F.when(t(target, "sensor_temperature").isNotNull(), measured).otherwise(F.abs(t(target, "set_temperature") - t(candidate, "set_temperature")))


def candidates(targets: DataFrame, masters: DataFrame, exact: tuple[str, ...] = HARD, same: tuple[str, ...] = ()) -> DataFrame:
    """Targets next to all masters with the same key; columns are prefixed ``t_`` and ``m_``.

    Columns in ``same`` may also be missing on both sides.  All of the key is an equi-join.
    """
    t = targets.select(*[F.col(c).alias(f"t_{c}") for c in targets.columns])
    m = masters.select(*[F.col(c).alias(f"m_{c}") for c in masters.columns])
    on = F.lit(True)
    for c in exact:
        on = on & (F.col(f"t_{c}") == F.col(f"m_{c}"))
    for c in same:
        on = on & F.col(f"t_{c}").eqNullSafe(F.col(f"m_{c}"))
    return t.join(m, on)


def mismatches(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail; a check that can't be made fails."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]), lambda x: x.isNotNull())


def _same(c: str) -> Column:
    return F.col(f"t_{c}") == F.col(f"m_{c}")


def _same_or_both_missing(c: str) -> Column:
    return F.col(f"t_{c}").eqNullSafe(F.col(f"m_{c}"))


def pedestal_candidates(flats: DataFrame, masters: DataFrame, p: Tolerances) -> DataFrame:
    """Every bias or dark with the hard key of a flat: what does not fit, and its distances."""
    joined = candidates(flats, masters).withColumns({"d_exposure": F.abs(F.col("t_exposure") - F.col("m_exposure")), "d_temperature": temperature_delta("t", "m")})
    checks = {"gain": _same("gain"), "offset": _same("offset"), "bayer": _same_or_both_missing("bayer"),
              "exposure": (F.col("m_frame_type") == "BIAS") | (F.col("d_exposure") <= p.exposure), "temperature": F.col("d_temperature") <= p.temperature}
    return joined.withColumn("mismatches", mismatches(checks))


def select_unique(compatible: DataFrame, target: list[str], candidate: str, scores: list[str], copies: Column | None = None) -> DataFrame:
    """``target, best, ties, scores``: candidates with the least score; the match is unique iff ``ties`` is 1.

    ``copies`` says how many candidates a row stands for.
    """
    order = W.partitionBy(*target).orderBy(*scores)
    best = compatible.withColumn("_r", F.rank().over(order)).filter("_r = 1")
    return best.groupBy(*target).agg(F.min(candidate).alias("best"), F.sum(F.lit(1) if copies is None else copies).alias("ties"), *[F.first(s).alias(s) for s in scores])


def nearest(targets: DataFrame, masters: DataFrame, exact: tuple[str, ...], same: tuple[str, ...], temperature: float, exposure: float | None = None) -> DataFrame:
    """``group_id, best, ties``: for each target the masters with the same key that are nearest in exposure, if asked for, and then in temperature.

    Groups with equal conditions are one row before anything is joined, so the work grows with the groups and with the
    different conditions near to each other, not with the pairs of groups.  Temperatures meet by bins of twice the tolerance.
    """
    measured = F.col("sensor_temperature").isNotNull()
    compared = [*exact, *same, *(["exposure"] if exposure is not None else [])]
    own = [*compared, "measured", "degrees"]
    t = targets.select("group_id", *compared, measured.alias("measured"), F.coalesce("sensor_temperature", "set_temperature").cast("double").alias("degrees"))
    either = [F.struct(F.lit(k).alias("measured"), F.col(c).cast("double").alias("degrees")) for k, c in ((True, "sensor_temperature"), (False, "set_temperature"))]
    m = masters.select("group_id", *compared, F.inline(F.array(*either))).filter("degrees IS NOT NULL")
    stock = m.groupBy(*own).agg(F.min("group_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    # Equal temperatures are their own bin; a tolerance too fine for bins does without.
    near = F.col("degrees") if temperature == 0 else F.rint(F.col("degrees") / (2 * temperature)) if temperature >= LEAST_BIN else F.lit(0.0)
    beside = F.array_distinct(F.array(*[near + k for k in ((0,) if temperature == 0 else (-1, 0, 1))]))
    kinds = t.select(*own).distinct().withColumn("bin", F.explode(beside))
    good = candidates(kinds, stock.withColumn("bin", near), (*exact, "measured", "bin"), same)
    good = good.withColumn("d_temperature", F.abs(F.col("t_degrees") - F.col("m_degrees"))).filter(F.col("d_temperature") <= temperature)
    scores = ["d_temperature"]
    if exposure is not None:
        good = good.withColumn("d_exposure", F.abs(F.col("t_exposure") - F.col("m_exposure"))).filter(F.col("d_exposure") <= exposure)
        scores = ["d_exposure", *scores]
    found = select_unique(good, [f"t_{c}" for c in own], "m_group_id", scores, F.col("m_copies"))
    on = F.lit(True)
    for c in own:
        on = on & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    return select_unique(t.join(found, on), ["group_id"], "best", scores, F.col("ties")).drop(*scores)


def associate_pedestals(flats: DataFrame, masters: DataFrame, parameters: Tolerances | None = None) -> DataFrame:
    """``flat_id, status, master_id``: a matched dark or a bias under the policy.

    An ambiguous dark does not fall back to a bias.
    """
    p = parameters or Tolerances()
    dark = nearest(flats, masters.filter("frame_type = 'DARK'"), FITTING, ("bayer",), p.temperature, p.exposure).toDF("g1", "dark", "darks")
    bias = nearest(flats, masters.filter("frame_type = 'BIAS'"), FITTING, ("bayer",), p.temperature).toDF("g2", "bias", "biases")
    joined = flats.select(F.col("group_id").alias("flat_id")).join(dark, F.col("flat_id") == F.col("g1"), "left").join(bias, F.col("flat_id") == F.col("g2"), "left")
    from_dark = F.when(F.col("darks") == 1, "matched_dark").when(F.col("darks") > 1, "ambiguous_dark")
    from_bias = F.when(F.col("biases") == 1, "bias").when(F.col("biases") > 1, "ambiguous_bias")
    status = {"require_matched_dark": F.coalesce(from_dark, F.lit("no_dark")), "require_bias": F.coalesce(from_bias, F.lit("no_bias")),
              "prefer_matched_dark_then_bias": F.coalesce(from_dark, from_bias, F.lit("none"))}[p.policy]
    joined = joined.withColumn("status", status)
    return joined.select("flat_id", "status", F.when(F.col("status") == "matched_dark", F.col("dark")).when(F.col("status") == "bias", F.col("bias")).alias("master_id"))


def light_candidates(lights: DataFrame, masters: DataFrame, p: Tolerances) -> DataFrame:
    """Darks need the exact exposure and a near temperature; flats the exact filter and, in colour, the mosaic."""
    joined = candidates(lights, masters).withColumn("d_temperature", temperature_delta("t", "m"))
    dark = F.col("m_frame_type") == "DARK"
    checks = {"gain": _same("gain"), "offset": _same("offset"), "bayer": _same_or_both_missing("bayer"), "exposure": ~dark | _same("exposure"),
              "temperature": ~dark | (F.col("d_temperature") <= p.temperature), "filter": dark | _same_or_both_missing("filter")}
    return joined.withColumn("mismatches", mismatches(checks))


def associate_lights(lights: DataFrame, masters: DataFrame, parameters: Tolerances | None = None) -> DataFrame:
    """``light_id, dark_status, dark_id, flat_status, flat_id``: the nearest dark if unique, the flat if there is one."""
    p = parameters or Tolerances()
    dark = nearest(lights, masters.filter("frame_type = 'DARK'"), (*FITTING, "exposure"), ("bayer",), p.temperature).toDF("g1", "dark", "darks")
    key = [*FITTING, "bayer", "filter"]
    stock = masters.filter("frame_type = 'FLAT'").groupBy(*key).agg(F.min("group_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    flats = candidates(lights.select("group_id", *key), stock, FITTING, ("bayer", "filter"))
    flat = flats.groupBy(F.col("t_group_id").alias("g2")).agg(F.min("m_group_id").alias("flat"), F.sum("m_copies").alias("flats"))
    joined = lights.select(F.col("group_id").alias("light_id")).join(dark, F.col("light_id") == F.col("g1"), "left").join(flat, F.col("light_id") == F.col("g2"), "left")
    status = lambda n: F.when(F.col(n).isNull(), "none").when(F.col(n) == 1, "matched").otherwise("ambiguous")
    return joined.select(
        "light_id", status("darks").alias("dark_status"), F.when(F.col("darks") == 1, F.col("dark")).alias("dark_id"),
        status("flats").alias("flat_status"), F.when(F.col("flats") == 1, F.col("flat")).alias("flat_id"),
    ).withColumn("ready", (F.col("dark_status") == "matched") & (F.col("flat_status") == "matched"))
