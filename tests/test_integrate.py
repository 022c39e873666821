"""Estimators against published and analytic values, and against themselves under other partitionings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwise.functions.student import esd_critical_value, quantile_from_tail
from stackwise.operators import integrate as I
from stackwise.operators import kernels
from stackwise.schema import HOT, INVALID, MISSING, SAMPLES, SATURATED, ParameterError

NAN, INF = float("nan"), float("inf")


def stack(spark, values, flags=None):
    flags = flags or [0] * len(values)
    return spark.createDataFrame([(0, i, 0, 0, 0, v, f) for i, (v, f) in enumerate(zip(values, flags, strict=True))], SAMPLES)


def one(df):
    return df.collect()[0].asDict()


# The published example of the generalized ESD test; three outliers.
ROSNER = [-0.25, 0.68, 0.94, 1.15, 1.20, 1.26, 1.26, 1.34, 1.38, 1.43, 1.49, 1.49, 1.55, 1.56, 1.58, 1.65, 1.69, 1.70, 1.76, 1.77, 1.81, 1.91, 1.94, 1.96, 1.99, 2.06, 2.09,
          2.10, 2.14, 2.15, 2.23, 2.24, 2.26, 2.35, 2.37, 2.40, 2.47, 2.54, 2.62, 2.64, 2.90, 2.92, 2.92, 2.93, 3.21, 3.26, 3.30, 3.59, 3.68, 4.30, 4.64, 5.34, 5.42, 6.01]


def test_student_quantiles():
    assert quantile_from_tail(0.025, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert quantile_from_tail(0.05, 1) == pytest.approx(6.313751514675043, rel=1e-9)
    assert esd_critical_value(54, 0.05) == pytest.approx(3.159, abs=1e-3)


def test_generalized_esd_published_example(spark):
    got = one(I.integrate_clipped(stack(spark, ROSNER), I.GeneralizedEsd(10 / 54 + 1e-9, 0.05)))
    assert (got["low_rejected"], got["high_rejected"], got["accepted"]) == (0, 3, 51)
    assert got["value"] == pytest.approx(np.mean(sorted(ROSNER)[:51]), rel=1e-12)


def test_esd_keeps_small_populations(spark):
    got = one(I.integrate_clipped(stack(spark, [1.0] * 13 + [1000.0]), I.GeneralizedEsd(0.5, 0.5)))
    assert got["accepted"] == 14


def test_mean_is_compensated_and_does_not_overflow(spark):
    assert one(I.integrate_mean(stack(spark, [1e16, 1.0, -1e16])))["value"] == pytest.approx(1 / 3, rel=1e-9)
    big = 1.7976931348623157e308
    assert one(I.integrate_mean(stack(spark, [big, big])))["value"] == big
    assert one(I.integrate_mean(stack(spark, [big, -big])))["value"] == 0.0
    assert one(I.integrate_median(stack(spark, [big, -big])))["value"] == 0.0


def test_support_accounting(spark):
    got = one(I.integrate_mean(stack(spark, [1.0, 3.0, NAN, INF, 5.0, NAN], [0, 0, 0, 0, HOT, SATURATED])))
    assert (got["accepted"], got["masked"], got["non_finite"], got["value"], got["flags"]) == (2, 2, 2, 2.0, 0)


def test_no_support(spark):
    got = one(I.integrate_median(stack(spark, [NAN, 2.0], [0, HOT])))
    assert math.isnan(got["value"]) and got["flags"] == (HOT | MISSING | INVALID)
    got = one(I.integrate_mean(stack(spark, [1.0, 2.0], [HOT, 128])))
    assert got["flags"] == (HOT | 128 | MISSING)


@pytest.mark.parametrize("name", ["strict_mean", "median", "percentile_clip", "sigma_clip", "winsorized_sigma_clip", "linear_fit_clip", "generalized_esd"])
def test_partitioning_does_not_matter(spark, name):
    rng = np.random.default_rng(3)
    data = [(0, f, 0, int(p // 4), int(p % 4), float(v), 0) for p in range(16) for f, v in enumerate(rng.normal(100, 5, 20))]
    samples = spark.createDataFrame(data, SAMPLES)
    results = [sorted(map(tuple, I.integrate(samples.repartition(n), name).collect())) for n in (1, 7, 64)]
    assert results[0] == results[1] == results[2]


def test_floor_discards_the_whole_decision(spark):
    assert one(I.integrate_percentile(stack(spark, [1.0, 2.0, 3.0, 4.0]), I.PercentileClip(0.4, 0.4, 3)))["accepted"] == 4
    assert one(I.integrate_percentile(stack(spark, [float(i) for i in range(10)]), I.PercentileClip(0.2, 0.1)))["value"] == np.mean(range(2, 9))


def test_linear_fit_keeps_a_ramp(spark):
    got = one(I.integrate_linear_fit(stack(spark, [float(3 * i + 1) for i in range(12)]), I.LinearFitClip(0.1, 0.1)))
    assert got["accepted"] == 12


def test_sigma_clip_rejects_an_outlier(spark):
    got = one(I.integrate_clipped(stack(spark, [10.0, 11.0, 9.0, 10.5, 9.5, 10.2, 9.8, 500.0]), I.SigmaClip(2.0, 2.0, 5)))
    assert (got["high_rejected"], got["low_rejected"]) == (1, 0) and got["value"] == pytest.approx(10.0)


def test_winsorized_differs_by_statistics_only():
    matrix, n = kernels.padded(np.array([1.0, 2.0, 3.0, 4.0, 100.0]), np.array([0, 5]))
    assert kernels.sigma_clip(matrix, n, 1.0, 1.0, 1, 3, True).sum() <= 5


def test_weights_scale_away(spark):
    samples = stack(spark, [1.0, 2.0, 4.0])
    for scale in (1.0, 1e200, 1e-200):
        weights = spark.createDataFrame([(0, scale), (1, 2 * scale), (2, scale)], "frame_id long, weight double")
        assert one(I.integrate_weighted_mean(samples, weights))["value"] == pytest.approx(2.25, rel=1e-12)


def test_dispositions_add_up(spark):
    samples = stack(spark, [10.0, 11.0, 9.0, 10.5, 9.5, 500.0, NAN, 3.0], [0] * 7 + [HOT])
    found = I.dispositions(samples, I.SigmaClip(1.5, 1.5, 5))
    total = {r["disposition"]: r["count"] for r in found.groupBy("disposition").count().collect()}
    assert sum(total.values()) == 8 and total["masked"] == 1 and total["non_finite"] == 1 and total["rejected_high"] == 1
    assert one(I.rebuild(found))["value"] == one(I.integrate_clipped(samples, I.SigmaClip(1.5, 1.5, 5)))["value"]


@pytest.mark.parametrize("bad", [lambda: I.PercentileClip(0.6, 0.5), lambda: I.SigmaClip(0, 1), lambda: I.GeneralizedEsd(0.6), lambda: I.LinearFitClip(minimum_retained=2), lambda: I.integrate(None, "mode")])
def test_domains(bad):
    with pytest.raises(ParameterError):
        bad()


def test_empty(spark):
    empty = spark.createDataFrame([], SAMPLES)
    for name in ("strict_mean", "sigma_clip", "generalized_esd", "linear_fit_clip"):
        assert I.integrate(empty, name).count() == 0


def test_rebuild_of_a_deep_position(spark):
    """60,000 samples at one position: the scale was sought again for each sample, over a minute in all."""
    import time

    n = F.col("id")
    samples = spark.range(60_000).select(F.lit(0).alias("stack_id"), n.alias("frame_id"), F.lit(0).alias("plane"), F.lit(0).alias("y"), F.lit(0).alias("x"),
                                         ((n * 7919) % 60_013 + 0.5).alias("value"), F.when(n % 10 == 0, 1).otherwise(0).cast("short").alias("flags"))
    k = F.col("frame_id")
    found = samples.withColumn("disposition", F.when(k % 10 == 0, "masked").when(k % 10 == 1, "rejected_low").otherwise("accepted"))
    began = time.time()
    got = I.rebuild(found).collect()[0]
    assert time.time() - began < 25
    assert (got["accepted"], got["masked"], got["low_rejected"], got["high_rejected"], got["non_finite"]) == (48_000, 6_000, 6_000, 0, 0)
    assert got["value"] == I.integrate_mean(samples.filter("frame_id % 10 > 1")).collect()[0]["value"]


def test_blocks_of_positions_hold_all_rows(monkeypatch):
    import pyarrow as pa

    lists = [[1.0] * n for n in (3, 0, 2, 9, 1, 1, 0)]
    batch = pa.record_batch([pa.array(range(7)), pa.array(lists, pa.list_(pa.float64()))], ["k", "v"])
    monkeypatch.setattr(I, "MOST_CELLS", 8)
    parts = list(I.blocks(batch, batch.column("v").offsets.to_numpy()))
    assert [p.column("k").to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5, 6]]
    assert [r for p in parts for r in p.column("v").to_pylist()] == lists
    assert len(list(I.blocks(batch.slice(0, 0), np.zeros(1, np.int32)))) == 1
