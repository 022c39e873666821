"""The registered queries of the stack operators, and the SQL that checks them.

Two adapters feed them: prices of parts as positions of one image (whole cents, so sums are exact in any order), and
vectors as 8 x 8 frames (whole thousandths).  Unsupported positions come out as NULL here; the operators return NaN.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise.functions.geometry import Affine, Projective
from stackwise.functions.numerics import neumaier_sum
from stackwise.functions.student import esd_critical_value
from stackwise.operators import calibrate, defects, drizzle, localnorm, preview, quality, registration, resample, review, statistics
from stackwise.operators import integrate as I
from stackwise.plans import association, pipelines
from stackwise.sources import fits, manifest
from stackwise.sources.adapters import EMBEDDING_SQL, LINEITEM_SQL, embedding_samples, lineitem_samples, table
from stackwise.streaming import running

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def no_nan(c: str | Column, digits: int | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    c = F.round(c, digits) if digits is not None else c
    return F.when(~F.isnan(c), c)


# --- SQL building blocks

GOOD = "flags = 0 AND isfinite(value)"
BASE = f"WITH s AS ({LINEITEM_SQL}), e AS ({EMBEDDING_SQL})"
COUNTS = """count(*) FILTER (flags <> 0) AS masked, count(*) FILTER (flags = 0 AND NOT isfinite(value)) AS non_finite, bit_or(flags) AS seen"""
RANKED = f""", v AS (SELECT y, x, value, row_number() OVER (PARTITION BY y, x ORDER BY value) AS r, count(*) OVER (PARTITION BY y, x) AS n FROM s WHERE {GOOD})
, c AS (SELECT y, x, {COUNTS} FROM s GROUP BY y, x)"""
FLAGS = "CASE WHEN m.n IS NULL THEN (c.seen | 1) | CASE WHEN c.non_finite > 0 THEN 32 ELSE 0 END ELSE 0 END"


def stacked(extra: str, kept: str, low: str = "0", high: str = "0", value: str | None = None) -> str:
    """``extra`` adds CTEs to v and c; ``kept``, ``low`` and ``high`` are conditions on the relation k."""
    value = value or f"round(avg(value) FILTER ({kept}), 6)"
    return f"""{BASE}{RANKED}{extra}
, m AS (SELECT y, x, max(n) AS n, {value} AS value, count(*) FILTER ({kept}) AS accepted, count(*) FILTER ({low}) AS low_rejected, count(*) FILTER ({high}) AS high_rejected FROM k GROUP BY y, x)
SELECT c.y, c.x, m.value, ({FLAGS})::SMALLINT AS flags, coalesce(accepted, 0) AS accepted, c.masked, c.non_finite, coalesce(low_rejected, 0) AS low_rejected, coalesce(high_rejected, 0) AS high_rejected
FROM c LEFT JOIN m ON c.y = m.y AND c.x = m.x"""


def _out(df: DataFrame, digits: int | None = 6) -> DataFrame:
    return df.select("y", "x", no_nan("value", digits).alias("value"), "flags", "accepted", "masked", "non_finite", "low_rejected", "high_rejected")


ALL = ", k AS (SELECT * FROM v)"


@register("stack_mean", stacked(ALL, "true", "false", "false"))
def stack_mean(spark, d):
    return _out(I.integrate_mean(lineitem_samples(spark, d)))


@register("stack_mean_crop", stacked(ALL, "true", "false", "false") + " WHERE c.y BETWEEN 0 AND 4 AND c.x BETWEEN 10 AND 39")
def stack_mean_crop(spark, d):
    return _out(I.integrate_mean(I.crop(lineitem_samples(spark, d), 0, 10, 5, 30)))


@register("stack_median", stacked(ALL, "true", "false", "false", "median(value)"))
def stack_median(spark, d):
    return _out(I.integrate_median(lineitem_samples(spark, d)), None)


WEIGHTS = ", w AS (SELECT *, (frame_id % 4 + 1)::DOUBLE AS weight FROM s)"


@register(
    "stack_weighted_mean",
    f"""{BASE}{WEIGHTS} SELECT y, x, round(sum(weight * value) FILTER ({GOOD}) / sum(weight) FILTER ({GOOD}), 6) AS value,
  (CASE WHEN count(*) FILTER ({GOOD}) = 0 THEN (bit_or(flags) | 1) | CASE WHEN count(*) FILTER (flags = 0 AND NOT isfinite(value)) > 0 THEN 32 ELSE 0 END ELSE 0 END)::SMALLINT AS flags,
  count(*) FILTER ({GOOD}) AS accepted, count(*) FILTER (flags <> 0) AS masked, count(*) FILTER (flags = 0 AND NOT isfinite(value)) AS non_finite,
  0::BIGINT AS low_rejected, 0::BIGINT AS high_rejected FROM w GROUP BY y, x""",
)
def stack_weighted_mean(spark, d):
    samples = lineitem_samples(spark, d)
    weights = samples.select("frame_id").distinct().withColumn("weight", (F.col("frame_id") % 4 + 1).cast("double"))
    return _out(I.integrate_weighted_mean(samples, weights))


@register(
    "stack_percentile_clip",
    stacked(", k AS (SELECT *, CASE WHEN n - floor(n * 0.2::DOUBLE) - floor(n * 0.1::DOUBLE) >= least(3, n) THEN floor(n * 0.2::DOUBLE) ELSE 0 END AS lo, CASE WHEN n - floor(n * 0.2::DOUBLE) - floor(n * 0.1::DOUBLE) >= least(3, n) THEN floor(n * 0.1::DOUBLE) ELSE 0 END AS hi FROM v)", "r > lo AND r <= n - hi", "r <= lo", "r > n - hi"),
)
def stack_percentile_clip(spark, d):
    return _out(I.integrate_percentile(lineitem_samples(spark, d), I.PercentileClip(0.2, 0.1)))


def _clip_sql(low: float, high: float, passes: int, winsorised: bool) -> str:
    """One CTE for each pass; the retained interval is (lo, hi] in ranks."""
    out = ", p0 AS (SELECT y, x, 0::BIGINT AS lo, max(n) AS hi, max(n) AS n, false AS done FROM v GROUP BY y, x)"
    for k in range(passes):
        if winsorised:
            stats = f"""SELECT v.y, v.x, avg(greatest(least(value, hv), lv)) AS m, stddev_pop(greatest(least(value, hv), lv)) AS s FROM v JOIN
              (SELECT p.y, p.x, max(value) FILTER (r = lo + 1) AS lv, max(value) FILTER (r = hi) AS hv FROM v JOIN p{k} p ON v.y = p.y AND v.x = p.x GROUP BY p.y, p.x) b ON v.y = b.y AND v.x = b.x GROUP BY v.y, v.x"""
        else:
            stats = f"SELECT v.y, v.x, avg(value) AS m, stddev_pop(value) AS s FROM v JOIN p{k} p ON v.y = p.y AND v.x = p.x WHERE r > lo AND r <= hi GROUP BY v.y, v.x"
        out += f"""
, a{k} AS ({stats})
, b{k} AS (SELECT p.y, p.x, any_value(p.lo) AS lo, any_value(p.hi) AS hi, any_value(p.n) AS n, any_value(p.done) AS done, any_value(s) AS s,
    any_value(p.lo) + count(*) FILTER (r > p.lo AND r <= p.hi AND value < m - {low} * s) AS nl, any_value(p.lo) + count(*) FILTER (r > p.lo AND r <= p.hi AND value <= m + {high} * s) AS nh
    FROM p{k} p JOIN a{k} a ON p.y = a.y AND p.x = a.x JOIN v ON v.y = p.y AND v.x = p.x GROUP BY p.y, p.x)
, p{k + 1} AS (SELECT y, x, CASE WHEN go THEN nl ELSE lo END AS lo, CASE WHEN go THEN nh ELSE hi END AS hi, n, NOT go AS done
    FROM (SELECT *, NOT done AND hi - lo > 3 AND s > 0 AND nh - nl >= 3 AND (nl <> lo OR nh <> hi) AS go FROM b{k}))"""
    return out + f", k AS (SELECT v.*, lo, hi FROM v JOIN p{passes} p ON v.y = p.y AND v.x = p.x)"


@register("stack_sigma_clip", stacked(_clip_sql(1.8, 1.6, 4, False), "r > lo AND r <= hi", "r <= lo", "r > hi"))
def stack_sigma_clip(spark, d):
    return _out(I.integrate_clipped(lineitem_samples(spark, d), I.SigmaClip(1.8, 1.6, 4)))


@register("stack_winsorized_clip", stacked(_clip_sql(1.9, 1.7, 4, True), "r > lo AND r <= hi", "r <= lo", "r > hi"))
def stack_winsorized_clip(spark, d):
    return _out(I.integrate_clipped(lineitem_samples(spark, d), I.SigmaClip(1.9, 1.7, 4, winsorized=True)))


LINE = """, t AS (SELECT *, (2 * (r - 1) + 1 - n)::DOUBLE / n AS q FROM v)
, f AS (SELECT y, x, avg(value) AS m, sum(value * q) / sum(q * q) AS b FROM t WHERE n >= 3 GROUP BY y, x)
, g AS (SELECT t.*, value - (m + b * q) AS d FROM t LEFT JOIN f ON t.y = f.y AND t.x = f.x)
, h AS (SELECT *, sqrt(avg(d * d) OVER (PARTITION BY y, x)) AS s FROM g)
, i AS (SELECT *, CASE WHEN n >= 3 AND d < -1.5 * s THEN -1 WHEN n >= 3 AND d > 1.5 * s THEN 1 ELSE 0 END AS side0 FROM h)
, k AS (SELECT *, CASE WHEN count(*) FILTER (side0 = 0) OVER (PARTITION BY y, x) >= least(3, n) THEN side0 ELSE 0 END AS side FROM i)"""


@register("stack_linear_fit_clip", stacked(LINE, "side = 0", "side = -1", "side = 1"))
def stack_linear_fit_clip(spark, d):
    return _out(I.integrate_linear_fit(lineitem_samples(spark, d), I.LinearFitClip(1.5, 1.5)))


ESD = I.GeneralizedEsd(0.3, 0.25)


def _esd_sql() -> str:
    """A recursive CTE that takes out the farthest sample of every position, step by step."""
    bounds = ", ".join(f"({m}, {esd_critical_value(m, ESD.significance)!r}::DOUBLE)" for m in range(5, 91))
    return f"""
, q AS (SELECT y, x, list(value ORDER BY value) AS vs, max(n) AS n, CASE WHEN max(n) < 15 THEN 0 ELSE least(floor(max(n) * 0.3::DOUBLE), max(n) - 3) END::INT AS most FROM v GROUP BY y, x)
, bound(m, l) AS (VALUES {bounds})
, step AS (
  WITH RECURSIVE t AS (
    SELECT y, x, vs, most, 0 AS i, 0::DOUBLE AS stat, NULL::DOUBLE AS gone, 0 AS side, 0::BIGINT AS held FROM q
    UNION ALL
    SELECT y, x, list_concat(list_slice(vs, 1, pos - 1), list_slice(vs, pos + 1, len(vs))), most, i + 1, abs(vs[pos] - m) / s, vs[pos], CASE WHEN vs[pos] < m THEN -1 ELSE 1 END, len(vs)::BIGINT
    FROM (SELECT *, CASE WHEN m - vs[1] >= vs[-1] - m THEN 1 ELSE list_position(vs, vs[-1]) END AS pos
      FROM (SELECT *, list_avg(vs) AS m, sqrt(list_sum(list_transform(vs, lambda z: (z - list_avg(vs)) * (z - list_avg(vs)))) / (len(vs) - 1)) AS s FROM t WHERE i < most AND len(vs) >= 3))
    WHERE s > 0)
  SELECT t.*, l FROM t LEFT JOIN bound ON m = held)
, z AS (SELECT y, x, coalesce(max(i) FILTER (stat > l), 0) AS k FROM step GROUP BY y, x)
, o AS (SELECT z.y, z.x, count(*) FILTER (side = -1 AND i <= k AND i > 0) AS low, count(*) FILTER (side = 1 AND i <= k AND i > 0) AS high FROM z JOIN step ON z.y = step.y AND z.x = step.x GROUP BY z.y, z.x)
, k AS (SELECT v.*, low, high FROM v JOIN o ON v.y = o.y AND v.x = o.x)"""


@register("stack_generalized_esd", stacked(_esd_sql(), "r > low AND r <= n - high", "r <= low", "r > n - high"))
def stack_generalized_esd(spark, d):
    return _out(I.integrate_clipped(lineitem_samples(spark, d), ESD))


@register(
    "automatic_plan",
    f"""{BASE} SELECT stack_id, n, CASE WHEN n < 3 THEN 'strict_mean' WHEN n < 8 THEN 'median' WHEN n < 15 THEN 'winsorized_sigma_clip' ELSE 'generalized_esd' END AS estimator,
  least(3, n)::INT AS minimum_retained, n >= 8 AS rejection_maps FROM (SELECT stack_id, count(DISTINCT frame_id) AS n FROM e GROUP BY 1)""",
)
def automatic_plan(spark, d):
    n = embedding_samples(spark, d).groupBy("stack_id").agg(F.countDistinct("frame_id").alias("n"))
    plan = n.withColumn("p", I.automatic_plan(F.col("n")))
    return plan.select("stack_id", "n", "p.estimator", "p.minimum_retained", "p.rejection_maps")


SOURCE_SQL = f"""{BASE}, v AS (SELECT *, row_number() OVER (PARTITION BY stack_id, y, x ORDER BY value, frame_id) AS r, count(*) OVER (PARTITION BY stack_id, y, x) AS n FROM e WHERE {GOOD})
, a AS (SELECT stack_id, y, x, avg(value) AS m, stddev_pop(value) AS s FROM v GROUP BY 1, 2, 3)
, b AS (SELECT v.*, value < m - 1.5 * s AS lo0, value > m + 1.5 * s AS hi0 FROM v JOIN a USING (stack_id, y, x))
, g AS (SELECT *, n > 3 AND count(*) FILTER (NOT lo0 AND NOT hi0) OVER (PARTITION BY stack_id, y, x) >= 3 AS ok FROM b)
, k AS (SELECT stack_id, frame_id, y, x, CASE WHEN ok AND lo0 THEN 'rejected_low' WHEN ok AND hi0 THEN 'rejected_high' ELSE 'accepted' END AS disposition, value, 0 AS flags FROM g
  UNION ALL SELECT stack_id, frame_id, y, x, CASE WHEN flags <> 0 THEN 'masked' ELSE 'non_finite' END, value, flags FROM e WHERE NOT ({GOOD}))"""
ONE_PASS = I.SigmaClip(1.5, 1.5, 1)


@register(
    "source_dispositions",
    SOURCE_SQL + " SELECT frame_id, " + ", ".join(f"count(*) FILTER (disposition = '{n}') AS {n}" for n in I.DISPOSITIONS) + " FROM k GROUP BY frame_id",
)
def source_dispositions(spark, d):
    return I.source_counts(I.dispositions(embedding_samples(spark, d), ONE_PASS))


@register(
    "support_and_rejection_maps",
    SOURCE_SQL + " SELECT stack_id, y, x, count(*) FILTER (disposition = 'accepted') AS accepted, count(*) FILTER (disposition = 'rejected_low') AS low, count(*) FILTER (disposition = 'rejected_high') AS high FROM k GROUP BY 1, 2, 3",
)
def support_and_rejection_maps(spark, d):
    science = I.integrate_clipped(embedding_samples(spark, d), ONE_PASS)
    maps = I.support_map(science).select("stack_id", "y", "x", F.col("value").cast("long").alias("accepted")).join(I.rejection_maps(science).select("stack_id", "y", "x", "low", "high"), ["stack_id", "y", "x"])
    return maps.select("stack_id", "y", "x", "accepted", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


SEEDS_SQL = SOURCE_SQL + """
, j AS (SELECT * FROM k WHERE disposition IN ('rejected_low', 'rejected_high'))
, seed AS (SELECT a.frame_id, a.disposition, a.y, a.x, a.stack_id FROM j a JOIN j b ON a.frame_id = b.frame_id AND a.disposition = b.disposition AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
  GROUP BY ALL HAVING count(*) >= 3)
, grown AS (SELECT DISTINCT frame_id, disposition, seed.y + dy.d AS y, seed.x + dx.d AS x FROM seed, (VALUES (-1), (0), (1)) dy(d), (VALUES (-1), (0), (1)) dx(d))
, hit AS (SELECT k.*, EXISTS (FROM grown g WHERE g.frame_id = k.frame_id AND g.y = k.y AND g.x = k.x AND g.disposition = 'rejected_low') AS lo,
  EXISTS (FROM grown g WHERE g.frame_id = k.frame_id AND g.y = k.y AND g.x = k.x AND g.disposition = 'rejected_high') AS hi FROM k)
, room AS (SELECT *, count(*) FILTER (disposition = 'accepted' AND lo = hi) OVER (PARTITION BY stack_id, y, x) AS remain FROM hit)
, after AS (SELECT stack_id, frame_id, y, x, value, flags, CASE WHEN disposition = 'accepted' AND lo <> hi AND remain >= 3 THEN CASE WHEN lo THEN 'rejected_low' ELSE 'rejected_high' END ELSE disposition END AS disposition, disposition AS before FROM room)"""
TAIL = defects.LargeScale(1, 1)


@register("large_scale_seeds", SEEDS_SQL + " SELECT frame_id, y, x FROM seed WHERE disposition = 'rejected_high'")
def large_scale_seeds(spark, d):
    return defects.large_scale_seeds(I.dispositions(embedding_samples(spark, d), ONE_PASS), "high", TAIL).select("frame_id", "y", "x")


@register(
    "large_scale_promotions",
    SEEDS_SQL + """ SELECT frame_id, count(*) FILTER (before = 'accepted' AND disposition = 'rejected_low') AS promoted_low, count(*) FILTER (before = 'accepted' AND disposition = 'rejected_high') AS promoted_high, 0::BIGINT AS invalid_changes FROM after GROUP BY 1""",
)
def large_scale_promotions(spark, d):
    before = I.dispositions(embedding_samples(spark, d), ONE_PASS)
    return I.promotions(before, defects.expand_large_scale(before, TAIL, TAIL, 3))


@register("rebuilt_stack", SEEDS_SQL + " SELECT stack_id, y, x, round(avg(value) FILTER (disposition = 'accepted'), 6) AS value, count(*) FILTER (disposition = 'accepted') AS accepted FROM after GROUP BY 1, 2, 3")
def rebuilt_stack(spark, d):
    found = defects.expand_large_scale(I.dispositions(embedding_samples(spark, d), ONE_PASS), TAIL, TAIL, 3)
    return I.rebuild(found).select("stack_id", "y", "x", no_nan("value", 6).alias("value"), "accepted")


@register(
    "psf_weights",
    """WITH f AS (SELECT p_partkey AS frame_id, 10 + p_size::DOUBLE AS snr, 2 + (p_partkey % 7)::DOUBLE / 4 AS fwhm, (p_partkey % 5)::DOUBLE / 10 AS ecc FROM part), r AS (SELECT * FROM f WHERE frame_id = 1)
SELECT f.frame_id, round(ln(pow(f.snr / r.snr, 2) * pow(r.fwhm / f.fwhm, 2) * (1 - f.ecc * f.ecc) / (1 - r.ecc * r.ecc)), 9) + 0.0::DOUBLE AS log_weight FROM f, r""",
)
def psf_weights(spark, d):
    # Logarithms: weights themselves may lie exactly between two rounded values.
    p = table(spark, d, "part")
    frames = p.select(F.col("p_partkey").alias("frame_id"), (10 + F.col("p_size")).cast("double").alias("snr"), (2 + (F.col("p_partkey") % 7) / 4).alias("fwhm"), ((F.col("p_partkey") % 5) / 10).alias("eccentricity"))
    return I.balanced_psf_weight(frames, frames.filter("frame_id = 1")).select("frame_id", (F.round(F.ln("weight"), 9) + 0.0).alias("log_weight"))


# --- calibration: masters derived from positions

DARK_SQL = "dark AS (SELECT 0 AS plane, y, x, ((y * 8 + x) % 5)::DOUBLE AS value, CASE WHEN y = 3 AND x = 3 THEN 4 ELSE 0 END AS flags FROM range(8) a(y), range(8) b(x))"
FLAT_SQL = "flat AS (SELECT 0 AS plane, y, x, CASE WHEN (y * 8 + x) % 13 = 0 THEN 0 ELSE 1 + (x % 4) / 4.0 END::DOUBLE AS value, 0 AS flags FROM range(8) a(y), range(8) b(x))"


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.lit(0).alias("plane"), F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"))


def dark_master(spark: SparkSession) -> DataFrame:
    return _grid(spark).withColumns({"value": ((F.col("y") * 8 + F.col("x")) % 5).cast("double"), "flags": F.when((F.col("y") == 3) & (F.col("x") == 3), 4).otherwise(0).cast("short")})


def flat_master(spark: SparkSession) -> DataFrame:
    value = F.when((F.col("y") * 8 + F.col("x")) % 13 == 0, 0.0).otherwise(1 + (F.col("x") % 4) / 4)
    return _grid(spark).withColumns({"value": value, "flags": F.lit(0).cast("short")})


def _calibrated(df: DataFrame) -> DataFrame:
    return df.select("stack_id", "frame_id", "y", "x", no_nan("value").alias("value"), "flags")


@register(
    "calibrate_dark_flat",
    f"""{BASE}, {DARK_SQL}, {FLAT_SQL} SELECT stack_id, frame_id, e.y, e.x, CASE WHEN (e.flags | d.flags) = 0 AND isfinite(e.value) AND abs(f.value) > 0.01 THEN (e.value - d.value) / f.value + 0.0::DOUBLE END AS value,
 (CASE WHEN (e.flags | d.flags) <> 0 THEN e.flags | d.flags WHEN isfinite(e.value) AND abs(f.value) > 0.01 THEN 0 ELSE 32 END)::SMALLINT AS flags FROM e JOIN dark d USING (y, x) JOIN flat f ON f.y = e.y AND f.x = e.x""",
)
def calibrate_dark_flat(spark, d):
    return _calibrated(calibrate.calibrate_dark_flat(embedding_samples(spark, d), dark_master(spark), flat_master(spark), 0.01, small_masters=True))


@register(
    "execute_light_plan",
    f"""{BASE}, {DARK_SQL}, {FLAT_SQL}, p AS (SELECT e.*, (frame_id % 3)::INT AS g FROM e WHERE frame_id % 3 <> 2)
SELECT frame_id, 'L' || g AS group_id, p.y, p.x, CASE WHEN (p.flags | d.flags) = 0 AND isfinite(p.value) AND abs(f.value) > 0.01 THEN (p.value - (d.value + g)) / f.value + 0.0::DOUBLE END AS value,
 (CASE WHEN (p.flags | d.flags) <> 0 THEN p.flags | d.flags WHEN isfinite(p.value) AND abs(f.value) > 0.01 THEN 0 ELSE 32 END)::SMALLINT AS flags FROM p JOIN dark d USING (y, x) JOIN flat f ON f.y = p.y AND f.x = p.x""",
)
def execute_light_plan(spark, d):
    """Three groups of lights, each with its own dark, one of them without a flat: it is left out."""
    e = embedding_samples(spark, d)
    groups = range(3)
    masters = flat_master(spark).withColumn("group_id", F.lit("F"))
    for g in groups:
        masters = masters.unionByName(dark_master(spark).withColumn("value", F.col("value") + g).withColumn("group_id", F.lit(f"D{g}")))
    frames = e.select("frame_id").distinct().withColumn("group_id", F.concat(F.lit("L"), (F.col("frame_id") % 3).cast("string")))
    plan = spark.createDataFrame([(f"L{g}", f"D{g}", "F" if g < 2 else None, g < 2) for g in groups], "light_id string, dark_id string, flat_id string, ready boolean")
    out = pipelines.execute_light_plan(e, frames, plan, masters, 0.01)
    return out.select("frame_id", "group_id", "y", "x", F.col("value") + 0.0, "flags").toDF("frame_id", "group_id", "y", "x", "value", "flags").withColumn("value", no_nan("value"))


@register(
    "subtract_pedestal",
    f"""{BASE}, {DARK_SQL} SELECT stack_id, frame_id, e.y, e.x, CASE WHEN (e.flags | d.flags) = 0 AND isfinite(e.value) THEN e.value - d.value + 0.0::DOUBLE END AS value,
 (CASE WHEN (e.flags | d.flags) <> 0 THEN e.flags | d.flags WHEN isfinite(e.value) THEN 0 ELSE 32 END)::SMALLINT AS flags FROM e JOIN dark d USING (y, x)""",
)
def subtract_pedestal(spark, d):
    return _calibrated(calibrate.subtract_pedestal(embedding_samples(spark, d), dark_master(spark), small_masters=True))


@register(
    "normalize_flat",
    f"""{BASE}, m AS (SELECT frame_id, median(value) FILTER ({GOOD} AND value > 0) AS med, count(*) FILTER ({GOOD} AND value > 0) AS n FROM e GROUP BY 1)
SELECT stack_id, frame_id, y, x, CASE WHEN flags = 0 AND isfinite(value) AND value > 0 AND n >= 20 THEN value / med END AS value,
 (CASE WHEN flags <> 0 THEN flags WHEN isfinite(value) AND value > 0 AND n >= 20 THEN 0 ELSE 32 END)::SMALLINT AS flags, CASE WHEN n < 20 THEN 'insufficient_samples' END AS failure FROM e JOIN m USING (frame_id)""",
)
def normalize_flat(spark, d):
    out = calibrate.normalize_flat(embedding_samples(spark, d), 20)
    return out.select("stack_id", "frame_id", "y", "x", no_nan("value").alias("value"), "flags", "failure")


@register("master_mean", f"{BASE} SELECT stack_id, y, x, round(avg(value) FILTER ({GOOD}), 6) AS value, count(*) FILTER ({GOOD}) AS accepted, 'dark' AS kind FROM e GROUP BY 1, 2, 3")
def master_mean(spark, d):
    return calibrate.master(embedding_samples(spark, d), "dark").select("stack_id", "y", "x", no_nan("value", 6).alias("value"), "accepted", "kind")


@register(
    "image_statistics",
    f"""{BASE} SELECT stack_id, frame_id, count(*) AS total, count(*) FILTER ({GOOD}) AS usable, count(*) FILTER (flags <> 0) AS masked, count(*) FILTER (flags = 0 AND NOT isfinite(value)) AS non_finite,
 min(value) FILTER ({GOOD}) AS minimum, max(value) FILTER ({GOOD}) AS maximum, round(avg(value) FILTER ({GOOD}), 6) AS mean, round(var_pop(value) FILTER ({GOOD}) * count(*) FILTER ({GOOD}) * count(*) FILTER ({GOOD})) AS scaled_population_variance, round(var_samp(value) FILTER ({GOOD}) * count(*) FILTER ({GOOD}) * (count(*) FILTER ({GOOD}) - 1)) AS scaled_sample_variance FROM e GROUP BY 1, 2""",
)
def image_statistics(spark, d):
    # n^2 and n (n - 1) times a variance of whole numbers is whole.
    out = statistics.image_statistics(embedding_samples(spark, d))
    n = F.col("usable")
    scaled = [F.round(F.col("population_variance") * n * n).alias("scaled_population_variance"), F.round(F.col("sample_variance") * n * (n - 1)).alias("scaled_sample_variance")]
    return out.select("stack_id", "frame_id", "total", "usable", "masked", "non_finite", "minimum", "maximum", F.round("mean", 6).alias("mean"), *scaled)


@register(
    "corpus_inventory",
    "SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
)
def corpus_inventory(spark, d):
    return statistics.inventory(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def _mad_sql(passes: int, sigma: float, least: int, keys: str = "stack_id, frame_id") -> str:
    out = f", g AS (SELECT {keys}, value FROM e WHERE {GOOD}), p0 AS (SELECT {keys}, '-inf'::DOUBLE AS lo, 'inf'::DOUBLE AS hi, false AS done, 0 AS it, false AS conv FROM g GROUP BY {keys})"
    for k in range(passes):
        out += f"""
, i{k} AS (SELECT {keys}, value FROM g JOIN p{k} USING ({keys}) WHERE value >= lo AND value <= hi)
, l{k} AS (SELECT {keys}, median(value) AS med, count(*) AS n FROM i{k} GROUP BY {keys})
, d{k} AS (SELECT {keys}, any_value(med) AS med, any_value(n) AS n, median(abs(value - med)) AS mad FROM i{k} JOIN l{k} USING ({keys}) GROUP BY {keys})
, c{k} AS (SELECT {keys}, any_value(mad) AS mad, any_value(n) AS n, any_value(med) AS med, count(*) FILTER (abs(value - med) <= {sigma} * (mad * {quality.MAD_SCALE!r})) AS kept FROM i{k} JOIN d{k} USING ({keys}) GROUP BY {keys})
, p{k + 1} AS (SELECT {keys}, CASE WHEN NOT done AND NOT stop THEN greatest(lo, med - {sigma} * (mad * {quality.MAD_SCALE!r})) ELSE lo END AS lo, CASE WHEN NOT done AND NOT stop THEN least(hi, med + {sigma} * (mad * {quality.MAD_SCALE!r})) ELSE hi END AS hi,
   done OR stop AS done, it + (NOT done)::INT AS it, conv OR (NOT done AND stop) AS conv FROM (SELECT *, mad = 0 OR kept = n AS stop FROM p{k} JOIN c{k} USING ({keys})))"""
    return out + f"""
, i AS (SELECT {keys}, value, it, conv FROM g JOIN p{passes} USING ({keys}) WHERE value >= lo AND value <= hi)
, l AS (SELECT {keys}, median(value) AS med, count(*) AS n, any_value(it) AS it, any_value(conv) AS conv FROM i GROUP BY {keys})
SELECT {keys}, any_value(med) AS location, median(abs(value - med)) AS mad, any_value(n) AS retained_samples, any_value(l.it) AS iterations, any_value(l.conv) AS converged FROM i JOIN l USING ({keys}) GROUP BY {keys}"""


@register("background_mad_clip", BASE + _mad_sql(3, 2.0, 8))
def background_mad_clip(spark, d):
    out = quality.estimate_background(embedding_samples(spark, d), quality.Background(2.0, 3, 1))
    return out.select("stack_id", "frame_id", "location", F.col("median_absolute_deviation").alias("mad"), "retained_samples", "iterations", "converged")


@register(
    "cfa_cell_mean",
    f"{BASE} SELECT stack_id, frame_id, (y // 2)::INT AS y, (x // 2)::INT AS x, CASE WHEN count(*) FILTER ({GOOD}) = 4 THEN sum(value) / 4 END AS value, (CASE WHEN count(*) FILTER ({GOOD}) = 4 THEN 0 ELSE bit_or(flags) | CASE WHEN count(*) FILTER (flags = 0 AND NOT isfinite(value)) > 0 THEN 32 ELSE 0 END END)::SMALLINT AS flags FROM e GROUP BY 1, 2, 3, 4",
)
def cfa_cell_mean(spark, d):
    return quality.cfa_cell_mean(embedding_samples(spark, d)).select("stack_id", "frame_id", "y", "x", no_nan("value").alias("value"), "flags")


RGB_SQL = "rgb AS (SELECT stack_id, frame_id - frame_id % 3 AS frame_id, (frame_id % 3)::INT AS plane, y, x, value, flags FROM e)"


def rgb_samples(spark: SparkSession, d: str) -> DataFrame:
    e = embedding_samples(spark, d)
    return e.withColumns({"plane": (F.col("frame_id") % 3).cast("int"), "frame_id": F.col("frame_id") - F.col("frame_id") % 3, "stack_id": F.lit(0)})


@register(
    "rgb_luminance",
    f"""{BASE}, {RGB_SQL}, w AS (SELECT frame_id, y, x, {', '.join(f"max(value) FILTER ({GOOD} AND plane = {p}) AS c{p}" for p in range(3))} FROM rgb GROUP BY 1, 2, 3)
SELECT frame_id, y, x, round(c0 * 0.2126 + c1 * 0.7152 + c2 * 0.0722, 6) AS value FROM w""",
)
def rgb_luminance(spark, d):
    return quality.rgb_luminance(rgb_samples(spark, d)).select("frame_id", "y", "x", no_nan("value", 6).alias("value"))


@register(
    "local_maxima",
    f"""{BASE}, g AS (SELECT * FROM e WHERE {GOOD}) SELECT frame_id, y, x, value AS peak FROM g a WHERE value > 150 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND NOT EXISTS (FROM g b WHERE b.frame_id = a.frame_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
 AND (b.value > a.value OR (b.value = a.value AND b.y * 8 + b.x < a.y * 8 + a.x)))""",
)
def local_maxima(spark, d):
    e = embedding_samples(spark, d)
    at = e.select("stack_id", "frame_id", "plane").distinct().withColumn("threshold", F.lit(150.0))
    return quality.local_maxima(e, at, border=1).select("frame_id", "y", "x", "peak")


def _near_sql(condition: str, least: int, hot: float, cold: float) -> str:
    return f"""{BASE}, g AS (SELECT * FROM e WHERE {GOOD}), n AS (SELECT a.stack_id, a.frame_id, a.y, a.x, any_value(a.value) AS value, list(b.value) AS vs, median(b.value) AS med FROM g a JOIN g b ON a.frame_id = b.frame_id AND {condition} GROUP BY 1, 2, 3, 4)
, t AS (SELECT *, list_median(list_transform(vs, lambda z: abs(z - med))) * {quality.MAD_SCALE!r} AS sig FROM n)
, dec AS (SELECT stack_id, frame_id, y, x, value, CASE WHEN len(vs) < {least} THEN 'insufficient_support' WHEN value - med > sig * {hot} THEN 'hot' WHEN value - med < -(sig * {cold}) THEN 'cold' ELSE 'clear' END AS decision FROM t)"""


SQUARE_SQL = _near_sql("abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x)", 5, 3.0, 3.0)
SPOTS = defects.LocalDefects(1, 1, 5, 3.0, 3.0)


@register("local_defects", SQUARE_SQL + " SELECT frame_id, y, x, (CASE decision WHEN 'hot' THEN 4 ELSE 8 END)::SMALLINT AS defect FROM dec WHERE decision IN ('hot', 'cold')")
def local_defects(spark, d):
    return defects.detect_local_defects(embedding_samples(spark, d), SPOTS).select("frame_id", "y", "x", "defect")


MERGED_SQL = SQUARE_SQL + ", mrg AS (SELECT y, x, bit_or(CASE decision WHEN 'hot' THEN 4 ELSE 8 END) AS defect, count(*) AS votes FROM dec WHERE decision IN ('hot', 'cold') GROUP BY 1, 2)"


@register("merge_defects", MERGED_SQL + " SELECT y, x, defect, votes, defect = 12 AS conflict FROM mrg")
def merge_defects(spark, d):
    return defects.merge_defect_maps(defects.detect_local_defects(embedding_samples(spark, d), SPOTS)).select("y", "x", "defect", "votes", "conflict")


@register(
    "correct_defects",
    f"""{BASE}, {DARK_SQL}, map AS (SELECT y, x FROM dark WHERE value = 4), g AS (SELECT e.* FROM e ANTI JOIN map USING (y, x) WHERE {GOOD})
, n AS (SELECT a.frame_id, a.y, a.x, median(b.value) AS med, count(b.value) AS n FROM e a JOIN g b ON a.frame_id = b.frame_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3)
SELECT e.frame_id, e.y, e.x, CASE WHEN m.y IS NULL OR (flags & ~12) <> 0 THEN CASE WHEN isnan(value) THEN NULL ELSE value END WHEN coalesce(n, 0) >= 4 THEN med END AS value,
 CASE WHEN m.y IS NULL THEN 'kept' WHEN (flags & ~12) <> 0 THEN 'blocked' WHEN coalesce(n, 0) >= 4 THEN 'corrected' ELSE 'unsupported' END AS outcome
FROM e LEFT JOIN map m ON e.y = m.y AND e.x = m.x LEFT JOIN n ON n.frame_id = e.frame_id AND n.y = e.y AND n.x = e.x""",
)
def correct_defects(spark, d):
    found = dark_master(spark).filter("value = 4").withColumn("defect", F.lit(4).cast("short"))
    out = defects.correct_defects(embedding_samples(spark, d), found, defects.square(1, 1), 4)
    return out.select("frame_id", "y", "x", no_nan("value").alias("value"), "outcome")


LINES = defects.LineDefects("rows", 3, 1, 3, 2.0, 2.0, 0.0, 3, 350_000)


@register(
    "linear_defects",
    _near_sql("a.x = b.x AND a.y <> b.y AND abs(a.y - b.y) <= 3", 3, 2.0, 2.0)
    + """, gate AS (SELECT frame_id, y, count(*) FILTER (decision <> 'insufficient_support') AS n, count(*) FILTER (decision = 'hot') AS h, count(*) FILTER (decision = 'cold') AS c FROM dec GROUP BY 1, 2)
SELECT frame_id, y, x, (CASE decision WHEN 'hot' THEN 4 ELSE 8 END)::SMALLINT AS defect FROM dec JOIN gate USING (frame_id, y)
WHERE (decision = 'hot' AND h >= 3 AND h * 1000000 >= n * 350000) OR (decision = 'cold' AND c >= 3 AND c * 1000000 >= n * 350000)""",
)
def linear_defects(spark, d):
    return defects.detect_linear_defects(embedding_samples(spark, d), LINES).select("frame_id", "y", "x", "defect")


# --- frames derived from parts: one row per frame, with planned nulls

CANDIDATE_SQL = "f AS (SELECT p_partkey AS frame_id, 2 + (p_partkey % 23)::DOUBLE / 8 AS fwhm, p_size AS stars, (p_partkey % 17)::DOUBLE / 20 AS eccentricity, p_retailprice AS noise FROM part)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("frame_id"), (2 + (k % 23) / 8).alias("fwhm"), F.col("p_size").alias("stars"), ((k % 17) / 20).alias("eccentricity"), F.col("p_retailprice").alias("noise"))


@register(
    "reference_ranks",
    f"""WITH {CANDIDATE_SQL}, r AS (SELECT frame_id, rank() OVER (ORDER BY fwhm) - 1 AS fwhm_rank, rank() OVER (ORDER BY stars DESC) - 1 AS star_rank, rank() OVER (ORDER BY eccentricity) - 1 AS eccentricity_rank, rank() OVER (ORDER BY noise) - 1 AS noise_rank FROM f)
SELECT *, fwhm_rank + star_rank + eccentricity_rank + noise_rank AS total, greatest(fwhm_rank, star_rank, eccentricity_rank, noise_rank) AS worst FROM r""",
)
def reference_ranks(spark, d):
    names = ("fwhm_rank", "star_rank", "eccentricity_rank", "noise_rank", "total", "worst")
    return registration.reference_ranks(candidates(spark, d)).select("frame_id", *names)


@register("select_reference", ORACLES["reference_ranks"] + " ORDER BY total, worst, fwhm_rank, star_rank, eccentricity_rank, noise_rank, frame_id LIMIT 1")
def select_reference(spark, d):
    names = ("fwhm_rank", "star_rank", "eccentricity_rank", "noise_rank", "total", "worst")
    return registration.select_reference(candidates(spark, d)).select("frame_id", *names)


STARS_SQL = """stars AS (SELECT (c_nationkey % 5)::BIGINT AS frame_id, (c_custkey * 37 % 640)::DOUBLE AS x, (c_custkey * 91 % 480)::DOUBLE AS y, abs(c_acctbal) / 100 AS snr, abs(c_acctbal) * 3 AS flux, abs(c_acctbal) AS peak,
 (c_custkey % 21)::DOUBLE / 20 AS eccentricity, c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0 AS saturated FROM customer)"""


def star_table(spark: SparkSession, d: str) -> DataFrame:
    k, a = F.col("c_custkey"), F.abs("c_acctbal")
    return table(spark, d, "customer").select(
        (F.col("c_nationkey") % 5).cast("long").alias("frame_id"), (k * 37 % 640).cast("double").alias("x"), (k * 91 % 480).cast("double").alias("y"), (a / 100).alias("snr"), (a * 3).alias("flux"), a.alias("peak"),
        ((k % 21) / 20).alias("eccentricity"), ((F.col("c_mktsegment") == "BUILDING") & (k % 3 == 0)).alias("saturated"),
    )


FEATURES = registration.FeatureSelection(10.0, 0.9, 12.0, 40)
FEATURES_SQL = f"""WITH {STARS_SQL}, a AS (SELECT *, CASE WHEN saturated THEN 'saturated' WHEN snr < 10 THEN 'low_snr' WHEN eccentricity > 0.9::DOUBLE THEN 'eccentric' WHEN x < 12 OR y < 12 OR x > 627 OR y > 467 THEN 'border' END AS why FROM stars)
, b AS (SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (PARTITION BY frame_id, why IS NULL ORDER BY snr DESC, flux DESC, peak DESC, eccentricity, y, x) - 1 END AS k FROM a)
, feat AS (SELECT frame_id, x, y, snr, CASE WHEN k >= 40 THEN 'limit' ELSE why END AS excluded, CASE WHEN k < 40 THEN k END AS rank FROM b)"""


@register("feature_catalog", FEATURES_SQL + " SELECT frame_id, x, y, snr, excluded, rank FROM feat")
def feature_catalog(spark, d):
    return registration.feature_catalog(star_table(spark, d), 640, 480, FEATURES).select("frame_id", "x", "y", "snr", "excluded", F.col("rank").cast("long").alias("rank"))


def features(spark: SparkSession, d: str) -> DataFrame:
    return registration.feature_catalog(star_table(spark, d), 640, 480, FEATURES).filter("rank IS NOT NULL").select("frame_id", F.col("rank").cast("long").alias("rank"), "x", "y")


TRIANGLES = registration.Triangles(20, 5, 4.0, 0.005, 8000)
TRIANGLES_SQL = FEATURES_SQL + """, p AS (SELECT frame_id, rank, x, y FROM feat WHERE rank IS NOT NULL)
, near AS (SELECT a.frame_id, a.rank AS a, b.rank AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.rank <> b.rank WHERE a.rank < 20)
, knn AS (SELECT *, row_number() OVER (PARTITION BY frame_id, a ORDER BY d, b) AS n FROM near)
, tri AS (SELECT q.frame_id, q.a, q.n, r.n AS m, list_sort([q.a, q.b, r.b]) AS ids, list_sort([q.d, r.d, sqrt((q.bx - r.bx) ** 2 + (q.by_ - r.by_) ** 2)]) AS e, abs((q.bx - q.ax) * (r.by_ - q.ay) - (q.by_ - q.ay) * (r.bx - q.ax)) AS cr
  FROM knn q JOIN knn r ON q.frame_id = r.frame_id AND q.a = r.a AND q.n < r.n WHERE q.n <= 5 AND r.n <= 5)
, ok AS (SELECT *, row_number() OVER (PARTITION BY frame_id, ids ORDER BY a, n, m) AS k FROM tri WHERE e[3] >= 4 AND cr / (e[3] * e[3]) >= 0.005)
, desc_ AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY a, n, m) - 1 AS triangle, ids, e[1] / e[3] AS sr, e[2] / e[3] AS mr, cr / (e[3] * e[3]) AS ar, e[3] AS ls FROM ok WHERE k = 1)"""


@register("triangle_descriptors", TRIANGLES_SQL + " SELECT frame_id, ids[1] AS i, ids[2] AS j, ids[3] AS k, round(sr, 8) AS short_ratio, round(mr, 8) AS middle_ratio, round(ar, 8) AS area, round(ls, 6) AS long_side FROM desc_")
def triangle_descriptors(spark, d):
    t = registration.triangle_descriptors(features(spark, d), TRIANGLES)
    return t.select("frame_id", *[F.col("ids")[k].alias(n) for k, n in enumerate("ijk")], F.round("short_ratio", 8).alias("short_ratio"), F.round("middle_ratio", 8).alias("middle_ratio"), F.round("area", 8).alias("area"), F.round("long_side", 6).alias("long_side"))


@register(
    "triangle_matches",
    TRIANGLES_SQL + """ SELECT s.frame_id AS source_id, r.frame_id AS reference_id, s.ids[1] AS si, s.ids[2] AS sj, s.ids[3] AS sk, r.ids[1] AS ri, r.ids[2] AS rj, r.ids[3] AS rk FROM desc_ s JOIN desc_ r ON s.frame_id <> 0 AND r.frame_id = 0
 WHERE abs(s.sr - r.sr) <= 0.02 AND abs(s.mr - r.mr) <= 0.02 AND abs(s.ar - r.ar) <= 0.02 AND r.ls / s.ls BETWEEN 0.8::DOUBLE AND 1.25::DOUBLE""",
)
def triangle_matches(spark, d):
    """Every other frame against frame 0, the reference."""
    t = registration.triangle_descriptors(features(spark, d), TRIANGLES)
    s, r = t.filter("frame_id <> 0"), t.filter("frame_id = 0")
    m = registration.match_triangles(s, r, registration.Matching(0.02, 0.02, 0.8, 1.25, "allow", 100_000, 1_000_000))
    ids = lambda df, n, f: df.select(F.col("frame_id").alias(f), F.col("triangle").alias(n), *[F.col("ids")[i].alias(f"{n}{c}") for i, c in enumerate("ijk")])
    return m.join(ids(s, "s", "source_id"), ["source_id", "s"]).join(ids(r, "r", "reference_id"), ["reference_id", "r"]).select("source_id", "reference_id", "si", "sj", "sk", "ri", "rj", "rk")


MATCH_SQL = "mt AS (SELECT (p_size % 4)::INT AS pair, (p_partkey * 31 % 500)::DOUBLE AS sx, (p_partkey * 57 % 400)::DOUBLE AS sy, p_partkey FROM part), mm AS (SELECT pair, sx, sy, 0.98 * sx - 0.05 * sy + 12 + (p_partkey % 3 - 1) * 0.1 AS rx, 0.05 * sx + 0.98 * sy - 7 + (p_partkey % 5 - 2) * 0.1 AS ry FROM mt)"


def match_table(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    m = table(spark, d, "part").select((F.col("p_size") % 4).cast("int").alias("pair"), (k * 31 % 500).cast("double").alias("sx"), (k * 57 % 400).cast("double").alias("sy"), "p_partkey")
    rx = 0.98 * F.col("sx") - 0.05 * F.col("sy") + 12 + (k % 3 - 1) * 0.1
    ry = 0.05 * F.col("sx") + 0.98 * F.col("sy") - 7 + (k % 5 - 2) * 0.1
    return m.select("pair", "sx", "sy", rx.alias("rx"), ry.alias("ry"))


FIT_SQL = f"""WITH {MATCH_SQL}, c AS (SELECT pair, avg(sx) mx, avg(sy) my, avg(rx) mu, avg(ry) mv, count(*) n FROM mm GROUP BY 1)
, f AS (SELECT pair, any_value(n) n, sum((sx - mx) * (rx - mu) + (sy - my) * (ry - mv)) / sum((sx - mx) ** 2 + (sy - my) ** 2) AS a, sum((sx - mx) * (ry - mv) - (sy - my) * (rx - mu)) / sum((sx - mx) ** 2 + (sy - my) ** 2) AS g, any_value(mx) mx, any_value(my) my, any_value(mu) mu, any_value(mv) mv FROM mm JOIN c USING (pair) GROUP BY 1)"""


@register("similarity_fit", FIT_SQL + " SELECT pair, n, round(a, 9) AS a, round(g, 9) AS d, round(mu - a * mx + g * my, 6) AS c, round(mv - g * mx - a * my, 6) AS f FROM f")
def similarity_fit(spark, d):
    fit = registration.similarity_sums(match_table(spark, d), ["pair"])
    return fit.select("pair", "n", F.round("a", 9).alias("a"), F.round("d", 9).alias("d"), F.round("c", 6).alias("c"), F.round("f", 6).alias("f"))


@register(
    "residual_statistics",
    FIT_SQL + """, r AS (SELECT pair, sqrt((a * sx - g * sy + mu - a * mx + g * my - rx) ** 2 + (g * sx + a * sy + mv - g * mx - a * my - ry) ** 2) AS r FROM mm JOIN f USING (pair))
SELECT pair, count(*) AS count, round(avg(r), 6) AS mean, round(sqrt(avg(r * r)), 6) AS rms, round(max(r), 6) AS maximum FROM r GROUP BY 1""",
)
def residual_statistics(spark, d):
    m = match_table(spark, d)
    out = registration.residual_statistics(m, registration.similarity_sums(m, ["pair"]).drop("n"), ["pair"])
    return out.select("pair", "count", *[F.round(c, 6).alias(c) for c in ("mean", "rms", "maximum")])


@register("model_selection")
def model_selection(spark, d):
    return registration.choose_model(registration.model_evidence(match_table(spark, d), 500, 400, ["pair"]))


@register("similarity_consensus")
def similarity_consensus(spark, d):
    """All frames moved and turned against frame 0 as it was: for frame 0 the known transform must come out."""
    ref = features(spark, d)
    moved = ref.withColumns({"x": 0.9998 * F.col("x") - 0.02 * F.col("y") + 5, "y": 0.02 * F.col("x") + 0.9998 * F.col("y") - 3})
    ref = ref.filter("frame_id = 0")
    t = registration.Triangles()
    m = registration.match_triangles(registration.triangle_descriptors(moved, t), registration.triangle_descriptors(ref, t))
    found = registration.confidence(registration.similarity_consensus(m, moved, ref), 640, 480)
    return found.select("source_id", "reference_id", *[F.round(c, 6).alias(c) for c in "abcdef"], "pairs", "accepted", F.array_join("rejections", ",").alias("rejections"))


# --- resampling, demosaicing, drizzle

SHIFT = Affine(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


@register("resample_identity", f"{BASE} SELECT frame_id, y, x, CASE WHEN {GOOD} THEN value END AS value, (CASE WHEN {GOOD} THEN 0 ELSE flags | 1 | CASE WHEN flags = 0 THEN 32 ELSE 0 END END)::SMALLINT AS flags FROM e")
def resample_identity(spark, d):
    out = resample.resample(embedding_samples(spark, d), 8, 8, 8, 8, SHIFT)
    return out.select("frame_id", "y", "x", no_nan("value").alias("value"), "flags")


LANCZOS_SQL = "CASE WHEN @ = 0 THEN 1 WHEN abs(@) >= 3 THEN 0 ELSE 3 * sin(pi() * @) * sin(pi() * @ / 3) / (pi() * @ * pi() * @) END"


@register(
    "lanczos_shift",
    f"""{BASE}, g AS (SELECT frame_id, y, x AS sx, value, {GOOD} AS ok FROM e), t AS (SELECT o.x, k.k AS sx, {LANCZOS_SQL.replace('@', '(o.x - 0.25 - k.k)')} AS w FROM range(3, 6) o(x), range(8) k(k) WHERE k.k BETWEEN o.x - 3 AND o.x + 2)
, r AS (SELECT frame_id, y, x, CASE WHEN bool_and(ok) THEN round(sum(w * CASE WHEN ok THEN value ELSE 0 END) / sum(w), 6) END AS value FROM t JOIN g USING (sx) GROUP BY 1, 2, 3)
SELECT e.frame_id, e.y, e.x, r.value FROM e LEFT JOIN r ON r.frame_id = e.frame_id AND r.y = e.y AND r.x = e.x""",
)
def lanczos_shift(spark, d):
    out = resample.resample(embedding_samples(spark, d), 8, 8, 8, 8, Affine(1.0, 0.0, 0.25, 0.0, 1.0, 0.0))
    return out.select("frame_id", "y", "x", no_nan("value", 6).alias("value"))


#: From a position of the output to its place in the source; no place is a whole number.
BENT = ((1.0, 0.02, 0.31), (-0.03, 1.0, 0.17), (0.004, 0.003, 1.0))


@register(
    "lanczos_projective",
    f"""{BASE}, o AS (SELECT y::INT AS y, x::INT AS x, (x + 0.02 * y + 0.31) / (0.004 * x + 0.003 * y + 1) AS u, (-0.03 * x + y + 0.17) / (0.004 * x + 0.003 * y + 1) AS v FROM range(8) a(y), range(8) b(x))
, t AS (SELECT o.y, o.x, k.k::INT AS sx, j.j::INT AS sy, ({LANCZOS_SQL.replace('@', '(u - k.k)')}) * ({LANCZOS_SQL.replace('@', '(v - j.j)')}) AS w FROM o, range(8) k(k), range(8) j(j)
 WHERE k.k BETWEEN floor(u) - 2 AND floor(u) + 3 AND j.j BETWEEN floor(v) - 2 AND floor(v) + 3 AND floor(u) BETWEEN 2 AND 4 AND floor(v) BETWEEN 2 AND 4)
, r AS (SELECT frame_id, t.y, t.x, CASE WHEN bool_and({GOOD}) THEN round(sum(w * CASE WHEN {GOOD} THEN value ELSE 0 END) / sum(w), 6) END AS value FROM t JOIN e ON e.y = sy AND e.x = sx GROUP BY 1, 2, 3)
SELECT e.frame_id, e.y, e.x, r.value FROM e LEFT JOIN r ON r.frame_id = e.frame_id AND r.y = e.y AND r.x = e.x""",
)
def lanczos_projective(spark, d):
    shape = Projective.of(np.linalg.inv(np.array(BENT)))
    out = resample.resample(embedding_samples(spark, d), 8, 8, 8, 8, shape)
    return out.select("frame_id", "y", "x", no_nan("value", 6).alias("value"))


@register(
    "registered_plan",
    f"""{BASE}, g AS (SELECT frame_id, y, x, {GOOD} AS ok, value, flags FROM e), m AS (SELECT frame_id, y, x, frame_id % 3 AS dx FROM e)
SELECT m.frame_id, m.y, m.x, CASE WHEN ok THEN value END AS value, (CASE WHEN g.frame_id IS NULL THEN 1 WHEN ok THEN 0 ELSE flags | 1 | CASE WHEN flags = 0 THEN 32 ELSE 0 END END)::SMALLINT AS flags
FROM m LEFT JOIN g ON g.frame_id = m.frame_id AND g.y = m.y AND g.x = m.x - dx""",
)
def registered_plan(spark, d):
    """A plan that moves each frame by its own whole number of columns, executed in one scan."""
    e = embedding_samples(spark, d)
    ids = [r[0] for r in e.select("frame_id").distinct().collect()]  # a plan has one entry for each frame
    plan = {"width": 8, "height": 8, "frames": [{"frame_id": f, "matrix": [1, 0, f % 3, 0, 1, 0, 0, 0, 1]} for f in ids]}
    return pipelines.execute_registration(e, plan, 8, 8).select("frame_id", "y", "x", no_nan("value").alias("value"), "flags")


@register("common_footprint", "SELECT y::INT AS y, x::INT AS x, ((x >= 2 AND y >= 1)::INT + (x <= 16)::INT)::INT AS covered, x >= 2 AND y >= 1 AND x <= 16 AS common FROM range(12) a(y), range(20) b(x)")
def common_footprint(spark, d):
    return resample.common_footprint(spark, 20, 12, [(20, 12, Affine(1, 0, 2, 0, 1, 1)), (20, 12, Affine(1, 0, -3, 0, 1, 0))])


def _kernel_rows() -> str:
    kinds = {"opp": resample.OPPOSITE_COLOUR, "row": resample.COLOUR_IN_ROW, "grn": resample.GREEN_AT_COLOUR}
    rows = [f"('{n}', {dx}, {dy}, {w}::DOUBLE / {k[0]})" for n, k in kinds.items() for (dx, dy), w in k[1].items()]
    rows += [f"('col', {dy}, {dx}, {w}::DOUBLE / 16)" for (dx, dy), w in resample.COLOUR_IN_ROW[1].items()]
    return ", ".join([*rows, "('own', 0, 0, 1.0)"])


@register(
    "demosaic",
    f"""{BASE}, g AS (SELECT frame_id, y, x, value, {GOOD} AS ok FROM e), o AS (SELECT p::INT AS plane, y::INT AS y, x::INT AS x FROM range(3) c(p), range(8) a(y), range(8) b(x))
, kn(kind, dx, dy, w) AS (VALUES {_kernel_rows()})
, kd AS (SELECT *, CASE WHEN plane = 1 THEN CASE WHEN (y + x) % 2 = 1 THEN 'own' ELSE 'grn' END WHEN y % 2 = plane // 2 AND x % 2 = plane // 2 THEN 'own' WHEN y % 2 = plane // 2 THEN 'row' WHEN x % 2 = plane // 2 THEN 'col' ELSE 'opp' END AS kind FROM o)
, t AS (SELECT plane, y, x, w, 7 - abs(((y + dy) % 14 + 14) % 14 - 7) AS ty, 7 - abs(((x + dx) % 14 + 14) % 14 - 7) AS tx FROM kd JOIN kn USING (kind))
SELECT frame_id, plane, t.y, t.x, CASE WHEN bool_and(ok) THEN round(sum(w * CASE WHEN ok THEN value ELSE 0 END), 6) END AS value FROM t JOIN g ON g.y = ty AND g.x = tx GROUP BY 1, 2, 3, 4""",
)
def demosaic(spark, d):
    return resample.demosaic(embedding_samples(spark, d), "RGGB").select("frame_id", "plane", "y", "x", no_nan("value", 6).alias("value"))


DRIZZLE = drizzle.Drizzle(1.0, 0.5, 8, 8)


def moved_frames(samples: DataFrame) -> DataFrame:
    """One transform for each frame, as a plan has, in a table: nothing is collected."""
    shape = Affine(1, 0, 0.4, 0, 1, 0).homography()
    return samples.select("frame_id").distinct().withColumn("matrix", F.array(*[F.lit(v) for row in shape.rows for v in row]))


@register(
    "drizzle_shift",
    f"""{BASE}, g AS (SELECT stack_id, y, x, value FROM e WHERE {GOOD}), t AS (SELECT stack_id, o.y, o.x, value,
 greatest(0, least(g.x + 0.4 + 0.25, o.x + 0.5) - greatest(g.x + 0.4 - 0.25, o.x - 0.5)) * greatest(0, least(g.y + 0.25, o.y + 0.5) - greatest(g.y - 0.25, o.y - 0.5)) / 0.25 AS w
 FROM g JOIN (SELECT y, x FROM range(8) a(y), range(8) b(x)) o ON abs(o.x - g.x) <= 1 AND o.y = g.y)
SELECT stack_id, y::INT AS y, x::INT AS x, round(sum(value * w) / sum(w), 6) AS value, round(sum(w), 6) AS weight FROM t WHERE w > 1e-9 GROUP BY 1, 2, 3""",
)
def drizzle_shift(spark, d):
    e = embedding_samples(spark, d)
    out = drizzle.finish(drizzle.accumulate(drizzle.scatter(e, moved_frames(e), DRIZZLE)), DRIZZLE)
    return out.filter("contributions > 0").select("stack_id", "y", "x", F.round("value", 6).alias("value"), F.round("weight", 6).alias("weight"))


@register(
    "drizzle_mosaic",
    f"""{BASE}, g AS (SELECT stack_id, CASE WHEN (y + x) % 2 = 1 THEN 1 ELSE 2 * (y % 2) END AS plane, y, x, value FROM e WHERE {GOOD}), t AS (SELECT stack_id, plane, o.y, o.x, value,
 greatest(0, least(g.x + 0.4 + 0.25, o.x + 0.5) - greatest(g.x + 0.4 - 0.25, o.x - 0.5)) * greatest(0, least(g.y + 0.25, o.y + 0.5) - greatest(g.y - 0.25, o.y - 0.5)) / 0.25 AS w
 FROM g JOIN (SELECT y, x FROM range(8) a(y), range(8) b(x)) o ON abs(o.x - g.x) <= 1 AND o.y = g.y)
SELECT stack_id, plane::INT AS plane, y::INT AS y, x::INT AS x, round(sum(value * w) / sum(w), 6) AS value, round(sum(w), 6) AS weight FROM t WHERE w > 1e-9 GROUP BY 1, 2, 3, 4""",
)
def drizzle_mosaic(spark, d):
    """Each colour of a mosaic drizzled to its own plane."""
    e = embedding_samples(spark, d)
    out = pipelines.drizzle_output(e, moved_frames(e), DRIZZLE, "RGGB")
    return out.filter("contributions > 0").select("stack_id", "plane", "y", "x", F.round("value", 6).alias("value"), F.round("weight", 6).alias("weight"))


# --- local normalisation

GRID = localnorm.Grid(4, 4, 100)
PAIR_SQL = f"""{BASE}, ref AS (SELECT y, x, value AS reference, flags AS rf FROM e WHERE frame_id = 0), pr AS (SELECT e.frame_id, e.y, e.x, value AS source, reference, (e.y // 4)::INT AS row_, (e.x // 4)::INT AS col_,
 CASE WHEN flags <> 0 THEN 'source_masked' WHEN rf <> 0 THEN 'reference_masked' WHEN NOT (isfinite(value) AND isfinite(reference)) THEN 'non_finite' END AS why FROM e JOIN ref USING (y, x))
, gd AS (SELECT * FROM pr WHERE why IS NULL)
, sl AS (SELECT a.frame_id, a.row_, a.col_, median((b.reference - a.reference) / (b.source - a.source)) AS scale, count(*) AS slopes FROM gd a JOIN gd b ON a.frame_id = b.frame_id AND a.row_ = b.row_ AND a.col_ = b.col_ AND (a.y, a.x) < (b.y, b.x) AND a.source <> b.source GROUP BY 1, 2, 3)
, ic AS (SELECT frame_id, row_, col_, any_value(scale) AS scale, any_value(slopes) AS slopes, median(reference - scale * source) AS off, count(*) AS samples FROM gd JOIN sl USING (frame_id, row_, col_) GROUP BY 1, 2, 3)"""


def reference_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = embedding_samples(spark, d).withColumn("stack_id", F.lit(0))
    return localnorm.pair_frames(e, e.filter("frame_id = 0"))


@register("cell_evidence", PAIR_SQL + " SELECT frame_id, row_ AS row, col_ AS column, count(*) FILTER (why IS NULL) AS eligible, 0::BIGINT AS protected, count(*) FILTER (why = 'source_masked') AS source_masked, count(*) FILTER (why = 'reference_masked') AS reference_masked, count(*) FILTER (why = 'non_finite') AS non_finite FROM pr GROUP BY 1, 2, 3")
def cell_evidence(spark, d):
    return localnorm.cell_evidence(reference_pairs(spark, d), GRID).select("frame_id", "row", "column", "eligible", "protected", "source_masked", "reference_masked", "non_finite")


@register("theil_sen_cells", PAIR_SQL + " SELECT frame_id, row_ AS row, col_ AS column, samples, slopes, round(scale, 9) AS scale, round(off, 6) AS \"offset\" FROM ic WHERE abs(scale) >= 1e-6")
def theil_sen_cells(spark, d):
    fit = localnorm.theil_sen(localnorm.sample_grid(reference_pairs(spark, d), GRID)).filter("failure IS NULL")
    return fit.select("frame_id", "row", "column", "samples", "slopes", F.round("scale", 9).alias("scale"), F.round("offset", 6).alias("offset"))


@register(
    "local_surface",
    PAIR_SQL + """, ct AS (SELECT frame_id, col_ * 4 + 1.5 AS cx, row_ * 4 + 1.5 AS cy, scale, off FROM ic WHERE abs(scale) >= 1e-6)
, w AS (SELECT e.frame_id, e.y, e.x, scale, off, 1 / ((e.x - cx) ** 2 + (e.y - cy) ** 2) AS w FROM e JOIN ct ON e.frame_id = ct.frame_id WHERE (e.x - cx) ** 2 + (e.y - cy) ** 2 <= 400)
SELECT frame_id, y, x, round(sum(w * scale) / sum(w), 6) AS scale, round(sum(w * off) / sum(w), 4) AS "offset", count(*) AS neighbours FROM w GROUP BY 1, 2, 3""",
)
def local_surface(spark, d):
    e = embedding_samples(spark, d).withColumn("stack_id", F.lit(0))
    fit = localnorm.theil_sen(localnorm.sample_grid(reference_pairs(spark, d), GRID))
    found = localnorm.evaluate_surface(e.select(*localnorm.KEYS, "y", "x"), localnorm.control_points(fit, GRID, 8, 8), localnorm.Surface(4, 1, 20.0), GRID)
    return found.select("frame_id", "y", "x", F.round("scale", 6).alias("scale"), F.round("offset", 4).alias("offset"), "neighbours")


@register(
    "protection_mask",
    f"""WITH {STARS_SQL}, dk AS (SELECT frame_id, x AS cx, y AS cy, least(greatest(eccentricity * 2 * CASE WHEN saturated THEN 2 ELSE 1 END, 1.5), 4) AS r FROM stars), off AS (SELECT a.d AS dy, b.d AS dx FROM range(-4, 5) a(d), range(-4, 5) b(d))
SELECT frame_id, (cy + dy)::INT AS y, (cx + dx)::INT AS x, count(*) AS overlaps FROM dk, off WHERE dx * dx + dy * dy <= r * r AND cy + dy BETWEEN 0 AND 479 AND cx + dx BETWEEN 0 AND 639 GROUP BY 1, 2, 3""",
)
def protection_mask(spark, d):
    stars = star_table(spark, d).withColumns({"stack_id": F.lit(0), "plane": F.lit(0), "fwhm_major": F.col("eccentricity")})
    return localnorm.protection_mask(stars, 640, 480, localnorm.Protection(2.0, 1.5, 4.0, 2.0)).select("frame_id", "y", "x", "overlaps")


# --- planning and review

FRAME_SQL = """fr AS (SELECT c_custkey AS k, 'g' || c_custkey AS group_id, ['BIAS','DARK','FLAT','LIGHT'][(c_custkey % 4 + 1)::INT] AS frame_type, 'cam' || (c_nationkey % 3) AS camera, 100 + c_nationkey % 2 AS width, 80 AS height, 1 AS x_binning, 1 AS y_binning,
 (c_custkey % 3)::DOUBLE * 30 AS exposure, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE -10 + (c_custkey % 9)::DOUBLE / 4 END AS sensor_temperature, -10 + (c_custkey % 3)::DOUBLE / 2 AS set_temperature, (c_custkey % 5)::DOUBLE * 20 AS gain, 10::DOUBLE AS "offset",
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'RGGB' END AS bayer, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'L' || (c_custkey % 2) END AS filter FROM customer)"""


def frame_groups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("g"), k.cast("string")).alias("group_id"), F.element_at(F.array(*[F.lit(n) for n in manifest.FRAME_TYPES]), (k % 4 + 1).cast("int")).alias("frame_type"), F.concat(F.lit("cam"), (F.col("c_nationkey") % 3).cast("string")).alias("camera"),
        (100 + F.col("c_nationkey") % 2).alias("width"), F.lit(80).alias("height"), F.lit(1).alias("x_binning"), F.lit(1).alias("y_binning"), ((k % 3) * 30).cast("double").alias("exposure"),
        F.when(k % 7 != 0, -10 + (k % 9) / 4).alias("sensor_temperature"), (-10 + (k % 3) / 2).alias("set_temperature"), ((k % 5) * 20).cast("double").alias("gain"), F.lit(10.0).alias("offset"),
        F.when(k % 3 != 0, "RGGB").alias("bayer"), F.when(k % 6 != 0, F.concat(F.lit("L"), (k % 2).cast("string"))).alias("filter"),
    )


JOINED_SQL = FRAME_SQL + """, jn AS (SELECT t.group_id AS tg, m.group_id AS mg, m.frame_type AS mt, t.frame_type AS tt, abs(t.exposure - m.exposure) AS de, CASE WHEN t.sensor_temperature IS NOT NULL THEN abs(t.sensor_temperature - m.sensor_temperature) ELSE abs(t.set_temperature - m.set_temperature) END AS dt,
 t.gain = m.gain AND t."offset" = m."offset" AND t.bayer IS NOT DISTINCT FROM m.bayer AS same, t.exposure = m.exposure AS sx, t.filter IS NOT DISTINCT FROM m.filter AS sf
 FROM fr t JOIN fr m USING (camera, width, height, x_binning, y_binning))"""


@register(
    "associate_pedestals",
    f"""WITH {JOINED_SQL}, ok AS (SELECT * FROM jn WHERE tt = 'FLAT' AND same AND dt <= 1 AND (mt = 'BIAS' OR (mt = 'DARK' AND de <= 30)))
, dk AS (SELECT tg, min(mg) AS best, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY tg ORDER BY de, dt) AS r FROM ok WHERE mt = 'DARK') WHERE r = 1 GROUP BY 1)
, bi AS (SELECT tg, min(mg) AS best, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY tg ORDER BY dt) AS r FROM ok WHERE mt = 'BIAS') WHERE r = 1 GROUP BY 1)
, st AS (SELECT group_id AS flat_id, CASE WHEN dk.n = 1 THEN 'matched_dark' WHEN dk.n > 1 THEN 'ambiguous_dark' WHEN bi.n = 1 THEN 'bias' WHEN bi.n > 1 THEN 'ambiguous_bias' ELSE 'none' END AS status, dk.best AS db, bi.best AS bb FROM fr LEFT JOIN dk ON dk.tg = group_id LEFT JOIN bi ON bi.tg = group_id WHERE frame_type = 'FLAT')
SELECT flat_id, status, CASE status WHEN 'matched_dark' THEN db WHEN 'bias' THEN bb END AS master_id FROM st""",
)
def associate_pedestals(spark, d):
    g = frame_groups(spark, d)
    return association.associate_pedestals(g.filter("frame_type = 'FLAT'"), g.filter("frame_type IN ('BIAS', 'DARK')"), association.Tolerances(30.0, 1.0))


@register(
    "associate_lights",
    f"""WITH {JOINED_SQL}, ok AS (SELECT * FROM jn WHERE tt = 'LIGHT' AND same AND ((mt = 'DARK' AND sx AND dt <= 1) OR (mt = 'FLAT' AND sf)))
, dk AS (SELECT tg, min(mg) AS best, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY tg ORDER BY dt) AS r FROM ok WHERE mt = 'DARK') WHERE r = 1 GROUP BY 1)
, fl AS (SELECT tg, min(mg) AS best, count(*) AS n FROM ok WHERE mt = 'FLAT' GROUP BY 1)
, st AS (SELECT group_id AS light_id, CASE WHEN dk.n IS NULL THEN 'none' WHEN dk.n = 1 THEN 'matched' ELSE 'ambiguous' END AS dark_status, CASE WHEN dk.n = 1 THEN dk.best END AS dark_id, CASE WHEN fl.n IS NULL THEN 'none' WHEN fl.n = 1 THEN 'matched' ELSE 'ambiguous' END AS flat_status, CASE WHEN fl.n = 1 THEN fl.best END AS flat_id
 FROM fr LEFT JOIN dk ON dk.tg = group_id LEFT JOIN fl ON fl.tg = group_id WHERE frame_type = 'LIGHT')
SELECT *, dark_status = 'matched' AND flat_status = 'matched' AS ready FROM st""",
)
def associate_lights(spark, d):
    g = frame_groups(spark, d)
    return association.associate_lights(g.filter("frame_type = 'LIGHT'"), g.filter("frame_type IN ('DARK', 'FLAT')"), association.Tolerances(0.0, 1.0))


@register(
    "group_manifest",
    """WITH p AS (SELECT s_suppkey AS k, ['BIAS','DARK','FLAT','LIGHT'][(s_suppkey % 4 + 1)::INT] AS t, s_nationkey % 3 AS cam FROM supplier), f AS (SELECT *, (k % 2)::DOUBLE * 60 AS exposure, CASE WHEN k % 5 <> 0 THEN -10 + (k % 3)::DOUBLE END AS temp FROM p)
, c AS (SELECT *, k % 10 <> 0 AND (k % 11 <> 0 OR t = 'DARK') AND (temp IS NOT NULL OR t = 'DARK') AS ok FROM f)
SELECT t AS frame_type, 'cam' || cam AS camera, exposure, count(*) AS files, min(temp) AS temperature_minimum, median(temp) AS temperature_median, max(temp) AS temperature_maximum FROM c WHERE ok GROUP BY t, cam, exposure, CASE WHEN t <> 'DARK' THEN temp END""",
)
def group_manifest(spark, d):
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(n) for n in manifest.FRAME_TYPES]), (k % 4 + 1).cast("int"))
    frames = table(spark, d, "supplier").select(
        F.concat(F.when(k % 11 == 0, "/data/darks/").otherwise("/data/session/"), k.cast("string"), F.lit(".fits")).alias("path"), F.concat(F.lit("cam"), (F.col("s_nationkey") % 3).cast("string")).alias("camera"), kind.alias("frame_type"),
        F.when(k % 10 != 0, "RGGB").alias("bayer"), F.lit("L").alias("filter"), ((k % 2) * 60).cast("double").alias("exposure"), F.when(k % 5 != 0, (-10 + k % 3).cast("double")).alias("sensor_temperature"), F.lit(-10.0).alias("set_temperature"),
        F.lit(100.0).alias("gain"), F.lit(10.0).alias("offset"), F.lit(1).alias("x_binning"), F.lit(1).alias("y_binning"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.array().cast("array<string>").alias("issues"),
    )
    return manifest.group_manifest(frames)["groups"].select("frame_type", "camera", "exposure", "files", "temperature_minimum", "temperature_median", "temperature_maximum")


METRIC_SQL = "fr AS (SELECT s_suppkey AS frame_id, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS snr, CASE WHEN s_suppkey % 9 <> 0 THEN 2 + (s_suppkey % 13)::DOUBLE / 4 END AS fwhm FROM supplier)"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("frame_id"), F.when(k % 6 != 0, F.col("s_acctbal")).alias("snr"), F.when(k % 9 != 0, 2 + (k % 13) / 4).alias("fwhm"))


@register("review_sort", f"WITH {METRIC_SQL} SELECT frame_id, row_number() OVER (ORDER BY snr DESC NULLS FIRST, frame_id) - 1 AS position FROM fr")
def review_sort(spark, d):
    return review.sorted_frames(metrics(spark, d), "snr", descending=True, missing_first=True).select("frame_id", "position")


@register(
    "frame_selection",
    f"""WITH {METRIC_SQL}, o AS (SELECT frame_id, CASE WHEN snr IS NULL THEN 'missing_retain' WHEN snr < 1000 THEN 'failed' ELSE 'passed' END AS a, CASE WHEN fwhm IS NULL THEN 'missing_reject' WHEN fwhm > 4.5 THEN 'failed' ELSE 'passed' END AS b FROM fr)
SELECT frame_id, a || ',' || b AS outcomes, a = 'failed' OR b IN ('failed', 'missing_reject') AS rejected FROM o""",
)
def frame_selection(spark, d):
    rules = [review.Rule("snr", "minimum", 1000.0), review.Rule("fwhm", "maximum", 4.5, "reject")]
    return review.evaluate_rules(metrics(spark, d), rules).select("frame_id", F.array_join("outcomes", ",").alias("outcomes"), "rejected")


# --- previews

BLOCK_SQL = f", bl AS (SELECT stack_id, frame_id, (y // 2)::INT AS y, (x // 2)::INT AS x, avg(value) FILTER ({GOOD}) AS value, count(*) FILTER ({GOOD}) AS valid, count(*) FILTER (NOT ({GOOD})) AS excluded, bit_or(flags)::SMALLINT AS flags FROM e GROUP BY 1, 2, 3, 4)"


@register("block_preview", BASE + BLOCK_SQL + " SELECT frame_id, y, x, round(value, 6) AS value, valid, excluded, flags FROM bl")
def block_preview(spark, d):
    return preview.block_preview(embedding_samples(spark, d), 1).select("frame_id", "y", "x", F.round("value", 6).alias("value"), "valid", "excluded", "flags")


@register("bitmask_preview", f"{BASE}, b AS (SELECT frame_id, (y // 4)::INT AS y, (x // 4)::INT AS x, abs(value) % 16 AS v, {GOOD} AS ok FROM e) SELECT frame_id, y, x, bit_or(CASE WHEN ok AND (v::INT & ~13) = 0 THEN v::BIGINT END) AS value, count(*) FILTER (ok AND (v::INT & ~13) = 0) AS valid FROM (SELECT *, CASE WHEN isfinite(v) THEN v ELSE 0 END AS v2 FROM b) GROUP BY 1, 2, 3".replace("(v::INT", "(v2::INT").replace("v::BIGINT", "v2::BIGINT"))
def bitmask_preview(spark, d):
    e = embedding_samples(spark, d).withColumn("value", F.abs("value") % 16)
    return preview.bitmask_preview(e, 2, 13).select("frame_id", "y", "x", "value", "valid")


STRETCH_SQL = f""", mid AS (SELECT frame_id, median(value) AS med, count(*) AS n, list_sort(list(value))[(floor((count(*) - 1) * 0.9995::DOUBLE) + 1)::INT] AS hq FROM e WHERE {GOOD} GROUP BY 1)
, dev AS (SELECT frame_id, any_value(med) AS med, any_value(hq) AS hq, median(abs(value - med)) * 1.4826::DOUBLE AS mad FROM e JOIN mid USING (frame_id) WHERE {GOOD} GROUP BY 1)
, bw AS (SELECT *, CASE WHEN mad > 0 THEN med - 2.8::DOUBLE * mad ELSE med - greatest(abs(med), 1) * 1e-6 END AS black FROM dev)
, st AS (SELECT *, CASE WHEN hq <= black OR hq <= med THEN med + greatest(abs(med), 1) * 1e-6 ELSE hq END AS white FROM bw)
, nb AS (SELECT *, least(greatest((med - black) / (white - black), 1e-6), 1 - 1e-6) AS bg FROM st)"""


@register("auto_stretch", BASE + STRETCH_SQL + " SELECT frame_id, round(black, 6) AS black, white, round(bg * 0.75 / (bg + 0.25 - 0.5 * bg), 9) AS midtone FROM nb")
def auto_stretch(spark, d):
    e = embedding_samples(spark, d).withColumn("value", F.when(F.col("flags") == 0, no_nan("value")))
    out = preview.display_transform(e)
    return out.select("frame_id", F.round("black", 6).alias("black"), "white", F.round("midtone", 9).alias("midtone"))


@register(
    "rejection_histogram",
    SOURCE_SQL + ", h AS (SELECT stack_id, y, x, count(*) FILTER (disposition IN ('rejected_low', 'rejected_high')) AS rejected FROM k GROUP BY 1, 2, 3) SELECT stack_id, rejected, count(*) AS positions FROM h GROUP BY 1, 2",
)
def rejection_histogram(spark, d):
    return preview.rejection_histogram(I.integrate_clipped(embedding_samples(spark, d), ONE_PASS))


@register("inspect_position", SOURCE_SQL + " SELECT 'science' AS product, round(avg(value) FILTER (disposition = 'accepted'), 6) AS value FROM k WHERE stack_id = 3 AND y = 2 AND x = 5 UNION ALL SELECT 'support', count(*) FILTER (disposition = 'accepted')::DOUBLE FROM k WHERE stack_id = 3 AND y = 2 AND x = 5")
def inspect_position(spark, d):
    science = I.integrate_clipped(embedding_samples(spark, d), ONE_PASS)
    return preview.inspect_position({"science": science, "support": I.support_map(science)}, 3, 0, 2, 5).select("product", F.round("value", 6).alias("value"))


# --- files and metadata

@register("fits_round_trip", f"{BASE} SELECT frame_id, y, x, CASE WHEN flags & 1 = 0 AND isfinite(value) THEN value END AS value, (CASE WHEN flags & 1 = 0 AND isfinite(value) THEN 0 ELSE 32 END)::SMALLINT AS flags FROM e")
def fits_round_trip(spark, d):
    """Every frame encoded as a file and decoded again."""
    out = fits.decode_images(fits.encode_images(embedding_samples(spark, d), {"CREATOR": "stackwise"}))
    return out.select("frame_id", "y", "x", no_nan("value").alias("value"), "flags")


@register("frame_identity", "SELECT s_suppkey AS frame_id, sha256('frame-v1' || chr(31) || length('/a/' || s_name) || chr(31) || '/a/' || s_name || chr(31) || (s_suppkey * 100) || chr(31) || sha256(s_name)) AS identity FROM supplier")
def frame_identity(spark, d):
    path = F.concat(F.lit("/a/"), F.col("s_name"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame_id"), manifest.frame_identity(path, F.col("s_suppkey") * 100, F.sha2("s_name", 256)).alias("identity"))


CARD_SQL = """hd AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'ATR585C' WHEN 1 THEN 'zwo asi294mc pro' WHEN 2 THEN 'atr585c(USB3)' WHEN 3 THEN ' ZWO ASI294MC Pro ' ELSE 'Other cam' END AS cam,
 CASE c_custkey % 4 WHEN 0 THEN 'LIGHT' WHEN 1 THEN 'dark' WHEN 2 THEN 'Flat ' ELSE 'Snapshot' END AS typ, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 7)::VARCHAR END AS e1, CASE WHEN c_custkey % 2 > 0 THEN (c_custkey % 5)::VARCHAR END AS e2, CASE WHEN c_custkey % 11 = 0 THEN 'bad' ELSE '100' END AS gain FROM customer)"""


def header_cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(v) for v in names]), (k % n + 1).cast("int"))
    card = lambda keyword, value: F.struct(F.lit(keyword).alias("keyword"), F.lit("string").alias("kind"), value.alias("value"), F.lit("").alias("raw"))
    cards = [
        card("INSTRUME", pick(5, "ATR585C", "zwo asi294mc pro", "atr585c(USB3)", " ZWO ASI294MC Pro ", "Other cam")), card("IMAGETYP", pick(4, "LIGHT", "dark", "Flat ", "Snapshot")),
        card("EXPTIME", F.when(k % 3 > 0, (k % 7).cast("string"))), card("EXPOSURE", F.when(k % 2 > 0, (k % 5).cast("string"))), card("GAIN", F.when(k % 11 == 0, "bad").otherwise("100")),
    ]
    name = F.concat(F.when(k % 6 == 0, "/x/DARKS20ms/").otherwise("/x/night/"), pick(3, "LIGHT_", "MASTERDARK-", "frame "), k.cast("string"), F.lit(".fits"))
    return table(spark, d, "customer").select(k.alias("k"), name.alias("path"), F.array(*cards).alias("cards"))


@register(
    "normalize_headers",
    f"""WITH {CARD_SQL} SELECT k, CASE WHEN upper(trim(cam)) = 'ZWO ASI294MC PRO' THEN 'ZWO ASI294MC Pro' WHEN upper(trim(cam)) LIKE 'ATR585C%' THEN 'ToupTek ATR585C' ELSE trim(cam) END AS camera, CASE WHEN typ = 'Snapshot' THEN typ ELSE upper(trim(typ)) END AS frame_type,
 coalesce(e1, e2)::DOUBLE AS exposure, CASE WHEN gain = '100' THEN 100::DOUBLE END AS gain, concat_ws(',', CASE WHEN e1 <> e2 THEN 'exposure:conflicting_values' END, CASE WHEN gain = 'bad' THEN 'gain:invalid_value' END) AS issues FROM hd""",
)
def normalize_headers(spark, d):
    headers = header_cards(spark, d)
    out = manifest.normalize_headers(headers).join(headers.select("path", "k"), "path")
    return out.select("k", "camera", "frame_type", "exposure", "gain", F.array_join("issues", ",").alias("issues"))


@register(
    "classify_frames",
    f"""WITH {CARD_SQL}, ev AS (SELECT k, CASE WHEN typ <> 'Snapshot' THEN upper(trim(typ)) END AS h, CASE WHEN k % 6 = 0 THEN 'DARK' END AS dir, CASE k % 3 WHEN 0 THEN 'LIGHT' WHEN 1 THEN 'DARK' END AS f FROM hd)
SELECT k, h AS header_type, dir AS directory_type, f AS filename_type, coalesce(h <> dir, false) OR coalesce(h <> f, false) OR coalesce(dir <> f, false) AS conflict,
 CASE WHEN NOT (coalesce(h <> dir, false) OR coalesce(h <> f, false) OR coalesce(dir <> f, false)) THEN coalesce(h, dir, f) END AS resolved FROM ev""",
)
def classify_frames(spark, d):
    headers = header_cards(spark, d)
    out = manifest.resolve_type(manifest.classify(manifest.normalize_headers(headers))).join(headers.select("path", "k"), "path")
    return out.select("k", "header_type", "directory_type", "filename_type", "conflict", "resolved")


@register(
    "correct_linear_defects",
    f"""{BASE}, g AS (SELECT * FROM e WHERE {GOOD} AND y <> 4), n AS (SELECT a.frame_id, a.y, a.x, median(b.value) AS med, count(b.value) AS n FROM e a JOIN g b ON a.frame_id = b.frame_id AND a.x = b.x AND a.y <> b.y AND abs(a.y - b.y) <= 3 WHERE a.y = 4 GROUP BY 1, 2, 3)
SELECT e.frame_id, e.y, e.x, CASE WHEN (flags & ~12) <> 0 THEN 'blocked' WHEN coalesce(n, 0) >= 4 THEN 'corrected' ELSE 'unsupported' END AS outcome, CASE WHEN (flags & ~12) <> 0 THEN CASE WHEN isnan(value) THEN NULL ELSE value END WHEN coalesce(n, 0) >= 4 THEN med END AS value
FROM e LEFT JOIN n ON n.frame_id = e.frame_id AND n.y = e.y AND n.x = e.x WHERE e.y = 4
UNION ALL SELECT frame_id, y, x, 'kept' AS outcome, CASE WHEN NOT isnan(value) THEN value END AS value FROM e WHERE y <> 4""",
)
def correct_linear_defects(spark, d):
    row = _grid(spark).filter("y = 4").withColumn("defect", F.lit(4).cast("short"))
    out = defects.correct_linear_defects(embedding_samples(spark, d), row, LINES, 4)
    return out.select("frame_id", "y", "x", "outcome", no_nan("value").alias("value"))


@register(
    "local_normalization",
    PAIR_SQL + """, ct AS (SELECT frame_id, col_ * 4 + 1.5 AS cx, row_ * 4 + 1.5 AS cy, scale, off FROM ic WHERE abs(scale) >= 1e-6)
, w AS (SELECT e.frame_id, e.y, e.x, scale, off, 1 / ((e.x - cx) ** 2 + (e.y - cy) ** 2) AS w FROM e JOIN ct ON e.frame_id = ct.frame_id WHERE (e.x - cx) ** 2 + (e.y - cy) ** 2 <= 400)
, cf AS (SELECT frame_id, y, x, sum(w * scale) / sum(w) AS scale, sum(w * off) / sum(w) AS off FROM w GROUP BY 1, 2, 3)
SELECT e.frame_id, e.y, e.x, CASE WHEN isfinite(value) THEN round(CASE WHEN scale IS NOT NULL THEN scale * value + off ELSE value END, 3) END AS value, (CASE WHEN scale IS NULL THEN flags | 1 ELSE flags END)::SMALLINT AS flags FROM e LEFT JOIN cf ON cf.frame_id = e.frame_id AND cf.y = e.y AND cf.x = e.x""",
)
def local_normalization(spark, d):
    e = embedding_samples(spark, d).withColumn("stack_id", F.lit(0))
    out = localnorm.normalize(e, e.filter("frame_id = 0"), 8, 8, GRID, localnorm.Surface(4, 1, 20.0))
    return out.select("frame_id", "y", "x", no_nan("value", 3).alias("value"), "flags")


@register(
    "render_grayscale",
    BASE + STRETCH_SQL + f""", tr AS (SELECT frame_id, black, white, bg * 0.75 / (bg + 0.25 - 0.5 * bg) AS m FROM nb), nv AS (SELECT e.frame_id, y, x, m, CASE WHEN {GOOD} THEN (value - black) / (white - black) END AS v FROM e JOIN tr USING (frame_id))
SELECT frame_id, y, x, CASE WHEN v IS NULL THEN 0 ELSE floor(least(greatest(CASE WHEN v <= 0 OR v >= 1 THEN v ELSE (m - 1) * v / ((2 * m - 1) * v - m) END, 0), 1) * 255 + 0.5)::INT END AS g, CASE WHEN v IS NULL THEN 0 ELSE 255 END AS a FROM nv""",
)
def render_grayscale(spark, d):
    e = embedding_samples(spark, d).withColumn("value", F.when(F.col("flags") == 0, no_nan("value")))
    return preview.render_grayscale(e, preview.display_transform(e)).select("frame_id", "y", "x", "g", "a")


@register(
    "render_rgb",
    f"""{BASE}, w AS (SELECT stack_id, y, x, max(CASE WHEN frame_id % 3 = 0 AND {GOOD} THEN value END) AS c0, max(CASE WHEN frame_id % 3 = 1 AND {GOOD} THEN value END) AS c1, max(CASE WHEN frame_id % 3 = 2 AND {GOOD} THEN value END) AS c2 FROM e GROUP BY 1, 2, 3)
, v AS (SELECT *, c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL AS ok FROM w), u AS (SELECT stack_id, y, x, ok, p, ([c0, c1, c2][p] + 2000) / 4000 AS v FROM v, range(1, 4) r(p))
, l AS (SELECT *, CASE WHEN ok THEN floor(least(greatest(CASE WHEN v <= 0 OR v >= 1 THEN v ELSE (0.3::DOUBLE - 1) * v / ((2 * 0.3::DOUBLE - 1) * v - 0.3::DOUBLE) END, 0), 1) * 255 + 0.5)::INT ELSE 0 END AS s FROM u)
SELECT stack_id, y, x, max(s) FILTER (p = 1) AS r, max(s) FILTER (p = 2) AS g, max(s) FILTER (p = 3) AS b, CASE WHEN any_value(ok) THEN 255 ELSE 0 END AS a FROM l GROUP BY 1, 2, 3""",
)
def render_rgb(spark, d):
    """The largest usable values of every third frame as one colour each."""
    e = embedding_samples(spark, d).withColumn("value", F.when(F.col("flags") == 0, no_nan("value"))).withColumn("plane", (F.col("frame_id") % 3).cast("int"))
    out = preview.render_rgb(e.withColumn("frame_id", F.lit(0).cast("long")), -2000.0, 2000.0, 0.3)
    return out.select("stack_id", "y", "x", "r", "g", "b", "a")


@register(
    "render_defects",
    f"""{BASE}, b AS (SELECT frame_id, y, x, ((y * 8 + x + frame_id) % 4 * 4)::INT AS k FROM e)
SELECT frame_id, y, x, [0, 255, 64, 255][k // 4 + 1] AS r, [0, 64, 128, 64][k // 4 + 1] AS g, [0, 64, 255, 255][k // 4 + 1] AS b, CASE WHEN k = 0 THEN 0 ELSE 255 END AS a FROM b""",
)
def render_defects(spark, d):
    e = embedding_samples(spark, d).withColumn("value", ((F.col("y") * 8 + F.col("x") + F.col("frame_id")) % 4 * 4).cast("int"))
    return preview.render_defects(e).select("frame_id", "y", "x", "r", "g", "b", "a")


@register(
    "file_checksums",
    """WITH b AS (SELECT c_custkey, rpad(hex(c_name), (ceil(length(hex(c_name)) / 8) * 8)::INT, '0') AS h FROM customer)
, w AS (SELECT c_custkey, ('0x' || substr(h, (1 + 8 * i)::INT, 8))::BIGINT AS v FROM b, range(64) r(i) WHERE 8 * i < length(h)), s AS (SELECT c_custkey, sum(v)::BIGINT AS v FROM w GROUP BY 1)
SELECT c_custkey, ((v & 4294967295) + (v >> 32))::BIGINT AS total FROM s""",
)
def file_checksums(spark, d):
    """The sum of the ones' complement over the bytes of each name."""
    return fits.checksums(table(spark, d, "customer").select("c_custkey", F.encode("c_name", "utf-8").alias("content")), "c_custkey").withColumnRenamed("checksum", "total")


@register("file_verification", f"{BASE} SELECT DISTINCT frame_id, 'valid' AS datasum, 'valid' AS checksum FROM e")
def file_verification(spark, d):
    """Every frame as a file whose checksums are verified."""
    files = fits.encode_images(embedding_samples(spark, d))
    return fits.verified(files.select("frame_id", "content"), "frame_id")


@register(
    "compensated_sums",
    "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1",
)
def compensated_sums(spark, d):
    """Huge values that cancel are put around the balances: only a compensated sum gives the balances back."""
    values = F.concat(F.array(F.lit(1e17)), F.sort_array(F.collect_list("c_acctbal")), F.array(F.lit(-1e17)))
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(values.alias("v")).select("c_mktsegment", F.round(neumaier_sum(F.col("v")), 2).alias("total"))


@register("star_measure")
def star_measure(spark, d):
    """Stars of the vector frames, with the smallest aperture."""
    p = quality.StarMeasurement(quality.Background(3.0, 4, 20), 1.0, 0.2, 1, 1, 3)
    return quality.measure_stars(embedding_samples(spark, d), p).select("frame_id", *[F.round(c, 6).alias(c) for c in ("y", "x", "flux", "snr", "eccentricity")])


# --- extension

@register(
    "windowed_event_mean",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def windowed_event_mean(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return running.windowed_mean(events).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


