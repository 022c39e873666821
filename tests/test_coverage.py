"""Functions that no registered query covers, against values worked out by hand or by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_images import frame

from stackwise.functions import geometry as G
from stackwise.operators import defects, drizzle, localnorm, preview, resample
from stackwise.operators.integrate import GeneralizedEsd, integrate_clipped
from stackwise.plans import association, pipelines
from stackwise.schema import ParameterError
from stackwise.streaming import running


@pytest.mark.parametrize("shape", [G.Affine(1.02, 0.05, -3.3, -0.04, 0.98, 2.2), G.Projective.of(np.array([[1, 0.02, 1.5], [0.01, 1, -2.5], [1e-4, 2e-4, 1]]))])
def test_source_windows_hold_all_taps(shape):
    y, x = np.mgrid[5:9, 0:40].astype(float)
    u, v = shape.inverse().apply(x, y)
    top, left, bottom, right = resample.source_window(40, 30, shape, 5, 4)
    assert top <= np.floor(v).min() - 2 and bottom >= np.floor(v).max() + 3 and left <= np.floor(u).min() - 2 and right >= np.floor(u).max() + 3
    p = drizzle.Drizzle(1.0, 0.7, 40, 30)
    near = drizzle.source_window(shape if isinstance(shape, G.Projective) else shape.homography(), p, 5, 4)
    assert near[0] <= v.min() and near[2] >= v.max() and near[1] <= u.min() and near[3] >= u.max()


def test_reduction_levels():
    assert preview.reduction_level(100, 80, 100, 80) == 0 and preview.reduction_level(4144, 2822, 1036, 1036) == 2
    assert preview.reduction_level(101, 1, 50, 1) == 2 and preview.reduction_level(1, 1, 1, 1) == 0
    with pytest.raises(ParameterError):
        preview.reduction_level(0, 1, 1, 1)


def test_coordinate_priorities(spark):
    def by_hand(y, x):
        mask = (1 << 64) - 1
        v = (x ^ (((y << 32) | (y >> 32)) & mask) ^ 0x9E3779B97F4A7C15) & mask
        v = ((v ^ (v >> 30)) * 0xBF58476D1CE4E5B9) & mask
        v = ((v ^ (v >> 27)) * 0x94D049BB133111EB) & mask
        return v ^ (v >> 31)

    spots = [(0, 0), (1, 0), (0, 1), (123, 4567), (4143, 2821)]
    got = spark.createDataFrame(spots, "y long, x long").select("y", "x", localnorm.coordinate_priority("y", "x").alias("p")).collect()
    assert {(r["y"], r["x"]): r["p"] + (1 << 63) for r in got} == {s: by_hand(*s) for s in spots}


def test_false_colours(spark):
    image = frame(spark, [[0.0, 10.0, 5.0, 100.0, -3.0]])
    shades = spark.createDataFrame([(0, 0, 0, 0.0, 10.0)], "stack_id int, frame_id long, plane int, black double, white double")
    got = {r["x"]: (r["r"], r["g"], r["b"], r["a"]) for r in preview.render_false_color(image, shades).collect()}
    assert got[0] == (0, 0, 0, 0)  # no signal is transparent
    assert got[1] == got[3] == (*preview.PALETTE[-1], 255) and got[2] == (*preview.PALETTE[2], 255) and got[4] == (*preview.PALETTE[0], 255)


def test_large_scale_without_seeds_changes_nothing(spark):
    rng, stack = np.random.default_rng(0), None
    for k in range(18):
        one = frame(spark, rng.normal(10, 1, (3, 3)) + (40 if k == 4 else 0) * (np.arange(9).reshape(3, 3) == 4), k)
        stack = one if stack is None else stack.unionByName(one)
    esd = GeneralizedEsd()
    want = {(r["y"], r["x"]): (r["value"], r["accepted"], r["high_rejected"]) for r in integrate_clipped(stack, esd).collect()}
    got = {(r["y"], r["x"]): (r["value"], r["accepted"], r["high_rejected"]) for r in pipelines.stack_with_large_scale(stack, esd, None, None).collect()}
    assert got == want and want[1, 1][2] >= 1
    # A lone reject is no detection: with a radius of one, three rejects must lie together.
    assert {k: v for k, v in got.items()} == {
        (r["y"], r["x"]): (r["value"], r["accepted"], r["high_rejected"]) for r in pipelines.stack_with_large_scale(stack, esd, None, defects.LargeScale(1, 1)).collect()
    }


def test_sessions_close_by_a_gap(spark):
    events = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:20:00", 2.0), (1, "2024-01-01 01:00:00", 4.0), (2, "2024-01-01 00:10:00", 8.0)]
    df = spark.createDataFrame(events, "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r["user_id"], str(r["session_start"]), r["n"], r["total"]) for r in running.sessions(df).collect())
    assert got == [(1, "2024-01-01 00:00:00", 2, 3.0), (1, "2024-01-01 01:00:00", 1, 4.0), (2, "2024-01-01 00:10:00", 1, 8.0)]


def test_jobs_of_a_group_are_counted(spark):
    with pipelines.cancellable(spark, "counted"):
        spark.range(100).repartition(3).count()
    done = pipelines.progress(spark, "counted")
    assert done["total"] >= 3 and done["completed"] <= done["total"]
    pipelines.cancel(spark, "counted")


def test_weights_must_cover_all_frames(spark):
    from stackwise.operators.integrate import integrate_weighted_mean

    both = frame(spark, [[1.0, 2.0]]).unionByName(frame(spark, [[3.0, 6.0]], 1))
    weights = spark.createDataFrame([(0, 1.0), (1, 3.0)], "frame_id long, weight double")
    assert [r["value"] for r in integrate_weighted_mean(both, weights).orderBy("x").collect()] == [2.5, 5.0]
    with pytest.raises(Exception, match="no weight for frame 1"):
        integrate_weighted_mean(both, weights.filter("frame_id = 0")).collect()


def test_drizzle_names_a_frame_without_transform(spark):
    samples = frame(spark, [[1.0]], 5)
    with pytest.raises(Exception, match="no transform for frame 5"):
        drizzle.scatter(samples, {4: G.Affine().homography()}, drizzle.Drizzle(1.0, 0.5, 2, 2)).collect()


def _groups(spark, n, kinds):
    """Many groups with few conditions: temperatures are measured or set, and some are missing."""
    rows = [
        (f"g{k}", kinds[k % len(kinds)], "cam", 100, 80, 1, 1, [1.0, 2.0, None][k % 3], [None, -10.0, -9.5, -8.7, 0.0][k % 5], [-10.0, -9.0, None][k % 7 % 3], 20.0, 10.0, None if k % 2 else "RGGB", "L" if k % 11 else None)
        for k in range(n)
    ]
    return spark.createDataFrame(rows, "group_id string, frame_type string, camera string, width int, height int, x_binning int, y_binning int, exposure double, sensor_temperature double, set_temperature double, gain double, offset double, bayer string, filter string")


def _by_hand(targets, masters, fits, scores):
    """The best and the number of ties for each target, from all pairs."""
    out = {}
    for t in targets:
        kind = "set_temperature" if t["sensor_temperature"] is None else "sensor_temperature"
        found = []
        for m in masters:
            dt = None if t[kind] is None or m[kind] is None else abs(t[kind] - m[kind])
            de = None if t["exposure"] is None or m["exposure"] is None else abs(t["exposure"] - m["exposure"])
            if t["bayer"] == m["bayer"] and fits(t, m, de, dt):
                found.append((scores(de, dt), m["group_id"]))
        least = min(found, default=(None,))[0]
        same = [g for s, g in found if s == least]
        out[t["group_id"]] = (min(same, default=None), len(same))
    return out


@pytest.mark.parametrize("tolerance", [0.0, 1e-9, 0.5, 1.0])
def test_pedestals_against_all_pairs(spark, tolerance):
    g = _groups(spark, 90, ("FLAT", "DARK", "BIAS", "FLAT", "FLAT"))
    flats, darks, biases = (g.filter(f"frame_type = '{k}'") for k in ("FLAT", "DARK", "BIAS"))
    near = lambda t, m, de, dt: dt is not None and dt <= tolerance
    dark = _by_hand(flats.collect(), darks.collect(), lambda t, m, de, dt: near(t, m, de, dt) and de is not None and de <= 1.0, lambda de, dt: (de, dt))
    bias = _by_hand(flats.collect(), biases.collect(), near, lambda de, dt: dt)
    for r in association.associate_pedestals(flats, darks.unionByName(biases), association.Tolerances(1.0, tolerance)).collect():
        (d, nd), (b, nb) = dark[r["flat_id"]], bias[r["flat_id"]]
        want = ("matched_dark", d) if nd == 1 else ("ambiguous_dark", None) if nd else ("bias", b) if nb == 1 else ("ambiguous_bias", None) if nb else ("none", None)
        assert (r["status"], r["master_id"]) == want


def _rows_of_joins(df):
    """The most rows that a join of the plan that ran has put out."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
        elif "QueryStage" in name:
            plan.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        plan += [children.apply(k) for k in range(children.size())]
    return most


def test_pedestals_join_conditions_not_pairs(spark):
    """600 flats and 400 masters of a few conditions: pairs would be tens of thousands."""
    g = _groups(spark, 1000, ("FLAT", "DARK", "BIAS", "FLAT", "FLAT"))
    out = association.associate_pedestals(g.filter("frame_type = 'FLAT'"), g.filter("frame_type <> 'FLAT'"), association.Tolerances(1.0, 1.0))
    assert 0 < _rows_of_joins(out) <= 600


@pytest.mark.parametrize("tolerance", [0.0, 0.5])
def test_lights_against_all_pairs(spark, tolerance):
    g = _groups(spark, 90, ("LIGHT", "DARK", "FLAT", "LIGHT", "LIGHT"))
    lights, darks, flats = (g.filter(f"frame_type = '{k}'") for k in ("LIGHT", "DARK", "FLAT"))
    dark = _by_hand(lights.collect(), darks.collect(), lambda t, m, de, dt: de == 0 and dt is not None and dt <= tolerance, lambda de, dt: dt)
    flat = _by_hand(lights.collect(), flats.collect(), lambda t, m, de, dt: t["filter"] == m["filter"], lambda de, dt: 0)
    for r in association.associate_lights(lights, darks.unionByName(flats), association.Tolerances(0.0, tolerance)).collect():
        for kind, (best, n) in (("dark", dark[r["light_id"]]), ("flat", flat[r["light_id"]])):
            assert (r[f"{kind}_status"], r[f"{kind}_id"]) == (("none", None) if n == 0 else ("matched", best) if n == 1 else ("ambiguous", None))


def test_lights_join_conditions_not_pairs(spark):
    g = _groups(spark, 1000, ("LIGHT", "DARK", "FLAT", "LIGHT", "LIGHT"))
    out = association.associate_lights(g.filter("frame_type = 'LIGHT'"), g.filter("frame_type <> 'LIGHT'"), association.Tolerances(0.0, 1.0))
    assert 0 < _rows_of_joins(out) <= 600
