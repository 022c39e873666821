"""Sources, spatial operators and plans: round trips, analytic images and brute force."""

import math

import numpy as np
import pytest
from helpers import DATA

from stackwise.functions import geometry as G
from stackwise.operators import defects, drizzle, localnorm, quality, registration, resample, review
from stackwise.plans import digests, pipelines
from stackwise.schema import INVALID, MISSING, SAMPLES, ParameterError
from stackwise.sources import fits, manifest


def frame(spark, image, frame_id=0, flags=None):
    image = np.asarray(image, float)
    flags = np.zeros(image.shape, int) if flags is None else flags
    return spark.createDataFrame([(0, frame_id, 0, y, x, float(image[y, x]), int(flags[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])], SAMPLES)


def image(df):
    out = {}
    for r in df.collect():
        out[r["y"], r["x"]] = r["value"]
    h, w = max(k[0] for k in out) + 1, max(k[1] for k in out) + 1
    return np.array([[out.get((y, x), np.nan) for x in range(w)] for y in range(h)])


# --- files

@pytest.mark.parametrize("bitpix", [8, 16, 32, 64, -32, -64])
def test_decode(bitpix):
    stored = np.array([0, 1, 5, 7], fits.DTYPES[bitpix])
    cards = [fits.format_card(k, v) for k, v in {"SIMPLE": True, "BITPIX": bitpix, "NAXIS": 2, "NAXIS1": 2, "NAXIS2": 2, "BZERO": 32768.0, "BSCALE": 2.0, "BLANK": 7}.items()]
    head = "".join([*cards, f"{'END':<80}"]).ljust(2880).encode()
    values, flags = fits.physical(head + stored.tobytes().ljust(2880, b"\0"), fits.layout(fits.parse_header(head)))
    assert values[:3].tolist() == [32768.0, 32770.0, 32778.0]
    assert flags[3] == (MISSING if bitpix > 0 else 0)


def test_round_trip_and_checksums(spark, tmp_path):
    values = np.arange(24.0).reshape(2, 3, 4)
    flags = np.zeros((2, 3, 4), int)
    flags[1, 2, 3] = MISSING
    data = fits.encode_f64(values, flags, {"CREATOR": "tests"})
    assert fits.verify_checksums(data) == {"DATASUM": "valid", "CHECKSUM": "valid"}
    broken = bytearray(data)
    broken[-2000] ^= 1
    assert fits.verify_checksums(bytes(broken))["DATASUM"] == "mismatch" or broken[-2000] == data[-2000]
    paths = fits.publish(spark, {"a.fits": data, "b.fits": data}, str(tmp_path))
    assert len(paths) == 2
    with pytest.raises(ParameterError):
        fits.publish(spark, {"c.fits": data, "a.fits": data}, str(tmp_path))
    assert not (tmp_path / "c.fits").exists()
    got = fits.read_samples(spark, str(tmp_path), band_rows=2)
    assert got.count() == 48
    last = got.filter("plane = 1 AND y = 2 AND x = 3").collect()[0]
    assert math.isnan(last["value"]) and last["flags"] == INVALID
    region = fits.read_samples(spark, str(tmp_path) + "/a.fits", (1, 1, 2, 2)).filter("plane = 0")
    assert sorted(r["value"] for r in region.collect()) == [5.0, 6.0, 9.0, 10.0]
    headers = fits.read_headers(spark, str(tmp_path))
    assert headers.filter("strict").count() == 2
    assert fits.fingerprints(spark, str(tmp_path)).select("sha256").distinct().count() == 1


def test_header_diagnostics():
    assert not fits.parse_header(b"SIMPLE  =                    T").strict
    card = fits.parse_card(f"{'OBJECT':<8}= {chr(39)}it{chr(39)}{chr(39)}s{chr(39)} / comment".ljust(80))
    assert card.value == "it's"
    assert fits.parse_card("EXPTIME =              1.25D+2".ljust(80)).value == 125.0
    assert fits.combine_checksums(0xFFFFFFFF, 1) == 1


def test_alignment_file():
    text = """<xdrz version="1.0" xmlns="x"><ReferenceGeometry width="100" height="50" numberOfChannels="1"/><AlignmentMatrix>1 0 -2 0 1 -3 0 0 1</AlignmentMatrix></xdrz>"""
    got = fits.parse_alignment_xml(text)
    assert got["matrix"].tolist() == [[1, 0, -2], [0, 1, -3], [0, 0, 1]] and got["width"] == 100
    same = fits.compare_alignment(got, G.Affine(1, 0, 2, 0, 1, 3))
    assert same["count"] == 25 and same["maximum"] < 1e-12
    with pytest.raises(ParameterError):
        fits.parse_alignment_xml(text.replace("1 0 -2", "1 0"))


def test_directory_scan(spark, tmp_path):
    cards = {"INSTRUME": "ATR585C", "IMAGETYP": "Dark", "EXPTIME": 30.0, "SET-TEMP": -10.0, "GAIN": 100, "OFFSET": 5, "XBINNING": 1, "YBINNING": 1, "FILTER": "L", "BAYERPAT": "RGGB"}
    for name, extra in (("darks/DARK_1.fits", {}), ("darks/DARK_2.fits", {}), ("darks/DARK_3.fits", {"EXPTIME": 60.0}), ("lights/LIGHT_1.fits", {"IMAGETYP": "Dark"})):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(fits.encode_f64(np.ones((1, 2, 2)), np.zeros((1, 2, 2), int), cards | extra))
    (tmp_path / "bad.fits").write_bytes(b"SIMPLE  = nothing")
    got = manifest.scan_directory(spark, str(tmp_path))
    assert sorted(r["files"] for r in got["groups"].collect()) == [1, 2]
    assert got["unassigned"].count() == 1 and got["failures"].count() == 1
    assert got["files"].select("frame_identity").distinct().count() == 4
    with pytest.raises(ParameterError):
        manifest.scan_directory(spark, str(tmp_path), maximum_files=2)


def test_metadata(spark):
    cards = [("INSTRUME", "zwo asi294mc pro"), ("IMAGETYP", "Light"), ("EXPTIME", "30"), ("EXPOSURE", "31"), ("GAIN", "x"), ("XBINNING", "1"), ("YBINNING", "1"), ("BAYERPAT", "rggb")]
    rows = [("/s/darks100ms/LIGHT_1.fits", [(k, "string", v, "") for k, v in cards])]
    headers = spark.createDataFrame(rows, "path string, cards array<struct<keyword:string,kind:string,value:string,raw:string>>")
    got = manifest.normalize_headers(headers)
    r = got.collect()[0]
    assert (r["camera"], r["frame_type"], r["bayer"], r["exposure"], r["gain"]) == ("ZWO ASI294MC Pro", "LIGHT", "RGGB", 30.0, None)
    assert r["issues"] == ["exposure:conflicting_values", "gain:invalid_value"]
    kind = manifest.classify(got).collect()[0]
    assert (kind["header_type"], kind["directory_type"], kind["filename_type"], kind["conflict"]) == ("LIGHT", "DARK", "LIGHT", True)
    resolved = {p: manifest.resolve_type(manifest.classify(got), p).collect()[0]["resolved"] for p in ("require_agreement", "prefer_header", "prefer_directory", "prefer_filename")}
    assert resolved == {"require_agreement": None, "prefer_header": "LIGHT", "prefer_directory": "DARK", "prefer_filename": "LIGHT"}


# --- geometry and registration

def test_transforms():
    a = G.Affine(0.9, -0.1, 5, 0.1, 0.9, -3)
    x, y = a.then(a.inverse()).apply(3.0, 4.0)
    assert (x, y) == (pytest.approx(3), pytest.approx(4))
    h = G.Projective.of(np.array([[1, 0.1, 3], [0, 1.1, -2], [1e-4, 0, 1]]))
    assert h.then(h.inverse()).apply(7.0, 9.0) == (pytest.approx(7), pytest.approx(9))
    lifted = G.lift_affine(G.Affine(1, 0, 3, 0, 1, 0))
    assert lifted.apply(0.5, 0.5) == (pytest.approx(6.5), pytest.approx(0.5))


def test_fits_recover_their_transform():
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 500, (40, 2))
    a = G.Affine(0.98, -0.05, 12, 0.05, 0.98, -7)
    q = np.stack(a.apply(p[:, 0], p[:, 1]), axis=1)
    assert np.allclose(G.fit_similarity(p, q).matrix, a.matrix, atol=1e-9)
    mirror = np.stack([-p[:, 0] + 3, p[:, 1]], axis=1)
    assert G.residuals(G.fit_similarity(p, mirror, reflected=True), p, mirror).max() < 1e-9
    h = G.Projective.of(np.array([[1, 0.02, 3], [0.01, 1.02, -2], [1e-5, 2e-5, 1]]))
    q = np.stack(h.apply(p[:, 0], p[:, 1]), axis=1)
    fit, ratio = G.fit_projective(p, q)
    assert G.residuals(fit, p, q).max() < 1e-6 and ratio > 1e-10
    assert registration.compare_models(p, q, 500, 500)["projective_better_folds"] == 5


def test_homography_of_many_matches():
    """In parts and in memory proportional to the matches: the left vectors of 40,000 would take 51 GB."""
    import tracemalloc

    rng = np.random.default_rng(2)
    p = rng.uniform(0, 500, (40_000, 2))
    h = G.Projective.of(np.array([[1, 0.02, 3], [0.01, 1.02, -2], [1e-5, 2e-5, 1]]))
    q = np.stack(h.apply(p[:, 0], p[:, 1]), axis=1) + rng.normal(0, 0.1, p.shape)
    tracemalloc.start()
    fit, _ = G.fit_projective(p, q)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert np.abs(fit.matrix - h.matrix).max() < 0.05
    few, ratio = G.fit_projective(p[:4], q[:4])
    assert G.residuals(few, p[:4], q[:4]).max() < 1e-6 and ratio > 1e-10


def test_parts_of_a_design_make_one_fit(monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 500, (50, 2))
    q = p * 1.01 + rng.normal(0, 0.2, p.shape)
    whole, ratio = G.fit_projective(p, q)
    monkeypatch.setattr(G, "DESIGN_ROWS", 7)
    parts, other = G.fit_projective(p, q)
    assert np.allclose(whole.matrix, parts.matrix, rtol=1e-9, atol=1e-9) and np.isclose(ratio, other)


def test_stars_and_quality(spark):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[0:64, 0:64]
    sky = rng.normal(100, 1.0, (64, 64))
    for cy, cx, top in ((20, 20, 300), (40, 45, 200)):
        sky += top * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * 2.0**2))
    stars = quality.measure_stars(frame(spark, sky), quality.StarMeasurement(quality.Background(3.0, 8, 50), radius=7))
    got = stars.orderBy("peak", ascending=False).toPandas()
    assert len(got) == 2
    assert got["x"][0] == pytest.approx(20, abs=0.1) and got["y"][1] == pytest.approx(40, abs=0.1)
    assert got["fwhm_major"][0] == pytest.approx(4.71, abs=0.5) and got["eccentricity"].max() < 0.4


def test_one_to_one_pairs():
    import pandas as pd

    pairs = pd.DataFrame({"support": [3, 2, 2], "residual": [0.1, 0.2, 0.1], "source_rank": [0, 0, 1], "reference_rank": [0, 1, 0]})
    assert registration.one_to_one(pairs)["source_rank"].tolist() == [0]


# --- resampling, demosaicing, drizzle

def test_resample_whole_shift(spark):
    src = np.arange(144.0).reshape(12, 12)
    out = image(resample.resample(frame(spark, src), 12, 12, 12, 12, G.Affine(1, 0, 2, 0, 1, 1)))
    assert np.array_equal(out[1:, 2:], src[:-1, :-2]) and np.isnan(out[0]).all()


def test_resample_keeps_a_constant_and_linear_fields(spark):
    y, x = np.mgrid[0:16, 0:16]
    out = image(resample.resample(frame(spark, 5.0 + 0 * x), 16, 16, 16, 16, G.Affine(1, 0, 0.3, 0, 1, 0.6)))
    assert np.nanmax(np.abs(out - 5)) < 1e-12 and np.isfinite(out[6, 6])


@pytest.mark.parametrize("transform", [G.Affine(0.99, -0.07, 2.3, 0.07, 0.99, -1.2), G.Affine(1, 0, -40, 0, 1, 0), G.Projective.of(np.array([[1, 0.02, 1], [0.01, 1.02, -2], [1e-4, 2e-4, 1]]))])
def test_bands_equal_taps(spark, transform):
    rng = np.random.default_rng(8)
    src, flags = rng.normal(10, 3, (24, 20)), np.zeros((24, 20), int)
    flags[5, 5], src[9, 12] = 2, np.nan
    samples = frame(spark, src, flags=flags)
    want = {(r["y"], r["x"]): r for r in resample.resample_by_taps(samples, 20, 24, 22, 26, transform).collect()}
    for band_rows in (4, 26):
        got = {(r["y"], r["x"]): r for r in resample.resample(samples, 20, 24, 22, 26, transform, band_rows).collect()}
        assert set(got) == set(want) and len(got) == 22 * 26
        for k, r in want.items():
            assert got[k]["flags"] == r["flags"]
            assert got[k]["value"] == pytest.approx(r["value"], rel=1e-9, nan_ok=True)


@pytest.mark.parametrize("pattern", ["RGGB", "BGGR", "GRBG", "GBRG"])
def test_demosaic_constant(spark, pattern):
    out = resample.demosaic(frame(spark, np.full((6, 4), 42.5)), pattern)
    assert out.count() == 72 and out.filter("abs(value - 42.5) > 1e-12").count() == 0


def test_footprint_rectangle(spark):
    found = resample.common_footprint(spark, 20, 12, [(20, 12, G.Affine(1, 0, 2, 0, 1, 1)), (20, 12, G.Affine(1, 0, -3, 0, 1, 0))])
    assert resample.largest_rectangle(found) == (1, 2, 15, 11)


def _mosaic_by_hand(cells, h, w, pattern):
    """Three planes of each position that is there, tap by tap; ``cells``: {(y, x): [(value, flags), ...]}."""
    taps, out = resample.kernel_taps(pattern), {}
    turn = lambda c, n: 0 if n == 1 else (n - 1) - abs(c % (2 * (n - 1)) - (n - 1))
    for (y, x), copies in cells.items():
        for channel in range(3):
            top, bad, seen, lost = 0.0, False, 0, False
            for dx, dy, weight in taps[(y & 1) * 2 + (x & 1), channel]:
                met = cells.get((turn(y + dy, h), turn(x + dx, w)), [])
                bad |= not met
                for value, flags in met:
                    nan = flags == 0 and not np.isfinite(value)
                    bad, seen, lost = bad or flags != 0 or nan, seen | flags, lost or nan
                    top += weight * value
            out[channel, y, x] = (None, seen | 1 | (32 if lost else 0)) if bad else (round(top * len(copies), 9), 0)
    return out


@pytest.mark.parametrize(("h", "w"), [(37, 35), (1, 1), (1, 18), (2, 17), (16, 16)])
def test_demosaic_over_tiles(spark, h, w):
    """Edges of tiles and frames, gaps, repeated positions, flags and values that aren't finite; two frames at once."""
    rng = np.random.default_rng(h * 100 + w)
    frames, sent = {}, []
    for f in (3, 1 << 40):
        cells = {}
        for y in range(h):
            for x in range(w):
                kind = rng.integers(0, 300) if h * w > 300 else 99
                if kind == 0 and (y, x) != (h - 1, w - 1):
                    continue
                value = float(rng.integers(-500, 500))
                cells[y, x] = [(float("nan") if kind == 1 else value, 2 if kind == 2 else 12 if kind == 3 else 0)] * (2 if kind == 4 else 1)
        frames[f] = _mosaic_by_hand(cells, h, w, "GRBG")
        sent += [(7, f, 0, y, x, v, g) for (y, x), copies in cells.items() for v, g in copies]
    rng.shuffle(sent)
    samples = spark.createDataFrame([(int(a), int(b), int(c), int(d), int(e), float(v), int(g)) for a, b, c, d, e, v, g in sent], SAMPLES)
    got = {}
    for r in resample.demosaic(samples, "GRBG").collect():
        assert (r["frame_id"], r["plane"], r["y"], r["x"]) not in got and r["stack_id"] == 7
        got[r["frame_id"], r["plane"], r["y"], r["x"]] = (None if np.isnan(r["value"]) else round(r["value"], 9), r["flags"])
    assert got == {(f, *k): v for f, cells in frames.items() for k, v in cells.items()}


def test_demosaic_shuffles_samples_once(spark):
    """No exchange but the one of the samples: each sample had gone out once for every tap that reads it."""
    out = resample.demosaic(frame(spark, np.full((6, 4), 42.5)), "RGGB")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert resample.demosaic(frame(spark, np.full((6, 4), 42.5)).filter("y < 0"), "RGGB").count() == 0


def test_drizzle_joins_the_transforms(spark, monkeypatch):
    """Frames with transforms and weights of their own, as dicts and as tables, without a broadcast of all of them to the workers."""
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("no worker needs all transforms"))
    p = drizzle.Drizzle(1.5, 0.6, 12, 12)
    shapes = {f: G.Projective.of(np.array([[1, 0.01 * f, 0.3 * f], [0.02, 1, 0.4], [1e-4 * f, 0, 1]])) for f in range(3)}
    src = np.arange(30.0).reshape(5, 6)
    samples = frame(spark, src).unionByName(frame(spark, src + 100, 1)).unionByName(frame(spark, src * 2, 2))
    weights = {0: 0.5, 2: 3.0}
    want = {}
    for f, image_ in ((0, src), (1, src + 100), (2, src * 2)):
        y, x = (a.ravel().astype(float) for a in np.mgrid[0:5, 0:6])
        own, oy, ox, part = drizzle.deposits(drizzle.corners(x, y, np.tile(shapes[f].matrix.ravel(), (30, 1)), p), p)
        for k, v in zip(zip(oy.tolist(), ox.tolist(), strict=True), np.stack([image_.ravel()[own] * part, part], axis=1) * weights.get(f, 1.0), strict=True):
            want[k] = want.get(k, 0) + v
    tables = drizzle.frame_table(spark, shapes), spark.createDataFrame(list(weights.items()), "frame_id long, weight double")
    for t, w in ((shapes, weights), tables, (shapes, tables[1])):
        got = {(r["y"], r["x"]): (r["flux"], r["weight"]) for r in drizzle.accumulate(drizzle.scatter(samples, t, p, weights=w)).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    with pytest.raises(Exception, match="no transform for frame 2"):
        drizzle.scatter(samples, tables[0].filter("frame_id < 2"), p).collect()


def test_drizzle_conserves_flux(spark):
    src = np.random.default_rng(2).uniform(1, 9, (6, 6))
    p = drizzle.Drizzle(2.0, 0.7, 30, 30)
    h = G.Projective.of(np.array([[0.98, -0.1, 4], [0.1, 0.98, 3], [0, 0, 1]]))
    sums = drizzle.accumulate(drizzle.scatter(frame(spark, src), {0: h}, p))
    assert sums.agg({"flux": "sum"}).first()[0] == pytest.approx(src.sum(), rel=1e-9)
    out = drizzle.finish(sums, p)
    assert out.count() == 900 and out.filter("contributions = 0 AND flags <> 1").count() == 0


# --- defects, review, plans

def test_hot_spot_is_found_and_mended(spark):
    src = np.random.default_rng(7).normal(10, 1, (9, 9))
    src[4, 4] = 500
    samples = frame(spark, src)
    found = defects.detect_local_defects(samples, defects.LocalDefects(2, 1, 6, 8.0, 8.0))
    assert [(r["y"], r["x"], r["defect"]) for r in found.collect()] == [(4, 4, 4)]
    fixed = defects.correct_defects(samples, found)
    assert abs(fixed.filter("y = 4 AND x = 4").first()["value"] - 10) < 3


def test_box_sums_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = {(int(a), int(b)) for a, b in rng.integers(0, 20, (60, 2))}
    df = spark.createDataFrame([(0, 0, 0, a, b) for a, b in pts], "stack_id int, frame_id long, plane int, y int, x int")
    got = {(r["y"], r["x"]): r["near"] for r in defects.box_sums(df, 2).collect()}
    assert got == {(a, b): sum(abs(a - c) <= 2 and abs(b - d) <= 2 for c, d in pts) for a, b in pts}


def test_review_book():
    book = review.ReviewBook()
    book.apply(book.preview({1: "rejected", 2: "accepted"}))
    stale = book.preview({1: "accepted"})
    book.apply(book.preview({2: "rejected"}))
    with pytest.raises(ParameterError):
        book.apply(stale)
    assert book.undo() == {2: "accepted"} and book.decisions == {1: "rejected", 2: "accepted"}
    book.seal()
    with pytest.raises(ParameterError):
        book.undo()


def test_digests_and_store(spark, tmp_path):
    assert digests.digest("a", {"x": 1.0}) != digests.digest("b", {"x": 1.0})
    assert digests.digest("a", {"x": -0.0, "y": 2}) == digests.digest("a", {"y": 2, "x": 0.0})
    store = digests.ArtifactStore(spark, str(tmp_path))
    key, df = digests.digest("a", 1), spark.range(5)
    assert store.lookup(key) is None and store.publish(key, df) and not store.publish(key, df)
    with pytest.raises(ParameterError):
        store.publish(key, spark.range(6))
    assert store.lookup(key).count() == 5
    assert not store.remove_if(key, (4, "0")) and store.remove_if(key, store.fingerprint(df)) and store.lookup(key) is None
    identity = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    plan = digests.registration_plan(1, 8, 8, [{"frame_id": 2, "matrix": identity}, {"frame_id": 1, "matrix": identity}])
    assert [f["frame_id"] for f in plan["frames"]] == [1, 2]
    with pytest.raises(ParameterError):
        digests.registration_plan(3, 8, 8, plan["frames"])


def test_pipelines(spark):
    lights = frame(spark, np.full((4, 4), 30.0)).unionByName(frame(spark, np.full((4, 4), 50.0), 1))
    dark, flat = frame(spark, np.full((4, 4), 10.0)), frame(spark, np.full((4, 4), 2.0))
    out = pipelines.stack_calibrated(lights, dark, flat, 0.1)
    assert {r["value"] for r in out.collect()} == {15.0}
    products = pipelines.registered_stack(lights, "median", crop=(0, 0, 2, 2))
    assert products["science"].count() == 4 and products["support"].first()["value"] == 2.0
    assert pipelines.band_plan(10, 100, 350) == [(0, 3), (3, 3), (6, 3), (9, 1)]
    assert pipelines.verify_same(out, out)
    flats = pipelines.build_master(lights, "flat", dark)
    assert {r["value"] for r in flats.collect()} == {1.0}
    plan = {"width": 4, "height": 4, "frames": [{"frame_id": k, "matrix": [1, 0, 0, 0, 1, 0, 0, 0, 1]} for k in (0, 1)]}
    assert pipelines.execute_registration(lights, plan, 4, 4).count() == 32
    assert pipelines.estimate_defects(100, 100)["scatter_bytes"] > 0


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from stackwise.streaming import running

    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 2.0), (2, "2024-01-01 00:20:00", "a", 4.0), (3, "2024-01-02 00:00:00", "b", 1.0)], "user_id long, ts string, event_type string, value double")
    events = events.withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = running.event_stream(spark, str(tmp_path / "in"), events.schema)
    running.run_to_table(running.windowed_mean(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["event_type"], r["n"], r["mean"]) for r in got] == [("a", 2, 3.0)]


def test_background_in_groups_and_in_joins(spark, monkeypatch):
    from stackwise.sources.adapters import embedding_samples

    samples = embedding_samples(spark, DATA)
    parameters = quality.Background(1.5, 6, 5)
    names = sorted(quality.estimate_background(samples, parameters).columns)
    grouped = sorted(map(str, quality.estimate_background(samples, parameters).select(*names).collect()))
    monkeypatch.setattr(quality, "GROUPED_SAMPLES", 0)
    assert sorted(map(str, quality.estimate_background(samples, parameters).select(*names).collect())) == grouped


def test_frames_of_a_plan_resample_together(spark):
    rng = np.random.default_rng(2)
    both = [rng.normal(10, 1, (24, 24)) for _ in range(2)]
    samples = frame(spark, both[0]).unionByName(frame(spark, both[1], 1)).unionByName(frame(spark, both[0], 2))
    shapes = {0: G.Affine(1, 0, 1.5, 0, 1, -0.25), 1: G.Affine(0.9, 0.1, 0.0, -0.1, 0.9, 2.0)}
    got = {(r["frame_id"], r["y"], r["x"]): (str(r["value"]), r["flags"]) for r in resample.resample(samples, 24, 24, 20, 22, shapes, band_rows=7).collect()}
    want = {}
    for f, shape in shapes.items():
        one = resample.resample(samples.filter(f"frame_id = {f}"), 24, 24, 20, 22, shape).collect()
        want |= {(f, r["y"], r["x"]): (str(r["value"]), r["flags"]) for r in one}
    assert got == want and len(got) == 2 * 20 * 22


def test_large_cells_theil_sen(spark):
    """The fit of a cell against all pairs by hand."""
    rng = np.random.default_rng(3)
    s = rng.normal(100, 10, 60)
    r = 1.7 * s - 4 + rng.normal(0, 0.5, 60)
    rows = [(0, 0, 0, 0, 0, int(k) // 8, int(k) % 8, float(s[k]), float(r[k])) for k in range(60)] + [(0, 1, 0, 0, 0, 0, k, 5.0, float(k)) for k in range(4)] + [(0, 2, 0, 0, 0, 0, 0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "stack_id int, frame_id long, plane int, `row` int, `column` int, y int, x int, source double, reference double")
    got = {x["frame_id"]: x for x in localnorm.theil_sen(df).collect()}
    i, j = np.triu_indices(60, 1)
    scale = np.median((r[j] - r[i]) / (s[j] - s[i]))
    offset = np.median(r - scale * s)
    assert got[0]["scale"] == pytest.approx(scale, rel=1e-12) and got[0]["offset"] == pytest.approx(offset, rel=1e-12)
    assert got[0]["residual"] == pytest.approx(np.median(np.abs(r - (scale * s + offset))), rel=1e-9) and got[0]["slopes"] == 60 * 59 // 2
    assert got[1]["failure"] == "degenerate_source" and got[1]["scale"] is None and got[2]["failure"] == "too_few_samples"


def test_typed_comparisons(spark):
    df = spark.createDataFrame([(0, 5, 1.0), (1, 9, 2.0), (2, None, None)], "frame_id long, usable_stars long, noise double")
    ids = lambda c: [r[0] for r in df.filter(c).select("frame_id").collect()]
    assert ids(review.comparison_passes("usable_stars", "less", 9)) == [0] and ids(review.comparison_passes("usable_stars", "greater", 5)) == [1]
    assert ids(review.comparison_passes("noise", "less", 2.0)) == [0] and ids(review.comparison_passes("noise", "greater", 1.5)) == [1]
    for metric, threshold in (("usable_stars", 5.0), ("usable_stars", -1), ("noise", 1), ("noise", float("inf")), ("noise", float("nan"))):
        assert ids(review.comparison_passes(metric, "less", threshold)) == []


def test_steps_wrap_and_bounce():
    s = review.FrameStepper((7, 8, 9))
    assert s.request_step(-1) == 9
    with pytest.raises(ParameterError):
        s.request_step(1)
    with pytest.raises(ParameterError):
        s.commit(8)
    s.commit(9)
    assert s.request_step(1) == 7
    b, seen = review.FrameStepper((1, 2, 3), "bounce", playing=True), []
    for _ in range(6):
        seen.append(b.request_playback_step())
        b.commit(seen[-1])
    assert seen == [2, 3, 2, 1, 2, 3]
    with pytest.raises(ParameterError):
        review.FrameStepper((1,)).request_step(1)


def test_memory_budget():
    budget = pipelines.MemoryBudget(100)
    with budget.try_reserve(60):
        with pytest.raises(ParameterError), budget.try_reserve(50):
            pass
        with budget.try_reserve(40):
            assert budget.available == 0
    assert budget.used == 0 and budget.peak == 100


def test_bounded_reads_of_files(spark, tmp_path):
    """The data source against whole-file reads: all samples, a pushed-down region, and no partitions outside of it."""
    from stackwise.sources import fits_source

    rng = np.random.default_rng(5)
    for k in range(2):
        values = rng.normal(0, 1, (2, 30, 17))
        (tmp_path / f"{k}.fits").write_bytes(fits.encode_f64(values, np.zeros(values.shape, int)))
    (tmp_path / "notes.txt").write_text("no image")
    fits_source.register(spark)
    source = spark.read.format("fits").option("band_samples", 17 * 8).load(str(tmp_path))
    key = lambda r: (r["path"].removeprefix("file:"), r["plane"], r["y"], r["x"], r["value"], r["flags"])
    whole = sorted(map(key, fits.read_samples(spark, str(tmp_path)).collect()))
    assert sorted(map(key, source.collect())) == whole and len(whole) == 2 * 2 * 30 * 17
    region = source.filter("plane = 1 AND y >= 5 AND y < 9 AND x BETWEEN 3 AND 6")
    assert sorted(map(key, region.collect())) == [r for r in whole if r[1] == 1 and 5 <= r[2] < 9 and 3 <= r[3] <= 6]
    assert region.rdd.getNumPartitions() == 2 and source.filter("y > 40").count() == 0
