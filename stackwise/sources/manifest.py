"""Metadata of frames: normalisation, classification, strict grouping and the session manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise.schema import finite, require

from . import fits

# Keywords in order of preference, and closed sets of names.
FRAME_TYPES = ("BIAS", "DARK", "FLAT", "LIGHT")
BAYER = ("RGGB", "BGGR", "GRBG", "GBRG")
KEYWORDS = {
    "camera": ("INSTRUME", "CAMERA"),
    "frame_type": ("IMAGETYP", "FRAME", "FRAMETYP"),
    "exposure": ("EXPTIME", "EXPOSURE"),
    "sensor_temperature": ("CCD-TEMP", "CCD_TEMP", "SENSORT"),
    "set_temperature": ("SET-TEMP", "SET_TEMP"),
    "gain": ("GAIN",),
    "offset": ("OFFSET",),
    "x_binning": ("XBINNING",),
    "y_binning": ("YBINNING",),
    "filter": ("FILTER",),
    "bayer": ("BAYERPAT", "BAYERPATN"),
}
ZWO, TOUPTEK = "ZWO ASI294MC Pro", "ToupTek ATR585C"
NUMBERS = ("exposure", "sensor_temperature", "set_temperature", "gain", "offset", "x_binning", "y_binning")
GROUP_KEY = ("frame_type", "camera", "width", "height", "exposure", "sensor_temperature", "set_temperature", "gain", "offset", "x_binning", "y_binning", "filter", "bayer")
REQUIRED = ("camera", "exposure", "sensor_temperature", "set_temperature", "gain", "offset", "x_binning", "y_binning", "filter", "bayer")


def card_values(cards: Column, keyword: str) -> Column:
    """All values of a keyword, in order."""
    return F.transform(F.filter(cards, lambda c: (c["keyword"] == keyword) & c["value"].isNotNull()), lambda c: c["value"])


def resolve(cards: Column, keywords: tuple[str, ...], numeric: bool) -> Column:
    """``struct(value, source, issue)``: the first keyword wins; disagreement and bad values are issues."""
    found = F.flatten(F.array(*[F.transform(card_values(cards, k), lambda v, k=k: F.struct(F.lit(k).alias("k"), v.alias("v"))) for k in keywords]))
    if numeric:
        number = F.transform(found, lambda s: F.struct(s["k"].alias("k"), s["v"].try_cast("double").alias("v")))
        good = F.filter(number, lambda s: finite(s["v"]))
        first = F.get(good, 0)
        near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
        conflict = F.exists(good, lambda s: ~near(s["v"], first["v"]))
        issue = F.when(F.size(good) < F.size(found), "invalid_value").when(F.coalesce(conflict, F.lit(False)), "conflicting_values")
    else:
        text = F.transform(found, lambda s: F.struct(s["k"].alias("k"), F.trim(s["v"]).alias("v")))
        good = F.filter(text, lambda s: s["v"] != "")
        first = F.get(good, 0)
        issue = F.when(F.coalesce(F.exists(good, lambda s: s["v"] != first["v"]), F.lit(False)), "conflicting_values")
    return F.struct(first["v"].alias("value"), first["k"].alias("source"), issue.alias("issue"))


def normalize_camera(raw: Column) -> Column:
    """``struct(value, confidence, sensor)``: known cameras by name, without case or with a transport suffix."""
    name = F.trim(raw)
    upper = F.upper(name)
    zwo, short = upper == ZWO.upper(), name == "ATR585C"
    touptek = (upper == TOUPTEK.upper()) | upper.rlike(r"^ATR585C\(.*\)$")
    value = F.when(zwo, ZWO).when(short | touptek, TOUPTEK).otherwise(name)
    exact = (name == ZWO) | short
    confidence = F.when(exact, "exact").when(zwo | touptek, "normalized").when(name.isNotNull(), "exact")
    sensor = F.when(zwo | short | touptek, "color").when(name.isNotNull(), "unknown")
    return F.struct(value.alias("value"), confidence.alias("confidence"), sensor.alias("sensor"))


def normalize_closed(raw: Column, names: tuple[str, ...]) -> Column:
    """``struct(value, confidence)`` for a closed set of upper-case names; anything else stays as it is."""
    name = F.trim(raw)
    upper = F.upper(name)
    known = upper.isin(*names)
    confidence = F.when(known & (name != upper), "normalized").when(name.isNotNull(), "exact")
    return F.struct(F.when(known, upper).otherwise(name).alias("value"), confidence.alias("confidence"))


def normalize_headers(headers: DataFrame) -> DataFrame:
    """Canonical metadata of each header (path, cards): nothing is ever guessed, a missing value stays null."""
    out = headers
    for name, keywords in KEYWORDS.items():
        out = out.withColumn(f"_{name}", resolve(F.col("cards"), keywords, name in NUMBERS))
    dims = {n: resolve(F.col("cards"), (k,), True)["value"].cast("int").alias(n) for n, k in (("width", "NAXIS1"), ("height", "NAXIS2"))}
    issues = F.filter(F.array(*[F.when(F.col(f"_{n}.issue").isNotNull(), F.concat(F.lit(f"{n}:"), F.col(f"_{n}.issue"))) for n in KEYWORDS]), lambda x: x.isNotNull())
    both = F.col("_x_binning.value").isNotNull() & F.col("_y_binning.value").isNotNull()
    binning = {n: F.when(both, F.col(f"_{n}.value").cast("int")).alias(n) for n in ("x_binning", "y_binning")}
    return out.select(
        "path", normalize_camera(F.col("_camera.value"))["value"].alias("camera"), normalize_closed(F.col("_frame_type.value"), FRAME_TYPES)["value"].alias("frame_type"),
        normalize_closed(F.col("_bayer.value"), BAYER)["value"].alias("bayer"), F.col("_filter.value").alias("filter"),
        *[F.col(f"_{n}.value").alias(n) for n in ("exposure", "sensor_temperature", "set_temperature", "gain", "offset")], *binning.values(), *dims.values(), issues.alias("issues"),
    )


def directory_type(name: Column) -> Column:
    """BIAS, DARK, FLAT or LIGHT from a directory's name; DARKS may have an exposure."""
    upper = F.upper(F.trim(name))
    out = F.lit(None).cast("string")
    for kind, plural in (("BIAS", "BIASES"), ("DARK", "DARKS"), ("FLAT", "FLATS"), ("LIGHT", "LIGHTS")):
        out = F.when(upper.isin(kind, plural), kind).otherwise(out)
    return F.when(upper.rlike("^DARKS[0-9]+(MS)?$"), "DARK").otherwise(out)


def filename_type(path: Column) -> Column:
    """The first token of the file's name; master files name their role."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    token = F.upper(F.get(F.split(stem, r"[_\- ]"), 0))
    out = F.when(token.isin("MASTERDARK"), "DARK").when(token.isin("MASTERFLAT"), "FLAT")
    return F.when(token.isin(*FRAME_TYPES), token).otherwise(out)


def classify(frames: DataFrame) -> DataFrame:
    """Evidence for the type of each frame from header, nearest directory and file name; they conflict if any differ."""
    parts = F.split("path", "/")
    directories = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    nearest = F.get(F.filter(F.transform(directories, directory_type), lambda t: t.isNotNull()), 0)
    header = F.when(F.col("frame_type").isin(*FRAME_TYPES), F.col("frame_type"))
    out = frames.withColumns({"header_type": header, "directory_type": nearest, "filename_type": filename_type(F.col("path"))})
    evidence = F.filter(F.array("header_type", "directory_type", "filename_type"), lambda t: t.isNotNull())
    return out.withColumn("conflict", F.size(F.array_distinct(evidence)) > 1).withColumn("evidence", evidence)


def resolve_type(classified: DataFrame, policy: str = "require_agreement") -> DataFrame:
    """``resolved``: the frame's type under a policy; a preferred source that is silent gives none."""
    one = {
        "require_agreement": F.when(~F.col("conflict"), F.get("evidence", 0)), "prefer_header": F.col("header_type"),
        "prefer_directory": F.col("directory_type"), "prefer_filename": F.col("filename_type"),
    }
    require(policy in one, f"unknown policy {policy}")
    return classified.withColumn("resolved", one[policy])


def missing_fields(required: tuple[str, ...] = REQUIRED) -> Column:
    """Stable list of the required fields that are absent; a dark does not need its measured temperature."""
    absent = {c: F.col(c).isNull() for c in required}
    if "sensor_temperature" in absent:
        absent["sensor_temperature"] = absent["sensor_temperature"] & ~F.coalesce(F.col("frame_type") == "DARK", F.lit(False))
    return F.filter(F.array(*[F.when(gone, c) for c, gone in absent.items()]), lambda c: c.isNotNull())


def with_groups(frames: DataFrame) -> DataFrame:
    """Adds ``missing`` and ``group_id``, a digest of the strict key; incomplete frames have no group.

    Darks match by set point, so their measured temperature is not part of the key.  -0.0 counts as 0.0.
    """
    measured = F.when(F.col("frame_type") != "DARK", F.col("sensor_temperature"))
    text = lambda c: F.coalesce(F.concat(F.lit("="), (measured if c == "sensor_temperature" else F.col(c)).cast("string")), F.lit("-"))
    plus_zero = frames.withColumns({c: F.col(c) + 0.0 for c in ("exposure", "sensor_temperature", "set_temperature", "gain", "offset")})
    key = F.concat_ws("\u001f", F.lit("group-v1"), *[text(c) for c in GROUP_KEY])
    return plus_zero.withColumn("missing", missing_fields()).withColumn("group_id", F.when(F.size("missing") == 0, F.sha2(key, 256)))


def group_manifest(frames: DataFrame, policy: str = "require_agreement") -> dict[str, DataFrame]:
    """``files``, ``groups`` and ``unassigned`` of a session; members of a group are a table, not a list."""
    resolved = resolve_type(classify(frames), policy)
    files = with_groups(resolved.withColumn("frame_type", F.coalesce("resolved", "frame_type")))
    complete = files.filter(F.col("resolved").isNotNull() & F.col("group_id").isNotNull())
    summary = [F.count(F.lit(1)).alias("files"), F.min("sensor_temperature").alias("temperature_minimum"), F.median("sensor_temperature").alias("temperature_median"), F.max("sensor_temperature").alias("temperature_maximum")]
    same = [F.first(c).alias(c) for c in GROUP_KEY if c != "sensor_temperature"]
    return {
        "files": files,
        "groups": complete.groupBy("group_id").agg(*same, *summary),
        "unassigned": files.filter(F.col("resolved").isNull() | F.col("group_id").isNull()).select("path", "missing", "conflict", "issues"),
    }


def scan_directory(spark: SparkSession, path: str, policy: str = "require_agreement", maximum_files: int = 1_000_000, maximum_bytes: int = 1 << 50) -> dict[str, DataFrame]:
    """The session manifest of a directory: ``files`` with fingerprints, ``groups``, ``unassigned`` and ``failures``.

    Limits are checked on the listing, before a byte is read.  A file whose header does not conform is a failure, not
    the end of the scan.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{fits,fit,fts}").load(path)
    n, size = listing.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    require(n <= maximum_files and size <= maximum_bytes, f"{n} files of {size} bytes are over the limits")
    headers = fits.read_headers(spark, path)
    out = group_manifest(normalize_headers(headers.filter("strict")), policy)
    prints = fits.fingerprints(spark, path).withColumnRenamed("path", "_path")
    files = out["files"].join(prints, F.col("path") == F.col("_path")).drop("_path")
    files = files.withColumn("frame_identity", frame_identity(F.col("path"), F.col("byte_length"), F.col("sha256")))
    return out | {"files": files, "failures": headers.filter("NOT strict").select("path", "diagnostics")}


def frame_identity(path: Column, length: Column, sha256: Column) -> Column:
    """Identity of a frame: a digest of its portable path, its size and its content's digest."""
    return F.sha2(F.concat_ws("\u001f", F.lit("frame-v1"), F.length(path).cast("string"), path, length.cast("string"), sha256), 256)
