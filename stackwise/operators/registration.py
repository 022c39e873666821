"""Reference choice, features, triangle descriptors, their matching, and transform estimation.

Tables in, tables out: ranks are window functions over frames, triangles come from nearest-neighbour self-joins inside
one frame, matching is an equi-join on 27 neighbouring descriptor bins.  Only the greedy one-to-one pairing and the
singular value decomposition of one frame pair run as a kernel, one group per pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwise.functions import geometry
from stackwise.schema import require


def reference_ranks(candidates: DataFrame) -> DataFrame:
    """Four ordinal ranks with gaps, from 0: sharper, more stars, rounder and less noisy is better.

    ``candidates``: (frame_id, fwhm, stars, eccentricity, noise), one row per frame.
    """
    rank = lambda order: (F.rank().over(W.orderBy(order)) - 1).cast("long")
    ranked = candidates.select(
        "*", rank(F.col("fwhm").asc()).alias("fwhm_rank"), rank(F.col("stars").desc()).alias("star_rank"),
        rank(F.col("eccentricity").asc()).alias("eccentricity_rank"), rank(F.col("noise").asc()).alias("noise_rank"),
    )
    names = ("fwhm_rank", "star_rank", "eccentricity_rank", "noise_rank")
    return ranked.withColumns({"total": sum((F.col(n) for n in names), F.lit(0)), "worst": F.greatest(*names)})


def select_reference(candidates: DataFrame) -> DataFrame:
    """The frame with the least total rank, then worst rank, then single ranks, then id."""
    return reference_ranks(candidates).orderBy("total", "worst", "fwhm_rank", "star_rank", "eccentricity_rank", "noise_rank", "frame_id").limit(1)


@dataclass(frozen=True)
class FeatureSelection:
    minimum_snr: float = 10.0
    maximum_eccentricity: float = 0.95
    border: float = 12.0
    maximum_features: int = 4096


def feature_catalog(stars: DataFrame, width: int, height: int, parameters: FeatureSelection | None = None) -> DataFrame:
    """Stars with the first reason for which they are no feature, or their rank among the best of their frame."""
    p = parameters or FeatureSelection()
    reason = (
        F.when(F.col("saturated"), "saturated")
        .when(F.col("snr") < p.minimum_snr, "low_snr")
        .when(F.col("eccentricity") > p.maximum_eccentricity, "eccentric")
        .when((F.col("x") < p.border) | (F.col("y") < p.border) | (F.col("x") > width - 1 - p.border) | (F.col("y") > height - 1 - p.border), "border")
    )
    order = [F.col("snr").desc(), F.col("flux").desc(), F.col("peak").desc(), F.col("eccentricity").asc(), F.col("y").asc(), F.col("x").asc()]
    ranked = stars.withColumn("excluded", reason)
    place = F.row_number().over(W.partitionBy("frame_id", F.col("excluded").isNull()).orderBy(*order)) - 1
    ranked = ranked.withColumn("rank", F.when(F.col("excluded").isNull(), place))
    over = F.col("rank") >= p.maximum_features
    return ranked.withColumns({"excluded": F.when(over, "limit").otherwise(F.col("excluded")), "rank": F.when(over, None).otherwise(F.col("rank"))})


@dataclass(frozen=True)
class Triangles:
    maximum_anchors: int = 256
    neighbours: int = 8
    minimum_long_side: float = 4.0
    minimum_area: float = 0.005
    maximum_triangles: int = 8000


def triangle_descriptors(features: DataFrame, parameters: Triangles | None = None) -> DataFrame:
    """Triangles of each anchor with pairs of its nearest neighbours, described by ratios that no similarity changes.

    ``features``: (frame_id, rank, x, y).  Vertices are in canonical order: apex (opposite the long side), the end of
    the short side, the end of the middle one.
    """
    p = parameters or Triangles()
    a = features.filter(F.col("rank") < p.maximum_anchors).select("frame_id", F.col("rank").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = features.select("frame_id", F.col("rank").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = a.join(b, "frame_id").filter("a <> b")
    near = near.withColumn("d", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    near = near.withColumn("n", F.row_number().over(W.partitionBy("frame_id", "a").orderBy("d", "b"))).filter(F.col("n") <= p.neighbours)
    other = near.select("frame_id", "a", F.col("b").alias("c"), F.col("bx").alias("cx"), F.col("by").alias("cy"), F.col("d").alias("e"), F.col("n").alias("m"))
    pairs = near.join(other, ["frame_id", "a"]).filter("n < m")
    pairs = pairs.withColumn("f", F.hypot(F.col("bx") - F.col("cx"), F.col("by") - F.col("cy")))
    point = lambda r, x, y: F.struct(F.col(r).alias("r"), F.col(x).alias("x"), F.col(y).alias("y"))
    edge = lambda length, u, v, w: F.struct(F.col(length).alias("d"), F.least(F.col(u), F.col(v)).alias("lo"), F.greatest(F.col(u), F.col(v)).alias("hi"), point(*w).alias("apex"))
    edges = F.array_sort(F.array(edge("d", "a", "b", ("c", "cx", "cy")), edge("e", "a", "c", ("b", "bx", "by")), edge("f", "b", "c", ("a", "ax", "ay"))))
    ids = F.array_sort(F.array(F.col("a").cast("long"), F.col("b").cast("long"), F.col("c").cast("long")))
    found = pairs.select("frame_id", "a", "n", "m", ids.alias("ids"), edges.alias("s"))
    found = found.select(
        "frame_id", "a", "n", "m", "ids", F.col("s")[0]["d"].alias("short"), F.col("s")[1]["d"].alias("middle"), F.col("s")[2]["d"].alias("long_side"),
        # opposite the long side is the apex; opposite the middle side the end of the short one, and so on
        F.col("s")[2]["apex"].alias("p0"), F.col("s")[1]["apex"].alias("p1"), F.col("s")[0]["apex"].alias("p2"),
    )
    x = lambda q: F.col(q)["x"] - F.col("p0")["x"]
    y = lambda q: F.col(q)["y"] - F.col("p0")["y"]
    found = found.withColumn("cross", x("p1") * y("p2") - y("p1") * x("p2"))
    found = found.withColumn("area", F.abs("cross") / (F.col("long_side") * F.col("long_side")))
    found = found.filter((F.col("long_side") >= p.minimum_long_side) & (F.col("area") >= p.minimum_area))
    # The first of equal triangles, by anchor and neighbours; then at most so many for each frame.
    first = W.partitionBy("frame_id", "ids").orderBy("a", "n", "m")
    found = found.withColumn("k", F.row_number().over(first)).filter("k = 1")
    order = W.partitionBy("frame_id").orderBy("a", "n", "m")
    found = found.withColumn("triangle", F.row_number().over(order) - 1).filter(F.col("triangle") < p.maximum_triangles)
    return found.select(
        "frame_id", "triangle", "ids",
        F.array(F.col("p0")["r"], F.col("p1")["r"], F.col("p2")["r"]).alias("vertices"),
        (F.col("short") / F.col("long_side")).alias("short_ratio"), (F.col("middle") / F.col("long_side")).alias("middle_ratio"),
        "area", "long_side", (F.col("cross") > 0).alias("clockwise"),
    )


@dataclass(frozen=True)
class Matching:
    side_tolerance: float = 0.003
    area_tolerance: float = 0.003
    minimum_scale: float = 0.95
    maximum_scale: float = 1.05
    reflection: str = "forbid"
    per_descriptor: int = 16
    maximum_matches: int = 5000

    def __post_init__(self) -> None:
        require(self.side_tolerance > 0 and self.area_tolerance > 0, "tolerances must be positive")
        require(self.reflection in ("forbid", "allow", "require"), "reflection must be forbid, allow or require")


def descriptor_bin(p: Matching) -> list[Column]:
    return [F.floor(F.col("short_ratio") / p.side_tolerance), F.floor(F.col("middle_ratio") / p.side_tolerance), F.floor(F.col("area") / p.area_tolerance)]


def match_triangles(source: DataFrame, reference: DataFrame, parameters: Matching | None = None) -> DataFrame:
    """Hypotheses: pairs of similar triangles, the nearest of each source triangle, then the nearest overall.

    A source descriptor probes the 27 bins around its own, so the join is an equi-join on bins.
    """
    p = parameters or Matching()
    s0, s1, s2 = descriptor_bin(p)
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    s = source.select(F.col("frame_id").alias("source_id"), F.col("triangle").alias("s"), F.col("vertices").alias("sv"), F.col("short_ratio").alias("ss"),
                      F.col("middle_ratio").alias("sm"), F.col("area").alias("sa"), F.col("long_side").alias("sl"), F.col("clockwise").alias("sc"), s0.alias("k0"), s1.alias("k1"), s2.alias("k2"))
    for k in ("k0", "k1", "k2"):
        s = s.withColumn("_d", F.explode(step)).withColumn(k, F.col(k) + F.col("_d")).drop("_d")
    s = s.filter("k0 >= 0 AND k1 >= 0 AND k2 >= 0")
    r0, r1, r2 = descriptor_bin(p)
    r = reference.select(F.col("frame_id").alias("reference_id"), F.col("triangle").alias("r"), F.col("vertices").alias("rv"), F.col("short_ratio").alias("rs"),
                         F.col("middle_ratio").alias("rm"), F.col("area").alias("ra"), F.col("long_side").alias("rl"), F.col("clockwise").alias("rc"), r0.alias("k0"), r1.alias("k1"), r2.alias("k2"))
    m = s.join(r, ["k0", "k1", "k2"])
    m = m.withColumns({"de": F.abs(F.col("ss") - F.col("rs")), "dm": F.abs(F.col("sm") - F.col("rm")), "da": F.abs(F.col("sa") - F.col("ra")),
                       "scale": F.col("rl") / F.col("sl"), "reflected": F.col("sc") != F.col("rc")})
    kind = {"forbid": ~F.col("reflected"), "allow": F.lit(True), "require": F.col("reflected")}[p.reflection]
    m = m.filter((F.col("de") <= p.side_tolerance) & (F.col("dm") <= p.side_tolerance) & (F.col("da") <= p.area_tolerance) & F.col("scale").between(p.minimum_scale, p.maximum_scale) & kind)
    m = m.withColumn("distance", F.hypot(F.hypot(F.col("de") / p.side_tolerance, F.col("dm") / p.side_tolerance), F.col("da") / p.area_tolerance))
    best = W.partitionBy("source_id", "reference_id", "s").orderBy("distance", "r")
    m = m.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= p.per_descriptor)
    total = W.partitionBy("source_id", "reference_id").orderBy("distance", "s", "r")
    m = m.withColumn("hypothesis", F.row_number().over(total) - 1).filter(F.col("hypothesis") < p.maximum_matches)
    return m.select("source_id", "reference_id", "hypothesis", "s", "r", F.col("sv").alias("source_ranks"), F.col("rv").alias("reference_ranks"),
                    F.greatest("de", "dm").alias("side_error"), F.col("da").alias("area_error"), "distance", "scale", "reflected")


@dataclass(frozen=True)
class Consensus:
    maximum_residual: float = 1.5
    minimum_triangles: int = 3
    minimum_pairs: int = 6
    maximum_models: int = 5000
    distinct_separation: float = 3.0


def one_to_one(pairs: pd.DataFrame) -> pd.DataFrame:
    """Greedy one-to-one pairing by support, residual and ranks; the order is the result, so this is sequential."""
    ordered = pairs.sort_values(["support", "residual", "source_rank", "reference_rank"], ascending=[False, True, True, True])
    used_s, used_r, keep = set(), set(), []
    for i, (s, r) in enumerate(zip(ordered["source_rank"], ordered["reference_rank"], strict=True)):
        if s not in used_s and r not in used_r:
            used_s.add(s)
            used_r.add(r)
            keep.append(i)
    return ordered.iloc[keep]


CONSENSUS = (
    "source_id long, reference_id long, a double, b double, c double, d double, e double, f double, reflected boolean, inlier_triangles long, pairs long, "
    "rms double, maximum double, competitor_triangles long, eligible long, truncated boolean, matches array<struct<sx:double,sy:double,rx:double,ry:double>>, failure string"
)


def find_consensus(found: pd.DataFrame, p: Consensus) -> dict:
    """The similarity that most triangle pairs agree on; ``found`` has one row per hypothesis with three matched points."""
    source = np.stack([np.stack(v) for v in found["source_points"]]).reshape(len(found), 3, 2)
    target = np.stack([np.stack(v) for v in found["reference_points"]]).reshape(len(found), 3, 2)
    reflected = found["reflected"].to_numpy()
    distance = found["distance"].to_numpy()
    models, scores = [], []
    for k in range(min(len(found), p.maximum_models)):
        model = geometry.fit_similarity(source[k], target[k], bool(reflected[k]))
        u, v = model.apply(source[..., 0], source[..., 1])
        apart = np.hypot(u - target[..., 0], v - target[..., 1])
        inlier = (apart.max(axis=1) <= p.maximum_residual) & (reflected == reflected[k])
        rms = float(np.sqrt((apart[inlier] ** 2).mean())) if inlier.any() else np.inf
        models.append((model, inlier))
        scores.append((-int(inlier.sum()), rms, distance[k], bool(reflected[k]), k))
    best = min(scores)
    model, inlier = models[best[4]]
    out = {"reflected": bool(reflected[best[4]]), "inlier_triangles": int(inlier.sum()), "eligible": int((reflected == reflected[best[4]]).sum()), "truncated": len(found) > p.maximum_models}
    if out["inlier_triangles"] < p.minimum_triangles:
        return out | {"failure": "insufficient_triangles"}
    rows = {}
    for k in np.flatnonzero(inlier):
        for j in range(3):
            key = (int(found["source_ranks"].iloc[k][j]), int(found["reference_ranks"].iloc[k][j]))
            rows.setdefault(key, [0, source[k, j], target[k, j]])[0] += 1
    table = pd.DataFrame([(s, r, n, *a, *b) for (s, r), (n, a, b) in rows.items()], columns=["source_rank", "reference_rank", "support", "sx", "sy", "rx", "ry"])
    table["residual"] = geometry.residuals(model, table[["sx", "sy"]].to_numpy(), table[["rx", "ry"]].to_numpy())
    pairs = one_to_one(table[table["residual"] <= p.maximum_residual])
    if len(pairs) < p.minimum_pairs:
        return out | {"failure": "insufficient_pairs"}
    a, b = pairs[["sx", "sy"]].to_numpy(), pairs[["rx", "ry"]].to_numpy()
    model = geometry.fit_similarity(a, b, out["reflected"])
    rest = geometry.residuals(model, a, b)
    size = source.max(initial=1.0)
    others = [-s[0] for s in scores if geometry.separation(models[s[4]][0], model, int(size) + 1, int(size) + 1) > p.distinct_separation]
    return out | {
        "a": model.a, "b": model.b, "c": model.c, "d": model.d, "e": model.e, "f": model.f, "pairs": len(pairs), "rms": float(np.sqrt((rest**2).mean())), "maximum": float(rest.max()),
        "competitor_triangles": max(others, default=None), "matches": [dict(zip(("sx", "sy", "rx", "ry"), map(float, row), strict=True)) for row in np.hstack([a, b])], "failure": None,
    }


def similarity_consensus(hypotheses: DataFrame, source: DataFrame, reference: DataFrame, parameters: Consensus | None = None) -> DataFrame:
    """One row per frame pair; its hypotheses (at most ``maximum_matches``) are one group."""
    p = parameters or Consensus()

    def located(found: DataFrame, features: DataFrame, frame: str, ranks: str, out: str) -> DataFrame:
        rows = found.select("source_id", "reference_id", "hypothesis", frame, F.posexplode(ranks).alias("i", "rank"))
        f = features.select(F.col("frame_id").alias(frame), "rank", "x", "y")
        rows = rows.join(f, [frame, "rank"]).groupBy("source_id", "reference_id", "hypothesis")
        points = F.array_sort(F.collect_list(F.struct("i", "x", "y")))
        return rows.agg(F.transform(points, lambda q: F.array(q["x"], q["y"])).alias(out))

    keys = ["source_id", "reference_id", "hypothesis"]
    found = hypotheses.join(located(hypotheses, source, "source_id", "source_ranks", "source_points"), keys).join(
        located(hypotheses, reference, "reference_id", "reference_ranks", "reference_points"), keys
    )
    names = [part.split()[0] for part in CONSENSUS.replace("struct<sx:double,sy:double,rx:double,ry:double>", "s").split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = find_consensus(pdf.sort_values("hypothesis").reset_index(drop=True), p)
        return pd.DataFrame([{n: row.get(n) for n in names} | {"source_id": key[0], "reference_id": key[1]}])[names]

    return found.groupBy("source_id", "reference_id").applyInPandas(run, CONSENSUS)


@dataclass(frozen=True)
class Confidence:
    minimum_triangles: int = 5
    minimum_ratio: float = 0.05
    minimum_pairs: int = 12
    minimum_margin: int = 2
    maximum_rms: float = 0.75
    maximum_residual: float = 1.5
    minimum_source_span: float = 0.15
    minimum_reference_span: float = 0.15
    allow_reflection: bool = False
    allow_truncated: bool = False


def confidence(consensus: DataFrame, width: int, height: int, parameters: Confidence | None = None) -> DataFrame:
    """All reasons against a registration, in fixed order; accepted iff there is none."""
    p = parameters or Confidence()
    ratio = F.col("inlier_triangles") / F.col("eligible")
    margin = F.col("inlier_triangles") - F.col("competitor_triangles")

    def span(axis: str, size: int) -> Column:
        values = F.transform("matches", lambda m: m[axis])
        return (F.array_max(values) - F.array_min(values)) / max(1, size - 1)

    checks = [
        (F.col("inlier_triangles") < p.minimum_triangles, "insufficient_inlier_triangles"),
        (ratio < p.minimum_ratio, "insufficient_inlier_ratio"),
        (F.col("pairs") < p.minimum_pairs, "insufficient_pairs"),
        (margin < p.minimum_margin, "insufficient_winner_margin"),
        (F.col("rms") > p.maximum_rms, "excessive_rms"),
        (F.col("maximum") > p.maximum_residual, "excessive_maximum_residual"),
        (span("sx", width) < p.minimum_source_span, "insufficient_source_horizontal_span"),
        (span("sy", height) < p.minimum_source_span, "insufficient_source_vertical_span"),
        (span("rx", width) < p.minimum_reference_span, "insufficient_reference_horizontal_span"),
        (span("ry", height) < p.minimum_reference_span, "insufficient_reference_vertical_span"),
        (F.col("reflected") & F.lit(not p.allow_reflection), "reflection_forbidden"),
        (F.col("truncated") & F.lit(not p.allow_truncated), "truncated_evidence"),
        (F.col("failure").isNotNull(), "no_consensus"),
    ]
    reasons = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for c, n in checks]), lambda r: r.isNotNull())
    return consensus.withColumns({"inlier_ratio": ratio, "winner_margin": margin, "rejections": reasons}).withColumn("accepted", F.size("rejections") == 0)


def similarity_sums(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares similarity of each group of matches (sx, sy, rx, ry), in two plain aggregations."""
    mean = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("sx", "sy", "rx", "ry")])
    x, y, u, v = (F.col(c) - F.col(f"m{c}") for c in ("sx", "sy", "rx", "ry"))
    sums = matches.join(mean, keys).groupBy(*keys).agg(
        F.sum(x * u + y * v).alias("dot"), F.sum(x * v - y * u).alias("cross"), F.sum(x * x + y * y).alias("square"),
        *[F.first(c).alias(c) for c in ("n", "msx", "msy", "mrx", "mry")],
    )
    a, b = F.col("dot") / F.col("square"), F.col("cross") / F.col("square")
    return sums.filter("square > 0").select(
        *keys, "n", a.alias("a"), (-b).alias("b"), (F.col("mrx") - a * F.col("msx") + b * F.col("msy")).alias("c"),
        b.alias("d"), a.alias("e"), (F.col("mry") - b * F.col("msx") - a * F.col("msy")).alias("f"),
    )


def residual_statistics(matches: DataFrame, transforms: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, RMS and maximum of the distances after the transform (a..f); nothing is clipped."""
    u = F.col("a") * F.col("sx") + F.col("b") * F.col("sy") + F.col("c")
    v = F.col("d") * F.col("sx") + F.col("e") * F.col("sy") + F.col("f")
    r = F.hypot(u - F.col("rx"), v - F.col("ry"))
    return matches.join(transforms, keys).withColumn("r", r).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg("r").alias("mean"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"), F.max("r").alias("maximum")
    )


MODELS = (
    "similarity_rms double, projective_rms double, rms_gain double, model_separation double, homography array<double>, matches long, folds long, projective_better_folds long, "
    "cv_similarity_rms double, cv_projective_rms double, cv_relative_gain double, cv_similarity_max double, cv_projective_max double, minimum_rank_separation double"
)


def compare_models(source: np.ndarray, target: np.ndarray, width: int, height: int, folds: int = 5, reflected: bool = False) -> dict:
    """Similarity against homography: fit on all matches, and spatial round-robin cross-validation."""
    require(2 <= folds <= 16, "folds must be 2 to 16")
    rms = lambda r: float(np.sqrt((r**2).mean()))
    s = geometry.fit_similarity(source, target, reflected)
    h, _ = geometry.fit_projective(source, target)
    order = np.lexsort((np.arange(len(source)), source[:, 0], source[:, 1]))
    fold = np.empty(len(source), np.int64)
    fold[order] = np.arange(len(source)) % folds
    r_s, r_h, better, ratios = np.empty(len(source)), np.empty(len(source)), 0, []
    for k in range(folds):
        out = fold == k
        a = geometry.fit_similarity(source[~out], target[~out], reflected)
        b, ratio = geometry.fit_projective(source[~out], target[~out])
        r_s[out], r_h[out] = geometry.residuals(a, source[out], target[out]), geometry.residuals(b, source[out], target[out])
        better += rms(r_h[out]) < rms(r_s[out])
        ratios.append(ratio)
    full_s, full_h = rms(geometry.residuals(s, source, target)), rms(geometry.residuals(h, source, target))
    return {
        "similarity_rms": full_s, "projective_rms": full_h, "rms_gain": full_s - full_h, "model_separation": geometry.separation(s, h, width, height),
        "homography": [float(v) for v in h.matrix.ravel()], "matches": len(source), "folds": folds, "projective_better_folds": better,
        "cv_similarity_rms": rms(r_s), "cv_projective_rms": rms(r_h), "cv_relative_gain": (rms(r_s) - rms(r_h)) / rms(r_s) if rms(r_s) > 0 else None,
        "cv_similarity_max": float(r_s.max()), "cv_projective_max": float(r_h.max()), "minimum_rank_separation": min(ratios),
    }


def model_evidence(matches: DataFrame, width: int, height: int, keys: list[str], folds: int = 5) -> DataFrame:
    """Evidence for or against a homography for each group of matches; one frame pair is one group.

    A group's memory is proportional to its matches; ties of the folds' order go by the order of the input.
    """
    kinds = ", ".join(f"`{k}` {matches.schema[k].dataType.simpleString()}" for k in keys)
    names = [part.split()[0] for part in MODELS.split(", ")]
    held = {n: {"long": pa.int64(), "double": pa.float64()}.get(kind, pa.list_(pa.float64())) for n, kind in (part.split() for part in MODELS.split(", "))}

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        points = [np.stack([rows[c].to_numpy().astype(np.float64) for c in pair], axis=1) for pair in (("sx", "sy"), ("rx", "ry"))]
        row = compare_models(*points, width, height, folds)
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([row[n]], held[n]) for n in names], names=[*keys, *names])

    return matches.select(*keys, "sx", "sy", "rx", "ry").groupBy(*keys).applyInArrow(run, f"{kinds}, {MODELS}")


@dataclass(frozen=True)
class ModelPolicy:
    minimum_matches: int = 32
    minimum_folds: int = 5
    minimum_better_folds: int = 4
    minimum_gain: float = 0.01
    minimum_relative_gain: float = 0.05
    minimum_rank_separation: float = 1e-6
    maximum_projective_rms: float = 0.75
    minimum_separation: float = 0.1


def choose_model(evidence: DataFrame, policy: ModelPolicy | None = None) -> DataFrame:
    """Nine conditions, all of which a homography must meet to be chosen over the similarity."""
    p = policy or ModelPolicy()
    checks = {
        "support_sufficient": F.col("matches") >= p.minimum_matches,
        "folds_sufficient": F.col("folds") >= p.minimum_folds,
        "fold_wins_sufficient": F.col("projective_better_folds") >= p.minimum_better_folds,
        "absolute_gain_sufficient": F.col("cv_similarity_rms") - F.col("cv_projective_rms") >= p.minimum_gain,
        "relative_gain_sufficient": F.coalesce(F.col("cv_relative_gain") >= p.minimum_relative_gain, F.lit(False)),
        "rank_separation_sufficient": F.col("minimum_rank_separation") >= p.minimum_rank_separation,
        "projective_rms_acceptable": F.col("cv_projective_rms") <= p.maximum_projective_rms,
        "worst_residual_not_increased": F.col("cv_projective_max") <= F.col("cv_similarity_max"),
        "separation_sufficient": F.col("model_separation") >= p.minimum_separation,
    }
    every = F.lit(True)
    for name in checks:
        every = every & F.col(name)
    return evidence.withColumns(checks).withColumn("projective", every)
