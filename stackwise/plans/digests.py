"""Identities of operations, plans and weights: domain-separated SHA-256 over canonical JSON, and a verified store."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise.schema import require


def canonical(value) -> str:
    """JSON with sorted keys; floats by their exact bits, so that equal text means equal numbers."""

    def exact(v):
        if isinstance(v, bool) or v is None or isinstance(v, int | str):
            return v
        if isinstance(v, float):
            return {"f64": struct.pack(">d", v + 0.0).hex()}
        if isinstance(v, dict):
            return {str(k): exact(x) for k, x in v.items()}
        if isinstance(v, Iterable):
            return [exact(x) for x in v]
        return exact(vars(v))

    return json.dumps(exact(value), sort_keys=True, separators=(",", ":"))


def digest(domain: str, value) -> str:
    """Key of an operation: equal values in different domains have different keys."""
    require(bool(domain), "a domain is needed")
    body = canonical(value).encode()
    return hashlib.sha256(f"{len(domain)}:{domain}:{len(body)}:".encode() + body).hexdigest()


def weight_set(weights: DataFrame) -> tuple[DataFrame, str]:
    """Weights (frame_id, weight) in canonical order with their digest; ids must be unique and weights positive."""
    rows = [(int(r[0]), float(r[1])) for r in weights.select("frame_id", "weight").orderBy("frame_id").collect()]  # one per frame of a stack
    require(len({k for k, _ in rows}) == len(rows), "frames must be unique")
    require(all(0 < w < float("inf") for _, w in rows), "weights must be finite and positive")
    return weights, digest("weights-v1", rows)


def registration_plan(reference_id: int, width: int, height: int, frames: list[dict]) -> dict:
    """A sealed plan: frames by id, exactly one reference with the identity, and a digest of everything."""
    ordered = sorted(frames, key=lambda f: f["frame_id"])
    require(len({f["frame_id"] for f in ordered}) == len(ordered), "frames must be unique")
    identity = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    chosen = [f for f in ordered if f["frame_id"] == reference_id]
    require(len(chosen) == 1 and [float(v) for v in chosen[0]["matrix"]] == identity, "the reference must be there once, with the identity")
    require(width > 0 and height > 0, "the crop must not be empty")
    plan = {"version": 1, "reference_id": reference_id, "width": width, "height": height, "frames": ordered}
    return plan | {"sha256": digest("registration-plan-v1", plan)}


class ArtifactStore:
    """Content-addressed tables: published once under an operation's key, verified before every read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str) -> str:
        require(len(key) == 64 and all(c in "0123456789abcdef" for c in key), "a key is 64 hex digits")
        return f"{self.root}/{key[:2]}/{key}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    @staticmethod
    def fingerprint(df: DataFrame) -> tuple[int, str]:
        """Rows, and an order-free sum of row hashes."""
        row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
        n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)"))).first()
        return int(n), str(total)

    def publish(self, key: str, df: DataFrame) -> bool:
        """True if written, False if the same was there; another content under the key is an error."""
        path = self._path(key)
        if self._exists(f"{path}/seal"):
            held = self.spark.read.json(f"{path}/seal").first()
            require((held["rows"], held["sum"]) == self.fingerprint(df), "another artifact has this key")
            return False
        df.write.mode("overwrite").parquet(f"{path}/data")
        rows, total = self.fingerprint(self.spark.read.parquet(f"{path}/data"))
        self.spark.createDataFrame([(rows, total)], "rows long, sum string").coalesce(1).write.mode("errorifexists").json(f"{path}/seal")
        return True

    def lookup(self, key: str) -> DataFrame | None:
        """The verified table, or None if there is none."""
        path = self._path(key)
        if not self._exists(f"{path}/seal"):
            return None
        df = self.spark.read.parquet(f"{path}/data")
        held = self.spark.read.schema("rows long, sum string").json(f"{path}/seal").first()
        require((held["rows"], held["sum"]) == self.fingerprint(df), "the artifact is damaged")
        return df

    def remove_if(self, key: str, fingerprint: tuple[int, str]) -> bool:
        """Remove only what has this fingerprint."""
        df = self.lookup(key)
        if df is None or self.fingerprint(df) != fingerprint:
            return False
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(key))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
