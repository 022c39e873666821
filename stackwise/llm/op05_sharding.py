"""Sharding by histogram sort: splitters of equal bytes from counted probes, then one exchange.

Rows are ordered by (hash of the text, id), so equal texts are neighbours.  A splitter is a key below which lies a
wanted number of bytes.  All splitters are sought at once: each has a bracket of keys, each round counts the exact
bytes below ``PROBES`` keys inside every bracket (partial sums in each partition, then one small sum), and brackets
shrink around their targets.  A splitter is settled once its bytes are within ``TOLERANCE`` of a shard.  Where one hash
holds more bytes than that (a large group of copies), the search goes on over the ids of that hash.  Only probes and
their counts reach the driver, a number that the shard count bounds.  Then all rows are exchanged once.

Slots are numbered without ordering a whole shard: rows fall into cells (shard, salt of the id), counts of the cells
give each cell its first slot.

Defined results: null text has no bytes, so size 16, and crc32 0.  Null ids sort first.  Repeated rows have equal keys
and no boundary divides them.  With fewer rows than shards some shards stay empty.  Extra columns are carried along by
``shard``; columns that it adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast, read_table, text_or_empty

SHARDS, OVERHEAD = 40, 16
#: Probes inside each bracket and round; the bytes that a splitter may be off, as a part of one shard.
PROBES, TOLERANCE = 128, 0.002
CELL_ROWS, SMALL_CELLS = 20_000, 100_000
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _below(keys: DataFrame, column: str, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with ``column`` below each of the sorted ``probes``."""
    at = np.array(probes, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(len(at) + 1, np.int64)
        rows = np.zeros(len(at) + 1, np.int64)
        for batch in batches:
            where = np.searchsorted(at, batch.column(0).to_numpy(zero_copy_only=False), "right")
            np.add.at(size, where, batch.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(where, minlength=len(rows))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(size[used]), pa.array(rows[used])], ["cell", "size", "rows"])

    cells = keys.select(column, "size").mapInArrow(count, "cell long, size long, rows long")
    size = np.zeros(len(at) + 1, np.int64)
    rows = np.zeros(len(at) + 1, np.int64)
    for cell, s, r in cells.groupBy("cell").agg(F.sum("size"), F.sum("rows")).collect():
        size[cell], rows[cell] = s, r
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def _search(keys: DataFrame, column: str, total: int, rows: int, targets: list[float], tolerance: float) -> list[tuple]:
    """For each target ``(lo, below lo, rows below lo, hi, below hi, rows below hi)``: known keys on either side.

    The search for a target ends when one side is within tolerance, or when no key lies between the two sides.
    """
    # HIGH + 1 is not a long: the upper end stands for "all rows", whatever key they have.
    brackets = [[LOW, 0, 0, HIGH + 1, total, rows] for _ in targets]

    def open_(b: list, t: float) -> bool:
        return min(t - b[1], b[4] - t) > tolerance and b[3] - b[0] > 1 and b[5] - b[2] > 1

    while any(open_(b, t) for b, t in zip(brackets, targets, strict=True)):
        probes = set()
        for b, t in zip(brackets, targets, strict=True):
            if open_(b, t):
                step = (b[3] - b[0]) / (PROBES + 1)
                probes |= {p for i in range(1, PROBES + 1) if b[0] < (p := b[0] + int(step * i)) < b[3]} | {b[0] + 1}
        probes = sorted(p for p in probes if p <= HIGH)
        sizes, counts = _below(keys, column, probes)
        for b, t in zip(brackets, targets, strict=True):
            for p, s, r in zip(probes, sizes.tolist(), counts.tolist(), strict=True):
                if s <= t and p > b[0]:
                    b[:3] = p, s, r
                if s > t and p < b[3]:
                    b[3:] = p, s, r
    return [tuple(b) for b in brackets]


def splitters(keys: DataFrame, shards: int) -> list[tuple[int, int]]:
    """``shards - 1`` boundaries ``(hash, id)``; a row belongs below a boundary if its key is smaller."""
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    targets = [total * i / shards for i in range(1, shards)]
    tolerance = TOLERANCE * total / shards
    out: list[tuple[int, int]] = []
    inside: dict[int, list[int]] = {}
    found = _search(keys, "h", total, rows, targets, tolerance)
    for k, (target, (lo, s_lo, r_lo, hi, s_hi, r_hi)) in enumerate(zip(targets, found, strict=True)):
        out.append((lo, LOW) if target - s_lo <= s_hi - target else (hi, LOW))
        if min(target - s_lo, s_hi - target) > tolerance and r_hi - r_lo > 1:
            inside.setdefault(lo, []).append(k)
    for text, at in inside.items():
        # All rows between the sides have one hash, one text.  Go on over its ids, for all of its boundaries at once.
        _, s_lo, r_lo, hi, s_hi, r_hi = found[at[0]]
        same = keys.filter(F.col("h") == text)
        wanted = [targets[k] - s_lo for k in at]
        for k, t, (lo, a, _, up, b, _) in zip(at, wanted, _search(same, "id", s_hi - s_lo, r_hi - r_lo, wanted, tolerance), strict=True):
            nearest = lo if t - a <= b - t else up
            out[k] = (text, nearest) if nearest <= HIGH else (hi, LOW)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``: bytes nearly equal in all shards, slots gapless from 0."""
    scratch = Scratch(docs.sparkSession, "shard")
    rows = docs.withColumns(
        {
            "size": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD,
            "_h": F.xxhash64(text_or_empty(text_col)),
            "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)),
        }
    )
    keys = scratch.table(rows.select(F.col("_h").alias("h"), F.col("_id").alias("id"), "size"))
    place = F.lit(0)
    for h, i in splitters(keys, shards):
        beyond = F.lit(False) if h > HIGH else (F.col("_h") > h) | ((F.col("_h") == h) & (F.col("_id") >= i))
        place = place + beyond.cast("int")
    salts = max(1, keys.count() // (shards * CELL_ROWS))
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts))
    cells = keys.select(F.col("h").alias("_h"), F.col("id").alias("_id")).select(place.alias("s"), salt.alias("t"))
    cells = cells.groupBy("s", "t").count()
    before = W.partitionBy("s").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    cells = scratch.table(cells.select("s", "t", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    order = W.partitionBy("shard", "_salt").orderBy("_h", "_id")
    placed = rows.withColumns({"shard": place, "_salt": salt}).withColumn("_n", F.row_number().over(order) - 1)
    small = checked_broadcast(cells, shards * salts, SMALL_CELLS)
    return (
        placed.join(small, (F.col("shard") == F.col("s")) & (F.col("_salt") == F.col("t")))
        .withColumn("slot", F.col("first") + F.col("_n"))
        .drop("_h", "_id", "_salt", "_n", "s", "t", "first")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(text_or_empty()))
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
