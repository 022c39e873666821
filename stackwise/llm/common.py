"""What several of the operators share: shared scratch tables, Arrow text buffers and vectorised hashing.

Scratch tables are Parquet files below ``spark.checkpoint.dir``, the one folder that the driver and all executors
see.  They cut lineage without tying data to an executor: a lost executor only costs the tasks that ran on it.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that the vectorised kernels look at together.  A document is never divided.
CHUNK_BYTES = 1 << 18


class Scratch:
    """Tables of one operator call in the shared folder.

    The folder comes from the session's ``spark.checkpoint.dir``.  Only where that is unset and Spark is local, as in
    tests, a folder of this machine is used; on a cluster an unset folder is an error.  A table is deleted when the
    operator has consumed it; what a returned frame still reads is deleted when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="stackwise-")
        self.spark = spark
        self.root = f"{base.rstrip('/')}/stackwise-{label}-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` written once as Parquet and read back: later plans start from the files."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        df.write.parquet(path)
        if self._n == 1:
            root, system = self._hadoop(self.root)
            system.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _hadoop(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished jobs now: they'd else stay until the driver's next collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in tables:
            path, system = self._hadoop(df._scratch_path)
            system.delete(path, True)

    def end(self) -> None:
        """Delete all tables of this scratch."""
        root, system = self._hadoop(self.root)
        system.delete(root, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its ``n + 1`` offsets; null is the empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    starts = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[starts[0] : starts[-1]] if len(starts) else raw
    return raw, starts - starts[0] if len(starts) else np.zeros(1, np.int64)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes together, one at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PolyHash:
    """Hashes of any byte range out of one running sum: ``sum(t[b[i]] * B**i)`` modulo ``2**64``."""

    def __init__(self, seed: int = 1):
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64((seed * 0xD1342543DE82EF95) & MASK64))
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * CHUNK_BYTES)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of equal byte ranges, equal hashes, wherever they start."""
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


#: 0x20 and 0x09 to 0x0D separate words; A to Z become a to z.  All other bytes are left alone.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of each word; words never cross documents."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[edges[edges > 0] - 1] = True
    start = np.flatnonzero(inside & first)
    end = np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


#: Keys that can each hold more than one in so many rows: no more than these many.
HOT_KEYS = 20_000


def spread_join(left: DataFrame, right: DataFrame, on: dict[str, str], weight: str, rows: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and in ``weight`` how many rows of ``left`` it meets.

    ``rows`` is the sum of all weights or more.  Keys with more than one in ``HOT_KEYS`` of them are ``HOT_KEYS`` at most:
    their rows are broadcast, so those of ``left`` stay where they are.  The others shuffle; none of these is hot.  The keys
    of ``left`` must not be null.
    """
    hot = F.col(weight) > rows // HOT_KEYS + 1
    same = reduce(and_, [left[a] == F.col(b) for a, b in on.items()])
    met = left.join(F.broadcast(right.filter(hot)), same, "left")
    first = next(iter(on.values()))
    cold = met.filter(F.col(first).isNull()).select(*[F.col(f"`{c}`") for c in left.columns])
    cold = cold.join(right.filter(~hot), reduce(and_, [F.col(a) == F.col(b) for a, b in on.items()]))
    return met.filter(F.col(first).isNotNull()).unionByName(cold)


def checked_broadcast(df: DataFrame, rows: int, limit: int):
    """A broadcast hint only while the row count is proven to be below ``limit``; a shuffle join beyond it."""
    return F.broadcast(df) if rows <= limit else df
