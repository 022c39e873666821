"""A batch data source for FITS images in mounted folders: bounded reads instead of whole files.

``register(spark)``, then ``spark.read.format("fits").load(folder)``.  The driver reads the headers only.  A partition is a
band of rows of one plane; it seeks to its rows and reads their bytes, so files of any size take the memory of one band.
Comparisons of ``plane``, ``y`` and ``x`` with constants are pushed down: bands and rows outside of them are never read.

Folders must be mounted at the same path everywhere.  Images in stores that only Spark reaches are read by
``fits.read_samples``, whole files at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from stackwise.schema import require

from .fits import BLOCK, Layout, layout, parse_header, physical

SCHEMA = "path string, plane int, y int, x int, value double, flags smallint"
PATTERNS = ("*.fits", "*.fit", "*.fts")
#: Samples in one band, about.
BAND_SAMPLES = 1 << 20


def read_layout(path: str) -> Layout:
    """The layout of one file, from its header blocks alone."""
    head = b""
    with open(path, "rb") as file:
        while True:
            part = file.read(BLOCK)
            head += part
            header = parse_header(head)
            if header.data_start or len(part) < BLOCK:
                return layout(header)


@dataclass
class Band(InputPartition):
    path: str
    shape: Layout
    plane: int
    top: int
    rows: int
    left: int
    width: int


class FitsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path", "").removeprefix("file://")
        require(bool(self.root), "a path is needed")
        self.band_samples = int(options.get("band_samples", BAND_SAMPLES))
        self.low = {"plane": 0, "y": 0, "x": 0}
        self.high: dict[str, int | None] = {"plane": None, "y": None, "x": None}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Bounds are taken over, and Spark filters once more what can't be taken over exactly."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) else None
            if name not in self.low or not isinstance(f.value, int):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                last = f.value - isinstance(f, LessThan)
                self.high[name] = last if self.high[name] is None else min(self.high[name], last)

    def _range(self, name: str, length: int) -> tuple[int, int]:
        high = self.high[name]
        return self.low[name], length if high is None else min(length, high + 1)

    def partitions(self) -> list[Band]:
        root = Path(self.root)
        files = [root] if root.is_file() else sorted(p for p in root.rglob("*") if any(fnmatch(p.name.lower(), x) for x in PATTERNS))
        out = []
        for path in files:
            shape = read_layout(str(path))
            (p0, p1), (y0, y1), (x0, x1) = (self._range(n, length) for n, length in (("plane", shape.planes), ("y", shape.height), ("x", shape.width)))
            rows = max(1, self.band_samples // shape.width)
            if x0 < x1:
                out += [Band(str(path), shape, p, y, min(rows, y1 - y), x0, x1 - x0) for p in range(p0, p1) for y in range(y0, y1, rows)]
        return out

    def read(self, band: Band | None) -> Iterator[pa.RecordBatch]:
        if band is None:  # no partitions at all
            return
        shape = band.shape
        with open(band.path, "rb") as file:
            file.seek(shape.data_start + (band.plane * shape.height + band.top) * shape.width * shape.itemsize)
            data = file.read(band.rows * shape.width * shape.itemsize)
        here = Layout(shape.bitpix, shape.width, band.rows, 1, shape.bscale, shape.bzero, shape.blank, 0)
        values, flags = (a.reshape(band.rows, shape.width)[:, band.left : band.left + band.width].ravel() for a in physical(data, here))
        n = len(values)
        y = np.repeat(np.arange(band.top, band.top + band.rows, dtype=np.int32), band.width)
        x = np.tile(np.arange(band.left, band.left + band.width, dtype=np.int32), band.rows)
        columns = [pa.array([band.path] * n), pa.array(np.full(n, band.plane, np.int32)), pa.array(y), pa.array(x), pa.array(values), pa.array(flags)]
        yield pa.RecordBatch.from_arrays(columns, ["path", "plane", "y", "x", "value", "flags"])


class FitsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FitsReader:
        return FitsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsDataSource)
