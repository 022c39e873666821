"""FITS images: headers, checksums, region reads as samples, and a binary64 writer.

Files are read through ``binaryFile``, so any store that Spark reaches will do; one file is decoded in bands of rows
into Arrow batches.  Headers only need the first blocks of a file.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwise.schema import INVALID, MISSING, require

# Fixed values of the format.
BLOCK, CARD = 2880, 80
DTYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
CANONICAL_NAN = struct.pack(">Q", 0x7FF8000000000000)
MAXIMUM_HEADER_BLOCKS = 1024


@dataclass(frozen=True)
class Card:
    keyword: str
    kind: str
    value: bool | int | float | str | None
    raw: str


@dataclass
class Header:
    """All cards in order, what was wrong with them, and where the data start."""

    cards: list[Card] = field(default_factory=list)
    diagnostics: list[tuple[str, str, str]] = field(default_factory=list)
    data_start: int = 0

    def get(self, keyword: str) -> bool | int | float | str | None:
        return next((c.value for c in self.cards if c.keyword == keyword), None)

    def values(self, keyword: str) -> list:
        return [c.value for c in self.cards if c.keyword == keyword and c.value is not None]

    @property
    def strict(self) -> bool:
        return not any(severity == "error" for severity, _, _ in self.diagnostics)


def parse_card(raw: str) -> Card:
    """One 80-byte card; a value is logical, integer, float (also with D exponent), string, undefined or raw."""
    keyword = raw[:8].rstrip()
    if raw[8:10] != "= ":
        return Card(keyword, "comment", None, raw)
    body = raw[10:]
    text = body.lstrip()
    if text.startswith("'"):
        out, i = [], 1
        while i < len(text):
            if text[i] == "'":
                if text[i + 1 : i + 2] == "'":
                    out.append("'")
                    i += 2
                    continue
                return Card(keyword, "string", "".join(out).rstrip(), raw)
            out.append(text[i])
            i += 1
        return Card(keyword, "raw", None, raw)
    token = text.split("/", 1)[0].strip()
    if not token:
        return Card(keyword, "undefined", None, raw)
    if token in ("T", "F"):
        return Card(keyword, "logical", token == "T", raw)
    try:
        return Card(keyword, "integer", int(token), raw)
    except ValueError:
        pass
    try:
        return Card(keyword, "float", float(token.replace("D", "E").replace("d", "e")), raw)
    except ValueError:
        return Card(keyword, "raw", None, raw)


def parse_header(data: bytes) -> Header:
    """The primary header; bounded in blocks, with conformance diagnostics instead of exceptions."""
    header = Header()
    say = lambda severity, code, message: header.diagnostics.append((severity, code, message))
    for block in range(MAXIMUM_HEADER_BLOCKS):
        part = data[block * BLOCK : (block + 1) * BLOCK]
        if len(part) < BLOCK:
            say("error", "truncated_header", f"block {block} has {len(part)} bytes")
        for at in range(0, len(part) - CARD + 1, CARD):
            raw = part[at : at + CARD].decode("latin-1")
            if any(not 0x20 <= ord(c) <= 0x7E for c in raw):
                say("warning", "non_printable", raw[:8].strip())
            if raw[:8].rstrip() == "END":
                header.data_start = (block + 1) * BLOCK
                _check_mandatory(header, say)
                return header
            card = parse_card(raw)
            if card.kind == "raw":
                say("warning", "unparsed_value", card.keyword)
            if card.keyword:
                header.cards.append(card)
        if len(part) < BLOCK:
            break
    say("error", "missing_end", "no END card")
    return header


def _check_mandatory(header: Header, say) -> None:
    for place, keyword in enumerate(("SIMPLE", "BITPIX", "NAXIS")):
        if len(header.cards) <= place or header.cards[place].keyword != keyword:
            say("error", "mandatory_order", keyword)
    seen = set()
    for c in header.cards:
        if c.keyword in ("COMMENT", "HISTORY", ""):
            continue
        if c.keyword in seen:
            say("warning", "duplicate_keyword", c.keyword)
        seen.add(c.keyword)


@dataclass(frozen=True)
class Layout:
    bitpix: int
    width: int
    height: int
    planes: int
    bscale: float
    bzero: float
    blank: int | None
    data_start: int

    @property
    def samples(self) -> int:
        return self.width * self.height * self.planes

    @property
    def itemsize(self) -> int:
        return abs(self.bitpix) // 8


def layout(header: Header) -> Layout:
    """Checked image layout of a two- or three-dimensional primary array."""
    bitpix, naxis = header.get("BITPIX"), header.get("NAXIS")
    require(bitpix in DTYPES, f"unsupported BITPIX {bitpix}")
    require(naxis in (2, 3), f"unsupported NAXIS {naxis}")
    axes = [header.get(f"NAXIS{k}") for k in range(1, naxis + 1)]
    require(all(isinstance(a, int) and a > 0 for a in axes), "axes must be positive")
    require(np.prod([float(a) for a in axes]) < 2**48, "the image is too large")
    number = lambda k, default: float(header.get(k)) if isinstance(header.get(k), int | float) else default
    blank = header.get("BLANK") if bitpix > 0 else None
    return Layout(bitpix, axes[0], axes[1], axes[2] if naxis == 3 else 1, number("BSCALE", 1.0), number("BZERO", 0.0), blank if isinstance(blank, int) else None, header.data_start)


def physical(data: bytes, shape: Layout, start: int = 0, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``count`` samples from ``start``: physical values and flags (undefined: MISSING, not finite: INVALID)."""
    count = shape.samples - start if count is None else count
    at = shape.data_start + start * shape.itemsize
    require(len(data) >= at + count * shape.itemsize, "the data are truncated")
    stored = np.frombuffer(data, DTYPES[shape.bitpix], count, at)
    values = stored.astype(np.float64)
    if (shape.bscale, shape.bzero) != (1.0, 0.0):
        values = values * shape.bscale + shape.bzero
    flags = np.zeros(count, np.int16)
    if shape.blank is not None:
        blank = stored == shape.blank
        values[blank], flags[blank] = np.nan, MISSING
    flags[(flags == 0) & ~np.isfinite(values)] = INVALID
    return values, flags


def checksum(data: bytes) -> int:
    """Ones-complement sum of big-endian 32-bit words."""
    words = np.frombuffer(data + b"\0" * (-len(data) % 4), ">u4")
    total = int(words.sum(dtype=np.uint64))
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


def combine_checksums(a: int, b: int) -> int:
    """Sums of parts add up, so parts may be summed anywhere."""
    total = a + b
    return (total & 0xFFFFFFFF) + (total >> 32)


def is_negative_zero(total: int) -> bool:
    return total in (0, 0xFFFFFFFF)


def encode_checksum(total: int) -> str:
    """The 16 printable characters that make the sum of the whole unit all ones."""
    value = ~total & 0xFFFFFFFF
    columns = []
    for shift in (24, 16, 8, 0):
        byte = (value >> shift) & 0xFF
        part = [byte // 4 + (byte % 4 if k == 0 else 0) + 0x30 for k in range(4)]
        odd = [*range(0x3A, 0x41), *range(0x5B, 0x61)]
        while any(c in odd for c in part):
            for k in (0, 2):
                if part[k] in odd or part[k + 1] in odd:
                    part[k] += 1
                    part[k + 1] -= 1
        columns.append(part)
    text = "".join(chr(columns[j][k]) for k in range(4) for j in range(4))
    return text[-1] + text[:-1]


def verify_checksums(data: bytes) -> dict[str, str]:
    """Status of DATASUM and CHECKSUM: valid, missing, undefined, malformed or mismatch."""
    header = parse_header(data)
    body = data[header.data_start : header.data_start + padded_size(layout(header))]
    out = {}
    for keyword in ("DATASUM", "CHECKSUM"):
        cards = [c for c in header.cards if c.keyword == keyword]
        if not cards:
            out[keyword] = "missing"
        elif cards[0].kind == "undefined" or cards[0].value == "":
            out[keyword] = "undefined"
        elif cards[0].kind != "string":
            out[keyword] = "malformed"
        elif keyword == "DATASUM":
            value = str(cards[0].value).strip()
            out[keyword] = "malformed" if not value.isdigit() else "valid" if int(value) == checksum(body) else "mismatch"
        else:
            out[keyword] = "valid" if is_negative_zero(combine_checksums(checksum(data[: header.data_start]), checksum(body))) else "mismatch"
    return out


def checksums(files: DataFrame, key: str) -> DataFrame:
    """``key, checksum`` of ``files`` (key, content): the ones' complement sum of each content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [checksum(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], [key, "checksum"])

    return files.select(key, "content").mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, checksum long")


def verified(files: DataFrame, key: str) -> DataFrame:
    """``key, datasum, checksum``: the status of both checksums of each file (key, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verify_checksums(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.string()) for k in ("DATASUM", "CHECKSUM"))], [key, "datasum", "checksum"])

    return files.select(key, "content").mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, datasum string, checksum string")


def padded_size(shape: Layout) -> int:
    return -(-shape.samples * shape.itemsize // BLOCK) * BLOCK


def format_card(keyword: str, value, comment: str = "") -> str:
    if isinstance(value, bool):
        body = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int | float):
        body = f"{value!r:>20}".upper() if isinstance(value, float) else f"{value:>20}"
    else:
        body = f"'{str(value).replace(chr(39), chr(39) * 2):<8}'"
    text = f"{keyword:<8}= {body}" + (f" / {comment}" if comment else "")
    require(len(text) <= CARD, f"card {keyword} is too long")
    return f"{text:<80}"


def encode_f64(values: np.ndarray, flags: np.ndarray, provenance: dict[str, str | int | float] | None = None) -> bytes:
    """A BITPIX -64 file of planes ``(planes, height, width)``; unavailable samples are one canonical NaN."""
    planes, height, width = values.shape
    body = values.astype(">f8")
    body = np.where(np.isnan(values) | (flags & MISSING != 0), np.frombuffer(CANONICAL_NAN, ">f8")[0], body).astype(">f8").tobytes()
    body += b"\0" * (-len(body) % BLOCK)
    axes = {"NAXIS1": width, "NAXIS2": height} | ({"NAXIS3": planes} if planes > 1 else {})
    cards = [format_card(k, v) for k, v in ({"SIMPLE": True, "BITPIX": -64, "NAXIS": len(axes)} | axes | (provenance or {})).items()]
    cards.append(format_card("DATASUM", str(checksum(body))))

    def head(value: str) -> bytes:
        text = "".join([*cards, format_card("CHECKSUM", value), f"{'END':<80}"])
        return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")

    total = combine_checksums(checksum(head("0" * 16)), checksum(body))
    return head(encode_checksum(total)) + body


def _files(spark: SparkSession, path: str, pattern: str = "*.{fits,fit,fts}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


CARDS = T.ArrayType(T.StructType([T.StructField("keyword", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("raw", T.StringType())]))
ISSUES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("severity", "code", "message")]))
HEADERS = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("cards", CARDS), T.StructField("diagnostics", ISSUES), T.StructField("strict", T.BooleanType())])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: cards, diagnostics and whether the header is strictly conforming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, size, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                h = parse_header(data)
                cards = [{"keyword": c.keyword, "kind": c.kind, "value": None if c.value is None else json.dumps(c.value) if isinstance(c.value, bool) else str(c.value), "raw": c.raw} for c in h.cards]
                rows.append({"path": name, "length": size, "cards": cards, "diagnostics": [dict(zip(("severity", "code", "message"), d, strict=True)) for d in h.diagnostics], "strict": h.strict})
            card = pa.list_(pa.struct([(n, pa.string()) for n in ("keyword", "kind", "value", "raw")]))
            issue = pa.list_(pa.struct([(n, pa.string()) for n in ("severity", "code", "message")]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("length", pa.int64()), ("cards", card), ("diagnostics", issue), ("strict", pa.bool_())]))

    return _files(spark, path).select("path", "length", "content").mapInArrow(run, HEADERS)


def read_samples(spark: SparkSession, path: str, region: tuple[int, int, int, int] | None = None, band_rows: int = 256) -> DataFrame:
    """``(path, plane, y, x, value, flags)`` of all images below ``path``; ``region`` is (y0, x0, height, width).

    Only the rows and columns of the region are decoded; a band of rows is one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shape = layout(parse_header(data))
                y0, x0, h, w = region or (0, 0, shape.height, shape.width)
                require(y0 >= 0 and x0 >= 0 and y0 + h <= shape.height and x0 + w <= shape.width, "the region is outside of the image")
                for plane in range(shape.planes):
                    for top in range(y0, y0 + h, band_rows):
                        rows = min(band_rows, y0 + h - top)
                        values, flags = physical(data, shape, (plane * shape.height + top) * shape.width, rows * shape.width)
                        values, flags = (a.reshape(rows, shape.width)[:, x0 : x0 + w].ravel() for a in (values, flags))
                        n = rows * w
                        y = np.repeat(np.arange(top, top + rows, dtype=np.int32), w)
                        x = np.tile(np.arange(x0, x0 + w, dtype=np.int32), rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * n), pa.array(np.full(n, plane, np.int32)), pa.array(y), pa.array(x), pa.array(values), pa.array(flags)], ["path", "plane", "y", "x", "value", "flags"]
                        )

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, plane int, y int, x int, value double, flags smallint")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Byte length and SHA-256 of each file."""
    return _files(spark, path, "*").select("path", F.col("length").alias("byte_length"), F.sha2("content", 256).alias("sha256"))


def encode_images(samples: DataFrame, provenance: dict | None = None) -> DataFrame:
    """``(stack_id, frame_id, content)``: one encoded file per frame; the frame is the unit of a file."""
    schema = "stack_id int, frame_id long, content binary"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        planes, height, width = (int(pdf[c].max()) + 1 for c in ("plane", "y", "x"))
        values, flags = np.full((planes, height, width), np.nan), np.full((planes, height, width), MISSING)
        at = pdf["plane"].to_numpy(), pdf["y"].to_numpy(), pdf["x"].to_numpy()
        values[at], flags[at] = pdf["value"].to_numpy(), pdf["flags"].to_numpy()
        return pd.DataFrame({"stack_id": [key[0]], "frame_id": [key[1]], "content": [encode_f64(values, flags, provenance)]})

    return samples.groupBy("stack_id", "frame_id").applyInPandas(run, schema)


def decode_images(files: DataFrame) -> DataFrame:
    """Samples of ``(stack_id, frame_id, content)``: the inverse of ``encode_images``, up to what a file can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stack, frame, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                shape = layout(parse_header(data))
                values, flags = physical(data, shape)
                plane, y, x = (a.ravel().astype(np.int32) for a in np.indices((shape.planes, shape.height, shape.width)))
                n = shape.samples
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, stack, np.int32)), pa.array(np.full(n, frame, np.int64)), pa.array(plane), pa.array(y), pa.array(x), pa.array(values), pa.array(flags)],
                    ["stack_id", "frame_id", "plane", "y", "x", "value", "flags"],
                )

    return files.select("stack_id", "frame_id", "content").mapInArrow(run, "stack_id int, frame_id long, plane int, y int, x int, value double, flags smallint")


def publish(spark: SparkSession, products: dict[str, bytes], directory: str) -> list[str]:
    """Write a set of products all or nothing: staged beside the target, then renamed; nothing is overwritten."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    # A folder of this call alone, so that two writers don't meet in it.
    staging = f"{directory}/.staging-{uuid.uuid4().hex}"
    stage = jvm.org.apache.hadoop.fs.Path(staging)
    done = []
    for name in products:
        require(not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}")), f"{name} exists")
    try:
        for name, data in products.items():
            out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{staging}/{name}"), False)
            out.write(bytearray(data))
            out.close()
        for name in products:
            target = jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}")
            require(fs.rename(jvm.org.apache.hadoop.fs.Path(f"{staging}/{name}"), target), f"{name} could not be published")
            done.append(target)
    except BaseException:
        for target in done:
            fs.delete(target, False)
        raise
    finally:
        fs.delete(stage, True)
    return [f"{directory}/{name}" for name in products]


def parse_alignment_xml(text: str) -> dict:
    """``version, width, height, channels, origin, matrix`` of an alignment file; its matrix maps reference to source."""
    import xml.etree.ElementTree as tree

    require(len(text) <= 8 << 20, "the file is too large")
    require("<!DOCTYPE" not in text and "<!ENTITY" not in text, "declarations are not allowed")
    root = tree.fromstring(text)
    name = lambda node: node.tag.rsplit("}", 1)[-1]
    require(name(root) == "xdrz" and root.get("version") is not None, "the root must be a versioned xdrz")

    def only(wanted: str):
        found = [node for node in root if name(node) == wanted]
        require(len(found) == 1, f"one {wanted} is needed")
        return found[0]

    size, matrix = only("ReferenceGeometry"), only("AlignmentMatrix")
    require(len(matrix) == 0, "the matrix must be text only")
    numbers = [float(v) for v in (matrix.text or "").replace(",", " ").replace(";", " ").split()]
    require(len(numbers) == 9 and bool(np.isfinite(numbers).all()), "nine finite numbers are needed")
    width, height, channels = (int(size.get(k, "0")) for k in ("width", "height", "numberOfChannels"))
    require(min(width, height, channels) > 0, "the geometry must be positive")
    origin = [node for node in root if name(node) == "AlignmentOrigin"]
    at = (float(origin[0].get("x")), float(origin[0].get("y"))) if origin else (0.0, 0.0)
    return {"version": root.get("version"), "width": width, "height": height, "channels": channels, "origin": at, "matrix": np.array(numbers).reshape(3, 3)}


def compare_alignment(alignment: dict, transform, divisions: int = 4) -> dict[str, float]:
    """Distances between an alignment file and a transform on a grid over the reference: count, RMS, maximum, centre."""
    steps = np.arange(divisions + 1) / divisions
    x, y = (a.ravel() for a in np.meshgrid((alignment["width"] - 1) * steps, (alignment["height"] - 1) * steps))
    ox, oy = alignment["origin"]
    u, v, w = np.linalg.inv(alignment["matrix"]) @ np.stack([x - ox, y - oy, np.ones_like(x)])
    require(bool((w != 0).all()), "the alignment has a horizon in the image")
    p, q = transform.apply(x, y)
    apart = np.hypot(u / w + ox - p, v / w + oy - q)
    return {"count": len(apart), "rms": float(np.sqrt((apart**2).mean())), "maximum": float(apart.max()), "centre": float(apart[len(apart) // 2])}
