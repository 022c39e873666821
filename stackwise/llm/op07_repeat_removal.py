"""Removal of every repeated 200-byte string, by column-wise construction of the collection's suffix order.

1. *Anchors.*  Among the ``GRAM``-byte strings of each 200-byte window the one with the smallest hash is its anchor, so
   equal windows have equal anchors at equal offsets.  Neighbouring windows with one anchor form a segment.  Only a
   segment whose anchor occurs elsewhere can hold a repeated window.
2. *Equal segments* (the same bytes around the same anchor, a 128-bit name) are repeated as a whole.
3. *Column-wise construction* for the segments that only share their anchor.  The distinct segments of a bucket are
   documents, aligned at their anchors.  One symbol of each document is inserted per round, from the last column to the
   first.  Taken in the suffix order so far, a round's symbols are the column's part of the collection's
   Burrows-Wheeler transform; sorting it stably within the anchors gives the next suffix order (the transform's
   last-to-first mapping), and updates the common prefix of neighbours: one more than the least common prefix between the two in
   the order of the round before.  Neighbours with 200 common bytes hold a repeated window.  The columns lie in a
   sequential external file, written once and read one column per round; a round keeps only order and prefixes.
   The full transform (one suffix for every byte of the corpus, as many rounds as the longest document) would read
   the whole collection once per byte of the longest text; aligned segments need 400 rounds whatever the input.
4. *Many distinct segments of one anchor* (more than ``MOST_ALIGNED``) aren't gathered: their windows are counted by
   their 128-bit names with the anchor's, in a distributed aggregation, which is exact as well.
5. *Removal.*  The byte ranges of each document are joined to its text and cut out.

A document is named by the hash of its id and text, so ids need not be unique.  Defined results: null text counts as
empty; texts under 200 bytes lose nothing; repeated rows are copies of each other and lose all their windows; strings
never cross documents; a null id is carried through.  Bytes are removed wherever the strings lie, so what remains need
not be valid UTF-8: it is a binary column.  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PolyHash, Scratch, chunks, read_table, text_or_empty, utf8

SPAN, GRAM = 200, 64
WINDOW = SPAN - GRAM + 1
#: Segments in one bucket of the construction, and distinct segments of one anchor that may be aligned in it.
BUCKET, MOST_ALIGNED = 16_000, 16_000
#: Bytes of columns that are kept in memory; more lie in a file of the executor's temporary folder.
COLUMN_BYTES = 1 << 26


def _slide(a: np.ndarray, pick, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over each window of ``width`` elements, at its first element."""
    out, step = a.copy(), 1
    while 2 * step <= width:
        out[:-step] = pick(out[:-step], out[step:])
        step *= 2
    if width > step:
        rest = width - step
        out[:-rest] = pick(out[:-rest], out[rest:])
    return out


def segments(data: np.ndarray, at: np.ndarray, gram: PolyHash, whole: PolyHash):
    """``doc, start, end, anchor, f, g`` of all segments in the documents that ``at`` bounds.

    Starts, ends and anchors are positions in the document; ``f`` names the anchor's string, ``g`` the segment.
    """
    n, none = len(data), (np.zeros(0, np.int64),) * 6
    if n < SPAN:
        return none
    prefix = gram.prefix(data)
    first = np.arange(n - GRAM + 1)
    value = gram.ranges(prefix, first, first + GRAM) | np.uint64(1)
    least = _slide(value, np.minimum, WINDOW)[: n - SPAN + 1]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = doc[: n - SPAN + 1] == doc[SPAN - 1 :]
    least[~inside] = 0
    # Runs of neighbouring windows in one document that have one least value.
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.concatenate(([0], change))
    crossed = np.flatnonzero((doc[: n - SPAN + 1][1:] != doc[: n - SPAN + 1][:-1]) & (least[1:] == least[:-1]) & (least[1:] > 0)) + 1
    if len(crossed):
        starts = np.unique(np.concatenate((starts, crossed)))
    stops = np.concatenate((starts[1:], [len(least)]))
    good = least[starts] > 0
    starts, stops = starts[good], stops[good]
    if not len(starts):
        return none
    # The anchor of a window is the first place in it with the least value.  Where a run has several, it is divided.
    wanted, rank = np.unique(least[starts], return_inverse=True)
    where = np.searchsorted(wanted, value)
    hit = np.flatnonzero(wanted[np.minimum(where, len(wanted) - 1)] == value)
    key = where[hit] * (n + 1) + hit
    order = np.argsort(key, kind="stable")
    key, hit = key[order], hit[order]
    out_start, out_stop, out_anchor = [], [], []
    while len(starts):
        anchor = hit[np.searchsorted(key, rank * (n + 1) + starts)]
        stop = np.minimum(stops, anchor + 1)
        out_start.append(starts)
        out_stop.append(stop)
        out_anchor.append(anchor)
        more = stop < stops
        starts, stops, rank = stop[more], stops[more], rank[more]
    starts, stops, anchor = map(np.concatenate, (out_start, out_stop, out_anchor))
    ends = stops + SPAN - 1
    g = whole.ranges(whole.prefix(data), starts, ends) + (anchor - starts).astype(np.uint64)
    d = doc[starts]
    return d, starts - at[d], ends - at[d], anchor - at[d], value[anchor].view(np.int64), g.view(np.int64)


def anchored(docs: DataFrame) -> DataFrame:
    """``u, v, lo, hi, p, f, g`` for the segments of ``docs`` (u, v, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, whole = PolyHash(1), PolyHash(2)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in chunks(offsets):
                base = offsets[a]
                d, lo, hi, p, f, g = segments(data[base : offsets[b]], offsets[a : b + 1] - base, gram, whole)
                if len(d):
                    at = pa.array(d + a)
                    columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x.astype(np.int32)) for x in (lo, hi, p)), pa.array(f), pa.array(g)]
                    yield pa.RecordBatch.from_arrays(columns, ["u", "v", "lo", "hi", "p", "f", "g"])

    return docs.mapInArrow(run, "u long, v long, lo int, hi int, p int, f long, g long")


def aligned_repeats(group: np.ndarray, left: np.ndarray, right: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which windows of aligned documents are repeated: ``(documents, WINDOW)`` booleans.

    Document ``i`` belongs to ``group[i]`` and covers columns ``-left[i]`` to ``right[i] - 1`` around its anchor.  Entry
    ``[i, k]`` is the window that starts in column ``k - (WINDOW - 1)``.
    """
    m, before, after = len(group), WINDOW - 1, SPAN
    marks = np.zeros((m, WINDOW), bool)
    order = np.argsort(group, kind="stable")
    name = group[order]
    rank = np.cumsum(np.concatenate(([True], name[1:] != name[:-1]))) - 1  # of the group, at each place of the order
    size = m * (before + after)
    with tempfile.TemporaryFile() as file:
        if size > COLUMN_BYTES:
            file.truncate(size)
            column = np.memmap(file, np.uint8, "r+", shape=(before + after, m))
        else:
            column = np.zeros((before + after, m), np.uint8)
        # Sequential columns: part by part of the documents, written once.
        for a in range(0, m, 4096):
            b = min(m, a + 4096)
            block = np.zeros((b - a, before + after), np.uint8)
            held = np.diff(offsets[a : b + 1])
            row = np.repeat(np.arange(b - a), held)
            place = np.arange(offsets[a], offsets[b]) - np.repeat(offsets[a:b], held) + np.repeat(before - left[a:b], held)
            block[row, place] = data[offsets[a] : offsets[b]]
            column[:, a:b] = block.T
        differ = np.full(m, after, np.int64)  # first column in which a document differs from its neighbour above
        for j in range(after - 1, -before - 1, -1):
            symbol = column[j + before][order].astype(np.int64)  # the transform: what stands before each suffix, in their order
            # Before its first and after its last column a document has a symbol that is like no other.
            present = (right[order] > j) & (left[order] >= -j)
            symbol[~present] = -1
            moved = np.argsort(rank * 257 + symbol, kind="stable")
            old, now = moved[:-1], moved[1:]
            same = (rank[old] == rank[now]) & (symbol[old] == symbol[now]) & present[now]
            new = np.full(m, j, np.int64)
            new[1:][same] = _least_between(differ, old[same] + 1, now[same])
            order, differ = order[moved], new
            if j <= 0:
                alike = np.zeros(m, bool)
                alike[1:] = same & (new[1:] - j >= SPAN)
                both = alike.copy()
                both[:-1] |= alike[1:]
                marks[order[both], j + before] = True
        del column
    return marks


def _least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of ``values[first..last]`` for each pair, from tables of powers of two."""
    out = values[last].copy()
    width = last - first + 1
    level, table = 0, values
    top = int(width.max(initial=1)).bit_length() - 1
    which = np.frexp(width.astype(np.float64))[1] - 1
    while True:
        at = np.flatnonzero(which == level)
        if len(at):
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << level) + 1])
        if level == top:
            return out
        step = 1 << level
        table = np.minimum(table[:-step], table[step:])
        level += 1


def _spans(marks: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges that the marked window starts cover."""
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(marks).tolist():
        if out and k <= out[-1][1]:
            out[-1] = (out[-1][0], k + SPAN)
        else:
            out.append((k, k + SPAN))
    return out


def _construct(table: pa.Table) -> pa.Table:
    """``f, g, a, b`` (byte ranges in the segment) of one bucket of distinct segments ``f, g, left, right, bytes``."""
    data, offsets = utf8(table["bytes"])
    left = table["left"].to_numpy().astype(np.int64)
    marks = aligned_repeats(table["f"].to_numpy(), left, table["right"].to_numpy().astype(np.int64), data, offsets)
    row, a, b = [], [], []
    for i in np.flatnonzero(marks.any(axis=1)).tolist():
        for x, y in _spans(marks[i]):
            row.append(i)
            a.append(x - (WINDOW - 1) + int(left[i]))
            b.append(y - (WINDOW - 1) + int(left[i]))
    names = table.select(["f", "g"]).combine_chunks().take(pa.array(row, pa.int64()))
    return pa.table([names["f"], names["g"], pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["f", "g", "a", "b"])


def _windows(cut: DataFrame) -> DataFrame:
    """``f, g, k, x, y``: window ``k`` of each segment and its 128-bit name, for anchors with too many segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = PolyHash(3), PolyHash(4)
        for batch in batches:
            data, offsets = utf8(batch.column("bytes"))
            left = batch.column("left").to_numpy().astype(np.int64)
            for a, b in chunks(offsets):
                base = offsets[a]
                part = data[base : offsets[b]]
                count = np.maximum(0, np.diff(offsets[a : b + 1]) - SPAN + 1)
                row = np.repeat(np.arange(a, b), count)
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                s = offsets[row] - base + k
                x = one.ranges(one.prefix(part), s, s + SPAN).view(np.int64)
                y = (two.ranges(two.prefix(part), s, s + SPAN) + (left[row] - k).astype(np.uint64)).view(np.int64)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("f").take(rows), batch.column("g").take(rows), pa.array(k.astype(np.int32)), pa.array(x), pa.array(y)],
                    ["f", "g", "k", "x", "y"],
                )

    return cut.mapInArrow(run, "f long, g long, k int, x long, y long")


def _cut(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``f, g, left, right, bytes`` for ``wanted`` (u, v, f, g, lo, hi, p) from the texts of ``docs`` (u, v, text)."""
    lists = wanted.groupBy("u", "v").agg(F.collect_list(F.struct("f", "g", "lo", "hi", "p")).alias("parts"))
    met = docs.join(lists, ["u", "v"]).select("text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            raw, parts = data.tobytes(), batch.column(1)
            flat = parts.flatten()
            f, g, lo, hi, p = (flat.field(k) for k in range(5))
            owner = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy())
            start = offsets[owner] + lo.to_numpy()
            stop = offsets[owner] + hi.to_numpy()
            left = (p.to_numpy() - lo.to_numpy()).astype(np.int32)
            right = (hi.to_numpy() - p.to_numpy()).astype(np.int32)
            for a in range(0, len(owner), 10_000):
                held = [raw[x:y] for x, y in zip(start[a : a + 10_000].tolist(), stop[a : a + 10_000].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [f.slice(a, 10_000), g.slice(a, 10_000), pa.array(left[a : a + 10_000]), pa.array(right[a : a + 10_000]), pa.array(held, pa.binary())],
                    ["f", "g", "left", "right", "bytes"],
                )

    return met.mapInArrow(run, "f long, g long, left int, right int, bytes binary")


def repeated_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, v, lo, hi``: byte ranges of ``docs`` (u, v, text) that repeated strings cover; ranges may overlap."""
    found = scratch.table(anchored(docs))
    shape = found.groupBy(F.col("f").alias("f1")).agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("least"), F.max("g").alias("most")).filter("n > 1")
    shape = scratch.table(shape.select("f1", (F.col("least") == F.col("most")).alias("uniform")))
    repeated = scratch.table(found.join(shape, F.col("f") == F.col("f1")).drop("f1"))
    scratch.drop(found)
    scratch.release()
    whole = repeated.filter("uniform").select("u", "v", "lo", "hi")
    mixed = repeated.filter("NOT uniform").drop("uniform")
    named = scratch.table(
        mixed.groupBy("f", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("u", "v", "lo", "hi", "p")).alias("one"))
    )
    count = scratch.table(named.groupBy(F.col("f").alias("f1")).agg(F.count(F.lit(1)).alias("kinds")))
    many = count.filter(F.col("kinds") > MOST_ALIGNED)
    wanted = named.select("one.u", "one.v", "f", "g", "one.lo", "one.hi", "one.p")
    cut = scratch.table(_cut(wanted, docs).dropDuplicates(["f", "g"]))
    total = cut.count()
    buckets = max(1, -(-total // BUCKET))
    few = cut.join(many, F.col("f") == F.col("f1"), "left_anti")
    ranges = (
        few.withColumn("bucket", F.pmod(F.xxhash64("f"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(_construct, "f long, g long, a int, b int")
    )
    ranges = scratch.table(ranges)
    if not many.isEmpty():
        names = _windows(cut.join(many, F.col("f") == F.col("f1"), "left_semi"))
        twice = names.groupBy(F.col("f").alias("f1"), F.col("x").alias("x1"), F.col("y").alias("y1")).count().filter("count > 1")
        hit = names.join(twice, (F.col("f") == F.col("f1")) & (F.col("x") == F.col("x1")) & (F.col("y") == F.col("y1")))
        ranges = ranges.unionByName(scratch.table(hit.select("f", "g", F.col("k").alias("a"), (F.col("k") + SPAN).alias("b"))))
    # A segment that occurs more than once is repeated as a whole; one that occurs once has the ranges found above.
    kinds = named.select(F.col("f").alias("f2"), F.col("g").alias("g2"), "n")
    tagged = mixed.join(kinds, (F.col("f") == F.col("f2")) & (F.col("g") == F.col("g2"))).drop("f2", "g2")
    tagged = scratch.table(tagged)
    spans = ranges.select(F.col("f").alias("f2"), F.col("g").alias("g2"), "a", "b")
    part = tagged.filter("n = 1").join(spans, (F.col("f") == F.col("f2")) & (F.col("g") == F.col("g2")))
    part = part.select("u", "v", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))
    out = scratch.table(whole.unionByName(tagged.filter("n > 1").select("u", "v", "lo", "hi")).unionByName(part))
    scratch.drop(repeated, named, cut, tagged)
    scratch.release()
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the remaining bytes) for each row."""
    scratch = Scratch(docs.sparkSession, "repeats")
    text = text_or_empty(text_col)
    # Rows are named by 128 bits of id and text; rows that repeat both are one text that occurs more than once.
    names = [F.xxhash64(F.col(id_col), text).alias("u"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("v")]
    docs = docs.select(F.col(id_col).alias("doc_id"), *names, text.alias("text"))
    ranges = repeated_ranges(docs.select("u", "v", "text"), scratch)
    lists = ranges.groupBy("u", "v").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    met = docs.join(lists, ["u", "v"], "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            size, removed, spans, sha, kept = [], [], [], [], []
            parts = batch.column(2)
            for i in range(len(parts)):
                text, cut, n = data[offsets[i] : offsets[i + 1]], 0, 0
                if parts[i].is_valid:
                    own = parts[i].values
                    lo, hi = own.field(0).to_numpy(), own.field(1).to_numpy()
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    cut = int(gone.sum())
                    n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = text[~gone]
                raw = text.tobytes()
                size.append(int(offsets[i + 1] - offsets[i]))
                removed.append(cut)
                spans.append(n)
                sha.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return met.mapInArrow(run, schema + ", kept binary" * keep_bytes)


def op7_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), keep_bytes=False)
