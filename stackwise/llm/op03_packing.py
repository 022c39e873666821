"""Packing documents into windows by non-negative least squares on the histogram of lengths.

Documents are tokenised and end with one more id.  Whole windows are cut off first, so every document leaves at most
one rest shorter than the window.  The histogram of rests has one bin per length.  Shallow combinations, two or three
lengths that fill a window exactly, are enumerated; non-negative least squares finds how often to repeat each so that
together they use up the histogram; the counts are rounded down, and what is left is packed greedily, best fit first.
The plan depends on the histogram alone.  Its size is bounded by the window, not by the corpus, so the driver makes it
and it is broadcast.  Each piece finds its place from its length and its rank among the pieces of that length.

Ranks come from counts of cells (length, salt of the id), so no length is ever ordered as a whole.

Defined results: a null text is an empty text, which is its end id alone.  Strings of special tokens in a text become
their special id, as the tokenizer does by default.  Null ids and repeated rows are pieces of their own.  An empty
table gives an empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast, read_table
from .op06_token_counts import byte_alphabet, merge_count

WINDOW, END_ID = 1024, 0
#: Rows in one cell of a length, and cells up to which their offsets are broadcast.
CELL_ROWS, SMALL_CELLS = 2_000, 100_000
PASSES = 400


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


@lru_cache(maxsize=8)
def joins_are_merges(path: str) -> bool:
    """Whether merging any two neighbours whose join is a token, the smallest id first, is the same as merging by the list.

    So it is if ids rise along the list and the listed merges make each token out of its own bytes.  For two neighbours
    without a merge of their own whose join is a token would have to come up in that token's bytes too, as the merges
    inside them don't depend on what is around, and would stay two there.
    """
    spec = _read(path)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        return False
    vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    ranks = {pair: i for i, pair in enumerate(merges)}
    return all(x < y for x, y in zip(made, made[1:])) and all(merge_count(list(token), ranks) == 1 for token in vocab if token not in special)


class Tokenizer:
    """Ids of a byte-level vocabulary file.

    Where joins are merges, which is checked for the whole vocabulary (``fast``), the faster of the two public encoders
    gives the same ids; otherwise the file's own library is used.  It is also used for each text that the faster one
    refuses: its regex engine gives up on runs of about a million blanks.
    """

    def __init__(self, path: str, fast: bool | None = None):
        self.path = path
        self.fast = self.slow = None
        if joins_are_merges(path) if fast is None else fast:
            import tiktoken

            spec = _read(path)
            vocab, back = spec["model"]["vocab"], {c: b for b, c in byte_alphabet().items()}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
            self.fast = tiktoken.Encoding(
                "vocabulary",
                pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
                mergeable_ranks=ranks,
                special_tokens=special,
            )

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the regex engine's stack is full
                pass
        if self.slow is None:
            import tokenizers

            self.slow = tokenizers.Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``): each document cut at multiples of the window."""

    fast = joins_are_merges(tokenizer)  # once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Tokenizer(tokenizer, fast)
        for batch in batches:
            row, start, length, crc, total, held, texts = [], [], [], [], [], [], batch.column(1)
            for i in range(len(texts)):
                ids = np.append(encoder.ids(texts[i].as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    row.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    if keep_ids:
                        held.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns, names = [*columns, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * keep_ids)


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window exactly, all of them present."""
    out = []
    for a in np.flatnonzero(present):
        if 2 * a <= window and present[window - a]:
            out.append(np.array([[0, a, window - a]]))
        b = np.arange(a, (window - a) // 2 + 1)
        c = window - a - b
        fits = (c >= b) & present[b] & present[np.clip(c, 0, window)]
        if fits.any():
            out.append(np.stack((np.full(fits.sum(), a), b[fits], c[fits]), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def repeat_counts(patterns: np.ndarray, histogram: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Non-negative least squares for ``patterns`` against ``histogram`` by accelerated projected gradients."""
    goal = histogram.astype(np.float64).copy()
    goal[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(patterns[:, k], x, len(goal)) for k in range(3))
        out[0] = 0  # the empty place of a pair
        return out

    reach = used(np.ones(len(patterns))).max(initial=1.0)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(passes):
        gap = used(y) - goal
        gradient = gap[patterns].sum(axis=1)
        new = np.maximum(0.0, y - gradient / (3 * reach))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is repeated; together they use every piece of ``histogram`` once."""
    left, out = histogram.astype(np.int64).copy(), []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    patterns = combinations(window, left > 0)
    if len(patterns):
        wanted = repeat_counts(patterns, left)
        whole = np.floor(wanted + 1e-9).astype(np.int64)
        for k in np.argsort(-wanted, kind="stable"):
            lengths = [int(n) for n in patterns[k] if n]
            times = min([int(whole[k]), *(int(left[n]) // lengths.count(n) for n in lengths)])
            if times > 0:
                for n in lengths:
                    left[n] -= times
                out.append((tuple(reversed(lengths)), times))
    # Greedy rest: the longest piece, then ever the longest that still fits; repeated while all of its pieces last.
    while left.any():
        space, chosen, spent = window, [], np.zeros_like(left)
        while True:
            fits = np.flatnonzero((left - spent)[: space + 1] > 0)
            if not len(fits):
                break
            n = int(fits[-1])
            chosen.append(n)
            spent[n] += 1
            space -= n
        times = min(int(left[n]) // int(spent[n]) for n in set(chosen))
        left -= spent * times
        out.append((tuple(chosen), times))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]], window: int) -> tuple[np.ndarray, ...]:
    """Sorted keys ``length * 2**44 + first rank`` with the first sequence and the offset of each run of places."""
    ranks, base, rows = np.zeros(window + 1, np.int64), 0, []
    for lengths, times in patterns:
        at = 0
        for n in lengths:
            rows.append(((n << 44) + int(ranks[n]), base, at))
            ranks[n] += times
            at += n
        base += times
    rows.sort()
    key, first, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return key, first, offset


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; offsets of a sequence are gapless from 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.table(pieces(docs, tokenizer, window, keep_ids))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most one row per length
        histogram[length] = n
    key, first, offset = places(plan(histogram, window), window)
    held = spark.sparkContext.broadcast((key, first, offset))  # bounded by the window
    salts = max(1, int(-(-histogram.max() // CELL_ROWS)))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    cells = cut.groupBy(F.col("length").alias("_n"), F.col("salt").alias("_s")).count()
    before = W.partitionBy("_n").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    cells = scratch.table(cells.select("_n", "_s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("n", F.row_number().over(order) - 1).join(
        checked_broadcast(cells, (window + 1) * salts, SMALL_CELLS), (F.col("length") == F.col("_n")) & (F.col("salt") == F.col("_s"))
    )
    names = [c for c in cut.columns if c != "salt"]
    ranked = ranked.select(*names, (F.col("first") + F.col("n")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, offset = held.value
        for batch in batches:
            wanted = (batch.column("length").to_numpy() << 44) + batch.column("rank").to_numpy()
            at = np.searchsorted(key, wanted, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(first[at] + wanted - key[at]), pa.array(offset[at])],
                [*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, schema + ", sequence_id long, `offset` long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
