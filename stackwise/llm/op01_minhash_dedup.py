"""Near-duplicate detection with bottom-k sketches of one hash function.

1. *Sketch.*  A document's set holds the hashes of its distinct 5-word shingles; the sketch is the ``SKETCH`` smallest.
   Documents with equal sets become one node, so exact copies cost nothing from here on.
2. *Inverted lists.*  Retained values that at least two nodes have are posted.  Two sets with Jaccard 0.75 share about
   three quarters of their sketches and at least ``SHARED`` of it but for a six-sigma event.  A node therefore only
   posts its rarest values, as many as must contain a shared one (prefix filtering): passages that many documents
   have are the most frequent values and are not posted by documents that hold much else.
3. *Overlaps.*  Only components are wanted, so a list first meets its pivot, the node whose values are the most
   frequent: each other node is paired with the pivot that it shares most posted values with, one pair a node.  Then
   lists of up to ``SHORT`` nodes pair what is still apart.
4. *Long lists* whose nodes are still in several components are refined: their nodes post shingles of their full
   sets, the rarest first, with the position.  A pair that first meets at positions ``i`` and ``j`` can share at most
   ``n - i`` and ``m - j`` shingles, and a link needs 3/7 of ``n + m``: so a node only meets nodes of a few sizes, and in
   the list of a shingle that nearly all copies have, only those that have hardly anything else.  These are the ones
   that pivots connect, in rounds for as long as a round connects much.  What is then left to compare are pairs of
   different components whose positions and sizes allow a link, found by a join on shingle and size class.
5. *Filter and verify.*  The union sketch of a pair (the smallest values of both sketches) estimates its Jaccard; six
   sigma below the threshold are let through.  The rest is verified on the full sets.  All pairs of 3 and 4 take both.
6. *Components* by alternating large-star and small-star joins over the verified links.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z.  With one to four words the whole sequence is
the one shingle.  Null, empty and blank texts have the empty set and are linked with nothing.  A row with null id is
returned with its set size, null component and ``kept`` true.  Rows that repeat id and text fall together; rows that
repeat an id with another text are documents of their own, with their own sets, links and component.  An empty table
gives an empty result.  Only the id and the text are read; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, PolyHash, Scratch, chunks, free_name, mix, read_table, utf8, word_spans

WORDS = 5
#: Links have ``100 * intersection >= PERCENT * union``.
PERCENT = 75
SKETCH = 64
#: Part of a sketch that linked sets share at least: 0.75 less six sigma of 64 draws.
SHARED = 0.42
#: Nodes of a list that are compared without refining it.
SHORT = 8
#: A round of pivots is followed by another if it connects more than this part of the nodes that are left.
WORTHWHILE = 0.02


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: PolyHash) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each document."""
    for lo, hi in chunks(offsets):
        base = offsets[lo]
        buf = LOWER[data[base : offsets[hi]]]
        starts, ends, doc = word_spans(buf, offsets[lo : hi + 1] - base)
        words = hasher.ranges(hasher.prefix(buf), starts, ends)
        n = len(words)
        full = np.zeros(0, np.uint64)
        if n >= WORDS:
            full = np.zeros(n - WORDS + 1, np.uint64)
            for j in range(WORDS):
                full = mix(full + words[j : n - WORDS + 1 + j])
        full = full.view(np.int64)
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        for d in range(hi - lo):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= WORDS:
                yield np.unique(full[a : b - WORDS + 1])
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    h = mix(h + words[j : j + 1])
                yield h.view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def sketches(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """``doc_id, h, n_shingles, a, b, sketch`` of ``docs`` (doc_id, h, text): ``(a, b, n_shingles)`` names the set, 128 bits and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = PolyHash()
        for batch in batches:
            n, a, b, small = [], [], [], []
            for s in shingle_sets(*utf8(batch.column(2)), hasher):
                u = s.view(np.uint64)
                n.append(len(s))
                a.append(int(mix(u + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                b.append(int(np.bitwise_xor.reduce(mix(u ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0)).view(np.int64)))
                small.append(s[:k])
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), _lists(small)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n_shingles", "a", "b", "sketch"])

    return docs.mapInArrow(run, "doc_id long, h long, n_shingles long, a long, b long, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """``node, full`` of ``docs`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = PolyHash()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids, held, size, at = batch.column(0), [], 0, 0
            for i, s in enumerate(shingle_sets(data, offsets, hasher)):
                held.append(s)
                size += len(s)
                if size > 1 << 19 or i == len(ids) - 1:  # sets of a batch leave in parts of a few MB
                    yield pa.RecordBatch.from_arrays([ids.slice(at, i + 1 - at), _lists(held)], ["node", "full"])
                    held, size, at = [], 0, i + 1

    return docs.mapInArrow(run, "node long, full array<long>")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of every node in ``edges`` (u, w); the component is its smallest node.

    Large-star links each node's larger neighbours to its smallest one, small-star the others; both only rewrite
    edges, and the rounds grow with the logarithm of the number of nodes.
    """
    def written(df: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        df = df.filter("u <> w").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)")).alias("sum"))
        return scratch.table(df), seen.get

    edges, mark = written(edges.select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")))
    while mark["n"]:
        both = edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("w").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.filter("w > u").join(low, F.col("u") == F.col("x")).select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("w").alias("m"))
        small = large.join(low, F.col("u") == F.col("x"))
        small = small.select(F.col("w").alias("u"), F.col("m").alias("w")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("w")))
        new, now = written(small)
        scratch.drop(edges)
        edges = new
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("w").alias("component")).unionByName(
        edges.select(F.col("w").alias("node"), F.col("w").alias("component")).distinct()
    )


def _passes(left, right, n_left, n_right):
    """Union-sketch estimate: the Jaccard of two sets is that of the smallest values of both sketches."""
    union = F.slice(F.array_sort(F.array_union(left, right)), 1, SKETCH)
    top = F.element_at(union, -1)
    shared = F.size(F.filter(F.array_intersect(left, right), lambda x: x <= top))
    return (100 * F.least(n_left, n_right) >= PERCENT * F.greatest(n_left, n_right)) & (shared >= F.floor(SHARED * F.size(union)))


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct ``pairs`` (u, w) whose union sketch lets them through and whose full sets reach the threshold."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n_shingles").alias(f"n{k}"))
    met = pairs.join(side("u"), "u").join(side("w"), "w")
    likely = scratch.table(met.filter(_passes(F.col("su"), F.col("sw"), F.col("nu"), F.col("nw"))).select("u", "w", "nu", "nw"))
    full = lambda k: sets.select(F.col("node").alias(k), F.col("full").alias(f"f{k}"))
    shared = F.size(F.array_intersect("fu", "fw"))
    linked = (100 + PERCENT) * shared >= PERCENT * (F.col("nu") + F.col("nw"))
    out = scratch.table(likely.join(full("u"), "u").join(full("w"), "w").filter(linked).select("u", "w"))
    scratch.drop(likely)
    return out


def _relabelled(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label`` after more links: components of the labels, then the labels of the nodes."""
    if links.isEmpty():
        return labels
    side = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    joined = connected_components(links.join(side("u"), "u").join(side("w"), "w").select(F.col("lu").alias("u"), F.col("lw").alias("w")), scratch)
    joined = joined.withColumnRenamed("node", "x")
    new = scratch.table(labels.join(joined, F.col("label") == F.col("x"), "left").select("node", F.coalesce("component", "label").alias("label")))
    scratch.drop(labels, links)
    return new


def _ranked(values: DataFrame, scratch: Scratch) -> DataFrame:
    """``v, node, n, count, i`` of ``values`` (v, node, n): values that several nodes have, and their place among the node's.

    The rarest come first; values that no other node has come before all of these.
    """
    common = scratch.table(values.groupBy("v").count().filter("count > 1"))
    order = W.partitionBy("node").orderBy("count", "v")
    alone = F.col("n") - F.count(F.lit(1)).over(W.partitionBy("node"))
    return values.join(common, "v").withColumn("i", alone + F.row_number().over(order) - 1)


def _open(lists: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``lists`` with the ``label`` of each node, and the ``size`` of its list; lists of one component are left out."""
    members = lists.join(labels, "node")
    shape = members.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return scratch.table(members.join(shape.select("v", "size"), "v"))


def _star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each node with the pivot that it shares most lists with: ``u, w``, one pair a node, no matter how long the lists are.

    The pivot of a list is the node with the most frequent values, in later turns one by hash: any of the largest component then.
    """
    score = F.col("weight") if turn == 0 else F.xxhash64("node", F.lit(turn)).cast("double")
    pivot = members.groupBy("v").agg(F.max(F.struct(score.alias("score"), "node", "label")).alias("best"))
    pivot = pivot.select("v", F.col("best.node").alias("pivot"), F.col("best.label").alias("to"))
    overlaps = members.join(pivot, "v").filter("label <> to").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("overlap"))
    best = overlaps.groupBy("node").agg(F.max(F.struct("overlap", "pivot")).alias("best")).select("node", "best.pivot")
    return best.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("w")).distinct()


def _short_pairs(members: DataFrame) -> DataFrame:
    """All pairs of different components in lists of up to ``SHORT`` nodes."""
    short = members.filter(F.col("size") <= SHORT)
    other = short.select(F.col("v").alias("v2"), F.col("node").alias("w"), F.col("label").alias("l2"))
    met = short.join(other, (F.col("v") == F.col("v2")) & (F.col("node") < F.col("w")) & (F.col("label") != F.col("l2")))
    return met.select(F.col("node").alias("u"), "w").distinct()


def _size_class(n):
    """Sizes within about three percent of each other."""
    return F.floor(33 * F.ln(n)).cast("int")


def _refined(long_: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``v, node, n, i, most, weight``: the lists of shingles of the full sets of all nodes in ``long_``.

    ``i`` is the shingle's place in the node's order and ``most`` the size of the largest set with which the node can be
    linked if this is the first shingle that they share: ``7 (n - i) >= 3 (n + most)``.  Shingles that are too late for
    any partner are not posted.
    """
    hot = sets.join(long_.select("node").distinct(), "node", "left_semi")
    values = scratch.table(hot.select("node", F.size("full").cast("long").alias("n"), F.explode("full").alias("v")))
    ranked = _ranked(values, scratch).withColumn("most", F.floor((4 * F.col("n") - 7 * F.col("i")) / 3))
    weight = F.sum("count").over(W.partitionBy("node")) / F.col("n")
    ranked = ranked.withColumn("weight", weight).filter("4 * most >= 3 * n")
    out = scratch.table(ranked.select("v", "node", "n", "i", "most", "weight"))
    scratch.drop(values)
    return out


def _position_pairs(members: DataFrame) -> DataFrame:
    """Pairs of different components in refined lists that positions and sizes allow to be linked.

    The larger set looks for the smaller one.  Most members of a long list are in one component; they don't meet each
    other at all: nodes outside that component meet all, nodes inside only those outside.
    """
    small = members.filter("most >= n").select("v", _size_class(F.col("n")).alias("c"), F.col("node").alias("w"), F.col("label").alias("lw"), F.col("n").alias("nw"), F.col("most").alias("mw"))
    kinds = small.groupBy("v", "c", "lw").count().groupBy("v", "c").agg(F.max(F.struct("count", "lw")).alias("best"), F.count(F.lit(1)).alias("kinds"))
    kinds = kinds.select("v", "c", F.col("best.lw").alias("main"), "kinds")
    upto = F.least("n", "most")
    large = members.withColumn("c", F.explode(F.sequence(_size_class(F.ceil(0.75 * F.col("n"))), _size_class(upto))))
    large = large.select("v", "c", "node", "label", "n", upto.alias("upto")).join(kinds, ["v", "c"]).filter("kinds > 1 OR label <> main")
    fits = "label <> lw AND nw <= upto AND 4 * nw >= 3 * n AND n <= mw AND (n > nw OR node < w)"
    outside = large.filter("label <> main").join(small, ["v", "c"]).filter(fits)
    inside = large.filter("label = main").join(small.join(kinds, ["v", "c"]).filter("lw <> main").drop("main", "kinds"), ["v", "c"]).filter(fits)
    pairs = outside.select("node", "w").unionByName(inside.select("node", "w"))
    return pairs.select(F.least("node", "w").alias("u"), F.greatest("node", "w").alias("w")).distinct()


def _components(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """``node, label`` of all nodes that are linked or could be; ``nodes``: node, n_shingles, sketch; ``texts`` gives (node, text)."""
    values = nodes.select("node", F.size("sketch").cast("long").alias("n"), F.explode("sketch").alias("v"))
    ranked = _ranked(values, scratch)
    weight = (F.sum("count").over(W.partitionBy("node")) / F.col("n")).alias("weight")
    posted = F.col("i") <= F.col("n") - F.greatest(F.lit(1), F.floor(SHARED * F.col("n")))
    posts = scratch.table(ranked.select("v", "node", weight, posted.alias("posted")).filter("posted").drop("posted"))
    labels = scratch.table(posts.select("node").distinct().select("node", F.col("node").alias("label")))
    lists = _open(posts, labels, scratch)
    scratch.drop(posts)
    sets = scratch.table(full_sets(texts(lists.select("node").distinct())))
    links = _links(_star_pairs(lists, 0), nodes, sets, scratch)
    labels = _relabelled(labels, links, scratch)
    again = _open(lists.drop("label", "size"), labels, scratch)
    scratch.drop(lists)
    links = _links(_short_pairs(again), nodes, sets, scratch)
    labels = _relabelled(labels, links, scratch)
    long_ = again.filter(F.col("size") > SHORT).drop("label", "size")
    long_ = _open(long_, labels, scratch)
    scratch.drop(again)
    if long_.isEmpty():
        return labels
    lists, turn = _refined(long_, nodes, sets, scratch), 0
    scratch.drop(long_)
    scratch.release()
    while True:
        members = _open(lists, labels, scratch)
        links = _links(_star_pairs(members, turn), nodes, sets, scratch)
        found, left = links.count(), members.agg(F.count_distinct("node")).first()[0]
        labels = _relabelled(labels, links, scratch)
        scratch.drop(members)
        turn += 1
        if found <= WORTHWHILE * left:
            break
    members = _open(lists, labels, scratch)
    labels = _relabelled(labels, _links(_position_pairs(members), nodes, sets, scratch), scratch)
    scratch.drop(members, lists, sets)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, h`` (``h`` tells texts of one id apart)."""
    scratch = Scratch(docs.sparkSession, "near")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    sketched = scratch.table(sketches(docs))
    set_of = ["a", "b", "n_shingles"]
    held = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    named = held.groupBy(*set_of).agg(F.min(F.struct("doc_id", "h")).alias("one"), F.first("sketch").alias("sketch"))
    # Written once, so that the numbers stay what they are.
    nodes = scratch.table(named.select(F.monotonically_increasing_id().alias("node"), *set_of, F.col("one.doc_id").alias("least"), "one.h", "sketch"))
    names = nodes.select("node", F.col("least").alias("doc_id"), "h")

    def texts(wanted: DataFrame) -> DataFrame:
        rows = docs.join(names.join(wanted, "node", "left_semi"), ["doc_id", "h"])
        return rows.dropDuplicates(["doc_id", "h"]).select("node", "text")

    labels = _components(nodes.select("node", "n_shingles", "sketch"), texts, scratch)
    labelled = nodes.select("node", *set_of, "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = scratch.table(labelled.drop("node"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    component = scratch.table(labelled.join(least, "label").select(*set_of, "component"))
    ids = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    known = sketched.filter(ids).select("doc_id", "h", *set_of).join(component, set_of)
    known = known.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "h")
    other = sketched.filter(~ids).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "h")
    out = known.unionByName(other)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "h")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest id stays."""
    gone, text = free_name(docs, "_gone"), free_name(docs, "_h")
    out = near_duplicates(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias(gone), F.col("h").alias(text)).distinct()
    return docs.join(out, (F.col(id_col).cast("long") == F.col(gone)) & (F.xxhash64(text_col) == F.col(text)), "left_anti")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("h")
