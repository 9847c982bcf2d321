"""SimHash near-duplicates by covering locality-sensitive hashing (operator 10).

A fingerprint has the majority bits of its shingles' XXH64. Linking: give each of
the 64 bit positions a random vector over GF(2) of r + 1 dimensions; every
non-zero vector v selects the positions whose inner product with v is 1 as a
mask. Any r positions leave some v orthogonal to all of them, so two fingerprints
that differ in at most r bits agree under some mask: no pair is missed. Each of
the 2**(r+1) - 1 masks is a table; buckets are sorted runs of distinct
fingerprints, verified inside the task, and give a spanning forest instead of
pairs. Buckets beyond RUN_LIMIT are counted out before any task holds one and go
another exact way (``_linked_by_neighbours``). Components come from edge
contraction in rounds that grow with the logarithm of the nodes.

Null texts count as empty. Texts without words have fingerprint zero and are
linked like any other. Rows with equal fingerprints are one node, so copies cost
nothing more. Null ids get a component like others but never name one (a class
of null ids alone has a null component). Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import discard, hex_id, map_arrow, materialise

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Distinct fingerprints of one bucket that are compared inside one task (256 KB).
RUN_LIMIT = 32_768


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text (bytes.lower and bytes.split know ASCII letters and white space only)."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(line)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(major, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id long, fp long`` (the 64 bits as a signed long), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py() or "", shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> list[int]:
    """Masks such that any two words within ``radius`` agree under at least one."""
    # balanced: each non-zero vector is dealt to about equally many positions
    rng = np.random.default_rng(seed)
    vectors = np.resize(np.arange(1, 1 << (radius + 1)), bits)
    rng.shuffle(vectors)
    return [sum(1 << i for i, v in enumerate(vectors.tolist()) if (v & a).bit_count() & 1) for a in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints; found ones leave the search."""
    edges: list[tuple[int, int]] = []
    left = fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(int(x), int(y)) for y in found]
                queue += list(found)
    return edges


def _link_runs(radius: int):
    """Streams (t, k, fp) sorted by (t, k): links (a, b) inside each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the open run's fingerprints
        key = None

        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*edges, strict=True)], names=["a", "b"])

        def close() -> list[tuple[int, int]]:
            return _forest(np.concatenate(held), radius) if held else []

        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False)
            k = batch.column(1).to_numpy(zero_copy_only=False)
            fp = np.ascontiguousarray(batch.column(2).to_numpy(zero_copy_only=False)).view(np.uint64)
            if not len(t):
                continue
            cuts = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1, [len(t)]])
            edges: list[tuple[int, int]] = []
            lengths = np.diff(cuts)
            # runs of one row inside the batch have no link: only the first, the last and longer ones matter
            for n in sorted({0, len(lengths) - 1, *np.flatnonzero(lengths > 1).tolist()}):
                i, j = int(cuts[n]), int(cuts[n + 1])
                here = (int(t[i]), int(k[i]))
                if here != key:
                    edges += close()
                    key, held = here, []
                held.append(fp[i:j])
            if edges:
                yield out(edges)
        if edges := close():
            yield out(edges)

    return run


def _linked_by_neighbours(hot: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """All links among fingerprints of oversized buckets, in rows linear in their number.

    Two members of a bucket differ only outside its mask. If they are within
    ``radius``, flipping up to radius // 2 of those bits in one and the rest in
    the other meets in a common word. At every word that someone reaches by
    radius // 2 flips or fewer, that one is within the radius of all who reach
    it, so one star through it links exactly what is connected there.
    """
    near, far = radius // 2, radius - radius // 2
    parts = None
    for t, mask in enumerate(masks):
        free = [i for i in range(64) if not mask >> i & 1]
        flips = [(n, sum(1 << i for i in c)) for n in range(far + 1) for c in combinations(free, n)]
        words = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col("a").bitwiseXOR(F.lit(_signed(x))).alias("word")) for n, x in flips)))
        part = hot.filter(F.col("t") == t).select("a", words.alias("w")).select("a", "w.n", "w.word")
        parts = part if parts is None else parts.unionByName(part)
    hubs = parts.groupBy("word").agg(F.min(F.when(F.col("n") <= near, F.col("a"))).alias("hub"), F.count("*").alias("m")).filter("hub is not null and m > 1")
    return parts.join(hubs, "word").filter("a <> hub").select("a", F.col("hub").alias("b")).distinct()


def links(nodes: DataFrame, radius: int = RADIUS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``radius``; ``nodes``: distinct ``fp``."""
    masks = covering_masks(radius)
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks))))
    rows = nodes.select("fp", tables.alias("x")).select("x.t", "x.k", "fp")
    hot = None
    if nodes.count() > run_limit:  # no bucket is larger than all fingerprints
        over = materialise(rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter(F.col("n") > run_limit).select("t", "k"), "over")
        if not over.isEmpty():
            hot = rows.join(over, ["t", "k"], "left_semi").select(F.col("fp").alias("a"), "t")
            rows = rows.join(over, ["t", "k"], "left_anti").select("t", "k", "fp")
    edges = materialise(map_arrow(rows.repartition("t", "k").sortWithinPartitions("t", "k"), _link_runs(radius), "a long, b long"), "links")
    return edges if hot is None else edges.unionByName(_linked_by_neighbours(hot, masks, radius))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node of an edge, the least member of its component.

    A round gives nodes random ranks, lets each point to its neighbour of the
    least rank if that is less than its own, shortens the pointers twice, and
    rewrites the edges to the nodes pointed to, until no edge is left: each round
    leaves a fixed share of the nodes, on any graph. Then the pointers are followed
    back. All states are tables keyed by node.
    """
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        ranked = lambda c, n=len(maps): F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("x"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("node"), F.least(ranked("a"), "m")["x"].alias("to"))
        points = materialise(points, "points")
        for _ in range(2):
            long = points
            points = materialise(long.join(long.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")), "points")
            discard(long)
        maps.append(points)
        moved = edges.join(points.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(points.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        last, edges = edges, materialise(moved.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        discard(last)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for points in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("to"), F.col("to").alias("later"))
        out = materialise(points.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("to")), "roots")
    least = out.groupBy("to").agg(F.min("node").alias("root"))
    return out.join(least, "to").select("node", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``doc_id, fp, component_id``: one row per row; the component's smallest id names it."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, run_limit)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    digits: Column = hex_id("fp")
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")
