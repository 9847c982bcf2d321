"""Classes of texts with like shingles: the corpus pipeline's near-duplicates.

Two texts are linked if the Jaccard similarity of their sets of SHINGLE-word
shingles is FIFTHS fifths (0.8) or more; classes are the components of the links. Pairs are
proposed by operator 10's covering LSH over SimHash fingerprints of these shingles (all that
differ in up to 3 bits), and as most pairs at 0.8 differ in more, by least shingle hashes
in BANDS bands of ROWS each too (a pair at exactly 0.8 meets in none with a chance of 3 in
a million, a nearer one with less). All are verified on their whole shingle sets
(64-bit hashes), so that nothing else is linked.

A bucket's members are first verified with its least one. Where they are not in
one class after that, those of a bucket of up to FEW are verified with each other.
In larger buckets members are verified with one other member after another, the
least edited first (HUBS at most, as long as that links a share of them); what is
left apart is proposed by rare shingles: of two alike sets, ordered by how many of
these texts hold a shingle, the rarest fifth of each (and one more) have one in
common, whose places bound what they share; so no pair is lost, while passages that
many texts share propose nothing. Texts of equal shingle sets are one node, so copies cost nothing more.
Texts of fewer words are one shingle; null texts and texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text, neardup
from ._spark import discard, map_arrow, materialise

SHINGLE, FIFTHS, BANDS, ROWS = 5, 4, 24, 4
#: Members of a bucket of which all pairs may be verified: at most FEW / 2 for each row.
FEW = 16
#: Further members that a larger bucket's are verified with, and the share of pairs that must be alike for one more.
HUBS, FRUITFUL = 12, 0.05
#: Sizes of work only, without effect on results: bytes of text at once, bits that tell which texts are asked for.
_CHUNK, _PLACES = 1 << 19, 1 << 24
_RNG = np.random.default_rng(20240817)
_FLIP = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_TURN = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a batch, and their offsets."""
    words = _text.Words(data, offsets)
    hashes, at = _text.shingles(words.hashes(), words.first, SHINGLE)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(at)))


def bands(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's whole set (0 if empty), and its bucket in every band."""
    full = np.flatnonzero(np.diff(at))
    whole, keys = np.zeros(len(at) - 1, np.uint64), np.zeros((len(at) - 1, BANDS), np.uint64)
    if len(full):
        starts = at[:-1][full]
        whole[full] = np.add.reduceat(_text.mix(hashes + np.uint64(1)), starts)
        for band in range(BANDS):
            key = np.full(len(full), band + 1, np.uint64)
            for j in range(band * ROWS, (band + 1) * ROWS):
                key = _text.mix(key * _TURN[0] + np.minimum.reduceat((hashes ^ _FLIP[j]) * _TURN[j], starts))
            keys[full, band] = key
    return whole, keys


def simhashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of each text's set: the bits set in over half of its shingles' hashes (0 if empty)."""
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        bits = np.unpackbits(_text.mix(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        often = np.add.reduceat(bits, at[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(often * 2 > np.diff(at)[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in _text.chunks(batch.column(1), _CHUNK):
            hashes, at = shingle_sets(data, offsets)
            whole, keys = bands(hashes, at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(whole.view(np.int64)), pa.array(np.diff(at)), pa.array(simhashes(hashes, at).view(np.int64)), lists], names=["id", "whole", "size", "fp", "keys"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for i, j, data, offsets in _text.chunks(batch.column(2), _CHUNK):
            left, at = shingle_sets(data, offsets)
            held: dict[str, np.ndarray] = {}  # the texts on the other side, many of which are the same
            for r in range(i, j):
                text = batch.column(3)[r].as_py() or ""
                if text not in held:
                    held.clear()
                    raw = np.frombuffer(text.encode(), np.uint8)
                    held[text] = shingle_sets(raw, np.array([0, len(raw)]))[0]
                x, y = left[at[r - i] : at[r - i + 1]], held[text]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 5 * both >= FIFTHS * (len(x) + len(y) - both):
                    kept.append(r)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in (0, 1)], names=["a", "b"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, size, text) to a row for each shingle of the set."""
    for batch in batches:
        for i, j, data, offsets in _text.chunks(batch.column(2), _CHUNK):
            hashes, at = shingle_sets(data, offsets)
            own = [pa.array(np.repeat(batch.column(c).to_numpy()[i:j], np.diff(at))) for c in range(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(hashes.view(np.int64))], names=["id", "size", "shingle"])


def rare_shingles(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``members`` (id, size): (shingle, id, size, pos) of each one's rarest shingles, and (id, own): shingles that no other has.

    ``pos`` is the place in the order of rarity, behind the own ones.
    """
    some = asked_for(members.select("id"), texts).join(members.select("id", "size"), "id").select("id", "size", "text")
    every = materialise(map_arrow(some, _shingles, "id long, size long, shingle long"), "shingles")
    often = every.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    of_text = Window.partitionBy("id")
    own = F.col("size") - F.count("*").over(of_text)
    shared = every.join(often, "shingle").withColumn("own", own).withColumn("pos", F.row_number().over(of_text.orderBy("often", "shingle")) + F.col("own"))
    shared = materialise(shared.filter(F.col("pos") <= F.floor(F.col("size") * (5 - FIFTHS) / 5) + 1).select("shingle", "id", "size", "pos", "own"), "rare")
    alone = shared.groupBy("id").agg(F.first("own").alias("own"))  # without a shared one among the rarest: a fifth is its own
    central = materialise(members.select("id", "size").join(alone, "id", "left").select("id", F.coalesce("own", "size").alias("own")), "central")
    discard(every)
    return shared.drop("own"), central


def pairs_by_rare_shingles(members: DataFrame, rare: DataFrame) -> DataFrame:
    """(a, b) of ``members`` (id, root) in different classes that may be alike, by ``rare`` shingles.

    What two sets have before the first shingle they share in the order of rarity,
    they don't share; so its places bound what they can share at all.
    """
    x, y = (rare.join(members, "id").select("shingle", F.col("id").alias(c), F.col("size").alias(f"s{c}"), F.col("pos").alias(f"p{c}"), F.col("root").alias(f"r{c}")) for c in "ab")
    enough = f"{5 + FIFTHS} * (1 + least(sa - pa, sb - pb)) >= {FIFTHS} * (sa + sb)"
    same = F.expr("a > b and ra <> rb") & F.expr(enough)
    return x.withColumnRenamed("shingle", "x").join(y.withColumnRenamed("shingle", "y"), (F.col("x") == F.col("y")) & same).select("a", "b").distinct()


def _pairs(members: DataFrame, key: str) -> DataFrame:
    """(a, b) of members (key, id, size, root) with one key, in different classes, of sizes that alike sets can have."""
    x, y = (members.select(key, F.col("id").alias(c), F.col("size").alias(f"s{c}"), F.col("root").alias(f"r{c}")) for c in "ab")
    return x.join(y, key).filter(f"a > b and ra <> rb and 5 * least(sa, sb) >= {FIFTHS} * greatest(sa, sb)").select("a", "b").distinct()


def links_by_hubs(members: DataFrame, texts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Links, pairs tried, and ``members`` (k, id, size, root, own) of buckets that still have several classes, with their classes.

    In each step every bucket's members are verified with one of them, unless both are in one class: the one with the
    fewest shingles of its own that hasn't been it, as edited copies are likest to the least edited one.
    """
    found: list[DataFrame] = []
    tried: list[DataFrame] = []
    used = None
    for _ in range(HUBS):
        free = members if used is None else members.join(used, ["k", "id"], "left_anti")
        hubs = materialise(free.groupBy("k").agg(F.min(F.struct("own", "id", "root", "size")).alias("h")), "hubs")
        used = hubs.select("k", "h.id") if used is None else used.unionByName(hubs.select("k", "h.id"))
        far = members.join(hubs, "k").filter(f"root <> h.root and 5 * least(size, h.size) >= {FIFTHS} * greatest(size, h.size)")
        pairs = materialise(far.select(F.greatest("id", "h.id").alias("a"), F.least("id", "h.id").alias("b")).distinct(), "pairs")
        asked = pairs.count()
        if not asked:
            break
        good = verified(pairs, texts)
        found.append(good)
        tried.append(pairs)
        root = members.select("id", "root").distinct()
        edges = good.join(root.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        merged = neardup.components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("merged"))
        last, now = members, members.join(merged, "root", "left").select("k", "id", "size", F.coalesce("merged", "root").alias("root"), "own")
        apart = now.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("k")
        members = materialise(now.join(apart, "k", "left_semi"), "apart")
        discard(last)
        if good.count() < FRUITFUL * asked:
            break
    return found, tried, members


def pairs_by_fingerprints(nodes: DataFrame) -> DataFrame:
    """(a, b) of ``nodes`` (id, fp) that connect all whose fingerprints are chained by differences of up to 3 bits (covering LSH)."""
    hubs = materialise(nodes.groupBy("fp").agg(F.min("id").alias("hub")), "fingerprints")
    equal = nodes.join(hubs, "fp").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    near = neardup.links(hubs.select("fp"))
    of = lambda c: hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"h{c}"))
    near = near.join(of("a"), "a").join(of("b"), "b").select(F.greatest("ha", "hb").alias("a"), F.least("ha", "hb").alias("b"))
    return equal.unionByName(near)


def asked_for(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, text`` of the ids (and of a few more, by chance); only such texts travel."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(_PLACES)).cast("int").alias("place")
    asked = ids.select(place("id")).distinct().toArrow()["place"].to_numpy()  # at most _PLACES numbers
    bits = np.zeros(_PLACES, bool)
    bits[asked] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield batch.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    return materialise(map_arrow(texts.select("id", "text", place("id")), run, "id long, text string, place int").select("id", "text"), "asked")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are alike; ``texts``: id, text."""
    some = asked_for(pairs.select(F.explode(F.array("a", "b")).alias("id")), texts)
    both = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return materialise(map_arrow(both.select("a", "b", "x", "y"), _verify, "a long, b long"), "alike")


def firsts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` of the first (least) row of each class; ids are distinct longs."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = materialise(map_arrow(texts, _sketch, "id long, whole long, size long, fp long, keys array<long>"), "sketches")
    least = sketches.groupBy("whole", "size").agg(F.min("id").alias("id"))
    nodes = materialise(sketches.select("id", "size", "fp", "keys").join(least.select("id"), "id", "left_semi"), "nodes")
    every = nodes.filter("size > 0").select("id", "size", F.explode("keys").alias("k"))
    shared = every.groupBy("k").agg(F.min("id").alias("hub"), F.count("*").alias("m")).filter("m > 1").select("k", "hub")
    buckets = materialise(every.join(shared, "k"), "buckets")
    stars = buckets.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).unionByName(pairs_by_fingerprints(nodes.filter("size > 0")))
    stars = materialise(stars.distinct(), "stars")
    links = verified(stars, texts)
    roots = neardup.components(links)
    members = buckets.join(roots.withColumnRenamed("node", "id"), "id", "left").select("k", "id", "size", F.coalesce("root", "id").alias("root"))
    apart = members.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).filter("m > 2 and low <> high").select("k", "m")
    members = materialise(members.join(apart, "k"), "apart")
    rest = _pairs(members.filter(F.col("m") <= FEW), "k")
    tried, more = [stars], []  # pairs with the least one are known
    many = members.filter(F.col("m") > FEW).select("k", "id", "size", "root")
    if not many.isEmpty():
        ids = materialise(many.select("id", "size").distinct(), "many")
        some = asked_for(ids, texts)
        rare, central = rare_shingles(ids, some)
        more, others, left = links_by_hubs(materialise(many.join(central, "id").select("k", "id", "size", "root", "own"), "large"), some)
        tried += others
        rest = rest.unionByName(pairs_by_rare_shingles(left.select("id", "root").distinct(), rare)).distinct()
    rest = materialise(rest.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more.append(verified(rest, texts))
    if more:
        roots = neardup.components(reduce(DataFrame.unionByName, [links, *more]))
    return nodes.select("id").join(roots.filter("node <> root").select(F.col("node").alias("id")), "id", "left_anti")
