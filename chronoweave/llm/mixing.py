"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 4).

A row's size is its number of words. Rows of a source are dealt into blocks by a
hash of id and text and put in a permuted order of blocks; a source's target is
met by whole passes over its blocks, then by blocks in permuted order as far as
they fit, then by rows of the block at the border as far as they fit, then by
single rows, the longest that fits first, until none fits any more, and by one row
more where that comes nearer. The blocks so drawn are a population with one colour per source. A splitting tree over the
output shards halves the shards at every node and draws the left half's quota of
blocks from the node's population without replacement (multivariate
hypergeometric, exact at every size), so that every shard gets exact block quotas
near the mixture's proportions. Each source then deals its drawn blocks, in
permuted order and disjointly, to the shards, and rows are shuffled inside their
shard by a hash.

There are SHARDS shards at least and one for SHARD_WORDS words, and BLOCKS blocks
of a source at least and BLOCKS_A_SHARD for every shard. A block with far more
rows than others (a row that is repeated very often) is split by row number;
which of equal rows are taken then depends on the files' layout, all else depends
on the rows alone.

Weights are cyclic over the sources in code-point order, null last. A target
stops at MAX_REPEATS times its source's size; the excess is shared again by
weight. Null texts have size 0 and are never drawn, nor are rows of null or
repeated ids treated in any other way than others. An empty table gives an empty
mixture. Only the id, text and source columns are read. The driver holds one row
per source, the tree's quotas (sources x shards) and at most FILL single rows of a
source at a time, never all rows of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import kept, map_arrow, materialise, restored

WEIGHTS, MAX_REPEATS, SEED = (1, 2, 3), 3, 17
SHARDS, SHARD_WORDS, BLOCKS, BLOCKS_A_SHARD = 64, 1 << 30, 4096, 64
#: Most sources whose table, a row each, is broadcast.
BROADCAST = 10_000
#: Single rows of a source that a step of filling looks at; steps go on until none fits.
FILL = 1024
#: A block is split that has so many rows more, and so many times the rows of its source's mean block.
HOT_ROWS, HOT_TIMES = 64, 8
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Words to take of each source: shares of all words by weight, at most ``most`` times the source."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, left = set(order), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= full
        left = max(left, 0.0)
    return out


def _log_factorials(a: int, b: int) -> float:
    """ln b! - ln a!; beyond 2**20 by the difference of Stirling's series, which keeps what a difference of large logarithms loses."""
    if min(a, b) < 1 << 20:
        return math.lgamma(b + 1) - math.lgamma(a + 1)
    d = b - a
    return (b + 0.5) * math.log1p(d / a) + d * math.log(a) - d + (1 / b - 1 / a) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn without replacement, at any size: an urn for few draws, else ratio of uniforms.

    The rejection's box is Stadlober's for unimodal discrete distributions.
    """
    total = good + bad
    if 2 * n > total:
        return good - hypergeometric(rng, good, bad, total - n)
    if 2 * good > total:
        return n - hypergeometric(rng, bad, good, n)
    n, good = min(n, good), max(n, good)  # what is drawn and what is marked can change places
    bad = total - good
    if n < 10:
        got = 0
        for k in range(n):
            got += int(rng.integers(total - k)) < good - got
        return got
    mean = n * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)) + 0.5)
    box = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = (n + 1) * (good + 1) // (total + 2)
    while True:
        u = 1 - rng.random()
        x = mean + 0.5 + box * (rng.random() - 0.5) / u
        if not 0 <= x < n + 1:
            continue
        k = int(x)
        at = _log_factorials(k, mode) + _log_factorials(good - k, good - mode) + _log_factorials(n - k, n - mode) + _log_factorials(bad - n + k, bad - n + mode)
        if 2 * math.log(u) <= at:
            return k


def splitting_tree(quotas: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (row) for each shard (column); rows sum to the quotas."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(quotas), shards), np.int64)
    stack = [(0, shards, [int(q) for q in quotas])]
    while stack:
        a, b, here = stack.pop()
        if b - a == 1:
            out[:, a] = here
            continue
        mid = (a + b) // 2
        others = sum(here)
        n = others * (mid - a) // (b - a)
        left = []
        for colour in here:  # one colour after another: the multivariate distribution by its conditionals
            others -= colour
            left.append(hypergeometric(rng, colour, others, n))
            n -= left[-1]
        stack += [(mid, b, [x - y for x, y in zip(here, left, strict=True)]), (a, mid, left)]
    return out


def sized(docs: DataFrame, keep: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """Rows with ``uid, key (id), source, size, spot`` and the columns of ``keep`` as kept_0 …; materialised."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("key"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col("doc_id").cast("string"), text, F.lit(SEED)).alias("spot"), *kept(keep),
    )
    return materialise(rows, "sized")


def _in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows of size 1 or more (uid, sid, key, size, spot) with their ``block``; blocks of very many rows are split by row number."""
    rows = rows.filter("size > 0").select("uid", "sid", "key", "size", "spot", F.pmod("spot", F.lit(blocks)).alias("block"))
    counts = rows.groupBy("sid", "block").agg(F.count("*").alias("n"))
    usual = counts.groupBy("sid").agg((F.sum("n") / F.lit(blocks)).alias("usual"))
    most = F.lit(HOT_ROWS) + F.lit(HOT_TIMES) * F.col("usual")
    hot = counts.join(usual, "sid").filter(F.col("n") > most).select("sid", "block", F.ceil(F.col("n") / most).alias("parts"))
    hot = materialise(hot, "hot")
    if hot.isEmpty():
        return rows
    # at most blocks / HOT_TIMES of a source
    part = F.pmod(F.xxhash64("uid"), F.col("parts"))
    split = rows.join(F.broadcast(hot), ["sid", "block"], "left").withColumn("block", F.when(F.col("parts").isNull(), F.col("block")).otherwise(blocks + F.pmod(F.xxhash64("block", part), F.lit(1 << 50))))
    return split.drop("parts")


def _permuted(blocks: DataFrame, seed: int) -> DataFrame:
    """Blocks (sid, block, words …) with their place ``nth`` in the permuted order and the words ``before`` them.

    Sums run in two steps, over stretches of the order and inside each, so that no task has a whole source.
    """
    spot = F.xxhash64("sid", "block", F.lit(seed))
    rows = blocks.withColumn("spot", spot).withColumn("stretch", F.shiftright("spot", 57))
    sums = rows.groupBy("sid", "stretch").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    ahead = Window.partitionBy("sid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "stretch", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_before"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w_before"))
    inside = Window.partitionBy("sid", "stretch").orderBy("spot", "block")
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("before", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
    rows = rows.join(sums, ["sid", "stretch"]).withColumn("nth", F.col("nth") + F.col("n_before")).withColumn("before", F.col("before") + F.col("w_before"))
    return rows.drop("spot", "stretch", "n_before", "w_before")


def draw(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, int]:
    """(sources, draws, shards) for ``sized`` rows.

    ``sources``: source, source_size, target. ``draws``: uid, pass, shard, order —
    one row for every copy of a row that the mixture takes.
    """
    spark = rows.sparkSession
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes, weights)
    shards = shards or max(SHARDS, -(-sum(sizes.values()) // SHARD_WORDS))
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    whole = {s: min(MAX_REPEATS, int(goal[s] // sizes[s] + 1e-9)) if sizes[s] else 0 for s in names}
    rest = {s: goal[s] - whole[s] * sizes[s] if sizes[s] and whole[s] < MAX_REPEATS else 0.0 for s in names}
    table = [(i, s, sizes[s], float(goal[s]), whole[s], float(rest[s])) for i, s in enumerate(names)]
    sources = spark.createDataFrame(table, "sid int, source string, source_size long, target double, whole int, rest double")
    small = F.broadcast if len(table) <= BROADCAST else lambda df: df  # one row a source
    right = small(sources.select(F.col("source").alias("s_"), "sid"))
    numbered = _in_blocks(rows.join(right, rows["source"].eqNullSafe(right["s_"])), max(BLOCKS, BLOCKS_A_SHARD * shards))

    blocks = _permuted(numbered.groupBy("sid", "block").agg(F.sum("size").alias("words")), seed).join(small(sources.select("sid", "whole", "rest")), "sid")
    blocks = materialise(blocks, "blocks")

    # the partial pass: whole blocks, rows of the block at the border, single rows that fill the gap
    border = blocks.filter("before < rest and before + words > rest").select("sid", "block", (F.col("rest") - F.col("before")).alias("room"))
    within = Window.partitionBy("sid", "block").orderBy("spot", "key", "size", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = numbered.join(border, ["sid", "block"]).withColumn("upto", F.sum("size").over(within)).filter("upto <= room").select("uid", "sid", "block", "size")
    some = materialise(some, "border")
    gap = {r["sid"]: r["rest"] - (r["w"] or 0) for r in blocks.groupBy("sid").agg(F.first("rest").alias("rest"), F.sum(F.when(F.expr("before + words <= rest"), F.col("words"))).alias("w")).collect()}
    for r in some.groupBy("sid").agg(F.sum("size").alias("w")).collect():
        gap[r["sid"]] -= r["w"]
    added: list[tuple[int, int]] = []
    free = numbered.join(blocks.filter("before + words > rest").select("sid", "block"), ["sid", "block"]).join(some.select("uid"), "uid", "left_anti")
    longest = Window.partitionBy("sid").orderBy(F.col("size").desc(), "spot", "key", "uid")
    while room := [(s, float(g)) for s, g in gap.items() if g >= 1]:
        left = free.join(small(spark.createDataFrame(room, "sid int, room double")), "sid").filter("size <= room")
        if added:
            left = left.join(F.broadcast(spark.createDataFrame([a[:1] for a in added], "uid long")), "uid", "left_anti")
        best = left.withColumn("k", F.row_number().over(longest)).filter(F.col("k") <= FILL).select("sid", "k", "uid", "size").collect()
        for r in sorted(best, key=lambda r: (r["sid"], r["k"])):
            if r["size"] <= gap[r["sid"]]:
                added.append((r["uid"], r["sid"]))
                gap[r["sid"]] -= r["size"]
        if not best:
            break
    if room:  # none fits: the shortest of the others, where it comes nearer from above
        gaps = small(spark.createDataFrame(room, "sid int, room double"))
        left = free.join(spark.createDataFrame(added or [(-1, -1)], "uid long, s_ int").select("uid"), "uid", "left_anti").join(gaps, "sid").filter("size > room and size < 2 * room")
        for r in left.groupBy("sid").agg(F.min(F.struct("size", "spot", "key", "uid")).alias("x")).collect():
            added.append((r["x"]["uid"], r["sid"]))

    # drawn blocks: (source, block, pass); a block of the border counts as one
    drawn = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole")))).filter("pass < whole or before < rest")
    count = {r["sid"]: r["n"] for r in blocks.groupBy("sid").agg(F.count("*").alias("n")).collect()}
    quota = {r["sid"]: r["n"] for r in drawn.groupBy("sid").agg(F.count("*").alias("n")).collect()}
    tree = splitting_tree([quota.get(i, 0) for i in range(len(names))], shards, seed)
    upper = spark.sparkContext.broadcast(np.cumsum(tree, axis=1) if len(names) else tree)  # sources x shards

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, at = batch.column("sid").to_numpy(), batch.column("at").to_numpy()
            shard = np.zeros(len(sid), np.int32)
            for s in np.unique(sid):
                shard[sid == s] = np.searchsorted(upper.value[s], at[sid == s], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shard)], names=["sid", "block", "pass", "all_rows", "shard"])

    counts = spark.createDataFrame([(i, n) for i, n in count.items()], "sid int, blocks long")
    place = drawn.join(small(counts), "sid").select("sid", "block", "pass", F.expr("pass < whole or before + words <= rest").alias("all_rows"), (F.col("pass") * F.col("blocks") + F.col("nth") - 1).alias("at"))
    place = map_arrow(place, deal, "sid int, block long, pass int, all_rows boolean, shard int")

    drawn_rows = numbered.select("uid", "sid", "block").join(place.filter("all_rows"), ["sid", "block"]).select("uid", "pass", "shard")
    border_rows = some.select("uid", "sid", "block").join(place.filter("not all_rows"), ["sid", "block"]).select("uid", "pass", "shard")
    draws = drawn_rows.unionByName(border_rows)
    if added:
        extra = spark.createDataFrame([(u, whole[names[s]], (seed * 31 + n) % shards) for n, (u, s) in enumerate(added)], "uid long, pass int, shard int")
        draws = draws.unionByName(extra)
    order: Column = F.xxhash64("uid", "pass", F.lit(seed))
    return sources.select("source", "source_size", "target"), draws.withColumn("order", order), shards


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int | None = None, ordered: bool = True) -> DataFrame:
    """The mixture itself: a row of ``docs`` for every copy taken, with ``mix_shard`` (and underscores, if ``docs`` has that name).

    Rows of a shard stand in one partition, in the shard's shuffled order, unless
    ``ordered`` is false (for a step that deals the rows anew anyway).
    """
    columns = docs.columns
    name = "mix_shard"
    while name in columns:
        name += "_"
    rows = sized(docs, tuple(columns), "text")
    _, draws, shards = draw(rows, weights, shards)
    taken = rows.join(draws, "uid")
    if ordered:
        taken = taken.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "order")
    return taken.select(*restored(columns), F.col("shard").alias(name))


def op4_mixing(docs: DataFrame) -> DataFrame:
    """Per row of documents: its size, its source's size and target, and the words that the mixture takes."""
    rows = sized(docs)
    sources, draws, _ = draw(rows)
    copies = draws.groupBy("uid").agg(F.count("*").alias("copies"), F.concat_ws(",", F.array_sort(F.collect_list("shard")).cast("array<string>")).alias("shards"))
    out = rows.join(copies, "uid", "left")
    right = sources.withColumnRenamed("source", "s_")
    right = F.broadcast(right) if right.limit(BROADCAST + 1).count() <= BROADCAST else right
    out = out.join(right, out["source"].eqNullSafe(right["s_"]))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.coalesce("copies", F.lit(0))).alias("taken"), "source", F.coalesce("shards", F.lit("")).alias("shards"))
