"""Language-model scoring by logistic context mixing (operator 6).

A text is coded bit by bit, bytes from the first (with a closing zero byte), most
significant bit first. For each bit, ORDERS hashed contexts (the last 1 to 5
bytes, with the bits of the byte so far) give a prediction from counts of zeros
and ones. Predictions are stretched (log odds) and combined by weights that two
gates select, the bits so far and the last byte; the two sums are averaged,
squashed, and refined by an adaptive map of (last byte, bits so far, quantised
prediction). Bits per byte follow from the probabilities of all bits.

Counters cover all texts learned from: partitions count six-byte windows, which
meet by their contexts and become counts of fixed slots. Weights and the adaptive
map learn from all windows too, each weighing as often as it occurs and with its
own occurrence taken out of the counts, so that they learn what predictions are
worth for a byte not counted yet. Each task learns weights online, in small steps
over its windows in the order of a hash, from the weights that all share; their
mean, by occurrences, is the next pass's start (PASSES). A last pass sums up the
adaptive map's cells under the weights so found. Then all is fixed: a score depends
on the text and the model. Weights vary a little with the number of tasks, as
online learning does with order; equal layouts of the input give equal scores. A
worker remembers costs by the six bytes that determine them.

The base score is that of a unigram model with additive smoothing. Counts of all
tokens are a distributed sum; the HEAD most frequent go to the scan as a table of
fixed size, other tokens are joined with their counts.

Null texts count as empty (one end token, one closing byte). Repeated rows are
scored each, and learned from as often. Without training rows all probabilities
are those of empty counts. Only the id and text columns are read. Tokens are
identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import discard, id_crc, kept, map_arrow, materialise

#: Slots of the contexts of 1, 2, ... bytes, as powers of 2; passes of learning weights; the head's tokens.
SLOT_BITS, PASSES, HEAD = (16, 18, 20, 21, 22), 1, 1 << 18
#: Step of the weights; windows of a step; levels of the map; counts that a slot has to begin with; occurrences that a cell has.
RATE, STEP, LEVELS, PRIOR, FIRM = 0.02, 512, 33, 0.1, 20.0
#: Sizes of work only, without effect on results: bytes of text at once, windows merged at once, windows of a stretch.
_CHUNK, _BUFFER, _STRETCH = 1 << 19, 1 << 20, 1 << 14
ORDERS = len(SLOT_BITS)
_BASE = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])  # all orders' slots stand in one row
_SLOTS = int(_BASE[-1])
_END = np.uint64(0xE4D0F7EC7)  # the end token's hash
_KEEP, _REMEMBER = 1_000_000, 21
_NODE = np.uint64(0x9E3779B97F4A7C15)
_ORDER = (np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six-byte windows (the coded byte lowest) of all bytes and closing zeros, and each text's offsets in them."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    ends = np.cumsum(lengths + 1 + ORDERS)  # each text: ORDERS zeros, its bytes, a closing zero
    wide = np.zeros(int(ends[-1]) if n else 0, np.uint64)
    own = np.arange(len(data)) + np.repeat((np.arange(n) + 1) * ORDERS + np.arange(n), lengths)
    wide[own] = data
    m = len(wide) - ORDERS
    window = np.zeros(max(m, 0), np.uint64)
    for k in range(ORDERS + 1):
        window <<= np.uint64(8)
        window |= wide[k : k + m]
    keep = np.ones(len(wide), bool)
    starts = ends - (lengths + 1 + ORDERS)
    for k in range(ORDERS):
        keep[starts + k] = False
    return window[keep[ORDERS:]], np.concatenate([[0], np.cumsum(lengths + 1)])


def slots(windows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the 8 bits: (bit number, node, bit, slots by order) of all windows."""
    byte = windows & np.uint64(255)
    contexts = []
    for k in range(ORDERS):
        context = windows >> np.uint64(8)
        if k < 7:
            context = context & np.uint64((1 << 8 * (k + 1)) - 1)
        contexts.append(_text.mix(context * _ORDER[k] + _ORDER[k]))
    for b in range(8):
        node = (byte | np.uint64(256)) >> np.uint64(8 - b)  # 1, then the bits so far behind a leading 1
        bit = (byte >> np.uint64(7 - b)) & np.uint64(1)
        at = np.stack([((c + node * _NODE) * _NODE >> np.uint64(64 - SLOT_BITS[k])).astype(np.int64) + _BASE[k] for k, c in enumerate(contexts)])
        yield b, node.astype(np.int64), bit.astype(bool), at


def add_slots(windows: np.ndarray, times: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
    """Add windows that occur so many times to the slots' zeros and ones."""
    for _, _, bit, at in slots(windows):
        for k in range(ORDERS):
            np.add.at(zeros, at[k][~bit], times[~bit])
            np.add.at(ones, at[k][bit], times[bit])


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + PRIOR) / (zeros + PRIOR))


@dataclass
class Model:
    """table: log odds of all orders' slots; gate1, gate2: weights by node and by last byte; refine: probabilities."""

    table: np.ndarray | None
    gate1: np.ndarray
    gate2: np.ndarray
    refine: np.ndarray

    def mixed(self, inputs: np.ndarray, node: np.ndarray, last: np.ndarray) -> np.ndarray:
        weights = self.gate1[node] + self.gate2[last]
        return np.clip(0.5 * np.einsum("ki,ik->i", inputs, weights), -11.5, 11.5)

    def refined(self, s: np.ndarray, node: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of a one; the lower level and the share of the upper one, for updates."""
        x = (s + 12) * ((LEVELS - 1) / 24)
        low = x.astype(np.int64)
        part = x - low
        cell = (last * 256 + node) * LEVELS + low
        p = self.refine[cell] * (1 - part) + self.refine[cell + 1] * part
        return 0.5 * (p + 1 / (1 + np.exp(-s))), cell, part

    def costs(self, windows: np.ndarray) -> np.ndarray:
        """log10 of each window's probability of its coded byte."""
        last = (windows >> np.uint64(8) & np.uint64(255)).astype(np.int64)
        out = np.zeros(len(windows))
        for _, node, bit, at in slots(windows):
            p = self.refined(self.mixed(self.table[at], node, last), node, last)[0]
            out += np.log10(np.where(bit, p, 1 - p))
        return out


def fresh(table: np.ndarray | None) -> Model:
    squash = 1 / (1 + np.exp(-(np.arange(LEVELS) * 24 / (LEVELS - 1) - 12)))
    return Model(table, np.full((256, ORDERS), 0.3), np.full((256, ORDERS), 0.3), np.tile(squash, 256 * 256 + 1))


def _left_out(windows: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (order, window x bit) from counts without one occurrence of the window; nodes, last bytes and bits."""
    bits = list(slots(windows))
    known = [stretched(np.maximum(zeros[at] - ~bit, 0), np.maximum(ones[at] - bit, 0)) for _, _, bit, at in bits]
    inputs = np.moveaxis(np.stack(known), 0, 2).reshape(ORDERS, -1)
    node = np.stack([n for _, n, _, _ in bits], axis=1).ravel()
    last = np.repeat((windows >> np.uint64(8) & np.uint64(255)).astype(np.int64), 8)
    return inputs, node, last, np.stack([b for _, _, b, _ in bits], axis=1).ravel()


def learn(model: Model, windows: np.ndarray, times: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
    """Online steps of the weights over windows that occur so many times, in the order of a hash."""
    order = np.argsort(windows * _NODE, kind="stable")
    for a in range(0, len(order), _STRETCH):
        part = order[a : a + _STRETCH]
        inputs, node, last, bit = _left_out(windows[part], zeros, ones)
        weight = np.repeat(times[part].astype(np.float64), 8)
        for i in range(0, 8 * len(part), 8 * STEP):
            x, n, c, w = inputs[:, i : i + 8 * STEP], node[i : i + 8 * STEP], last[i : i + 8 * STEP], weight[i : i + 8 * STEP]
            wrong = (bit[i : i + 8 * STEP] - 1 / (1 + np.exp(-model.mixed(x, n, c)))) * w
            for gate, at in ((model.gate1, n), (model.gate2, c)):
                # the mean step of the rows that select a weight, times the root of their number
                scale = RATE * np.sqrt(np.bincount(at, minlength=256)) / np.maximum(np.bincount(at, weights=w, minlength=256), 1e-9)
                for k in range(ORDERS):
                    gate[:, k] += scale * np.bincount(at, weights=wrong * x[k], minlength=256)


def cells(model: Model, windows: np.ndarray, times: np.ndarray, zeros: np.ndarray, ones: np.ndarray, sums: np.ndarray, shares: np.ndarray) -> None:
    """Add to the map's cells the occurrences that fall to them, and those of a one."""
    for a in range(0, len(windows), _STRETCH):
        inputs, node, last, bit = _left_out(windows[a : a + _STRETCH], zeros, ones)
        weight = np.repeat(times[a : a + _STRETCH].astype(np.float64), 8)
        _, cell, part = model.refined(model.mixed(inputs, node, last), node, last)
        for at, share in ((cell, weight * (1 - part)), (cell + 1, weight * part)):
            np.add.at(shares, at, share)
            np.add.at(sums, at[bit], share[bit])


def refine(model: Model, at: np.ndarray, sums: np.ndarray, shares: np.ndarray) -> None:
    """The map from its cells' sums; a cell begins with FIRM occurrences at the squashed prediction."""
    model.refine[at] = (sums + FIRM * model.refine[at]) / (shares + FIRM)
    np.clip(model.refine, 1e-5, 1 - 1e-5, out=model.refine)


class _Memory:
    """Costs by window in a table with one place for each hash; a newcomer takes the place."""

    def __init__(self, model: Model):
        self.model = model
        self.windows = np.full(1 << _REMEMBER, np.iinfo(np.uint64).max, np.uint64)
        self.costs = np.zeros(1 << _REMEMBER, np.float32)

    def of(self, windows: np.ndarray) -> np.ndarray:
        at = (windows * _NODE >> np.uint64(64 - _REMEMBER)).astype(np.int64)
        out = self.costs[at].astype(np.float64)
        missed = np.flatnonzero(self.windows[at] != windows)
        if len(missed):
            new, back = np.unique(windows[missed], return_inverse=True)
            cost = np.concatenate([self.model.costs(new[i : i + 16384]).astype(np.float32) for i in range(0, len(new), 16384)])
            out[missed] = cost[back]
            at = (new * _NODE >> np.uint64(64 - _REMEMBER)).astype(np.int64)
            self.windows[at], self.costs[at] = new, cost
        return out


def _merge(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, t = np.concatenate(keys), np.concatenate(times)
    keys.clear(), times.clear()
    order = np.argsort(k, kind="stable")
    k, t = k[order], t[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(t, first) if len(k) else t


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): how often a task has seen a token (kind 0) or a window (kind 1)."""
    held: list[tuple[list, list]] = [([], []), ([], [])]
    docs = 0

    def hold(kind: int, values: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
        keys, times = held[kind]
        u, n = np.unique(values, return_counts=True)
        keys.append(u), times.append(n)
        if sum(map(len, keys)) > 2 * _KEEP:
            held[kind] = tuple([x] for x in _merge(keys, times))
            if len(held[kind][0][0]) > least:
                yield from rows(kind)

    def rows(kind: int) -> Iterator[pa.RecordBatch]:
        k, t = _merge(*held[kind])
        for i in range(0, len(k), 1 << 18):
            key = k[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(t[i : i + (1 << 18)])], names=["kind", "key", "n"])

    for batch in batches:
        for i, j, data, offsets in _text.chunks(batch.column(0), _CHUNK):
            yield from hold(0, _text.Words(data, offsets).hashes(), _KEEP)
            yield from hold(1, coded(data, offsets)[0], _KEEP)
            docs += j - i
    if docs:
        yield from hold(0, np.full(docs, _END), _KEEP)
        for kind in (0, 1):
            if held[kind][0]:
                yield from rows(kind)


def _to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with their numbers to a task's slots with zeros and ones, summed in two rows of all slots."""
    zeros, ones = np.zeros(_SLOTS, np.int64), np.zeros(_SLOTS, np.int64)
    held: tuple[list, list] = ([], [])
    rows = 0

    def add() -> None:
        windows, times = _merge(*held)
        windows = windows.view(np.uint64)
        for i in range(0, len(windows), 1 << 14):
            add_slots(windows[i : i + (1 << 14)], times[i : i + (1 << 14)], zeros, ones)

    for batch in batches:
        for column, values in zip(held, batch.columns, strict=True):
            column.append(values.to_numpy().copy())  # the batch itself goes
        rows += batch.num_rows
        if rows >= _BUFFER:
            add()
            rows = 0
    if rows:
        add()
    used = np.flatnonzero((zeros != 0) | (ones != 0))
    for i in range(0, len(used), 1 << 17):
        key = used[i : i + (1 << 17)]
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(zeros[key]), pa.array(ones[key])], names=["slot", "n", "m"])


@dataclass
class Trained:
    """model; token counts as a table (token long, c long); their sum and number."""

    model: Model
    tokens: DataFrame
    total: int
    distinct: int


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        yield batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()


def mixer(seen: DataFrame, zeros: np.ndarray, ones: np.ndarray, passes: int = PASSES) -> Model:
    """Weights and adaptive map from all of ``seen`` (key, n): windows with their numbers of occurrences."""
    sc = seen.sparkSession.sparkContext
    counts = sc.broadcast((zeros, ones))  # tables of fixed size
    model = fresh(None)
    for _ in range(passes):
        gates = model.gate1, model.gate2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = fresh(None)
            own.gate1, own.gate2 = (g.copy() for g in gates)  # noqa: B023  the pass is over before the next begins
            total = 0
            for windows, times in _windows(batches):
                learn(own, windows, times, *counts.value)
                total += int(times.sum())
            if total:
                both = np.concatenate([own.gate1.ravel(), own.gate2.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both * total), pa.array(np.full(len(both), float(total)))], names=["at", "x", "w"])

        rows = map_arrow(seen, run, "at int, x double, w double").groupBy("at").agg((F.sum("x") / F.sum("w")).alias("x")).toArrow()
        if rows.num_rows:
            both = np.zeros(2 * 256 * ORDERS)
            both[rows["at"].to_numpy()] = rows["x"].to_numpy()
            model.gate1, model.gate2 = both.reshape(2, 256, ORDERS)
    gates = model.gate1, model.gate2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fresh(None)
        own.gate1, own.gate2 = gates
        sums, shares = np.zeros(len(own.refine)), np.zeros(len(own.refine))
        for windows, times in _windows(batches):
            cells(own, windows, times, *counts.value, sums, shares)
        used = np.flatnonzero(shares)
        for i in range(0, len(used), 1 << 17):
            at = used[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at]), pa.array(shares[at])], names=["at", "x", "w"])

    # at most one row a cell, whatever the corpus
    rows = map_arrow(seen, add, "at int, x double, w double").groupBy("at").agg(F.sum("x").cast("float").alias("x"), F.sum("w").cast("float").alias("w")).toArrow()
    refine(model, rows["at"].to_numpy(), rows["x"].to_numpy().astype(np.float64), rows["w"].to_numpy().astype(np.float64))
    counts.unpersist()
    return model


def train(docs: DataFrame) -> Trained:
    """Learn from all rows of ``docs`` (doc_id, text)."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = materialise(map_arrow(texts, _count, "kind int, key long, n long"), "seen")
    tokens = materialise(seen.filter("kind = 0").groupBy("key").agg(F.sum("n").alias("c")).select(F.col("key").alias("token"), "c"), "tokens")
    # windows meet by their last three context bytes, so that most slots (orders 3 to 5) are summed in one task and a
    # common pair of letters is dealt over many; rows of slots go straight to their sums, without partial ones
    windows = seen.filter("kind = 1").select("key", "n")
    dealt = windows.repartition(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF)))
    counted = map_arrow(dealt, _to_slots, "slot int, n long, m long").repartition("slot").groupBy("slot").agg(F.sum("n").cast("float").alias("n"), F.sum("m").cast("float").alias("m"))
    table = counted.toArrow()  # at most one row per slot, whatever the corpus
    zeros, ones = np.zeros(_SLOTS, np.float32), np.zeros(_SLOTS, np.float32)
    for batch in table.to_batches():
        at = batch["slot"].to_numpy()
        zeros[at], ones[at] = batch["n"].to_numpy(), batch["m"].to_numpy()
    del table
    model = mixer(windows, zeros, ones)
    discard(seen)
    model.table = stretched(zeros, ones).astype(np.float32, copy=False)
    sums = tokens.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    return Trained(model, tokens, sums["n"] or 0, sums["v"])


def score(docs: DataFrame, trained: Trained, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, n_known, base_score, score`` for every row, with the columns of ``keep`` as kept_0 …."""
    spark = docs.sparkSession
    floor = 0.1
    bottom = np.log10(trained.total + floor * (trained.distinct + 1))
    head = trained.tokens.orderBy(F.desc("c"), "token").limit(HEAD).toArrow()
    places, costs = np.zeros(1 << 21, np.uint64), np.zeros(1 << 21)
    token = head["token"].to_numpy().view(np.uint64)
    at = (token >> np.uint64(43)).astype(np.int64)
    # the most frequent token of a place has it; the others are joined like any other
    at, first = np.unique(at, return_index=True)
    places[at] = token[first]
    costs[at] = np.log10(head["c"].to_numpy()[first] + floor) - bottom
    shared = spark.sparkContext.broadcast((trained.model, places, costs))  # tables of fixed size

    kept_names = [f"kept_{k}" for k in range(len(keep))]
    schema = "uid long, doc_id long" + "".join(f", kept_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)) + ", n_bytes long, n_tokens long, head_known long, head_score double, score double, tail array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, places, costs = shared.value
        memory = model.__dict__.setdefault("memory", _Memory(model))  # a worker keeps it for its next tasks
        for batch in batches:
            text = batch.column(2)
            for i, j, data, offsets in _text.chunks(text, _CHUNK):
                words = _text.Words(data, offsets)
                counts = np.diff(words.first)
                hashes = np.insert(words.hashes(), words.first[1:], _END)
                ends = np.concatenate([[0], np.cumsum(counts + 1)])
                at = (hashes >> np.uint64(43)).astype(np.int64)
                hit = places[at] == hashes
                own = np.add.reduceat(np.where(hit, costs[at], 0.0), ends[:-1])
                hits = np.concatenate([[0], np.cumsum(hit)])
                known = hits[ends[1:]] - hits[ends[:-1]]
                rest = hashes[~hit].view(np.int64)
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts + 1 - known)]).astype(np.int32)), pa.array(rest))
                windows, spans = coded(data, offsets)
                bits = np.add.reduceat(memory.of(windows), spans[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c)[i:j] for c in (0, 1, *range(3, 3 + len(keep)))), pa.array(np.diff(offsets)), pa.array(counts + 1), pa.array(known),
                        pa.array(own), pa.array(bits), tail,
                    ],
                    names=["uid", "doc_id", *kept_names, "n_bytes", "n_tokens", "head_known", "head_score", "score", "tail"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *kept(keep))
    scored = materialise(map_arrow(rows, run, schema), "scored")
    shared.unpersist()  # what was scored is written
    tails = scored.select("uid", F.explode("tail").alias("token")).groupBy("uid", "token").agg(F.count("*").alias("times")).join(trained.tokens, "token", "left")
    one = F.log10(F.coalesce("c", F.lit(0)) + F.lit(floor)) - F.lit(float(bottom))
    sums = tails.groupBy("uid").agg(F.sum(F.col("times") * one).alias("tail_score"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    out = scored.drop("tail").join(sums, "uid", "left")
    return out.select(
        "doc_id", *kept_names, "n_bytes", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"), "score",
    )


def op6_lm(docs: DataFrame) -> DataFrame:
    """Scores of all documents by models of those whose crc32 modulo 10 isn't 0."""
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(10)) == 0
    trained = train(docs.filter(~held))
    out = score(docs, trained)
    bpb = -F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(trained.total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bpb.alias("bits_per_byte"))
