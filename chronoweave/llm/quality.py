"""Quality classifier: hashed word n-grams, logistic regression, FTRL (operator 2).

Words are runs of letters, digits and non-ASCII bytes, or runs of ASCII signs,
with their case. A text's features are its hashed words and word pairs, each
occurrence weighing 1 / sqrt(number of occurrences). A pair whose second word
repeats the first, or the one before the first, is the same feature whatever the
word. The weights are learned by
follow-the-regularised-leader (proximal) updates over a sample of labelled ids: the
SAMPLE ones of the least hashes; a score is the logistic function of the sparse dot
product of a text's features and the weights.

Null and empty texts have no feature: their score is that of the intercept.
Labels that are null teach nothing; repeated labels of one id count once (the
largest), and of the texts of one id the one of the least hash is learned from.
Without labels every score is 0.5. Repeated rows get equal scores. Only
id and text, and the labels' id and label, are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import id_crc, map_arrow, materialise

BITS, SAMPLE, PASSES = 18, 12_000, 3
SAME, SAME_AGAIN = 1, 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For rows [i, j): feature numbers of all occurrences, and each text's offsets in them."""
    for i, j, data, offsets in _text.chunks(texts):
        words = _text.Words(data, offsets, fold=False, kinds=_text.SIGNS)
        h, first = words.hashes(), words.first
        n = len(h)
        shift = np.uint64(64 - BITS)
        one = (h >> shift).astype(np.int64)
        two = (_text.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> shift).astype(np.int64) if n > 1 else np.zeros(0, np.int64)
        two[h[1:] == h[:-1]] = SAME
        again = np.zeros(max(n - 1, 0), bool)
        again[1:] = h[2:] == h[:-2]
        again[first[:-1][np.diff(first) > 1]] = False  # a text's first word has none before it
        two[again] = SAME_AGAIN
        # words and pairs interleaved, a pair after its first word; the last word of a text opens no pair
        both = np.empty(2 * n, np.int64)
        both[0::2] = one
        both[1:-1:2] = two
        keep = np.ones(2 * n, bool)
        ends = first[1:][np.diff(first) > 0]
        keep[2 * ends - 1] = False
        counts = np.diff(first)
        yield i, j, both[keep], np.concatenate([[0], np.cumsum(np.maximum(2 * counts - 1, 0))])


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (label, feature numbers, values), in order; weights and intercept."""
    size = 1 << BITS
    z, g2 = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(passes):
        for label, at, x in examples:
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA * w
            g2[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from at most ``sample`` labelled ids of ``docs``, those of the least hashes.

    The chosen ids, bounded by ``sample``, are the only broadcast side.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, at, offsets in features(batch.column(2)):
                index, value = [], []
                for d in range(j - i):
                    u, c = np.unique(at[offsets[d] : offsets[d + 1]], return_counts=True)
                    index.append(u.astype(np.int32))
                    value.append((c / np.sqrt(max(1, c.sum()))).astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["doc_id", "y", "at", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    table = materialise(map_arrow(rows, vectors, "doc_id long, y int, at array<int>, x array<float>"), "vectors").toArrow()
    order = np.argsort(_text.mix(table["doc_id"].to_numpy().view(np.uint64) + np.uint64(1)), kind="stable")
    ys, ats, xs = table["y"].to_numpy(), table["at"], table["x"]
    return train([(int(ys[i]), ats[int(i)].values.to_numpy(), xs[int(i)].values.to_numpy().astype(np.float64)) for i in order])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: probability of label 1 for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        for batch in batches:
            out = np.empty(len(batch.column(0)))
            for i, j, at, offsets in features(batch.column(1)):
                sums = np.concatenate([[0.0], np.cumsum(weights[at], dtype=np.float64)])
                n = np.diff(offsets)
                out[i:j] = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(n, 1)) + intercept
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, score double")


def op2_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document; ids whose crc32 modulo 4 is 2 are held out of the labels."""
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    out = score(docs, fit(docs, labels.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
