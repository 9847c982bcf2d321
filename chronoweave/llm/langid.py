"""Language identification by nearest centroids (operator 5).

A text's vector counts its hashed byte n-grams (2 and 3 bytes, Latin
letters folded, runs of other ASCII signs as one gap), damped by log(1 + n), weighted by inverse document frequency and scaled
to length one. Every language has up to CLUSTERS centroids from spherical
k-means over a sample of at most SAMPLE distinct texts (those of the least hashes);
document frequencies come from all rows that may be learned from. A text goes to the language of its most
similar centroid by cosine. It is rejected if that similarity is below the
language's limit: a share of the least similarity in the sample.

``und`` is given to null texts and texts without a letter (general category L; score
0, rejected). Rows without a language teach nothing; with no labelled row at all
every text is ``und``. Repeated rows get equal results; in the sample a text counts
once for a language, however often it occurs. Only id, text and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import id_crc, map_arrow, materialise, named

BITS, SAMPLE, CLUSTERS, ROUNDS, LIMIT_SHARE = 12, 512, 4, 12, 0.5
#: Rows and bytes of text that are counted at once.
_ROWS, _CHUNK = 128, 1 << 18
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Centroids:
    """idf: 2**BITS; centres: a row for each, of langs[i]; limits: least cosine accepted by langs[i]."""

    langs: list[str]
    centres: np.ndarray
    idf: np.ndarray
    limits: np.ndarray


#: ASCII letters folded; other ASCII bytes are gaps (32); the rest as it is.
_FOLD = _text.LOWER.copy()
_FOLD[[b for b in range(0x80) if not chr(b).isalpha()]] = 32


def _letters(data: np.ndarray) -> np.ndarray:
    """Folded bytes; capitals of the Latin-1 letters too (C3 80 to C3 9E)."""
    low = _FOLD[data].astype(np.uint32)
    if len(data) > 1:
        low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 0x20
    return low


def _run_of_gaps(low: np.ndarray, n: int) -> np.ndarray:
    """Where an n-gram has two gaps side by side."""
    gap = low == 32
    two = gap[:-1] & gap[1:]
    return two[: len(low) - n + 1] if n == 2 else two[: len(low) - 2] | two[1 : len(low) - 1]


def counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """For rows [i, j): their n-gram counts, a dense row each."""
    size = 1 << BITS
    for i, j, data, offsets in _text.chunks(texts, _CHUNK, _ROWS):
        low = _letters(data)
        row = np.repeat(np.arange(j - i), np.diff(offsets)) * size
        total = np.zeros((j - i) * size, np.int64)
        for n in (2, 3):
            if len(low) < n:
                continue
            gram = low[: len(low) - n + 1].copy()
            for k in range(1, n):
                gram = gram << np.uint32(8) | low[k : len(low) - n + 1 + k]
            inside = (row[: len(gram)] == row[n - 1 :]) & ~_run_of_gaps(low, n)
            at = (gram * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)
            total += np.bincount((at + row[: len(gram)])[inside], minlength=len(total))
        yield i, j, total.reshape(j - i, size)


def vectors(grams: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(grams.astype(np.float32)) * idf
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(length, 1e-12)[:, None]


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from the mean's nearest row and then the least similar ones."""
    centres = x[[int((x @ x.mean(axis=0)).argmax())]]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[int((x @ centres.T).max(axis=1).argmin())]])
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    return centres


def _least(sample: int):
    """Rows (lang, h) to a task's rows (lang, n, h): its rows of a language, and its ``sample`` least distinct hashes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            langs, h = pc.dictionary_encode(batch.column(0)), batch.column(1).to_numpy()
            codes = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = h[codes == k]
                n, known = held.get(lang, (0, np.zeros(0, np.int64)))
                held[lang] = n + len(own), np.unique(np.concatenate([known, own]))[:sample]
        for lang, (n, known) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (1 + len(known)), pa.string()), pa.array([n] + [0] * len(known), pa.int64()), pa.array([None, *known.tolist()], pa.int64())], names=["lang", "n", "h"])

    return run


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Centroids:
    """Learn from rows for which ``usable`` holds: ``sample`` distinct texts of each language, and all for the frequencies."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    counted = materialise(map_arrow(rows.select("lang", "h"), _least(sample), "lang string, n long, h long"), "least")
    per = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    size = 1 << BITS
    if not per:
        return Centroids([], np.zeros((0, size), np.float32), np.ones(size, np.float32), np.zeros(0))
    # a language's sample ends with its sample-th distinct hash
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = counted.filter("h is not null").select("lang", "h").distinct().withColumn("nth", nth).filter(F.col("nth") <= sample).groupBy("lang").agg(F.max("h").alias("h"))
    limit = F.create_map(*(F.lit(x) for r in last.collect() for x in (r["lang"], r["h"])))
    chosen = F.col("h") <= F.element_at(limit, F.col("lang"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of chosen texts' counts, and one row of document frequencies for each bin with any."""
        seen = np.zeros(size, np.int64)
        sent: set[tuple[str, int]] = set()  # at most ``sample`` of each language

        def table(langs: list, hs: list, ats: list, ns: list, bins: list, dfs: list) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((langs, hs, ats, ns, bins, dfs), kinds, strict=True)], names=["lang", "h", "at", "n", "bin", "df"])

        for batch in batches:
            langs, hs, keep = batch.column(0), batch.column(2), np.array(batch.column(3).to_pylist(), bool)
            for i, j, grams in counts(batch.column(1)):
                seen += (grams > 0).sum(axis=0)
                for p in np.flatnonzero(keep[i:j]).tolist():
                    key = langs[i + p].as_py(), hs[i + p].as_py()
                    if key not in sent:
                        sent.add(key)
                        at = np.flatnonzero(grams[p]).astype(np.int32)
                        yield table([key[0]], [key[1]], [at], [grams[p][at].astype(np.int32)], [None], [None])
        bins = np.flatnonzero(seen)
        none = [None] * len(bins)
        yield table(none, none, none, none, bins.tolist(), seen[bins].tolist())

    got = materialise(map_arrow(rows.select("lang", "text", "h", chosen.alias("chosen")), gather, "lang string, h long, at array<int>, n array<int>, bin int, df long"), "ngrams")
    df = np.zeros(size)
    for r in got.filter("bin is not null").groupBy("bin").agg(F.sum("df").alias("df")).collect():
        df[r["bin"]] = r["df"]
    idf = (np.log((1 + sum(per.values())) / (1 + df)) + 1).astype(np.float32)
    picked = got.filter("lang is not null").dropDuplicates(["lang", "h"]).select("lang", "h", "at", "n").toArrow()
    names, order = np.array(picked["lang"].to_pylist(), object), np.argsort(picked["h"].to_numpy())
    langs, centres, limits = [], [], []
    for lang in sorted(per):
        own = order[names[order] == lang]  # by hash: the same order whatever the partitions
        grams = np.zeros((len(own), size), np.int32)
        for row, i in enumerate(own.tolist()):
            grams[row, picked["at"][i].values.to_numpy()] = picked["n"][i].values.to_numpy()
        x = vectors(grams, idf)
        c = _cluster(x, clusters)
        least = (x @ c.T).max(axis=1).min()
        langs += [lang] * len(c)
        centres.append(c)
        limits += [LIMIT_SHARE * float(least)] * len(c)
    return Centroids(langs, np.vstack(centres).astype(np.float32), idf, np.array(limits))


def predict(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score, rejected``, with the columns of ``extra`` before them as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids and frequencies of 2**BITS bins
    twice = text_col in extra and docs.schema[text_col].dataType.simpleString() == "string"  # one copy will do
    place = 1 + (extra.index(text_col) if twice else len(extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(place)
            langs: list[str] = []
            scores = np.zeros(len(texts))
            rejected = np.ones(len(texts), bool)
            for i, j, grams in counts(texts):
                like = vectors(grams, m.idf) @ m.centres.T if m.langs else None
                for d in range(j - i):
                    text = texts[i + d].as_py()
                    if like is None or not text or not _LETTER.search(text):
                        langs.append("und")
                        continue
                    best = int(like[d].argmax())
                    langs.append(m.langs[best])
                    scores[i + d] = min(1.0, max(0.0, float(like[d, best])))
                    rejected[i + d] = like[d, best] < m.limits[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(1 + k) for k in range(len(extra))), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=["doc_id", *(f"x{k}" for k in range(len(extra))), "lang_pred", "score", "rejected"])

    text = [] if twice else [F.col(text_col).cast("string").alias("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(named(c).alias(f"x{k}") for k, c in enumerate(extra)), *text)
    kinds = "".join(f", x{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(extra))
    return map_arrow(rows, run, f"doc_id long{kinds}, lang_pred string, score double, rejected boolean")


def trainable() -> Column:
    """Rows that a model may learn from: crc32 of the id modulo 5 isn't 0."""
    return F.pmod(id_crc(F.col("doc_id")), F.lit(5)) != 0


def op5_language(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs, trainable())).select("doc_id", (~trainable()).alias("held_out"), "lang_pred", "score", "rejected")
