"""Document fingerprints by consistent weighted sampling (operator 1).

A text's terms are its five-word shingles, weighted by how often they occur. For
each of SAMPLES independent draws, a term gets r and c from Gamma(2, 1) and beta
from the uniform distribution, all functions of the term and the draw alone; with
weight S its level is t = floor(ln S / r + beta), and its rank
ln a = ln c - r (t - beta) - r. The draw keeps the term of the least rank with its
level. Two texts keep the same (term, level) with a probability that equals their
generalised Jaccard similarity, so the share of equal samples estimates it.
For a weight of 1 the level is 0 and the rank that of an exponential variate, so a
hash of term and draw gives that one first, and then r, c and beta from their
distributions given it: with y = r (1 - beta), exp(y) - 1 is exponential with the
variate as its rate, and r - y is exponential.

Null texts count as empty, and a text without words has the fingerprint of all
zeros, which is like itself and nothing else. Texts of one to four words have
their whole sequence as only term. Repeated rows get repeated fingerprints. Only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import map_arrow

SAMPLES, SHINGLE = 128, 5
#: Rows of the sample behind each range's limits in the neighbours' query.
PER_RANGE = 64
_BLOCK = 512

_rng = np.random.default_rng(5)
_DRAWS = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UNDO = np.array([pow(int(d), -1, 1 << 64) for d in _DRAWS], np.uint64)
_OTHER = np.uint64(0xC3A5C85C97CB3127)
_LEVEL = np.uint64(0x9FB21C651E98DF25)
_TOP = np.uint64(48)


def signature(terms: np.ndarray) -> np.ndarray:
    """SAMPLES 16-bit samples of a multiset of 64-bit terms; never 0 but for no terms at all.

    Term times draw (odd, so it can be undone) is a uniform number of 64 bits. Among
    terms that occur once the least product is the least rank, so that no other
    variate is needed for them.
    """
    if not len(terms):
        return np.zeros(SAMPLES, np.uint16)
    terms = np.sort(terms)
    new = np.empty(len(terms), bool)
    new[0] = True
    np.not_equal(terms[1:], terms[:-1], out=new[1:])
    often = counts = None
    if not new.all():
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(terms)))
        terms = terms[at]
        often, counts, terms = terms[counts > 1], counts[counts > 1], terms[counts == 1]
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(terms), _BLOCK):
        np.minimum(least, (terms[i : i + _BLOCK, None] * _DRAWS).min(axis=0), out=least)
    kept = least * _UNDO
    if often is not None:
        ranks = np.log(once(least)) if len(terms) else np.full(SAMPLES, np.inf)
        draws = np.arange(SAMPLES)
        for i in range(0, len(often), _BLOCK):
            block = often[i : i + _BLOCK]
            r, lnc, beta = variates(block[:, None] * _DRAWS)
            level = np.floor(np.log(counts[i : i + _BLOCK])[:, None] / r + beta)
            rank = lnc - r * (level - beta) - r
            first = rank.argmin(axis=0)
            better = rank[first, draws] < ranks
            ranks = np.where(better, rank[first, draws], ranks)
            kept = np.where(better, block[first] ^ (level[first, draws].astype(np.uint64) * _LEVEL), kept)
    samples = (_text.mix(kept) >> _TOP).astype(np.uint16)
    samples[samples == 0] = 1
    return samples


def once(product: np.ndarray) -> np.ndarray:
    """The exponential variate of a uniform 64-bit number: a for the weight 1."""
    return -np.log1p(-(product.astype(np.float64) + 0.5) * 2.0**-64 * (1 - 2.0**-53))


def variates(product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta, given the variate for the weight 1."""
    a = once(product)
    bits = _text.mix(product ^ _OTHER)
    e = -np.log(((bits >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32)
    rest = -np.log(((bits & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32)
    y = np.log1p(e / a)
    r = y + rest
    return r, np.log(a) + y, rest / r


def signatures(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """One row of samples for each text."""
    out = np.empty((len(texts), SAMPLES), np.uint16)
    for i, j, data, offsets in _text.chunks(texts):
        words = _text.Words(data, offsets)
        terms, at = _text.shingles(words.hashes(), words.first, shingle)
        for d in range(j - i):
            out[i + d] = signature(terms[at[d] : at[d + 1]])
    return out


def hexes(rows: np.ndarray) -> list[str]:
    width = 4 * rows.shape[1]
    digits = rows.astype(">u2").tobytes().hex()
    return [digits[i : i + width] for i in range(0, len(digits), width)]


def weighted_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint``: SAMPLES samples of four hexadecimal digits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hexes(signatures(batch.column(1), shingle)), pa.string())], names=["doc_id", "fingerprint"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fingerprint string")


def likeness(a: str, b: str) -> float:
    """Share of equal samples of two fingerprints."""
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


# --- the contract's query: each text, its edited text and the next document -----------

_NULL_KEY = -(1 << 63)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op1_fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness.

    Neighbours in ascending doc_id (null ids first, repeated ids by a hash of their
    text) meet without a global window: rows are dealt to ranges of (id, hash), whose
    limits come from a sample of PER_RANGE rows a range, each range is sorted by
    itself, and the first row of a range also goes, as an echo, to the end of the
    range before. Texts travel compressed, once. The driver holds the sample and a
    pair a range; there are as many ranges as the scan has partitions, at least.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_KEY)).alias("key"), F.xxhash64(text).alias("h"), text.alias("text"))
    n = max(own.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    limits = _limits(own, n)
    firsts = _firsts(own, limits)
    before = [r for r, _, _ in firsts[-1:] + firsts[:-1]]  # the first range comes after the last
    echo = {(key, h): r for (_, key, h), r in zip(firsts, before, strict=True)}
    heads = np.array(sorted({key for key, _ in echo}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        sent: set[tuple[int, int]] = set()  # equal rows echo once a task
        for batch in batches:
            keys, hs = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            part = _range_of(keys, hs, *limits)
            packed = [squeeze(t.as_py().encode()) for t in batch.column(2)]
            extra = []
            for i in np.flatnonzero(np.isin(keys, heads)).tolist():
                pair = int(keys[i]), int(hs[i])
                if pair in echo and pair not in sent:
                    sent.add(pair)
                    extra.append(i)
            take = np.concatenate([np.arange(len(keys)), np.array(extra, np.int64)]).astype(np.int64)
            back = np.zeros(len(take), bool)
            back[len(keys) :] = True
            part = part[take]
            part[len(keys) :] = [echo[int(keys[i]), int(hs[i])] for i in extra]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(back), pa.array(keys[take]), pa.array(hs[take]), pa.array([packed[i] for i in take], pa.binary())], names=["part", "echo", "key", "h", "packed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_text = zstandard.ZstdDecompressor().decompress

        def texts() -> Iterator[tuple[int, bool, int, str]]:
            for batch in batches:
                for part, back, key, _, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield part, back, key, open_text(packed).decode()

        def pairs() -> Iterator[tuple[int, str, str]]:
            held = None
            for part, back, key, text in texts():
                if held is not None and held[0] == part:
                    yield held[1], held[2], text
                held = None if back else (part, key, text)

        def result(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
            keys, own_texts, after = zip(*rows, strict=True)
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(own_texts, after, strict=True)]
            # the next document's samples are the next row's, but for a break between ranges
            chain = [*own_texts, after[-1]]
            mine = signatures(pa.array(chain, pa.large_string()))
            theirs = signatures(pa.array(edited, pa.large_string()))
            following = mine[1:].copy()
            for i in range(len(rows) - 1):
                if after[i] is not own_texts[i + 1]:
                    following[i] = signatures(pa.array([after[i]], pa.large_string()))[0]
            mine = mine[:-1]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([None if k == _NULL_KEY else k for k in keys], pa.int64()), pa.array([len(t) for t in own_texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(hexes(mine)), pa.array(hexes(theirs)),
                    pa.array((mine == theirs).mean(axis=1)), pa.array((mine == following).mean(axis=1)),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

        rows: list[tuple[int, str, str]] = []
        size = 0
        for row in pairs():
            rows.append(row)
            size += len(row[1])
            if size > 4 << 20 or len(rows) >= 2000:
                yield result(rows)
                rows, size = [], 0
        if rows:
            yield result(rows)

    dealt = map_arrow(own, deal, "part int, echo boolean, key long, h long, packed binary")
    return map_arrow(dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "echo", "key", "h"), compare, RESULT)


def _limits(own: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Limits (id, hash) of at most ``n`` ranges of about equally many rows, from a sample of rows by their place."""
    rows = own.count()
    share = min(1.0, PER_RANGE * n / max(rows, 1))
    at = F.pmod(F.xxhash64("place"), F.lit(1 << 40)) < int(share * (1 << 40))
    some = own.select("key", "h", F.monotonically_increasing_id().alias("place")).filter(at).select("key", "h").toArrow()
    pairs = sorted(zip(some["key"].to_pylist(), some["h"].to_pylist(), strict=True))
    cuts = sorted({pairs[len(pairs) * i // n] for i in range(1, n)}) if pairs else []
    return np.array([k for k, _ in cuts], np.int64), np.array([h for _, h in cuts], np.int64)


def _range_of(keys: np.ndarray, hs: np.ndarray, cut_keys: np.ndarray, cut_hs: np.ndarray) -> np.ndarray:
    """How many limits are not above each (id, hash)."""
    part = np.searchsorted(cut_keys, keys, "left")
    upto = np.searchsorted(cut_keys, keys, "right")
    for key in np.unique(keys[upto > part]).tolist():  # ids that limits share with rows: their hashes decide
        own = keys == key
        i, j = np.searchsorted(cut_keys, key, "left"), np.searchsorted(cut_keys, key, "right")
        part[own] += np.searchsorted(cut_hs[i:j], hs[own], "right")
    return part.astype(np.int32)


def _firsts(own: DataFrame, limits: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """(range, least id, its least hash) of every range that has rows, in order."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, int]] = {}
        for batch in batches:
            keys, hs = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            parts = _range_of(keys, hs, *limits)
            order = np.lexsort((hs, keys, parts))
            for i in order[np.flatnonzero(np.diff(parts[order], prepend=-1))].tolist():
                p, pair = int(parts[i]), (int(keys[i]), int(hs[i]))
                found[p] = min(pair, found.get(p, pair))
        if found:
            columns = zip(*((p, *pair) for p, pair in found.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["part", "key", "h"])

    rows = map_arrow(own.select("key", "h"), least, "part int, key long, h long").groupBy("part").agg(F.min(F.struct("key", "h")).alias("x")).collect()
    return sorted((r["part"], r["x"]["key"], r["x"]["h"]) for r in rows)
