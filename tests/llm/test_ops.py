"""Operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import _text, fingerprints, langid, licenses, lm, media_ts, mixing, neardup, packing, pii, quality

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, key string, fp long, component_id string"
AWKWARD = [
    (1, "One two three four five six seven.", "en", "a"), (2, "One two three four five six seven.", "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n", "de", "a"),
    (None, "no id here at all x@y.zz", "en", None), (7, "word", "en", "c"), (7, "word", "en", "c"), (8, "9" * 3000, None, "c"), (9, "é" * 5000 + " fin", "fr", "d"),
    (10, "Licensed  under the MIT licence!\nCopyright 2020 x", "en", "a"), (11, "a b " * 9000, "en", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 0, 1, "k", 2, "c") for r in AWKWARD], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


OPS = {
    "op1": lambda d: fingerprints.op1_fingerprint(d), "op3": lambda d: pii.op3_pii(d), "op4": lambda d: mixing.op4_mixing(d), "op5": lambda d: langid.op5_language(d), "op6": lambda d: lm.op6_lm(d),
    "op7": lambda d: media_ts.op7_media(d), "op8": lambda d: licenses.op8_licenses(d), "op9": lambda d: packing.op9_packing(d), "op10": lambda d: neardup.op10_simhash(d), "op2": lambda d: quality.op2_quality(d, labels(d.sparkSession)),
}


@pytest.mark.parametrize("name", OPS)
def test_awkward_rows_and_empty_table(awkward, name):
    rows = OPS[name](awkward).collect()
    ids = collections.Counter(r["doc_id"] for r in rows if r.asDict().get("piece", 0) == 0)
    assert ids == collections.Counter(r[0] for r in AWKWARD)
    assert OPS[name](awkward.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPS)
def test_very_long_texts(spark, name):
    """A text of a million code points, with copies, beside short ones; equal texts get equal results."""
    rng = np.random.default_rng(1)
    long = " ".join(f"wörd{i}" for i in rng.integers(0, 10**6, 100_000).tolist())
    df = spark.createDataFrame([(1, long, "en", "a"), (2, "short one here", "de", "b"), (3, long, "en", "a"), (4, long + " and an end", "en", "c")], "doc_id long, text string, lang string, source string")
    rows = {(r["doc_id"], r.asDict().get("piece", 0)): r.asDict() for r in OPS[name](df).collect()}
    assert {k for k, _ in rows} == {1, 2, 3, 4}
    alike = {"op1": "fingerprint", "op2": "score", "op3": "spans", "op4": "size", "op5": "score", "op6": "score", "op7": "media_sha256", "op8": "digest", "op9": "ids_crc32", "op10": "fingerprint"}[name]
    assert all(rows[1, n][alike] == rows[3, n][alike] for k, n in rows if k == 1)


def test_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.op1_fingerprint(docs).collect()}
    ids = sorted(texts)
    shingles = lambda t: collections.Counter(tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4)))
    errors = []
    for i, k in enumerate(ids):
        t, u = texts[k], texts[ids[(i + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        errors.append(got[k]["near_edited"] - sum((a & b).values()) / sum((a | b).values()))
        assert got[k]["near_next"] == fingerprints.likeness(got[k]["fingerprint"], got[ids[(i + 1) % len(ids)]]["fingerprint"])
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_fingerprint_weights():
    rng = np.random.default_rng(1)
    terms = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = np.repeat(terms, rng.integers(1, 9, 60)), np.repeat(terms, rng.integers(1, 9, 60))
    ca, cb = collections.Counter(a.tolist()), collections.Counter(b.tolist())
    want = sum((ca & cb).values()) / sum((ca | cb).values())
    assert abs((fingerprints.signature(a) == fingerprints.signature(b)).mean() - want) < 0.15


def test_fingerprint_variates():
    """r and c are Gamma(2, 1), beta is uniform, and the weight 1 has the rank that its variate says."""
    rng = np.random.default_rng(3)
    r, lnc, beta = fingerprints.variates(product := rng.integers(0, 2**64, 200_000, dtype=np.uint64))
    for x in (r, np.exp(lnc)):
        assert abs(x.mean() - 2) < 0.02 and abs(x.var() - 2) < 0.06 and abs((x < 1).mean() - (1 - 2 / math.e)) < 0.005
    assert abs(beta.mean() - 0.5) < 0.005 and abs(beta.var() - 1 / 12) < 0.002 and abs(np.corrcoef(r, beta)[0, 1]) < 0.01 and abs(np.corrcoef(r, lnc)[0, 1]) < 0.01
    assert np.allclose(lnc + r * (beta - 1), np.log(fingerprints.once(product)))


def test_neighbours_of_repeated_ids(spark):
    """Ids that repeat go by a hash of the text; every row meets the next, the last one the first."""
    rows = [(5, f"text {i} of five") for i in range(40)] + [(5, "again and again")] * 20 + [(i, f"number {i} here") for i in range(6, 60)] + [(None, "no id"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    line = sorted(((-(1 << 63) if i is None else i, key[t or ""], t or "") for i, t in rows))
    want = collections.Counter()
    for (i, _, t), (_, _, u) in zip(line, [*line[1:], line[0]], strict=True):
        want[None if i == -(1 << 63) else i, hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.op1_fingerprint(df).collect()) == want


def test_quality_held_out(spark, docs):
    d = "/root/testdata/sf0.01"
    got = quality.op2_quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9


def quality_words(text):
    """Hashes of runs of letters, digits and non-ASCII signs, or of ASCII signs; each hashed by itself."""
    runs = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", text)
    return [int(_text.Words(np.frombuffer(r.encode(), np.uint8), np.array([0, len(r.encode())]), fold=False, kinds=np.ones(256, np.uint8)).hashes()[0]) for r in runs]


def quality_features(text):
    h = quality_words(text)
    out = [x >> (64 - quality.BITS) for x in h]
    for i in range(len(h) - 1):
        pair = _text.mix(np.array([(h[i] * 0x9E3779B97F4A7C15 + h[i + 1]) % 2**64], np.uint64))[0] >> np.uint64(64 - quality.BITS)
        out.append(quality.SAME_AGAIN if i and h[i + 1] == h[i - 1] else quality.SAME if h[i + 1] == h[i] else int(pair))
    return out


def test_quality_scores_by_plain_sums(spark, docs, texts):
    weights, intercept = model = quality.fit(docs, labels(spark))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for k, t in list(texts.items())[:60]:
        at = quality_features(t)
        want = 1 / (1 + math.exp(-(sum(float(weights[a]) for a in at) / math.sqrt(max(1, len(at))) + intercept)))
        assert math.isclose(got[k], want, rel_tol=1e-6)


def test_quality_learns_by_the_leader(monkeypatch):
    """FTRL-proximal against one number after another."""
    rng = np.random.default_rng(2)
    examples = [(int(rng.random() < 0.5), np.sort(rng.choice(50, 6, replace=False)), rng.random(6)) for _ in range(80)]
    z, n, size = collections.defaultdict(float), collections.defaultdict(float), 1 << quality.BITS

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for y, at, x in examples:
            pairs = [*zip(at.tolist(), x.tolist(), strict=True), (size, 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    weights, intercept = quality.train(examples)
    assert np.allclose(weights[:50], [weight(i) for i in range(50)], atol=1e-5) and math.isclose(intercept, weight(size), abs_tol=1e-9)


def test_samples_are_bounded_and_never_empty(spark):
    """Copies of an id or a row don't multiply in the samples of labelled rows, and few rows are all taken."""
    rows = [(1, "one and the same text again", "en")] * 400 + [(2, f"ein anderer text {i}", "de") for i in range(300)] + [(i, f"words of {i} and more", "en") for i in range(3, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] * 3, "doc_id long, quality int")
    weights, _ = quality.fit(df, known, sample=4)
    assert np.count_nonzero(weights)
    model = langid.fit(df, F.lit(True), sample=5)
    assert sorted(set(model.langs)) == ["de", "en"]
    got = {r["lang_pred"] for r in langid.predict(df, model).filter("doc_id = 2").collect()}
    assert got == {"de"}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for kind, rx in BASE.items():
        for m in re.finditer(rx, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(reversed(d))) % 10
            if {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and not luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark):
    rows = [(i, f"Filler words here. Please contact user handle: u{i}@mail.example.org now") for i in range(12)]
    rows += [(100, "Please contact user handle: zed_77x! and more"), (101, "later zed_77x again"), (102, "a@b.cc_x@d.ee 1.2.3.4.5.6.7.8 999.1.1.1 +1 (437) 555-0689\n4111 1111 1111 1111 é@x.y ü+49 (0)30-1234567.")]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in pii.op3_pii(df).collect()}
    for k, t in rows:
        assert got[k]["base_sha256"] == hashlib.sha256(base(t).encode()).hexdigest()
    assert got[100]["spans"] == "ctx-email:28:35" and got[101]["spans"] == "ctx-email:6:13"
    clean = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert clean[100]["text"] == "Please contact user handle: [CTX-EMAIL]! and more" and clean[100]["n_chars"] == len(clean[100]["text"])


def bootstrapped(texts):
    """New spans by the method, with sets and loops (texts whose cards and telephone numbers hold no spaces)."""
    runs = {}
    for d, t in enumerate(texts):
        out = []
        for m in re.finditer(r"\S+", t):
            lead = len(m[0]) - len(re.sub(r"^[^\w+@]+|^_+", "", m[0]))
            core = re.sub(r"[\W_]+$", "", m[0][lead:])
            if len(core) >= 4 and re.search(r"[0-9@]|[^\s_]_+[^\s_]", m[0]):
                out.append((m.start() + lead, core, " ".join(t[: m.start()][-pii.CONTEXT :].lower().split()[-2:])))
        runs[d] = out
    kind = lambda core: min((x.split(":")[0] for x in base(core).split(",") if x), default="secret" if re.fullmatch("[0-9a-f]{40}", core) else None)
    graph = {(p, core) for out in runs.values() for _, core, p in out if p}
    seeds = {core: kind(core) for _, core in graph if kind(core)}
    conf = {(c, k): 1.0 for c, k in seeds.items()}
    for _ in range(pii.ROUNDS):
        scores = {}
        for p in {p for p, _ in graph}:
            members = [c for q, c in graph if q == p]
            for k in {k for c in members for x, k in conf if x == c}:
                known = [conf[c, k] for c in members if (c, k) in conf]
                if sum(v >= pii.MIN_CONFIDENCE for v in known) >= pii.MIN_SEEDS:
                    scores[p, k] = sum(known) / (len(members) + pii.SMOOTH)
        conf = {(c, k): 1.0 for c, k in seeds.items()}
        for c in {c for _, c in graph} - set(seeds):
            for k in {k for _, k in scores}:
                doubt = [1 - v for (p, q), v in scores.items() if q == k and (p, c) in graph]
                if doubt:
                    conf[c, k] = 1 - math.prod(doubt)
    trusted = {}
    for (p, k), v in sorted(scores.items(), key=lambda x: (x[1], x[0][1])):
        if v >= pii.MIN_PRECISION:
            trusted[p] = k
    sure = {}
    for c in {c for _, c in graph}:
        for k in sorted(set(trusted.values())):
            v = 1 - math.prod(1 - scores[p, k] for p, q in trusted.items() if q == k and (p, c) in graph)
            if v >= pii.MIN_CONFIDENCE and v >= sure.get(c, (0, ""))[0]:
                sure[c] = v, k
    out = []
    for d in range(len(texts)):
        spans = [tuple(map(int, x.split(":")[1:])) for x in base(texts[d]).split(",") if x]
        new = []
        for start, core, p in runs[d]:
            kinds = [*([trusted[p]] if p in trusted else []), *([sure[core][1]] if core in sure else [])]
            if kinds and kind(core) in (None, "secret") and all(b <= start or a >= start + len(core) for a, b in spans):
                new.append((f"ctx-{min(kinds)}", start, start + len(core)))
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(new)))
    return out


def test_pii_bootstraps_like_sets_and_loops(spark):
    rng = np.random.default_rng(8)
    words = [f"w{c}" for c in "abcdefgh"]
    contexts = ["mail me", "api key", "login name:", "host at", "the thing"]
    makers = [
        lambda i: f"u{i}@mail.example.org", lambda i: f"{rng.integers(0, 256)}.{rng.integers(0, 256)}.0.{i % 256}", lambda i: "".join(rng.choice(list("0123456789abcdef"), 40)),
        lambda i: f"user_{i}", lambda i: f"x{i}-{i}", lambda i: f"zed_{i % 7}",
    ]
    usual = {"mail me": [0, 0, 0, 0, 3], "api key": [2, 2, 2, 2, 2, 5], "login name:": [0, 3, 5, 0, 0, 0], "host at": [1, 1, 1, 1, 4], "the thing": [0, 1, 2, 3, 4, 5]}
    texts = []
    for i in range(150):
        parts = []
        for _ in range(rng.integers(1, 5)):
            c = contexts[rng.integers(0, 5)]
            made = makers[usual[c][rng.integers(0, len(usual[c]))]](int(rng.integers(0, 60)))
            parts.append(f"{' '.join(rng.choice(words, rng.integers(0, 4)))} {c} {'(' * rng.integers(0, 2)}{made}{rng.choice(['', ',', '!', ' and'])}")
        texts.append(" ".join(parts))
    got = {r["doc_id"]: r for r in pii.op3_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = bootstrapped(texts)
    for i, t in enumerate(texts):
        assert ",".join(x for x in (base(t), want[i]) if x) == got[i]["spans"], t
    assert sum(r["n_added"] for r in got.values()) > 40


def test_pii_finds_secrets_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pii.op3_pii(docs).join(docs.select("doc_id", "text"), "doc_id").filter(r"text rlike '(?i)token = \"[0-9a-f]{40}'").collect()
    assert got and all("ctx-secret" in r["spans"] for r in got)


def test_pii_is_linear_in_a_texts_length(spark):
    import time

    many = " ".join(f"id_{i} or a{i}@b.cc" for i in range(50_000))
    df = spark.createDataFrame([(1, "x" * 200_000 + " b c 1@"), (2, many)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["n_email"] for r in pii.op3_pii(df).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got == {1: 0, 2: 50_000} and clean[2].count("[EMAIL]") == 50_000 and "@" not in clean[2]
    assert time.time() - began < 60


def test_pii_addresses_with_zero_parts(spark):
    rows = [(1, "at 10.0.0.1 or 0.0.0.0, then 010.001.000.255; 8.8.8.0"), (2, "00.1.2.3 000.000.000.000 0256.0.0.1 10.0.0.256 127.0.0.1"), (3, "0" * 2000 + ".0.0.0 and 300.0.0.0")]
    got = {r["doc_id"]: r for r in pii.op3_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["n_ip"] for k, _ in rows] == [4, 3, 1]
    assert all(got[k]["base_sha256"] == hashlib.sha256(base(t).encode()).hexdigest() for k, t in rows)


def test_mixing(spark):
    # a source must have rows enough for whole rows to come near its target: 1000 documents in 20 sources
    got = mixing.op4_mixing(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    by = got.groupby("source").agg(size=("size", "sum"), whole=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.whole).all() and (got.taken <= 3 * got["size"]).all()
    want = mixing.targets(dict(zip(by.index, by.whole, strict=True)))
    assert all(abs(want[s] - t) < 1e-6 for s, t in by.target.items())
    assert (abs(by.taken - by.target) <= 0.02 * by.target).all()
    tree = mixing.splitting_tree([10, 500, 33], 8)
    assert tree.sum(axis=1).tolist() == [10, 500, 33] and np.ptp(tree.sum(axis=0)) <= 3


def test_mixing_against_plain_targets(spark):
    """Targets by sharing the excess step by step in exact fractions, and takes within a row's size."""
    from fractions import Fraction

    rng = np.random.default_rng(6)
    sources = [None, "a", "b", "c", "d", "e"]
    rows = [(i if i % 5 else None, " ".join(["w"] * int(rng.integers(0, 30))), sources[min(5, int(rng.exponential(1.5)))]) for i in range(3000)]
    got = mixing.op4_mixing(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    want, open_ = {}, set(order)
    while open_:
        left = Fraction(sum(sizes.values())) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        want |= {s: Fraction(3 * sizes[s]) for s in over} if over else share
        open_ = open_ - over if over else set()
    for s in order:
        mine = got[got.source.isna()] if s is None else got[got.source == s]
        assert mine.source_size.iloc[0] == sizes[s] and math.isclose(mine.target.iloc[0], float(want[s]), rel_tol=1e-9)
        assert abs(mine.taken.sum() - float(want[s])) <= 15 and (mine.taken <= 3 * mine["size"]).all() and (mine.taken % mine["size"].clip(lower=1) == 0).all()


def test_mixing_splits_a_row_that_is_repeated(spark):
    rows = [(7, "one two three", "s")] * 3000 + [(None, f"word {i}", "s") for i in range(3000)] + [(i, "x y", "t") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sized = mixing.sized(df).withColumn("sid", F.lit(0))
    most = mixing._in_blocks(sized, 64).groupBy("block").count().agg(F.max("count")).first()[0]
    assert most < 1.2 * (mixing.HOT_ROWS + mixing.HOT_TIMES * 8000 / 64)
    got = mixing.op4_mixing(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 3 for r in got)


def test_draws_without_replacement():
    rng = np.random.default_rng(0)
    for good, bad, n in [(30, 50, 20), (500, 300, 640), (7, 9, 5)]:
        got = np.bincount([mixing.hypergeometric(rng, good, bad, n) for _ in range(20_000)], minlength=n + 1)
        log = math.lgamma
        ways = lambda a, b: log(a + 1) - log(b + 1) - log(a - b + 1) if 0 <= b <= a else -math.inf
        want = np.array([math.exp(ways(good, k) + ways(bad, n - k) - ways(good + bad, n)) if k <= good and n - k <= bad else 0.0 for k in range(n + 1)]) * 20_000
        some = want >= 5
        assert ((got[some] - want[some]) ** 2 / want[some]).sum() < some.sum() + 5 * math.sqrt(2 * some.sum()) and got[~some].sum() < 60
    good, bad, n = 3 * 10**12, 7 * 10**12, 10**12
    draws = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(3000)], float)
    spread = math.sqrt(n * 0.3 * 0.7 * 0.9)
    assert abs(draws.mean() - 0.3 * n) < 5 * spread / math.sqrt(3000) and 0.93 < draws.std() / spread < 1.07
    tree = mixing.splitting_tree([3 * 10**12, 10**10], 8)
    assert tree.sum(axis=1).tolist() == [3 * 10**12, 10**10] and np.ptp(tree.sum(axis=0)) <= 3


def test_language_held_out(docs):
    got = langid.op5_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.85


def test_language_scores_by_plain_cosines(docs, texts):
    model = langid.fit(docs, langid.trainable())
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    capitals = {bytes([0xC3, b]): bytes([0xC3, b + 0x20]) for b in range(0x80, 0x9F)}
    for k, t in list(texts.items())[:60]:
        raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in t.encode())
        raw = re.sub(b"\xc3[\x80-\x9e]", lambda m: capitals[m[0]], raw)
        n = collections.Counter()
        for size in (2, 3):
            for i in range(len(raw) - size + 1):
                gram = raw[i : i + size]
                if b"  " not in gram:
                    n[(int.from_bytes(gram, "big") * 2654435761 & 0xFFFFFFFF) >> (32 - langid.BITS)] += 1
        x = {i: math.log1p(c) * float(model.idf[i]) for i, c in n.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        like = [sum(v * float(c[i]) for i, v in x.items()) / length for c in model.centres]
        assert got[k]["lang_pred"] == model.langs[int(np.argmax(like))] and math.isclose(got[k]["score"], max(like), abs_tol=1e-4)


def test_language_of_what_has_no_letter(spark, docs):
    model = langid.fit(docs, langid.trainable())
    df = spark.createDataFrame([(1, "\u00b2 \u00bd 10"), (2, "\u2167"), (3, "12 _ !"), (4, "a"), (5, "\u0436"), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] == "und" for r in langid.predict(df, model).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True}


def test_language_model(docs, texts):
    got = lm.op6_lm(docs).collect()
    fold = str.maketrans({c: c + 32 for c in range(65, 91)})
    tokens = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t.translate(fold)) if w] + ["\0end"]
    counts = collections.Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 10 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in got:
        w = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0


def test_language_model_probabilities_sum_to_one():
    model = lm.fresh(np.random.default_rng(0).normal(0, 2, lm._SLOTS).astype(np.float32))
    windows = (np.uint64(0x6162636465) << np.uint64(8)) + np.arange(256, dtype=np.uint64)
    assert math.isclose((10 ** model.costs(windows)).sum(), 1, rel_tol=1e-9)


def test_language_model_slots_and_learning(texts):
    """Sums by tasks in pieces are those of all windows at once; learning leaves the slots as they were, in stretches or not."""
    some = [t.encode() for t in list(texts.values())[:30]] + [b"", b"z" * (lm._STRETCH + 1000)]
    data, offsets = np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])])
    windows, _ = lm.coded(data, offsets)
    zeros, ones = np.zeros(lm._SLOTS, np.int64), np.zeros(lm._SLOTS, np.int64)
    lm.add_slots(windows, np.ones(len(windows), np.int64), zeros, ones)
    batches = [pa.record_batch([pa.array(windows[i : i + 1000].view(np.int64)), pa.array(np.ones(len(windows[i : i + 1000]), np.int64))], names=["key", "n"]) for i in range(0, len(windows), 1000)]
    got = pa.Table.from_batches(lm._to_slots(iter(batches)))
    assert got["slot"].to_pylist() == np.flatnonzero(zeros + ones).tolist()
    assert np.array_equal(got["n"].to_numpy(), zeros[got["slot"].to_numpy()]) and np.array_equal(got["m"].to_numpy(), ones[got["slot"].to_numpy()])


def test_language_model_learns_for_unseen_text(texts):
    every = [t.encode() for t in dict.fromkeys(texts.values())]
    known, unseen = every[: len(every) * 2 // 3], every[len(every) * 2 // 3 :]
    of = lambda some: lm.coded(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]))[0]
    windows, times = np.unique(of(known), return_counts=True)
    zeros, ones = np.zeros(lm._SLOTS, np.int64), np.zeros(lm._SLOTS, np.int64)
    for i in range(0, len(windows), 1 << 16):
        lm.add_slots(windows[i : i + (1 << 16)], times[i : i + (1 << 16)], zeros, ones)
    zeros, ones = zeros.astype(np.float32), ones.astype(np.float32)
    model = lm.fresh(lm.stretched(zeros, ones))
    score = lambda: sum(model.costs(w).sum() for w in np.array_split(of(unseen), 40))
    plain = score()
    lm.learn(model, windows, times, zeros, ones)
    gated = score()
    sums, shares = np.zeros(len(model.refine)), np.zeros(len(model.refine))
    lm.cells(model, windows, times, zeros, ones, sums, shares)
    assert math.isclose(shares.sum(), 8 * times.sum(), rel_tol=1e-9)
    lm.refine(model, np.arange(len(sums)), sums, shares)
    assert plain < gated < score()


def test_language_model_scores_one_bit_after_another(spark):
    """Scores against a scorer that goes from bit to bit with plain counts of hashed contexts."""
    rows = [(i, t) for i, t in enumerate(["abracadabra " * 4, "the cat sat on the mat", "the mat sat", None, "", "Ünïcode ü", "zzzz the cat", "abra the", "cat", "on the abracadabra", "mat"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trained = lm.train(df.filter("doc_id % 3 > 0"))
    model, mask = trained.model, (1 << 64) - 1

    def mixed_bits(h):
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & mask
        h ^= h >> 29
        h = h * 0xC2B2AE3D27D4EB4F & mask
        return h ^ h >> 32

    def places(before, node):
        for k in range(lm.ORDERS):
            context = int.from_bytes(before[-k - 1 :], "big")
            yield int(lm._BASE[k]) + ((mixed_bits((context * int(lm._ORDER[k]) + int(lm._ORDER[k])) & mask) + node * int(lm._NODE)) * int(lm._NODE) & mask) % 2**64 // 2 ** (64 - lm.SLOT_BITS[k])

    def bits(text):
        seen = bytes(lm.ORDERS)
        for byte in (text or "").encode() + b"\0":
            node = 1
            for b in range(7, -1, -1):
                yield seen, node, byte >> b & 1
                node = 2 * node + (byte >> b & 1)
            seen += bytes([byte])

    counts = collections.defaultdict(lambda: [0, 0])
    for i, t in rows:
        if i % 3:
            for before, node, bit in bits(t):
                for at in places(before, node):
                    counts[at][bit] += 1
    got = {r["doc_id"]: r["score"] for r in lm.score(df, trained).collect()}
    for i, t in rows:
        total = 0.0
        for before, node, bit in bits(t):
            x = [math.log((counts[at][1] + lm.PRIOR) / (counts[at][0] + lm.PRIOR)) for at in places(before, node)]
            s = max(-11.5, min(11.5, sum(v * (model.gate1[node, k] + model.gate2[before[-1], k]) / 2 for k, v in enumerate(x))))
            level = (s + 12) * (lm.LEVELS - 1) / 24
            cell, part = (before[-1] * 256 + node) * lm.LEVELS + int(level), level - int(level)
            p = (model.refine[cell] * (1 - part) + model.refine[cell + 1] * part + 1 / (1 + math.exp(-s))) / 2
            total += math.log10(p if bit else 1 - p)
        assert math.isclose(got[i], total, rel_tol=1e-4), i


def test_transport_streams(texts):
    for t in [*list(texts.values())[:40], "", "x" * 4608, "y" * 9999]:
        payload = media_ts.pad(t.encode())
        stored = media_ts.mux(payload)
        got = media_ts.demux(stored)
        assert got.payload == payload and got.continuity_errors == 0 and got.program == 1 and len(payload) % 576 == 0 and payload
        assert got.pts == [6480 * 8 * i for i in range(len(got.pts))] and len(got.random_access) == len(got.pts)
    assert media_ts.demux(stored[:940] + stored[1128:]).continuity_errors == 1


def test_transport_streams_of_another_writer():
    """A stream put together by hand from the standard's fields: other numbers, a network table, stuffing, lost and repeated packets."""

    def crc(data):
        c = 0xFFFFFFFF
        for byte in data:
            for k in range(7, -1, -1):
                c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (c >> 31) ^ (byte >> k & 1) else 0)
        return c.to_bytes(4, "big")

    def table(kind, number, body):
        head = bytes([kind, 0xB0, len(body) + 9]) + number.to_bytes(2, "big") + b"\xc1\0\0" + body
        return head + crc(head)

    def packet(pid, counter, payload, start=False, adaptation=None):
        out = bytes([0x47, 0x40 * start | pid >> 8, pid & 255])
        room = 184 - len(payload)
        if adaptation is None and not room:
            return out + bytes([0x10 | counter]) + payload
        field = (adaptation or b"\0" if room > 1 else b"")
        field += b"\xff" * (room - 1 - len(field))
        return out + bytes([(0x30 if payload else 0x20) | counter, len(field)]) + field + payload

    def pes(data, pts=None, unbounded=False):
        stamp = b"" if pts is None else bytes([0x31 | (pts >> 30 & 7) << 1, pts >> 22 & 255, 1 | (pts >> 15 & 127) << 1, pts >> 7 & 255, 1 | (pts & 127) << 1])
        extra = b"" if pts is None else bytes([0x11, 0, 1, 0, 1])  # a decoding time too
        body = bytes([0x80, 0xC0 if stamp else 0, len(stamp + extra) + 2]) + stamp + extra + b"\xff\xff" + data
        return b"\0\0\1\xe0" + (0 if unbounded else len(body)).to_bytes(2, "big") + body

    pat = table(0, 9, b"\0\0\xe0\x10" + (7).to_bytes(2, "big") + (0xE000 | 0x55).to_bytes(2, "big"))
    pmt = table(2, 7, (0xE000 | 0x66).to_bytes(2, "big") + b"\xf0\x03\x05\x01\x41" + b"\x1b" + (0xE000 | 0x66).to_bytes(2, "big") + b"\xf0\x00" + b"\x0f\xe0\x67\xf0\0")
    one, two = bytes(range(200)) + b"\0\0\1tail", b"second" * 50
    first, second = pes(one, 2**33 - 5), pes(two, unbounded=True)
    cut = lambda data: [data[i : i + 150] for i in range(0, len(data), 150)]
    es, counter = [], 13
    for data, access in ((first, True), (second, False)):
        for n, part in enumerate(cut(data)):
            es.append(packet(0x66, counter, part, n == 0, b"\x40" if access and n == 0 else None))
            counter = (counter + 1) % 16
    idle = packet(0x66, 14, b"")
    tables = [packet(0, 3, b"\x02xx" + pat, True), packet(0x55, 8, b"\0" + pmt, True)]
    got = media_ts.demux(b"".join([packet(0x1FFF, 0, b"z" * 184), *tables, es[0], idle, es[1], es[1], *es[2:]]))
    assert (got.program, got.pmt_pid, got.es_pid, got.stream_type, got.continuity_errors) == (7, 0x55, 0x66, 0x1B, 0)
    assert got.payload == one + two and got.pts == [2**33 - 5, None] and got.random_access == [3]
    assert media_ts.demux(b"".join([*tables, es[0], *es[2:]])).continuity_errors == 1
    with pytest.raises(ValueError):
        media_ts.demux(b"".join(tables).replace(b"\x41", b"\x42"))


def test_licenses(spark, docs):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    key = lambda r: (r["doc_id"], r["digest"], r["whole_license"], r["license_lines"], r["licenses"])
    want = con.sql(licenses.oracle()).df().astype(object)
    want = want.where(want.notna(), None)
    assert sorted(map(key, licenses.op8_licenses(docs).collect())) == sorted(map(key, want.to_dict("records")))
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and t.startswith("MIT License"))
    df = spark.createDataFrame([(1, "Copyright (c) 2021 A B\n" + mit.upper().replace("LICENSE", "LICENCE")), (2, mit + " but not"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["whole_license"] for r in licenses.op8_licenses(df).collect()}
    assert got == {1: "MIT", 2: None, 3: None}


def test_licenses_joined_or_literal(spark, docs, monkeypatch):
    """A large table of known texts is joined, with the same result; an empty one finds nothing."""
    known = licenses.known(spark)
    rows = lambda: sorted((r["doc_id"], r["whole_license"] or "", r["license_lines"], r["licenses"]) for r in licenses.scan(docs, known).collect())
    few = rows()
    assert "Exchange" not in licenses.scan(docs, known)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(licenses, "LITERAL", 3)
    assert rows() == few and any(x[2] for x in few)
    assert licenses.scan(docs, known.limit(0)).filter("license_lines > 0 or whole_license is not null").count() == 0


def test_full_licenses(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
    rows = [(i, open(f"/usr/share/common-licenses/{name}").read().upper()) for i, name in enumerate(names)]
    rows.append((99, 'Text.\n   Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file'))
    got = {r["doc_id"]: r for r in licenses.op8_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["whole_license"] for i in range(len(names))] == list(names.values())
    assert got[99]["licenses"] == "Apache-2.0" and got[99]["license_lines"] == 1 and got[99]["whole_license"] is None


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.op9_packing(docs).toPandas()
    for k, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        want = [zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes()) for i in range(0, len(ids), 4096)]
        assert got[got.doc_id == k].sort_values("piece").ids_crc32.tolist() == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) + 1


def test_tokenizer_gives_the_vocabularys_ids(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    mine, rng = packing.WordTokenizer(packing.vocabulary_path()), np.random.default_rng(0)
    signs = list("etaoinshrdlucmfwypvbgkjqxzETAOéüñßÀ'-.0123<|>\u00a0\u0301\u0416\u4e00\u2028\U0001f600")
    for _ in range(40):
        text = " ".join("".join(rng.choice(signs, rng.integers(1, 12))) for _ in range(300)) + " <|endoftext|> it's  \n we'll\t"
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids


def sequential_best_fit(lengths, capacity):
    """Sequences that best fit by falling length needs, one piece after another."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in left if g >= n]
        if fits:
            left[left.index(min(fits))] -= n
        else:
            left.append(capacity - n)
    return len(left)


@pytest.mark.parametrize("kind", ["mixed", "hot", "long"])
def test_packing_in_many_ranges(spark, kind):
    """Whole and gapless in any number of ranges, and about as few sequences as one sweep over all rows."""
    rng = np.random.default_rng(4)
    lengths = {
        "mixed": np.minimum(np.exp(rng.normal(5, 1.5, 900)).astype(int) + 1, 1000), "hot": np.where(rng.random(900) < 0.4, 333, rng.integers(1, 1001, 900)), "long": np.full(50, 1000),
    }[kind].tolist()
    rows = spark.createDataFrame([(i % 7, n, "x") for i, n in enumerate(lengths)], "id long, length long, row string")
    got = packing.pack(rows, 1000, 150).toPandas()
    assert sorted(got.length) == sorted(lengths) and list(got.columns) == ["id", "length", "row", "sequence_id", "offset"]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 1000
    assert got.sequence_id.nunique() <= 1.01 * sequential_best_fit(lengths, 1000) + 1


def test_best_fit_takes_the_smallest_gap():
    taken, offsets, left = packing.best_fit(np.array([7, 5, 5, 3, 2, 2]), np.array([6, 9, 5]), 10)
    assert taken.tolist() == [1, 2, 0, -1, 1, -1] and offsets.tolist() == [1, 5, 4, 0, 8, 0] and left.tolist() == [1, 0, 0]


def test_deals_come_from_the_nearest_range_above():
    assert packing.deals([(0, 0, None, 3, 90), (1, 2, 50, 2, 40), (2, 3, 30, 0, None)]) == [(0, 0, 2, 1), (1, 0, 2, 2), (0, 2, 3, 2)]


def components(fps, radius=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius):
            parent[find(i)] = find(i + 1 + int(j))
    return [find(i) for i in range(len(fps))]


def test_covering_masks_miss_no_pair():
    masks, rng = neardup.covering_masks(), np.random.default_rng(3)
    for _ in range(3000):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not m & flip for m in masks)


@pytest.mark.parametrize("limit", [neardup.RUN_LIMIT, 4])
def test_links_of_planted_groups(spark, limit):
    rng = np.random.default_rng(5)
    fps = set()
    for c in rng.integers(0, 2**63, 6, dtype=np.uint64):
        x = int(c)
        for _ in range(12):
            fps.add(x)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
    values = np.array(sorted(fps), np.uint64)
    nodes = spark.createDataFrame([(neardup._signed(int(v)),) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in neardup.components(neardup.links(nodes, run_limit=limit)).collect()}
    mine = [got.get(neardup._signed(int(v)), neardup._signed(int(v))) for v in values]
    same = lambda labels: {tuple(np.flatnonzero([x == y for x in labels])) for y in labels}
    assert same(mine) == same(components(values))


def test_components_of_an_ordered_path(spark, monkeypatch):
    written = []
    keep = neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df, label: written.append(label) or keep(df, label))
    edges = spark.createDataFrame([(i, i + 1) for i in range(1000)] + [(5000, 5001)], "a long, b long").coalesce(2)
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(1001)} | {5000: 5000, 5001: 5000}
    assert written.count("edges") <= 9


def test_simhash(docs, texts):
    import xxhash

    got = {r["doc_id"]: r for r in neardup.op10_simhash(docs).collect()}
    for k, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", t.translate(str.maketrans({c: c + 32 for c in range(65, 91)}))) if x]
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        assert got[k]["fingerprint"] == f"{sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64)):016x}"
    ids = sorted(texts)
    labels_ = components(np.array([int(got[k]["fingerprint"], 16) for k in ids], np.uint64))
    least = {}
    for k, c in zip(ids, labels_, strict=True):
        least[c] = min(k, least.get(c, k))
    assert all(got[k]["component_id"] == least[c] for k, c in zip(ids, labels_, strict=True))


def test_pipeline(spark, awkward, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and set(out.doc_id) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    one = corpus_pipeline.near_duplicates(spark, awkward.select("doc_id", "text", "lang", "source", "n_chars"), SF)
    assert one.filter("text = 'word'").count() == 1 and one.filter("text like 'One two%'").count() == 1 and one.filter("doc_id is null").count() == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_a_large_group_of_edited_copies_takes_few_pairs(spark, monkeypatch):
    """Copies with random edits, of which many pairs are just below 0.8, find their classes without all pairs being verified."""
    import corpus_pipeline
    from chronoweave.llm import alike

    asked = []
    keep = alike.verified
    monkeypatch.setattr(alike, "verified", lambda pairs, texts: asked.append(pairs.count()) or keep(pairs, texts))
    rng = np.random.default_rng(12)
    base, texts = [f"w{w}" for w in rng.integers(0, 5000, 150)], []
    for _ in range(300):
        words = list(base)
        for k in rng.integers(0, 150, int(rng.integers(0, 5))):
            words[k] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and len(a & b) >= 0.8 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for i, x in enumerate(label):
        least.setdefault(x, i)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
    assert got == sorted(least.values()) and len(got) < 60 and sum(asked) < 300 * 299 / 2 / 4


def test_rare_shingles_lose_no_pair(spark):
    """All pairs of alike sets are proposed, and a passage that all texts share proposes few others."""
    from chronoweave.llm import alike

    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(100))
    texts = [f"{passage} " + " ".join(f"w{w}" for w in rng.integers(0, 10**6, 90)) for _ in range(80)]
    for t in texts[:20]:
        words = t.split()
        words[int(rng.integers(100, 190))] = "edited"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    members = spark.createDataFrame([(i, i, len(s)) for i, s in enumerate(sets)], "id long, root long, size long")
    rare, central = alike.rare_shingles(members, df)
    got = {(r["a"], r["b"]) for r in alike.pairs_by_rare_shingles(members.select("id", "root"), rare).collect()}
    many = collections.Counter(x for s in sets for x in s)
    own = {r["id"]: r["own"] for r in central.collect()}
    assert all(own[i] in (sum(many[x] == 1 for x in s), len(s)) for i, s in enumerate(sets))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) == 20 and want <= got and len(got) < 60


def test_columns_of_any_name(spark):
    """Extra columns named like the operators' own, or with a dot, come out as they went in."""
    import corpus_pipeline

    names = ["row_", "uid", "mix_shard", "kept_0", "a.b", "id", "sid", "base", "x0", "block"]
    rows = [(i, f"Write to a{i}@b.org about number {i} and then some more words of {i * 7919}", "en", "s", 9, *(f"{n}{i}" for n in names)) for i in range(30)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and all(r["a.b"] == f"a.b{r['doc_id']}" and r["mix_shard"] == f"mix_shard{r['doc_id']}" for r in out.collect())
    assert set(corpus_pipeline.packing_(spark, df, SF).columns) >= {"doc_id", "sequence_id", "offset"}
    assert mixing.mix(df).columns == [*df.columns, "mix_shard_"]


@pytest.mark.parametrize("few", [0, 16])
def test_pipeline_near_duplicates(spark, monkeypatch, few):
    """One row of each class at a Jaccard similarity of 0.8 or more of five-word shingles, by brute force."""
    import corpus_pipeline
    from chronoweave.llm import alike

    monkeypatch.setattr(alike, "FEW", few)
    rng = np.random.default_rng(11)
    texts = ["", "  ", "one", "One ", "one two"]
    for length in rng.integers(30, 300, 40):
        texts.append(" ".join(f"w{w}" for w in rng.integers(0, 5000, length)))
        for edits in rng.integers(1, 8, 4):  # copies of copies, with some words changed
            words = texts[-1].split()
            for k in rng.integers(0, len(words), edits):
                words[k] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    label = list(range(len(texts)))
    linked = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                linked += 1
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for i, x in enumerate(label):
        least.setdefault(x, i)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
    assert linked > 60 and got == sorted(least.values())


def test_near_duplicates_meet_by_covering_lsh(spark, monkeypatch):
    """Chains of fingerprints within 3 bits are connected, and nearly equal texts are found where no band proposes them."""
    from chronoweave.llm import alike

    rng = np.random.default_rng(11)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centres for k in (0, 1, 2, 3, 5)]
    fps += fps[:4]
    nodes = spark.createDataFrame([(k, f - 2**64 if f >= 2**63 else f) for k, f in enumerate(fps)], "id long, fp long")

    def classes(edges):
        root = list(range(len(fps)))
        for a, b in edges:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
        return root

    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    got = [(r["a"], r["b"]) for r in alike.pairs_by_fingerprints(nodes).collect()]
    assert classes(got) == classes(near) and set(got) <= set(near) and all(a > b for a, b in got)

    words = [f"w{x}" for x in rng.integers(0, 5000, 600)]
    texts = [" ".join(words), " ".join([*words[:-1], "last"]), " ".join(f"v{x}" for x in rng.integers(0, 5000, 600))]
    assert (int(alike.simhashes(*_sets(texts[0]))[0]) ^ int(alike.simhashes(*_sets(texts[1]))[0])).bit_count() <= 3
    plain = alike.bands
    fresh = iter(range(10**9))
    monkeypatch.setattr(alike, "BANDS", 1)
    monkeypatch.setattr(alike, "bands", lambda hashes, at: (plain(hashes, at)[0], np.array([[next(fresh)] for _ in range(len(at) - 1)], np.uint64)))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    assert sorted(r["id"] for r in alike.firsts(docs, "id", "text").collect()) == [0, 2]


def _sets(text):
    from chronoweave.llm import alike

    raw = np.frombuffer(text.encode(), np.uint8)
    return alike.shingle_sets(raw, np.array([0, len(raw)]))
