"""Golden fixtures, file layouts, and every catalogue query against DuckDB on the smallest tables."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave import config
from chronoweave.config import Settings, filter_mode, label_scores, numbers, truthy
from chronoweave.functions import scalar
from chronoweave.functions.answers import answer
from chronoweave.operators import candidates, clusters, evaluate, forecast, history, prompts
from chronoweave.plans import catalogue
from chronoweave.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    columns = sorted(frame.columns)
    clean = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(([clean(v) for v in r] for r in frame[columns].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def quads(spark, rows):
    return files.canonical(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_idx long, subject string, relation string, object string, ts_raw string"))


def asked(spark, q, raw, s=Settings()):
    df = spark.createDataFrame([(1, q[0], q[1], q[1].lower(), raw)], "query_id long, sq string, rq string, rq_norm string, tq_raw string")
    return history.with_settings(df.withColumn("tq", scalar.parse_time(F.col("tq_raw"))), s)


def test_history_and_self_loop(spark):
    q = quads(spark, [("USA", "meet", "China", "2014-01-01"), ("USA", "meet", "Mexico", "2013-12-01"), ("Canada", "visit", "USA", "2015-01-01"), ("USA", "praise", "USA", "2013-01-01")])
    h = history.entity_history(history.endpoints(q)).filter("entity = 'USA'").orderBy("pos").collect()
    assert [r["object"] if r["subject"] == "USA" else r["subject"] for r in h] == ["USA", "Mexico", "China", "Canada"]


def test_short_term_counts_unknown_times_as_newest(spark):
    q = quads(spark, [("A", "r", "B", "2014-01-02"), ("A", "r", "C", "2014-01-01"), ("A", "r", "D", "junk"), ("A", "r", "E", "2014-01-03")])
    h = history.history_before(asked(spark, ("A", "r"), "2014-02-01", Settings(short=2)), history.endpoints(q))
    assert {r["object"] for r in history.short_term(h).collect()} == {"D", "E"}


def test_pool_drops_all_copies_of_a_short_term_event(spark):
    q = quads(spark, [("A", "r", "B", "2014-01-01"), ("A", "r", "B", "2014-01-01"), ("A", "r", "C", "2013-01-01")])
    h = history.history_before(asked(spark, ("A", "r"), "2014-02-01", Settings(short=1)), history.endpoints(q))
    assert [r["object"] for r in history.long_term_pool(h).collect()] == ["C"]


def test_single_event_days_are_kept_and_lengths_bounded(spark):
    q = quads(spark, [("A", "r", f"o{i}", f"2014-01-{i + 1:02d}") for i in range(20)])
    h = history.history_before(asked(spark, ("A", "r"), "2014-02-01", Settings(short=5, total=12)), history.endpoints(q))
    both = history.dual_history(h).collect()
    assert len(both) == 12 and sum(r["is_short"] for r in both) == 5


def test_candidates(spark):
    q = quads(spark, [("China", "meet", "Japan", "2013-01-01"), ("China", "meet", "Russia", "2013-06-01"), ("China", "consult", "Japan", "2013-09-01"), ("China", "meet", "India", "2013-12-01"), ("Russia", "meet", "Belarus", "2013-01-01"), ("Japan", "visit", "China", "2013-03-01"), ("China", "meet", "?", "2013-01-05")])
    ends, ask = history.endpoints(q), asked(spark, ("China", "meet"), "2014-01-01")
    first = candidates.first_order(ask, ends)
    one = candidates.as_lists(first).first()["candidates"]
    two = candidates.as_lists(candidates.second_order(ask, first, ends)).first()["candidates"]
    assert one == ["India", "Japan", "Russia"] and two == ["Belarus", "India", "Japan", "Russia"]
    assert candidates.adaptive(ask, first, ends, 4).filter("second").count() == 4


def test_candidates_of_unknown_times(spark):
    q = quads(spark, [("A", "r", "B", "junk"), ("A", "r", "C", "2014-03-01"), ("D", "r", "A", "2014-01-01"), ("A", "r", "C", "2014-01-05")])
    ends = history.endpoints(q)
    for raw, want in (("2014-01-03", {"B", "D"}), ("2014-02-01", {"B", "C", "D"}), ("junk", {"B", "C", "D"})):
        ask = asked(spark, ("A", "r"), raw)
        assert {r["candidate"] for r in candidates.first_order(ask, ends).collect()} == want
        h = history.neighbours(history.history_before(ask, ends))
        assert {r["neighbour"] for r in h.collect()} == want


def test_answers(spark):
    three, two = ["a", "b", "cc"], ["q", "zz"]
    cases = [
        ("x\nAnswer: 2", three, "b"), ("[3]", three, "cc"), ("the answer is 9 or\nanswer is 1", three, "a"), ("cc", three, "cc"), ('"b"', three, "b"), ("2", three, "b"), ("maybe cc then", three, "cc"),
        (")", three, ""), ("none of 5", three, "none of 5"), ("1. text\nno", two, "1. text"), (None, three, ""), ("Choice: 3 it is", three, "cc"), ("2 of them", three, "b"), ("3.\n\n  ", three, "cc"),
        ("2\nfinal 1", three, "a"), ("7\n2", three, "b"), ("x" * 900 + " [2]", three, "b"), ("[2] " + "x" * 900, three, "[2] " + "x" * 900), ("  free text ", [], "free text"), ("zz q", ["", "q", "zz"], "zz"), (None, None, ""),
    ]
    rows = spark.createDataFrame(cases, "output string, candidates array<string>, want string")
    assert [(r["output"], r["got"]) for r in rows.withColumn("got", answer(F.col("output"), F.col("candidates"))).collect()] == [(o, w) for o, _, w in cases]


def test_settings_from_an_environment():
    s = Settings.from_env({"SHORT_TERM_L": "5", "DISABLE_LONG_TERM": "yes", "EVAL_FILTER": "time_aware", "MAX_LOGPROB_CANDIDATES": "7", "LLM_PROVIDER": "hf", "MIN_SIMILAR_HISTORY_LENGTH": "3"})
    assert (s.short, s.use_long, s.filter, s.max_scored, s.label_scores, s.least_history) == (5, False, "time-aware", 7, False, 3)
    assert [truthy(x) for x in ("1", " Yes ", "on", "0", "", None)] == [True, True, True, False, False, False] and truthy("", True)
    assert label_scores({}) and not label_scores({"USE_LOGPROB_PREDICTION": "0"}) and numbers("1, 2,", ()) == (1, 2) and numbers(" ", (3,)) == (3,)


def test_presets():
    assert config.INTERACTIVE.least_history == 40 and config.METRICS.least_history == 25 and config.FAST.least_history == 17 and config.DEFAULT.least_history == 100
    assert (config.METRICS.event_cap, config.METRICS.chunk, config.FAST.total) == (32, 16, 40) and config.DEFAULT.label_scores and not config.FAST.label_scores


def test_number_of_clusters(spark):
    """The elbow is the point farthest from the chord; three groups far apart are found as three."""
    assert clusters.elbow([2, 3, 4, 5, 6], [100.0, 20.0, 15.0, 10.0, 5.0]) == 3
    rows = [(f"e{g}_{i}", [float(g == k) + 0.01 * ((i * 7 + k) % 5) for k in range(3)]) for g in range(3) for i in range(20)]
    k, tried = clusters.optimal_k(spark.createDataFrame(rows, "entity string, features array<float>"), restarts=2)
    assert k == 3 and [t[0] for t in tried] == list(range(2, 8)) and {t[0] for t in tried if t[2] is not None} == {2, 3, 4, 5}


def test_templates_and_generator(spark, tmp_path):
    (tmp_path / "answer.txt").write_text("{query}|{candidates}|{history}|{analogies}")
    (tmp_path / "other.txt").write_text("not ours")
    t = prompts.templates_of(spark, str(tmp_path))
    assert t.answer.startswith("{query}|") and t.score == prompts.SCORE
    w = catalogue.World(spark, SF, settings=catalogue._EXAMPLES)
    models = forecast.Models(generator=lambda prompt: F.concat(F.lit("Because: "), F.length(prompt).cast("string")))
    rows = forecast.contexts(w.queries.limit(5), w.ends, w.entities, catalogue._EXAMPLES, models, t).collect()
    assert rows and all(r["prompt"].startswith(r["question"] + "|1. ") for r in rows) and any("Because: " in r["prompt"] for r in rows)


def test_a_whole_run_clusters_once(spark):
    s = Settings(analogies=1, min_contexts=5, min_history=0)
    w = catalogue.World(spark, SF, settings=s)
    records, rates = forecast.evaluated(w.quads, w.queries, w.ends, s=s, start=2, n=6, sample=20)
    row = rates.first()
    assert row["evaluated"] + row["skipped"] == 6 == records.count()
    some = forecast.clustered(w.ends, w.queries, 20, k=3)
    assert some.join(w.queries, some["entity"] == w.queries["sq"]).count() == w.queries.count() and some.select("cluster").distinct().count() <= 3


def test_scorers_that_say_too_little_fail(spark):
    w = catalogue.World(spark, SF)
    models = forecast.Models(scorer=forecast.chunk_scorer(lambda prompt, events: [1.0] * (len(events) - 1)), chunked=True)
    with pytest.raises(Exception, match="scores for"):
        forecast.retrieved(w.queries, w.ends, Settings(chunk=2), models).count()


def test_cache_saves_time_and_clusters_need_vectors(spark, tmp_path):
    cache = files.ResponseCache(spark, str(tmp_path / "c"))
    took = forecast.timed(spark.createDataFrame([("a",), ("b",)], "payload string"), cache, lambda rows: rows.withColumn("value", F.upper("payload")) if "payload" in rows.columns else rows)
    assert set(took) == {"off", "warm", "on", "speedup", "saved"} and cache.clear() == 2
    some = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "entity string")
    got = clusters.cluster_entities(some, k=2, restarts=1)
    assert got.k == 2 and got.entities.count() == 4 and -1 <= got.silhouette <= 1
    with pytest.raises(ValueError):
        clusters.cluster_entities(some, clusters.embed(some.limit(2)), 2)


def test_phrases(spark):
    rows = [("visit", "made a visit to"), ("Stop talks with", "stopped talks with"), ("try", "tried with"), ("", "interacted with"), ("y", "yed with")]
    got = spark.createDataFrame(rows, "r string, want string").withColumn("got", scalar.phrase(F.col("r"))).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_loaders(spark, tmp_path):
    d = tmp_path / "plain"
    d.mkdir()
    (d / "train").write_text("subject\trelation\tobject\ttimestamp\nA\tmeet\tB\t2014-01-01\textra\nshort\trow\nC\tvisit\tD\t\n")
    (d / "valid.txt").write_text('E,"meet, with",F,2014-01-02\n')
    got = files.read_quads(spark, str(d)).orderBy("event_idx").collect()
    assert [(r["split"], r["subject"], r["relation"], r["ts_raw"]) for r in got] == [("train", "A", "meet", "2014-01-01"), ("train", "C", "visit", ""), ("valid", "E", "meet, with", "2014-01-02")]
    e = tmp_path / "coded"
    e.mkdir()
    (e / "train.txt").write_text("0\t0\t1\t24\n7\t0\tx\t24\n0\t9\t7\t24\n1\t2\n")
    (e / "entity2id.txt").write_text("South_Korea\t0\nJapan\t1\nbad\n")
    (e / "relation2id.txt").write_text("Make_a_visit\t0\n")
    got = files.read_quads(spark, str(e)).orderBy("event_idx").collect()
    assert [(r["subject"], r["relation"], r["object"]) for r in got] == [("South Korea", "make a visit", "Japan"), ("7", "0", "x"), ("South Korea", "9", "7")]
    assert str(got[0]["day"]) == "2005-01-25"
    j = tmp_path / "e.json"
    j.write_text(json.dumps([{"s": "A", "rel": "meet", "tail": "B", "time": "2014-01-01"}, {"subject": "", "head": "C", "r": "x", "o": "D"}]))
    assert [(r["subject"], r["object"]) for r in files.read_quads(spark, str(j)).orderBy("event_idx").collect()] == [("A", "B"), ("C", "D")]
    lines = tmp_path / "e.jsonl"
    lines.write_text('{"s": "A", "r": "meet", "o": "B", "t": "2014-01-01", "more": [1]}\n{"subject": "C", "relation": " Visit ", "object": "D", "timestamp": 5}\n\n')
    assert [(r["subject"], r["relation_norm"], r["object"], str(r["day"])) for r in files.read_quads(spark, str(lines)).orderBy("event_idx").collect()] == [("A", "meet", "B", "2014-01-01"), ("C", "visit", "D", "2005-01-06")]
    broken = tmp_path / "q.csv"
    broken.write_text('A,"meets\nand, greets",B,2014-01-01\nC,"says ""no""",D,2014-01-02\nshort,row\n')
    assert [(r["subject"], r["relation"], r["ts_raw"]) for r in files.read_quads(spark, str(broken)).orderBy("event_idx").collect()] == [("A", "meets\nand, greets", "2014-01-01"), ("C", 'says "no"', "2014-01-02")]
    (tmp_path / "o.json").write_text("{}")
    with pytest.raises(ValueError):
        files.read_quads(spark, str(tmp_path / "o.json"))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_quads(spark, str(tmp_path / "none"))


def test_cache_computes_misses_once(spark, tmp_path):
    cache = files.ResponseCache(spark, str(tmp_path / "cache"))
    ask = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b")], "key string, payload string")
    compute = lambda df: df.withColumn("value", F.upper("payload"))
    assert sorted(r["value"] for r in cache.fill(ask, compute).collect()) == ["A", "A", "B"]
    assert sorted(r["value"] for r in cache.fill(ask, lambda df: df.withColumn("value", F.lit("no"))).collect()) == ["A", "A", "B"]
    cache.put(spark.createDataFrame([("k1", "newer")], "key string, value string"))
    assert sorted(r["value"] for r in cache.table().collect()) == ["B", "newer"] and cache.clear() == 3


def test_records_round_trip_and_filters(spark, tmp_path):
    w = catalogue.World(spark, SF)
    records = evaluate.records(w.ranks, w.queries)
    files.write_records(records, str(tmp_path / "r"))
    again = files.read_records(spark, str(tmp_path / "r"))
    assert evaluate.posthoc(again).collect() == evaluate.posthoc(records).collect()
    with pytest.raises(ValueError):
        filter_mode("other")


def test_streaming_last_events(spark, tmp_path):
    from chronoweave.streaming.recent import last_events

    spark.createDataFrame([("a", i, f"2024-01-01 00:00:0{i}") for i in range(6)], "entity string, event_idx long, t string").select("entity", "event_idx", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity string, event_idx long, ts timestamp").parquet(str(tmp_path / "in"))
    q = last_events(stream, 3).writeStream.format("memory").queryName("recent").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["event_idx"] for r in spark.table("recent").collect()) == [3, 4, 5]


def test_streaming_counts(spark, tmp_path):
    from chronoweave.streaming.recent import counts

    rows = [("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 23:00:00"), ("b", "2024-01-01 12:00:00"), ("a", "2024-01-02 00:00:00"), ("a", "2024-01-09 00:00:00")]
    spark.createDataFrame(rows, "relation string, t string").select("relation", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("relation string, ts timestamp").parquet(str(tmp_path / "in"))
    q = counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((str(r["window"]["start"])[:10], r["relation"], r["n"]) for r in spark.table("counted").collect())
    assert got == [("2024-01-01", "a", 2), ("2024-01-01", "b", 1), ("2024-01-02", "a", 1), ("2024-01-09", "a", 1)]


def likeness(spark, rows, schema="id long, name string, at timestamp, features array<double>, g string"):
    return spark.createDataFrame(rows, schema)


def test_best_of_a_group_without_pairs(spark, monkeypatch):
    """Blocks, ties by name, the question's own name, times, repeated names, null and NaN features, against all pairs."""
    import datetime as dt
    import math

    import numpy as np

    from chronoweave.operators import nearest

    monkeypatch.setattr(nearest, "BLOCK", 3)
    monkeypatch.setattr(nearest, "CELLS", 20)
    rng = np.random.default_rng(5)
    day = lambda n: dt.datetime(2024, 1, 1 + int(n))
    vector = lambda: [float(x) for x in rng.integers(-2, 3, 3)]
    members = [(None, f"m{k % 17}", day(k) if k % 4 else None, vector(), "ab"[k % 2]) for k in range(24)]
    members += [(None, "odd", None, None, "a"), (None, "gap", None, [1.0, None, 2.0], "a"), (None, "nan", None, [math.nan, 0.0, 1.0], "a"), (None, "short", None, [1.0], "a")]
    asked = [(k, f"m{k}", day(k) if k % 5 else None, vector(), "ab"[k % 2]) for k in range(16)] + [(99, "z", None, [1.0, 1.0, 1.0], "c")]
    got = nearest.compared(likeness(spark, asked), likeness(spark, members), ["g"]).collect()

    def like(a, b):
        if a is None or b is None or len(a) != len(b) or None in a + b:
            return None
        return sum((x * y for x, y in zip(a, b, strict=True)), 0.0)

    want = {}
    for i, name, at, mine, g in asked:
        open_ = sorted((m for m in members if m[4] == g and m[1] != name and (at is None or m[2] is None or m[2] < at)), key=lambda m: m[1])
        rows = [(m[1], like(mine, m[3])) for m in open_]
        want[i] = sorted(rows, key=lambda r: (1, 0) if r[1] is None else (-1, 0) if math.isnan(r[1]) else (0, -r[1]))
    text = lambda rows: [f"{n} {s}" for n, s in rows]
    found = {i: text([(r["peer"], r["similarity"]) for r in sorted(got, key=lambda r: r["nth"]) if r["id"] == i]) for i in want}
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(text(v)) for i, v in want.items()}
    assert {i: [x.split()[1] for x in v] for i, v in found.items()} == {i: [x.split()[1] for x in text(v)] for i, v in want.items()}
    best = nearest.compared(likeness(spark, asked), likeness(spark, members), ["g"], 2).collect()
    for i, rows in want.items():
        names = list(dict.fromkeys(n for n, _ in rows))[:2]
        assert set(names) <= {r["peer"] for r in best if r["id"] == i}


def test_similar_events_of_large_clusters_make_no_pairs(spark):
    """A peer in two clusters or with two rows counts once, and no join of questions and members is left in the plan."""
    from chronoweave.operators import similar

    q = quads(spark, [("B", "r", "x", "2014-01-01"), ("B", "r", "y", "2014-01-02"), ("C", "r", "x", "2014-01-03"), ("C", "r", "z", "2014-01-05")])
    s = Settings(analogies=2, min_contexts=0, min_history=0)
    names = spark.createDataFrame([("A", [1.0], 0), ("A", [1.0], 1), ("B", [0.5], 0), ("B", [0.25], 1), ("C", [0.4], 0)], "entity string, features array<double>, cluster int")
    got = similar.similar_events(asked(spark, ("A", "r"), "2014-02-01", s), names, history.endpoints(q), s)
    assert [(r["nth"], r["peer"], r["event_idx"], r["similarity"]) for r in got.orderBy("nth").collect()] == [(1, "B", 0, 0.5), (2, "C", 2, 0.4)]


def test_own_histories_are_asked_in_order_until_one_is_long_enough(spark, monkeypatch):
    from chronoweave.operators import similar

    q = quads(spark, [("B", "r", f"o{i}", f"2014-01-{i + 1:02d}") for i in range(20)])
    s, tried = Settings(short=3, total=6, analogies=1, min_contexts=0, min_history=6), []
    plain = similar.long_enough
    monkeypatch.setattr(similar, "long_enough", lambda events, ends, s: tried.append(events.count()) or plain(events, ends, s))
    pairs = spark.createDataFrame([("B", "r")], "subject string, relation_norm string")
    got = similar.earliest(pairs, history.endpoints(q), s).collect()
    assert [r["event_idx"] for r in got] == [6] and tried == [1]


def test_second_order_by_tiles_against_all_pairs(spark, monkeypatch):
    """Many tiles, long and short neighbourhoods, self-loops, repeats and names that collide under the first seed."""
    import numpy as np

    from chronoweave.operators import reach

    rng = np.random.default_rng(3)
    events = [(f"s{rng.integers(0, 25)}", "r", f"o{int(rng.integers(0, 200) ** 2 / 200)}" if k % 3 else f"s{rng.integers(0, 25)}", "2014-01-01") for k in range(400)]
    ends = history.endpoints(quads(spark, [*events, ("s1", "r", "s1", "2014-01-01")]))
    rows = [(k, f"s{k}", "r", "r", "2015-01-01") for k in range(25)]
    ask = spark.createDataFrame(rows, "query_id long, sq string, rq string, rq_norm string, tq_raw string").withColumn("tq", scalar.parse_time(F.col("tq_raw")))
    near: dict[str, set] = {}
    for s, _, o, _ in [*events, ("s1", "r", "s1", "")]:
        near.setdefault(s, set()).add(o)
        near.setdefault(o, set()).add(s)
    want = {k: near.get(s, set()) | {x for c in near.get(s, set()) for x in near[c] if x != s} for k, s, *_ in rows}
    want = {k: sorted(v) for k, v in want.items() if v}
    monkeypatch.setattr(reach, "NAMES", 40)
    monkeypatch.setattr(reach, "BLOCK", 7)
    monkeypatch.setattr(reach, "CHUNK", 5)
    key = reach._key
    monkeypatch.setattr(reach, "_key", lambda name, seed: F.length(name).cast("long") if not seed else key(name, seed))
    one = candidates.first_order(ask, ends)
    got = candidates.second_order(ask, one, ends)
    assert "Join" not in got.select("candidate")._jdf.queryExecution().executedPlan().toString()
    found: dict[int, list] = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append(r["candidate"])
    assert {k: sorted(v) for k, v in found.items()} == want
    sizes = {r["query_id"]: (r["n"], r["first_c"], r["last_c"]) for r in candidates.second_order_sizes(ask, one, ends).collect()}
    assert sizes == {k: (len(v), v[0], v[-1]) for k, v in want.items()}
    adapted = {(r["query_id"], r["second"]): r["n"] for r in candidates.adaptive_sizes(ask, one, ends, 12).collect()}
    assert adapted == {(r["query_id"], r["second"]): r["n"] for r in candidates.adaptive(ask, one, ends, 12).groupBy("query_id", "second").agg(F.count("*").alias("n")).collect()}


def test_best_answer_from_lists_makes_no_rows_of_candidates(spark):
    from chronoweave.operators import predict, reach

    q = quads(spark, [("A", "r", f"o{i}", "2014-01-01") for i in range(3)] + [(f"B{i}", "r", f"o{i % 3}", "2014-01-01") for i in range(40)])
    ends, s = history.endpoints(q), Settings(confidence=0.9)
    ask = asked(spark, ("A", "r"), "2014-02-01", s)
    lists = reach.lists(ask, candidates.first_order(ask, ends), candidates.hops(ends), ("sq", "rq", "tq_raw"))
    got, want = predict.best_of_lists(lists).first(), predict.predictions(predict.forecast(ask, ends, s)).first()
    assert got["candidate"] == want["predicted"] and abs(got["prob"] - want["prob"]) < 1e-12
    assert "explode" not in predict.best(ask, ends, s)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_retry_scores_all_of_many_second_order_candidates(spark, tmp_path):
    """More names than ``max_scored`` usually allows, and a user without any history."""
    events = [(0, k) for k in range(80)] + [(u, k) for u in range(1, 601) for k in (u % 80, (u * 7) % 80)] + [(601, 3)]
    rows = pd.DataFrame({"event_id": range(len(events)), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(len(events)), unit="min"), "user_id": [u for u, _ in events], "event_type": "view", "value": 1.0, "props": [f'{{"k": {k}}}' for _, k in events]})
    con = duckdb.connect()
    con.sql(f"copy (select * replace (ts::timestamp as ts) from rows) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.sql(catalogue.oracle_sql()["predict_retry"]).df()
    got = catalogue.queries()["predict_retry"](spark, str(tmp_path)).toPandas()
    assert want["second"].sum() == 1 and len(want) == 601
    assert rows_of(got) == rows_of(want)


def test_best_answers_are_those_of_predict(spark, monkeypatch):
    """Inside tasks, where names don't fit one task, and where more candidates than are scored leave the answer to the text."""
    from chronoweave.operators import reach

    q = quads(spark, [("A", "r", f"o{i}", f"2014-01-{1 + i % 28:02d}") for i in range(60)] + [(f"Bé{i}", "r", f"o{i % 3}", "2014-01-01") for i in range(40)] + [("C", "r", "o1", "2014-01-05")])
    ends = history.endpoints(q)
    ask = spark.createDataFrame([(1, "A"), (2, "C"), (3, "nobody")], "query_id long, sq string").selectExpr("query_id", "sq", "'r' AS rq", "'r' AS rq_norm", "'2014-02-01' AS tq_raw", "timestamp_ntz'2014-02-01' AS tq")
    t = prompts.Templates(answer="{candidates}|{history}|{query}|{candidates}|{analogies}")
    for s in (Settings(confidence=0.1), Settings(confidence=0.1, max_scored=50)):
        want = forecast.predict(ask, ends, s=s, templates=t).withColumn("prob", F.array_max("probs")).select("query_id", "second", "predicted", "prob").toPandas()
        got = forecast.best(ask, ends, s=s, templates=t)
        assert ("MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()) and rows_of(got.toPandas()) == rows_of(want)
        assert want.set_index("query_id")["second"].to_dict() == {1: True, 2: False, 3: True}
    monkeypatch.setattr(reach, "WHOLE", 50)
    s = Settings(confidence=0.1)
    assert rows_of(forecast.best(ask, ends, s=s, templates=t).toPandas()) == rows_of(forecast.predict(ask, ends, s=s, templates=t).withColumn("prob", F.array_max("probs")).select("query_id", "second", "predicted", "prob").toPandas())
