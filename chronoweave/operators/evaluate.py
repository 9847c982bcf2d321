"""Ranks of the right answer, raw or filtered by other known answers, and rates over questions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import filter_mode


def known_answers(quads: DataFrame, mode: str) -> DataFrame:
    """Distinct facts: subject, relation, object, and the raw time if the filter heeds it."""
    columns = ["subject", "relation", "object", *["ts_raw"] * (filter_mode(mode) == "time-aware")]
    return quads.select(*columns).distinct()


def filtered_ranks(ranks: DataFrame, queries: DataFrame, quads: DataFrame, mode: str) -> DataFrame:
    """Ranks without candidates that are other known answers; the right one always stays."""
    mode = filter_mode(mode)
    rows = ranks.join(queries.select("query_id", "sq", "rq", "tq_raw", "ground_truth"), "query_id")
    if mode == "none":
        return rows.drop("sq", "rq", "tq_raw")
    facts = known_answers(quads, mode).withColumnsRenamed({"ts_raw": "at"}).withColumn("known", F.lit(True))
    same = (F.col("sq") == F.col("subject")) & (F.col("rq") == F.col("relation")) & (F.col("candidate") == F.col("object"))
    if mode == "time-aware":
        same = same & (F.col("tq_raw") == F.col("at"))
    kept = rows.join(facts, same, "left").filter("known is null or candidate = ground_truth").select(*rows.columns)
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w)).drop("sq", "rq", "tq_raw")


def right_ranks(ranks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, rank`` of every question's right answer; null rank where it isn't a candidate (the question is skipped)."""
    right = ranks.join(queries.select("query_id", "ground_truth"), "query_id") if "ground_truth" not in ranks.columns else ranks
    found = right.filter("candidate = ground_truth").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id").join(found, "query_id", "left")


def hits(right: DataFrame, *by: str) -> DataFrame:
    """evaluated, skipped and rates over the evaluated; mrr is an extension."""
    rate = lambda k: F.coalesce(F.avg(F.when(F.col("rank").isNotNull(), (F.col("rank") <= k).cast("double"))), F.lit(0.0)).alias(f"hit_at_{k}")
    return right.groupBy(*by).agg(F.count("rank").alias("evaluated"), F.sum(F.col("rank").isNull().cast("long")).alias("skipped"), rate(1), rate(10), F.coalesce(F.avg(1.0 / F.col("rank")), F.lit(0.0)).alias("mrr"))


def posthoc(records: DataFrame) -> DataFrame:
    """Rates from prediction records: those whose right answer was a candidate, by ranked list (else top 10)."""
    place = F.array_position(F.coalesce("raw.ranked_candidates", "raw.top10"), F.col("ground_truth"))
    rows = records.filter("in_oq").select(F.when(place > 0, place).alias("rank"))
    return rows.agg(F.count("*").alias("evaluated"), *(F.coalesce(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(f"hit_at_{k}") for k in (1, 10)))


ABLATIONS = {
    "full": {}, "without_long_term": {"use_long": False}, "without_short_term": {"use_short": False}, "without_analogies": {"use_analogies": False},
}


def ablations(queries: DataFrame) -> DataFrame:
    """Every question under four settings: all, and without long term, short term or analogies."""
    return under(queries, {name: {"use_short": True, "use_long": True, "use_analogies": True} | off for name, off in ABLATIONS.items()})


def sweep(queries: DataFrame, totals=(50, 100, 150), shorts=(10, 20, 30), alphas=(2.25, 2.75, 3.0)) -> DataFrame:
    """Every question under all combinations of L, l and alpha: one job for the whole grid."""
    return under(queries, {f"L={a},l={b},alpha={c}": {"total": a, "l": b, "alpha": float(c)} for a, b, c in product(totals, shorts, alphas)})


def under(queries: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """A row of a question for each setting, with ``base_id``, ``setting`` and an id of its own: base_id x settings + the setting's place."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("setting"), F.lit(i).alias("setting_id"), *(F.lit(v).alias(k) for k, v in s.items())) for i, (name, s) in enumerate(settings.items()))))
    replaced = {k for s in settings.values() for k in s}
    rows = queries.drop(*replaced).withColumn("s_", each).select(*(c for c in queries.columns if c not in replaced), "s_.*")
    return rows.withColumn("base_id", F.col("query_id")).withColumn("query_id", F.col("query_id") * len(settings) + F.col("setting_id"))


def window(queries: DataFrame, start: int = 0, n: int = 0) -> DataFrame:
    """Questions [start, start + n) in the order of their ids; n of 0 or less: all from start on."""
    rows = queries.orderBy("query_id").offset(start)
    return rows.limit(n) if n > 0 else rows


def first_question(quads: DataFrame) -> DataFrame:
    """The first event as a question, its object hidden."""
    row = quads.orderBy("event_idx").limit(1)
    return row.select(F.col("event_idx").alias("query_id"), F.col("subject").alias("sq"), F.col("relation").alias("rq"), F.col("relation_norm").alias("rq_norm"), F.col("ts_raw").alias("tq_raw"), F.col("ts").alias("tq"), F.col("object").alias("ground_truth"))


def speedup(off: Column, on: Column) -> Column:
    """Times without and with a cache to (speed-up, share saved)."""
    return F.struct((off / on).alias("speedup"), (1 - on / off).alias("saved"))


def metrics(ranks: DataFrame, queries: DataFrame, quads: DataFrame, mode: str = "none", *by: str) -> DataFrame:
    """Rates (``hits``) of ranked candidates under a filter, for each group of questions named by columns of ``queries``."""
    right = right_ranks(filtered_ranks(ranks, queries, quads, mode), queries)
    return hits(right.join(queries.select("query_id", *by), "query_id") if by else right, *by)


def records(ranks: DataFrame, queries: DataFrame, mode: str = "none") -> DataFrame:
    """Prediction records, a row per question."""
    top = F.array_sort(F.collect_list(F.struct("rank", "candidate", "prob")))
    lists = ranks.groupBy("query_id").agg(top.alias("r"), F.array_sort(F.collect_list("candidate")).alias("candidate_set"))
    rows = queries.join(lists, "query_id", "left")
    names, probs = F.transform("r", lambda x: x["candidate"]), F.transform("r", lambda x: x["prob"])
    place = F.array_position(names, F.col("ground_truth"))
    inside = F.coalesce(place > 0, F.lit(False))
    raw = F.struct((place == 1).alias("hit_at_1"), (place <= 10).alias("hit_at_10"), place.cast("long").alias("rank"), names.alias("ranked_candidates"), probs.alias("ranked_probs"), F.slice(names, 1, 10).alias("top10"), F.slice(probs, 1, 10).alias("top10_probs"))
    return rows.select(
        F.col("query_id").alias("index"), F.struct(F.col("sq").alias("subject"), F.col("rq").alias("relation"), F.col("tq_raw").alias("timestamp")).alias("query"), "ground_truth",
        F.when(inside, F.get(names, F.lit(0))).alias("predicted"), F.coalesce(F.size("candidate_set"), F.lit(0)).cast("long").alias("candidate_size"), "candidate_set", inside.alias("in_oq"),
        F.when(~inside, F.lit("gt_not_in_oq")).alias("skipped_reason"), F.lit(mode).alias("eval_filter"), F.when(inside, raw).alias("raw"),
    )
