"""Scores, probabilities and ranks of candidates, and answers as text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.answers import answer
from ..functions.scalar import hash_score, softmax
from ..sources.files import settled
from . import candidates as cand
from . import reach
from .history import with_settings


def candidate_scores(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Deterministic scores, in the JVM."""
    rows = candidates.join(queries.select("query_id", "sq", "rq", "tq_raw"), "query_id")
    return rows.withColumn("score", hash_score(F.concat_ws("|", "sq", "rq", "tq_raw", "candidate"))).drop("sq", "rq", "tq_raw")


def opaque_scores(rows: DataFrame, score: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Scores from any Python function of batches (a model client, say); it is called in Arrow batches on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = score(batch)
            if len(values) < len(batch):
                raise ValueError(f"{len(values)} scores for {len(batch)} rows")
            yield batch.assign(score=list(values)[: len(batch)])

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double")


def ranked(scored: DataFrame) -> DataFrame:
    """Probabilities (softmax per question) and ranks; ties by the candidate's name."""
    w = Window.partitionBy("query_id").orderBy(F.col("prob").desc(), "candidate")
    return scored.withColumn("prob", softmax(F.col("score"), "query_id")).withColumn("rank", F.row_number().over(w))


def one_hot(answers: DataFrame, lists: DataFrame) -> DataFrame:
    """Ranks from text answers: the named candidate has probability 1, the others follow by name."""
    rows = answers.join(lists, "query_id").withColumn("predicted", answer(F.col("output"), F.col("candidates")))
    long = rows.select("query_id", "predicted", F.explode("candidates").alias("candidate"))
    w = Window.partitionBy("query_id").orderBy(F.col("prob").desc(), "candidate")
    return long.withColumn("prob", (F.col("candidate") == F.col("predicted")).cast("double")).withColumn("rank", F.row_number().over(w))


def predictions(ranks: DataFrame) -> DataFrame:
    return ranks.filter("rank = 1").select("query_id", F.col("candidate").alias("predicted"), "prob")


def best_of_lists(rows: DataFrame) -> DataFrame:
    """``query_id, candidate, prob`` of the best candidate from ``rows`` (query_id, sq, rq, tq_raw, candidates), as ``candidate_scores``
    and ``ranked`` would find it: every list gives its best and its sum, so that no row of a candidate is made."""
    score = lambda x: hash_score(F.concat_ws("|", "sq", "rq", "tq_raw", x))
    scored = rows.select("query_id", "candidates", F.transform("candidates", score).alias("scores")).withColumn("top", F.array_max("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x))
    # lists are sorted, so the first of equal scores has the least name
    name = F.get("candidates", (F.array_position("scores", F.col("top")) - 1).cast("int"))
    parts = scored.select("query_id", "top", total.alias("total"), name.alias("candidate"))
    best = parts.groupBy("query_id").agg(F.min_by("candidate", F.struct(-F.col("top"), "candidate")).alias("candidate"), F.max("top").alias("top"), F.sum("total").alias("total"))
    return best.select("query_id", "candidate", (F.exp("top") / F.col("total")).alias("prob"))


def best(queries: DataFrame, ends: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``query_id, predicted, prob``: the best of ``forecast`` alone. Second-order candidates stay in lists."""
    if s.confidence <= 0 or s.second_order:
        return predictions(forecast(queries, ends, s))
    queries = settled(with_settings(queries, s), "questions")
    one = settled(cand.first_order(queries, ends), "one")
    first = forecast(queries, ends, replace(s, confidence=0.0), one)
    best = settled(first.filter("rank = 1").select("query_id", "candidate", "prob", "second"), "first")
    unsure = best.filter((F.col("prob") < s.confidence) & ~F.col("second")).select("query_id")
    again = queries.join(unsure, "query_id", "left_semi")
    lists = reach.lists(again, one.join(unsure, "query_id", "left_semi"), cand.hops(ends), ("sq", "rq", "tq_raw"))
    rows = best.join(unsure, "query_id", "left_anti").select("query_id", "candidate", "prob").unionByName(best_of_lists(lists))
    return rows.withColumnRenamed("candidate", "predicted")


def forecast(queries: DataFrame, ends: DataFrame, s: Settings = DEFAULT, one: DataFrame | None = None) -> DataFrame:
    """Ranked candidates by scores of question and name alone (``operators.forecast`` asks models with whole prompts),
    with a second pass over those of low confidence if asked for."""
    queries = with_settings(queries, s)
    one = cand.first_order(queries, ends) if one is None else one
    if s.second_order:
        found = cand.second_order(queries, one, ends).withColumn("second", F.lit(True))
    elif s.adaptive:
        found = cand.adaptive(queries, one, ends, s.min_candidates)
    else:
        found = one.withColumn("second", F.lit(False))
    ranks = ranked(candidate_scores(queries, found))
    if s.confidence <= 0 or s.second_order:
        return ranks
    unsure = ranks.groupBy("query_id").agg(F.max("prob").alias("top"), F.max("second").alias("wide")).filter((F.col("top") < s.confidence) & ~F.col("wide")).select("query_id")
    again = cand.second_order(queries.join(unsure, "query_id", "left_semi"), one.join(unsure, "query_id", "left_semi"), ends).withColumn("second", F.lit(True))
    return ranks.join(unsure, "query_id", "left_anti").unionByName(ranked(candidate_scores(queries, again)).select(*ranks.columns))
