"""Candidate answers: neighbours of the question's entity, neighbours of neighbours, or whichever is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reach
from .history import neighbours

NOT_ANSWERS = ("?", "None", "null", "")


def neighbours_since(ends: DataFrame) -> DataFrame:
    """``entity, neighbour, since``: distinct pairs and when they first met; null if some event of theirs has no known time."""
    pairs = neighbours(ends).filter(~F.col("neighbour").isin(*NOT_ANSWERS)).groupBy("entity", "neighbour")
    return pairs.agg(F.when(F.count("ts") == F.count(F.lit(1)), F.min("ts")).alias("since"))


def first_order(queries: DataFrame, ends: DataFrame) -> DataFrame:
    """``query_id, candidate``: distinct other sides of the events before the question.

    A pair's first event decides, so questions meet distinct neighbours instead of events.
    """
    met = queries.select("query_id", "sq", "tq").join(neighbours_since(ends), F.col("sq") == F.col("entity"))
    return met.filter("tq is null or since is null or since < tq").select("query_id", F.col("neighbour").alias("candidate"))


def hops(ends: DataFrame) -> DataFrame:
    """``entity, neighbour`` of all events, with repeats."""
    return neighbours(ends).filter(~F.col("neighbour").isin(*NOT_ANSWERS)).select("entity", "neighbour")


def second_order(queries: DataFrame, one: DataFrame, ends: DataFrame, time_bounded: bool = False) -> DataFrame:
    """First-order candidates ``one`` and their neighbours over all events (or those before the question).

    Neighbourhoods over all events are put together inside tasks (``reach``), so that no pair of a question and
    a candidate is shuffled.
    """
    if not time_bounded:
        return reach.lists(queries, one, hops(ends)).select("query_id", F.explode("candidates").alias("candidate"))
    asked = one.join(queries.select("query_id", "sq", "tq"), "query_id").withColumnRenamed("candidate", "entity")
    two = asked.join(neighbours_since(ends), "entity").filter("tq is null or since < tq")
    return one.unionByName(two.filter("neighbour <> sq").select("query_id", F.col("neighbour").alias("candidate"))).distinct()


def second_order_sizes(queries: DataFrame, one: DataFrame, ends: DataFrame) -> DataFrame:
    """``query_id, n, first_c, last_c`` of ``second_order``: number, least and greatest name."""
    return reach.summary(queries, one, hops(ends))


def few(queries: DataFrame, one: DataFrame, least: int) -> DataFrame:
    """``query_id`` of questions with fewer than ``least`` first-order candidates."""
    sizes = queries.select("query_id").join(one.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    return sizes.filter(F.coalesce("n", F.lit(0)) < least).select("query_id")


def adaptive(queries: DataFrame, one: DataFrame, ends: DataFrame, least: int = 3) -> DataFrame:
    """``query_id, candidate, second``: second-order sets only for questions with fewer than ``least`` first-order ones."""
    narrow = few(queries, one, least)
    enough = one.join(narrow, "query_id", "left_anti").withColumn("second", F.lit(False))
    wide = second_order(queries.join(narrow, "query_id", "left_semi"), one.join(narrow, "query_id", "left_semi"), ends).withColumn("second", F.lit(True))
    return enough.unionByName(wide)


def adaptive_sizes(queries: DataFrame, one: DataFrame, ends: DataFrame, least: int = 3) -> DataFrame:
    """``query_id, second, n`` of ``adaptive``: how many candidates questions with any have."""
    narrow = few(queries, one, least)
    enough = one.join(narrow, "query_id", "left_anti").groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit(False).alias("second"), "n")
    wide = second_order_sizes(queries.join(narrow, "query_id", "left_semi"), one.join(narrow, "query_id", "left_semi"), ends)
    return enough.unionByName(wide.select("query_id", F.lit(True).alias("second"), "n"))


def as_lists(candidates: DataFrame) -> DataFrame:
    """``query_id, candidates``: sorted lists, as prompts and answers need them."""
    return candidates.groupBy("query_id").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"))
