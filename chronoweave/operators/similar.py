"""Similar events of cluster peers: same relation, enough context, long enough history, best per peer and overall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..sources.files import settled
from .history import EVENT, dual_history, history_before, prior_contexts, with_settings
from .nearest import compared


def _own(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Questions with their entity's cluster and features; unclustered ones have none."""
    return queries.join(entities.select(F.col("entity").alias("sq"), "cluster", "features"), "sq")


def begun(ends: DataFrame) -> DataFrame:
    """Events under the entity that began them, with the number of its events before (0 for unknown times)."""
    timed = prior_contexts(ends.filter(F.col("entity").isNotNull()))
    rows = timed.unionByName(ends.filter("ts is null").withColumn("contexts", F.lit(0).cast("long")))
    return rows.filter("entity = subject").drop("entity")


def long_enough(events: DataFrame, ends: DataFrame, s: Settings) -> DataFrame:
    """Events whose own dual history has ``least_history`` rows. Histories depend on the event alone: each is made once."""
    distinct = events.select("event_idx", "subject", "relation", "relation_norm", "ts_raw", "ts").distinct()
    asked = distinct.select(F.col("event_idx").alias("query_id"), F.col("subject").alias("sq"), F.col("relation").alias("rq"), F.col("relation_norm").alias("rq_norm"), F.col("ts_raw").alias("tq_raw"), F.col("ts").alias("tq"))
    histories = dual_history(history_before(with_settings(asked, s), ends))
    enough = histories.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= s.least_history).select(F.col("query_id").alias("event_idx"))
    return events.join(enough, "event_idx", "left_semi")


def earliest(pairs: DataFrame, ends: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The earliest event that qualifies of each of ``pairs`` (subject, relation_norm): unknown times first, then the event's number.

    Of a peer's events of one relation all are equally like the question, so the
    earliest one is chosen; if it isn't before the question, no other one is.
    Where histories of events must be made to tell, a pair's events are asked in
    their order, one, one, two, four … at a time, until one qualifies.
    """
    pair = ["subject", "relation_norm"]
    ends = ends.join(pairs.select(F.col("subject").alias("entity")).distinct(), "entity", "left_semi")
    events = begun(ends).filter(F.col("contexts") >= max(s.min_contexts, s.least_history)).join(pairs, pair, "left_semi")
    rest = [c for c in EVENT if c not in ("ts", "event_idx", *pair)]
    first = lambda rows: rows.groupBy(*pair).agg(F.min(F.struct("ts", "event_idx", "contexts", *rest)).alias("x")).select(*pair, "x.*")
    if s.least_history <= 0 or s.use_short and s.least_history <= s.short:
        return first(events)
    turn = Window.partitionBy(*pair).orderBy(F.col("ts").asc_nulls_first(), "event_idx")
    left, until, found = settled(events.withColumn("turn", F.row_number().over(turn)), "eligible"), 1, []
    ends = settled(ends, "ends")
    while not left.isEmpty():
        found.append(settled(first(long_enough(left.filter(F.col("turn") <= until), ends, s)), "earliest"))
        left, until = settled(left.filter(F.col("turn") > until).join(found[-1], pair, "left_anti"), "eligible"), 2 * until
    return reduce(DataFrame.unionByName, found) if found else first(events.limit(0))


def similar_events(queries: DataFrame, entities: DataFrame, ends: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The most similar event of each peer, then the ``analogies`` best of a question (``nth`` from 1)."""
    if s.analogies <= 0:
        return queries.limit(0).select("query_id")
    asked = _own(queries.select(F.col("query_id").alias("id"), "sq", F.col("rq_norm").alias("relation_norm"), F.col("tq").alias("at")), entities).withColumnRenamed("sq", "name")
    members = entities.select(F.col("entity").alias("subject"), "cluster", "features")
    met = ends.filter("entity = subject").select("subject", "relation_norm").distinct().join(members.select("subject", "cluster"), "subject")
    pairs = met.join(asked.select("cluster", "relation_norm").distinct(), ["cluster", "relation_norm"], "left_semi").select("subject", "relation_norm").distinct()
    chosen = settled(earliest(pairs, ends, s), "chosen")
    offers = chosen.select("subject", "relation_norm", F.col("ts").alias("at")).join(members, "subject").withColumnRenamed("subject", "name")
    near = compared(asked, offers, ["cluster", "relation_norm"], s.analogies)
    # an entity may be in several clusters, and a peer be met more than once
    near = near.groupBy(F.col("id").alias("query_id"), "peer").agg(F.max("similarity").alias("similarity"))
    overall = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "peer")
    best = near.withColumn("nth", F.row_number().over(overall)).filter(F.col("nth") <= s.analogies).join(queries.select("query_id", "rq_norm"), "query_id")
    rows = best.join(chosen, (F.col("peer") == F.col("subject")) & (F.col("rq_norm") == F.col("relation_norm")))
    return rows.select("query_id", "nth", "peer", "similarity", "contexts", *EVENT)


def ranked_by_similarity(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """``query_id, peer, similarity, nth``: all peers of a question by falling likeness."""
    own = _own(queries.select(F.col("query_id").alias("id"), "sq"), entities).withColumnRenamed("sq", "name").withColumn("at", F.lit(None).cast("timestamp"))
    own = own.withColumn("often", F.count("*").over(Window.partitionBy("id")))
    members = entities.select(F.col("entity").alias("name"), "cluster", "features", F.lit(None).cast("timestamp").alias("at"))
    near = lambda asked: compared(asked, members, ["cluster"]).withColumnRenamed("id", "query_id")
    # of an entity that is there more than once, the ranks run over all its groups
    several = near(own.filter("often > 1")).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "peer")))
    return near(own.filter("often = 1")).unionByName(several)
