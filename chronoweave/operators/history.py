"""Histories of many questions at once: endpoints, strict as-of joins, short and long term.

Questions are rows ``query_id, sq, rq, rq_norm, tq_raw, tq`` and may carry their
own settings (``with_settings``), so a sweep of settings is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.scalar import hash_score, threshold

#: Scores that differ by no more are equal.
TIED = 1e-9
EVENT = ("event_idx", "subject", "relation", "relation_norm", "object", "ts_raw", "ts", "day")


def endpoints(quads: DataFrame) -> DataFrame:
    """One row per event and distinct endpoint: a join on ``entity`` replaces the OR of two columns."""
    return quads.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"), *EVENT)


def neighbours(ends: DataFrame) -> DataFrame:
    """The endpoints with the other side of the event."""
    return ends.withColumn("neighbour", F.when(F.col("subject") == F.col("entity"), F.col("object")).otherwise(F.col("subject")))


def chronological() -> list[Column]:
    return [F.col("ts").asc_nulls_last(), F.col("ts_raw").asc(), F.col("event_idx").asc()]


def _by_days(ends: DataFrame, inside: Column) -> DataFrame:
    """``inside`` (a rank over an entity's day) plus the entity's events on days before, as ``pos``.

    Ranks run inside days and days are summed up, so that no task sorts all events
    of a busy entity. Unknown times come last.
    """
    daily = ends.groupBy("entity", "day").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("entity").orderBy(F.col("day").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select(F.col("entity").alias("e_"), F.col("day").alias("d_"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before_"))
    rows = ends.withColumn("inside_", inside).join(daily, (F.col("entity") == F.col("e_")) & F.col("day").eqNullSafe(F.col("d_")))
    return rows.withColumn("pos", F.col("before_") + F.col("inside_")).drop("e_", "d_", "before_", "inside_")


def entity_history(ends: DataFrame) -> DataFrame:
    """Every entity's events in time order (``pos`` from 1)."""
    return _by_days(ends, F.row_number().over(Window.partitionBy("entity", "day").orderBy(*chronological())))


def with_settings(queries: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The questions with the settings that they don't carry yet."""
    values = {"use_analogies": s.use_analogies, "l": s.short, "total": s.total, "alpha": float(s.alpha), "day_cap": s.day_cap, "event_cap": s.event_cap, "use_short": s.use_short, "use_long": s.use_long}
    return queries.withColumns({k: F.lit(v) for k, v in values.items() if k not in queries.columns})


SETTINGS = ("l", "total", "alpha", "day_cap", "event_cap", "use_short", "use_long")


def history_before(queries: DataFrame, ends: DataFrame) -> DataFrame:
    """Events of a question's entity strictly before it; those of unknown time count as earliest here.

    A question of unknown time sees them all. ``pos``: time order, unknown last.
    """
    strict = F.col("tq").isNull() | F.col("ts").isNull() | (F.col("ts") < F.col("tq"))
    rows = queries.join(ends, F.col("sq") == F.col("entity")).filter(strict)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*chronological())))


def history_hash(rows: DataFrame) -> DataFrame:
    """``query_id, digest``: SHA-256 of a history's fields as JSON, in order (``place``)."""
    event = F.struct("place", F.array("subject", "relation", "object", "ts_raw").alias("fields"))
    events = F.transform(F.array_sort(F.collect_list(event)), lambda x: x["fields"])
    return rows.groupBy("query_id").agg(F.sha2(F.to_json(events), 256).alias("digest"))


def by_relation(history: DataFrame) -> DataFrame:
    return history.filter(F.col("relation_norm") == F.col("rq_norm"))


def short_term(history: DataFrame) -> DataFrame:
    """The last l events of each question; unknown times count as newest."""
    newest = Window.partitionBy("query_id").orderBy(F.col("ts").desc_nulls_first(), F.col("pos").desc())
    last = history.withColumn("nth", F.row_number().over(newest))
    return last.filter(F.col("use_short") & (F.col("nth") <= F.col("l"))).drop("nth")


def long_term_pool(history: DataFrame) -> DataFrame:
    """The history without any event that equals one of the short term in subject, relation, object and raw time."""
    newest = Window.partitionBy("query_id").orderBy(F.col("ts").desc_nulls_first(), F.col("pos").desc())
    key = Window.partitionBy("query_id", "subject", "relation_norm", "object", "ts_raw")
    marked = history.withColumn("short", F.col("use_short") & (F.row_number().over(newest) <= F.col("l")))
    return marked.withColumn("equal", F.max("short").over(key)).filter("not equal").drop("short", "equal")


def scored_events(rows: DataFrame) -> DataFrame:
    """Deterministic scores of events, in the JVM: the default scorer."""
    return rows.withColumn("score", hash_score(F.concat_ws("|", "subject", "relation", "object", "ts_raw")))


def day_groups(history: DataFrame, scorer=scored_events, chunk: int = 0, like: Column | None = None) -> DataFrame:
    """The long-term pool's events of known time with what the threshold needs.

    Adds ref (the question's time, else the pool's last), span T (days, from the
    whole pool, at least 1), F, delta, score, p (softmax in the day) and c (threshold).
    For a scorer that takes so many events at a time, ``chunk`` numbers them inside
    a day; a chunk of two events or more whose scores are all equal is scored by
    ``like`` (a likeness of question and event) instead.
    """
    w = Window.partitionBy("query_id")
    short = F.least(F.when(F.col("use_short"), F.col("l")).otherwise(0), F.max("pos").over(w))
    pool = long_term_pool(history.withColumn("target", F.greatest(F.col("total") - short, F.lit(0)))).filter("target > 0 and use_long")
    last = F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("pos"))).over(w)
    pool = pool.withColumn("ref", F.coalesce("tq", last)).withColumn("oldest", F.min("ts").over(w)).filter("ref is not null and ts is not null")
    pool = pool.withColumn("span", F.greatest(F.lit(1), F.expr("timestampdiff(DAY, oldest, ref)")))
    days = pool.withColumn("day_rank", F.dense_rank().over(w.orderBy(F.col("day").desc()))).filter("day_cap <= 0 or day_rank <= day_cap")
    group = Window.partitionBy("query_id", "day")
    days = days.withColumn("from_last", F.row_number().over(group.orderBy(F.col("pos").desc()))).filter("event_cap <= 0 or from_last <= event_cap")
    if chunk:
        days = days.withColumn("chunk", ((F.row_number().over(group.orderBy("pos")) - 1) / chunk).cast("int"))
    days = scorer(days)
    if chunk and like is not None:
        together = Window.partitionBy("query_id", "day", "chunk")
        tied = (F.max("score").over(together) - F.min("score").over(together) <= TIED) & (F.count("*").over(together) > 1)
        days = days.withColumn("score", F.when(tied, like).otherwise(F.col("score")))
    days = days.withColumn("f", F.count("*").over(group)).withColumn("delta", F.datediff(F.to_date("ref"), "day"))
    e = F.exp(F.col("score") - F.max("score").over(group))
    days = days.withColumn("p", e / F.sum(e).over(group))
    return days.withColumn("c", threshold(F.col("f").cast("double"), F.col("delta").cast("double"), F.col("span").cast("double"), F.col("alpha")))


def long_term(history: DataFrame, scorer=scored_events, chunk: int = 0, like: Column | None = None) -> DataFrame:
    """Events whose probability reaches the threshold: newest days first, up to L less the short term."""
    kept = day_groups(history, scorer, chunk, like).filter("p >= c")
    order = Window.partitionBy("query_id").orderBy(F.col("day").desc(), F.col("pos").asc())
    return kept.withColumn("nth", F.row_number().over(order)).filter("nth <= target").drop("nth")


def dual_history(history: DataFrame, scorer=scored_events, chunk: int = 0, like: Column | None = None) -> DataFrame:
    """Long-term and short-term rows in one table, in their final order (``place``): unknown times first, long before short."""
    columns = ["query_id", *EVENT, "pos"]
    both = long_term(history, scorer, chunk, like).select(*columns, F.lit(0).alias("is_short")).unionByName(short_term(history).select(*columns, F.lit(1).alias("is_short")))
    order = Window.partitionBy("query_id").orderBy(F.col("ts").asc_nulls_first(), "is_short", "pos")
    return both.withColumn("place", F.row_number().over(order))


def filter_scored(rows: DataFrame, alpha: float = DEFAULT.alpha, query_time: str | None = None) -> DataFrame:
    """The threshold over rows ``group_id, event…, ts, day, score`` as they are: no caps, no length.

    Without a query time the newest time of the group counts; a group without any
    known time is returned whole, else rows of unknown time go.
    """
    w = Window.partitionBy("group_id")
    ref = F.coalesce(F.col(query_time), F.max("ts").over(w)) if query_time else F.max("ts").over(w)
    rows = rows.withColumn("ref", ref).withColumn("oldest", F.min("ts").over(w))
    rows = rows.withColumn("span", F.greatest(F.lit(1), F.expr("timestampdiff(DAY, oldest, ref)")))
    group = Window.partitionBy("group_id", "day")
    e = F.exp(F.col("score") - F.max("score").over(group))
    c = threshold(F.count("*").over(group).cast("double"), F.datediff(F.to_date("ref"), "day").cast("double"), F.col("span").cast("double"), F.lit(alpha))
    rows = rows.withColumn("p", e / F.sum(e).over(group)).withColumn("c", c)
    return rows.filter("oldest is null or (ts is not null and p >= c)")


def prior_contexts(ends: DataFrame) -> DataFrame:
    """For each event and endpoint, how many of the entity's events are strictly earlier (known times only)."""
    earlier = F.rank().over(Window.partitionBy("entity", "day").orderBy("ts")).cast("long") - 1
    return _by_days(ends.filter("ts is not null"), earlier).withColumnRenamed("pos", "contexts")
