"""Forecasts from end to end: contexts, prompts, models, answers. Models are functions; the defaults are deterministic."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.answers import answer
from ..functions.scalar import hash_score, let, softmax_of
from ..sources.files import settled
from . import candidates as cand
from . import clusters, evaluate, prompts, reach
from .history import day_groups, dual_history, history_before, scored_events, with_settings
from .similar import similar_events


def hashed_labels(prompt: Column, candidates: Column) -> Column:
    """Deterministic scores of candidates under a prompt, which is read once."""
    return let(F.sha2(prompt, 256), lambda read: F.transform(candidates, lambda c: hash_score(F.concat(read, F.lit("|"), c))))


def hashed_answer(prompt: Column) -> Column:
    """A deterministic predictor of text: names a place in the list that the prompt ends with, by the prompt's hash."""
    listed = F.regexp_extract(prompt, r"([0-9]+)\. [^\n]*\nAnswer:\s*$", 1)
    place = F.conv(F.substring(F.sha2(prompt, 256), 1, 8), 16, 10).cast("long") % F.try_to_number(F.nullif(listed, F.lit("")), F.lit("999999999")).cast("long") + 1
    return F.coalesce(F.concat(F.lit("Answer: "), place.cast("string")), F.lit("UNKNOWN"))


@dataclass(frozen=True)
class Models:
    """What a forecast asks. scorer: rows of day groups to the same with ``score``; like: a likeness of question and event
    for chunks that all score the same; generator: texts of a column of prompts; labels: scores (array<double>) of columns of
    prompts and candidates, null where it fails; predictor: texts of a column of prompts. ``functions.answers`` wraps Python
    functions as labels and predictors, ``chunk_scorer`` one as a scorer."""

    scorer: Callable[[DataFrame], DataFrame] = scored_events
    like: Column | None = None
    generator: Callable[[Column], Column] | None = None
    labels: Callable[[Column, Column], Column] | None = hashed_labels
    predictor: Callable[[Column], Column] = hashed_answer
    #: Whether the scorer or ``like`` needs chunks.
    chunked: bool = False


def chunk_scorer(score: Callable[[str, list[str]], list[float]], templates: prompts.Templates = prompts.Templates()) -> Callable[[DataFrame], DataFrame]:
    """A Python function of (prompt, events as sentences) as a scorer: a call for each chunk of a day, on the executors.

    Fewer scores than events are an error; what is more is left out.
    """

    def scorer(rows: DataFrame) -> DataFrame:
        said = prompts.verbalised(rows)
        asked = prompts.asked(rows.select("query_id", "sq", "rq", "tq_raw", "tq").distinct()).select("query_id", "question")
        said = said.join(asked, "query_id")

        def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
            batch = batch.sort_values("pos")
            events = batch["sentence"].tolist()
            listed = "\n".join(f"{i}. {e}" for i, e in enumerate(events, 1))
            text = templates.score.replace("{query}", batch["question"].iloc[0]).replace("{n}", str(len(events))).replace("{events}", listed)
            scores = list(score(text, events))
            if len(scores) < len(events):
                raise ValueError(f"{len(scores)} scores for {len(events)} events")
            return pd.DataFrame({"query_id": batch["query_id"], "pos": batch["pos"], "score": [float(x) for x in scores[: len(events)]]})

        kind = rows.schema["query_id"].dataType.simpleString()
        scored = said.select("query_id", "day", "chunk", "pos", "sentence", "question").groupBy("query_id", "day", "chunk").applyInPandas(run, f"query_id {kind}, pos int, score double")
        return rows.join(scored, ["query_id", "pos"])

    return scorer


def candidate_sets(queries: DataFrame, ends: DataFrame, s: Settings = DEFAULT, one: DataFrame | None = None) -> DataFrame:
    """``query_id, candidate, second``: neighbours, neighbours of neighbours, or whichever the settings ask for."""
    one = cand.first_order(queries, ends) if one is None else one
    if s.second_order:
        return cand.second_order(queries, one, ends).withColumn("second", F.lit(True))
    if s.adaptive:
        return cand.adaptive(queries, one, ends, s.min_candidates)
    return one.withColumn("second", F.lit(False))


def candidate_lists(queries: DataFrame, ends: DataFrame, s: Settings = DEFAULT, one: DataFrame | None = None) -> DataFrame:
    """``query_id, candidates, second`` of ``candidate_sets``: sorted lists, made of parts of lists for second-order sets."""
    if not s.second_order:
        sets = candidate_sets(queries, ends, s, one)
        return sets.groupBy("query_id").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"), F.max("second").alias("second"))
    parts = reach.lists(queries, cand.first_order(queries, ends) if one is None else one, cand.hops(ends))
    return parts.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("candidates"))).alias("candidates"), F.lit(True).alias("second"))


def _own_histories(queries: DataFrame, similar: DataFrame, ends: DataFrame, s: Settings, models: Models) -> tuple[DataFrame, DataFrame]:
    """Similar events with an id for their own history under their question's settings, and these histories; each is made once."""
    flags = ["use_short", "use_long", "l", "total", "alpha"]
    wanted = similar.join(queries.filter("use_analogies").select("query_id", *flags), "query_id")
    wanted = wanted.withColumn("own_id", F.concat_ws("/", "event_idx", *flags))
    asked = wanted.select(F.col("own_id").alias("query_id"), F.col("subject").alias("sq"), F.col("relation").alias("rq"), F.col("relation_norm").alias("rq_norm"), F.col("ts_raw").alias("tq_raw"), F.col("ts").alias("tq"), *flags).distinct()
    chunk = s.chunk if models.chunked else 0
    return wanted.drop(*flags), dual_history(history_before(with_settings(asked, s), ends), models.scorer, chunk, models.like)


def contexts(queries: DataFrame, ends: DataFrame, entities: DataFrame | None = None, s: Settings = DEFAULT, models: Models = Models(), templates: prompts.Templates = prompts.Templates()) -> DataFrame:
    """``query_id, question, candidates, second, prompt`` of all questions, without asking any predictor.

    Questions may carry their own settings (``evaluate.under``). Without
    ``entities`` (entity, features, cluster) there are no analogies.
    """
    queries = with_settings(queries, s)
    return _with_candidates(_bodies(queries, ends, history_before(queries, ends), entities, s, models, templates), candidate_lists(queries, ends, s), s, templates)


def _bodies(queries: DataFrame, ends: DataFrame, known: DataFrame, entities: DataFrame | None, s: Settings, models: Models, templates: prompts.Templates) -> DataFrame:
    """What prompts say besides candidates (``prompts.bodies``), from the histories ``known``."""
    dual = dual_history(known, models.scorer, s.chunk if models.chunked else 0, models.like)
    examples = None
    if entities is not None and s.analogies > 0:
        similar, own = _own_histories(queries, similar_events(queries, entities, ends, s), ends, s, models)
        examples = prompts.analogies(similar, own, models.generator, templates)
    return prompts.bodies(queries, dual, examples)


def _with_candidates(bodies: DataFrame, lists: DataFrame, s: Settings, templates: prompts.Templates) -> DataFrame:
    known = F.coalesce("candidates", F.array().cast("array<string>"))
    return bodies.join(lists, "query_id", "left").select("query_id", "question", known.alias("candidates"), F.coalesce("second", F.lit(s.second_order)).alias("second"), prompts.whole(templates).alias("prompt"))


def infer(context: DataFrame, s: Settings = DEFAULT, models: Models = Models(), once: bool = False) -> DataFrame:
    """``query_id, candidates, second, probs, predicted, by_labels``.

    Label scores answer where the settings ask for them, there are 1 to
    ``max_scored`` candidates and the call doesn't fail; else the predictor's text
    does, which gives its candidate the probability 1 and all others 0. ``once``:
    the scores are written before the two are told apart.
    """
    rows = context
    if s.label_scores and models.labels is not None:
        few = F.size("candidates").between(1, s.max_scored)
        rows = rows.withColumn("logits", F.when(few, models.labels(F.col("prompt"), F.col("candidates"))))
        shares = let(F.col("logits"), lambda given: F.when(F.size(given) == F.size("candidates"), softmax_of(given)))
        # out of a generator, so that neither a filter nor a later column works the scores out again
        rows = rows.select("query_id", "candidates", "second", "prompt", F.explode(F.array(shares)).alias("shares"))
    else:
        rows = rows.withColumn("shares", F.lit(None).cast("array<double>"))
    if once:
        rows = settled(rows.select("query_id", "candidates", "second", F.when(F.col("shares").isNull(), F.col("prompt")).alias("prompt"), "shares"), "scored")
    scored = rows.filter("shares is not null")
    best = F.get("candidates", (F.array_position("shares", F.array_max("shares")) - 1).cast("int"))
    columns = ["query_id", "candidates", "second", "probs", "predicted", "by_labels"]
    scored = scored.withColumn("probs", F.col("shares")).withColumn("predicted", best).withColumn("by_labels", F.lit(True))
    told = rows.filter("shares is null").withColumn("output", models.predictor(F.col("prompt"))).withColumn("predicted", answer(F.col("output"), F.col("candidates")))
    told = told.withColumn("probs", F.transform("candidates", lambda c: (c == F.col("predicted")).cast("double"))).withColumn("by_labels", F.lit(False))
    return scored.select(*columns).unionByName(told.select(*columns))


def predict(queries: DataFrame, ends: DataFrame, entities: DataFrame | None = None, s: Settings = DEFAULT, models: Models = Models(), templates: prompts.Templates = prompts.Templates()) -> DataFrame:
    """``infer`` over all questions' contexts; those below the confidence asked for are answered again from second-order candidates.

    With a confidence to reach, first answers are written before the unsure ones are asked again: no model is asked twice.
    """
    if s.confidence <= 0 or s.second_order:
        return infer(contexts(queries, ends, entities, s, models, templates), s, models)
    asks = _first(queries, ends, entities, s, models, templates)
    return asks.first.filter(~_unsure(s)).unionByName(_again(asks, _unsure(s), s, models, templates))


@dataclass(frozen=True)
class _Asks:
    """What a forecast that may ask again has written: questions, endpoints, bodies of prompts, first-order candidates, first answers."""

    queries: DataFrame
    ends: DataFrame
    bodies: DataFrame
    one: DataFrame
    first: DataFrame

    def only(self, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Questions, bodies and first-order candidates of some questions."""
        return tuple(df.join(ids, "query_id", "left_semi") for df in (self.queries, self.bodies, self.one))


def _first(queries: DataFrame, ends: DataFrame, entities: DataFrame | None, s: Settings, models: Models, templates: prompts.Templates) -> _Asks:
    queries, ends = settled(with_settings(queries, s), "questions"), settled(ends, "ends")
    known = settled(history_before(queries, ends), "histories")
    bodies = settled(_bodies(queries, ends, known, entities, s, models, templates), "bodies")
    one = settled(cand.first_order(queries, ends), "one")
    context = _with_candidates(bodies, candidate_lists(queries, ends, s, one), s, templates)
    return _Asks(queries, ends, bodies, one, settled(infer(context, s, models, once=True), "answers"))


def _unsure(s: Settings) -> Column:
    return (F.coalesce(F.array_max("probs"), F.lit(0.0)) < s.confidence) & ~F.col("second")


def _again(asks: _Asks, which: Column, s: Settings, models: Models, templates: prompts.Templates) -> DataFrame:
    """Answers of some first answers' questions from second-order candidates, with the same bodies of prompts."""
    queries, bodies, one = asks.only(asks.first.filter(which).select("query_id"))
    wide = replace(s, second_order=True)
    return infer(_with_candidates(bodies, candidate_lists(queries, asks.ends, wide, one), wide, templates), s, models)


def best(queries: DataFrame, ends: DataFrame, entities: DataFrame | None = None, s: Settings = DEFAULT, models: Models = Models(), templates: prompts.Templates = prompts.Templates()) -> DataFrame:
    """``query_id, second, predicted, prob``: ``predict`` with the best answer's probability alone.

    The default label scores are asked again inside the tasks that put second-order lists together; such lists,
    their prompts and their probabilities never leave them. Other models, and more names than a task holds, go by ``predict``'s way.
    """
    shown = lambda answers: answers.select("query_id", "second", "predicted", F.array_max("probs").alias("prob"))
    if s.confidence <= 0 or s.second_order or not s.label_scores or models.labels is not hashed_labels:
        return shown(predict(queries, ends, entities, s, models, templates))
    asks = _first(queries, ends, entities, s, models, templates)
    # without neighbours there are no neighbours of neighbours: the second prompt is the first
    which, none = _unsure(s) & (F.size("candidates") > 0), F.size("candidates") == 0
    ask, bodies, one = asks.only(asks.first.filter(which).select("query_id"))
    ask = ask.join(bodies.select("query_id", prompts.around(templates).alias("around")), "query_id")
    given = pa.schema([("predicted", pa.string()), ("prob", pa.float64())])
    again = reach.whole(ask, one, cand.hops(asks.ends), ("around",), reach.hashed_best, given, s.max_scored)
    if again is None:
        again = shown(_again(asks, which, s, models, templates))
    first = shown(asks.first.filter(~which).withColumn("second", F.col("second") | none))
    return first.unionByName(again.withColumn("second", F.lit(True)))


def ranks(answers: DataFrame) -> DataFrame:
    """``query_id, candidate, prob, rank``; ties by name."""
    both = F.arrays_zip(F.col("candidates").alias("candidate"), F.col("probs").alias("prob"))
    rows = answers.select("query_id", F.explode(both).alias("x")).select("query_id", "x.candidate", "x.prob")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("prob").desc(), "candidate")))


def retrieved(queries: DataFrame, ends: DataFrame, s: Settings = DEFAULT, models: Models = Models()) -> DataFrame:
    """The long-term pool as the scorer sees and scores it."""
    return day_groups(history_before(with_settings(queries, s), ends), models.scorer, s.chunk if models.chunked else 0, models.like)


def clustered(ends: DataFrame, queries: DataFrame, sample: int = 500, k: int | None = None, encode=clusters.embed, seed: int = 42) -> DataFrame:
    """Clusters of a sample of the entities and of all that the questions ask about."""
    names = clusters.sampled(clusters.entity_list(ends), sample, queries.select(F.col("sq").alias("entity")).distinct(), seed)
    return clusters.cluster_entities(names, k=k, encode=encode, seed=seed, restarts=1).entities


def evaluated(quads: DataFrame, queries: DataFrame, ends: DataFrame, entities: DataFrame | None = None, s: Settings = DEFAULT, models: Models = Models(), start: int = 0, n: int = 0, sample: int = 0) -> tuple[DataFrame, DataFrame]:
    """Prediction records and rates of a window of questions: the whole run in one plan.

    Without ``entities``, ``sample`` of them are clustered first, once for all questions (0: no analogies).
    """
    asked = evaluate.window(queries, start, n)
    if entities is None and sample:
        entities = clustered(ends, asked, sample)
    ranked = ranks(predict(asked, ends, entities, s, models))
    return evaluate.records(ranked, asked, s.filter), evaluate.metrics(ranked, asked, quads, s.filter)


def timed(asks: DataFrame, cache, compute: Callable[[DataFrame], DataFrame]) -> dict[str, float]:
    """Seconds that a batch of ``asks`` (key, payload) takes without the cache, filling it, and from it; and what it saves."""
    import time

    def took(run: Callable[[], DataFrame]) -> float:
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    off = took(lambda: compute(asks))
    warm = took(lambda: cache.fill(asks, compute))
    on = took(lambda: cache.fill(asks, compute))
    return {"off": off, "warm": warm, "on": on, "speedup": off / on, "saved": 1 - on / off}


