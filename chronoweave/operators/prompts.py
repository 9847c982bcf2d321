"""Sentences, questions and prompts. Wording of the prompts is our own; any other can be given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import date_words, phrases_of, question, sentence

NO_ANALOGIES = "(no analogies)"
SCORE = "Question: {query}\nWhich of these {n} events help to answer it? Give a score to each.\n{events}"
ANALOGY = "{target}Events:\n{history}\n\nQuestion: {query}\nAnswer: {answer}\nExplain in a few sentences how the events lead to the answer."
ANSWER = "Answer the last question with the number of one candidate.\n\n{analogies}\n\nEvents:\n{history}\n\nQuestion: {query}\nCandidates:\n{candidates}\nAnswer:"


@dataclass(frozen=True)
class Templates:
    """Texts with names in braces. score: query, n, events; analogy: history, query, answer, target; answer: analogies, history, query, candidates."""

    score: str = SCORE
    analogy: str = ANALOGY
    answer: str = ANSWER


def templates_of(spark: SparkSession, folder: str) -> Templates:
    """Templates from ``score.txt``, ``analogy.txt`` and ``answer.txt``, as far as a folder has them."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"))
    known = {r["name"].removesuffix(".txt"): r["value"] for r in files.filter(F.col("name").isin("score.txt", "analogy.txt", "answer.txt")).collect()}
    return Templates(**known)


def fill(template: str, **values: Column) -> Column:
    """A template with its names in braces replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(text), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def with_phrases(df: DataFrame, relation: str = "relation", name: str = "said") -> DataFrame:
    """Phrases are made once per distinct relation and joined (Spark broadcasts them by their size)."""
    table = phrases_of(df, relation).withColumnRenamed("phrase", name)
    return df.join(table, relation, "left")


def verbalised(quads: DataFrame) -> DataFrame:
    """Events with their ``sentence``."""
    return with_phrases(quads).withColumn("sentence", sentence(F.col("subject"), F.col("said"), F.col("object"), date_words(F.col("ts_raw"), F.col("ts")))).drop("said")


def asked(queries: DataFrame) -> DataFrame:
    """Questions with their ``question``."""
    return with_phrases(queries, "rq").withColumn("question", question(F.col("sq"), F.col("said"), date_words(F.col("tq_raw"), F.col("tq")))).drop("said")


def numbered(rows: DataFrame, by: str, order: str, text: str, name: str) -> DataFrame:
    """``by, name``: a group's texts as a numbered list, in order."""
    items = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(by).agg(F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x[text])), "\n").alias(name))


def candidate_list(candidates: Column) -> Column:
    return F.array_join(F.transform(candidates, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")


def plain_analysis(prompt: Column, answer: Column) -> Column:
    """What a deterministic generator says, whatever the prompt."""
    return F.concat(F.lit("The events lead to "), answer, F.lit("."))


def analyses(rows: DataFrame, generate=None, templates: Templates = Templates()) -> DataFrame:
    """Rows (history, question, answer, target) with their ``analysis``; ``generate``: a column of texts from a column of prompts."""
    prompt = fill(templates.analogy, history=F.col("history"), query=F.col("question"), answer=F.col("answer"), target=F.col("target"))
    return rows.withColumn("analysis", generate(prompt) if generate else plain_analysis(prompt, F.col("answer")))


def grounded(queries: DataFrame, events: DataFrame, generate=None, templates: Templates = Templates()) -> DataFrame:
    """``query_id, analysis`` for lists of events (query_id, place, event): the last one is the grounded one, those before it its history.

    The question itself stands ahead of the prompt.
    """
    last = events.groupBy("query_id").agg(F.max("place").alias("last"))
    rows = events.join(last, "query_id")
    before = numbered(verbalised(rows.filter("place < last")), "query_id", "place", "sentence", "history")
    target = asked(queries).select("query_id", F.concat(F.lit("To be answered in the end: "), "question", F.lit("\n")).alias("target"))
    one = rows.filter("place = last").select("query_id", F.col("subject").alias("sq"), F.col("relation").alias("rq"), F.col("ts_raw").alias("tq_raw"), F.col("ts").alias("tq"), F.col("object").alias("answer"))
    whole = asked(one).join(before, "query_id", "left").join(target, "query_id").withColumn("history", F.coalesce("history", F.lit("")))
    return analyses(whole, generate, templates).select("query_id", "analysis")


def analogies(similar: DataFrame, histories: DataFrame, generate=None, templates: Templates = Templates()) -> DataFrame:
    """``query_id, analogies``: each similar event's history, question, answer and analysis as text.

    ``similar``: query_id, nth and the event, and own_id if histories aren't keyed by
    the event's number; ``histories``: their dual histories (query_id). ``generate``:
    column of analyses from a column of prompts.
    """
    own = F.col("own_id") if "own_id" in similar.columns else F.col("event_idx")
    events = numbered(verbalised(histories), "query_id", "place", "sentence", "history").withColumnRenamed("query_id", "own_id")
    rows = asked(similar.select("query_id", "nth", own.alias("own_id"), F.col("subject").alias("sq"), F.col("relation").alias("rq"), F.col("ts_raw").alias("tq_raw"), F.col("ts").alias("tq"), F.col("object").alias("answer")))
    rows = rows.join(events, "own_id", "left").withColumn("history", F.coalesce("history", F.lit(""))).withColumn("target", F.lit(""))
    rows = analyses(rows, generate, templates)
    text = F.concat(F.lit("Analogy "), F.col("nth").cast("string"), F.lit(":\n"), "history", F.lit("\nQuestion: "), "question", F.lit("\nAnswer: "), "answer", F.lit(". "), "analysis")
    items = F.array_sort(F.collect_list(F.struct("nth", text.alias("text"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(items, lambda x: x["text"]), "\n").alias("analogies"))


def bodies(queries: DataFrame, dual: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """What prompts say besides candidates: ``query_id, question, history, analogies``."""
    rows = asked(queries).join(numbered(verbalised(dual), "query_id", "place", "sentence", "history"), "query_id", "left")
    rows = rows.join(examples, "query_id", "left") if examples is not None else rows.withColumn("analogies", F.lit(None).cast("string"))
    return rows.select("query_id", "question", F.coalesce("history", F.lit("")).alias("history"), F.coalesce("analogies", F.lit(NO_ANALOGIES)).alias("analogies"))


def whole(templates: Templates = Templates()) -> Column:
    """The prompt of a row of ``bodies`` with its ``candidates``."""
    return fill(templates.answer, analogies=F.col("analogies"), history=F.col("history"), query=F.col("question"), candidates=F.coalesce(candidate_list(F.col("candidates")), F.lit("")))


def around(templates: Templates = Templates()) -> Column:
    """The texts of a row of ``bodies`` before, between and after the places of the candidates in its prompt."""
    return F.array(*(fill(part, analogies=F.col("analogies"), history=F.col("history"), query=F.col("question")) for part in templates.answer.split("{candidates}")))


def prompts(queries: DataFrame, dual: DataFrame, lists: DataFrame, examples: DataFrame | None = None, templates: Templates = Templates()) -> DataFrame:
    """Whole prompts: ``query_id, question, candidates, prompt``."""
    rows = bodies(queries, dual, examples).join(lists, "query_id", "left")
    return rows.select("query_id", "question", "candidates", whole(templates).alias("prompt"))
