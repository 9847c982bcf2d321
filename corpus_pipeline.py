"""From documents to packed training sequences: five stages, each on all that its predecessor kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. All but the last return
the columns of documents. ``run`` writes each stage's result to the shared folder
and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import alike, langid, mixing, packing, pii
from chronoweave.llm._spark import discard, documents, kept, materialise, named, restored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that are rejected (no letters, or far from all centroids) go."""
    columns = docs.columns
    out = langid.predict(docs, langid.fit(docs, langid.trainable()), extra=tuple(columns))
    return out.filter("not rejected").select(*(F.col(f"x{k}").alias(c) for k, c in enumerate(columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates (five-word shingles, similarity 0.8 or more): its first.

    Rows are told apart by number, so null and repeated ids are safe.
    """
    columns = docs.columns
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("uid"), *kept(columns)), "numbered")
    first = alike.firsts(rows, "uid", f"kept_{columns.index('text')}")
    return rows.join(first, rows["uid"] == first["id"], "left_semi").select(*restored(columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mixture of sources takes; packing deals them anew."""
    return mixing.mix(docs, ordered=False).select(*map(named, docs.columns))


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return packing.op9_packing(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing_)]
#: Trained models and connected components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(last)  # the documents themselves are not of our writing and stay
    return STAGES[-1][1](spark, docs, sf_dir)
