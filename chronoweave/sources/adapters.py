"""Canonical events from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RAW = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quads(df: DataFrame, index: Column, subject: Column, relation: Column, obj: Column, ts: Column) -> DataFrame:
    out = df.select(index.cast("long").alias("event_idx"), subject.alias("subject"), relation.alias("relation"), F.lower(F.trim(relation)).alias("relation_norm"), obj.alias("object"), ts.alias("ts"))
    return out.withColumn("ts_raw", F.date_format("ts", _RAW)).withColumn("day", F.to_date("ts"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events: user, event type, item."""
    e = _table(spark, sf_dir, "events")
    item = F.concat(F.lit("item_"), F.get_json_object("props", "$.k"))
    return _quads(e, F.col("event_id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")), F.col("event_type"), item, F.col("ts"))


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with their customer and a number that is unique, made inside each order line (of up to 9,999 rows)."""
    li = _table(spark, sf_dir, "lineitem")
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    li = li.withColumn("event_idx", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000 + F.row_number().over(w))
    return li.select("event_idx", "l_orderkey", "l_suppkey", "l_shipdate", F.concat("l_returnflag", "l_linestatus").alias("flags")).join(o, "l_orderkey")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' shipments: supplier, flags, customer."""
    j = _shipped(spark, sf_dir)
    return _quads(j, F.col("event_idx"), F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")), F.col("flags"), F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")), F.col("l_shipdate"))


def national(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the supplier's nation as subject: many events a day."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = _shipped(spark, sf_dir).join(s, "l_suppkey").join(n, "n_nationkey")
    return _quads(j, F.col("event_idx"), F.col("n_name"), F.col("flags"), F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")), F.col("l_shipdate"))


def entities(spark: SparkSession, sf_dir: str, prefix: str = "user_") -> DataFrame:
    """``entity, features, cluster`` from the table of embeddings."""
    return _table(spark, sf_dir, "embeddings").select(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).alias("entity"), F.col("embedding").alias("features"), F.col("label").alias("cluster"))


def held_out(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, queries): the newest event of each subject becomes a question, all others are known."""
    newest = Window.partitionBy("subject").orderBy(F.col("ts").desc_nulls_last(), F.col("event_idx").desc())
    marked = quads.withColumn("nth", F.row_number().over(newest))
    asked = marked.filter("nth = 1").select(F.col("event_idx").alias("query_id"), F.col("subject").alias("sq"), F.col("relation").alias("rq"), F.col("relation_norm").alias("rq_norm"), F.col("ts_raw").alias("tq_raw"), F.col("ts").alias("tq"), F.col("object").alias("ground_truth"))
    return marked.filter("nth > 1").drop("nth"), asked
