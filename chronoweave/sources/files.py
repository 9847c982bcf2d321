"""Event files to the canonical table: delimited, id-encoded, JSON, JSON lines, directories of splits."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import digest, normal, parse_time, strip

SPLITS = ("train", "test", "valid", "dev")
#: Names of a field in JSON objects, the first that isn't empty counts.
ALIASES = {"subject": ("subject", "s", "head"), "relation": ("relation", "r", "rel"), "object": ("object", "o", "tail"), "ts_raw": ("timestamp", "t", "time")}
PROBE = 4096


def canonical(rows: DataFrame, split: str = "train", order: Column | None = None) -> DataFrame:
    """Add what all operators use to rows of subject, relation, object, ts_raw (and event_idx, or an order for it)."""
    columns = [strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("subject", "relation", "object", "ts_raw")]
    index = F.col("event_idx") if "event_idx" in rows.columns else (order if order is not None else F.monotonically_increasing_id())
    out = rows.select(index.cast("long").alias("event_idx"), F.lit(split).alias("split"), *columns)
    out = out.withColumn("relation_norm", normal(F.col("relation"))).withColumn("ts", parse_time(F.col("ts_raw")))
    return out.withColumn("day", F.to_date("ts"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one (a local one where none is set in local mode); deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for plans that ask for it more than once."""
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file."""
    fs, p = _fs(spark, path)
    stream = fs.create(p)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _opens_with(spark: SparkSession, path: str) -> str:
    """The first character of a file that is no white space; a file's beginning is all that is read."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        while (b := stream.read()) >= 0:
            if not chr(b).isspace():
                return chr(b)
    finally:
        stream.close()
    return ""


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def split_files(spark: SparkSession, path: str, splits: tuple[str, ...] = SPLITS) -> dict[str, str]:
    """Files of the splits that are there: the bare name before ``name.txt``."""
    found = {}
    for s in splits:
        for name in (s, f"{s}.txt"):
            if exists(spark, f"{path}/{name}"):
                found[s] = f"{path}/{name}"
                break
    return found


def delimiter(sample: str) -> str:
    """Tab if there is one; else of comma, semicolon and bar the one that splits the lines most evenly; comma in doubt."""
    if "\t" in sample:
        return "\t"
    lines = [x for x in sample.splitlines() if x.strip()][:20]
    even = [d for d in ",;|" if lines and lines[0].count(d) >= 3 and len({x.count(d) for x in lines}) == 1]
    return even[0] if even else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """subject, relation, object, ts_raw of lines with four fields or more; header lines (``subject``) are skipped.

    Lines without quotes are split as text, so that an empty field differs from a
    missing one; lines with quotes are parsed as CSV. Where a line has an odd number
    of quotes, a quoted field goes on in the next one: then the whole file is read as CSV.
    """
    head = spark.read.text(path).limit(50).collect()
    sep = delimiter("\n".join(r["value"] for r in head)[:PROBE])
    lines = spark.read.text(path)
    names = ("subject", "relation", "object", "ts_raw")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    if not lines.filter(quotes % 2 == 1).isEmpty():
        schema = ", ".join(f"{n} string" for n in names)
        parsed = spark.read.schema(schema).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
        rows = parsed.select(F.monotonically_increasing_id().alias("event_idx"), *names).filter("ts_raw is not null")
        return rows.filter(F.lower(strip(F.col("subject"))) != "subject")
    plain = F.split(F.col("value"), "\\" + sep if sep != "\t" else "\t", -1)
    typed = F.from_csv(F.col("value"), ", ".join(f"c{i} string" for i in range(4)), {"sep": sep, "mode": "PERMISSIVE", "enforceSchema": "true"})
    quoted = F.array(*(typed[f"c{i}"] for i in range(4)))
    fields = F.when(F.contains(F.col("value"), F.lit('"')), F.when(typed["c3"].isNotNull(), quoted)).otherwise(plain)
    rows = lines.select(F.monotonically_increasing_id().alias("event_idx"), fields.alias("f")).filter(F.size("f") >= 4)
    rows = rows.select("event_idx", *(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return rows.filter(F.lower(strip(F.col("subject"))) != "subject")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``idx, name`` of a tab-separated file; malformed lines are skipped, the last name of an index counts."""
    f = F.split(F.col("value"), "\t", -1)
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), strip(F.get(f, F.lit(0))).alias("name"), strip(F.get(f, F.lit(1))).alias("idx"))
    return rows.filter(F.col("idx").rlike("^-?[0-9]+$")).groupBy("idx").agg(F.max_by("name", "line").alias("name"))


def read_encoded(spark: SparkSession, path: str, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Id-encoded lines, decoded by the maps (small: Spark broadcasts them by their size); unknown ids stay as they are."""
    f = F.split(F.col("value"), "\t", -1)
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("event_idx"), f.alias("f")).filter(F.size("f") >= 4)
    rows = rows.select("event_idx", *(strip(F.get("f", F.lit(i))).alias(n) for i, n in enumerate(("s", "r", "o", "t"))))
    coded = F.col("s").rlike("^-?[0-9]+$") & F.col("r").rlike("^-?[0-9]+$") & F.col("o").rlike("^-?[0-9]+$")
    rows = rows.withColumn("coded", coded)
    for c, table in (("s", entities), ("r", relations), ("o", entities)):
        names = table.select(F.col("idx").alias(c), F.col("name").alias(f"{c}_name"))
        rows = rows.join(names, c, "left")
    decoded = lambda c: F.when(F.col("coded"), F.coalesce(f"{c}_name", c)).otherwise(F.col(c))
    words = lambda c: F.when(F.col("coded"), F.translate(decoded(c), "_", " ")).otherwise(decoded(c))
    return rows.select("event_idx", words("s").alias("subject"), normal(F.translate(decoded("r"), "_", " ")).alias("relation"), words("o").alias("object"), F.col("t").alias("ts_raw"))


def from_objects(rows: DataFrame) -> DataFrame:
    """Objects under any of ALIASES to the four fields; none of them gives the empty text."""
    have = set(rows.columns)
    pick = lambda names: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have), F.lit(""))
    return rows.select(F.monotonically_increasing_id().alias("event_idx"), *(pick(names).alias(c) for c, names in ALIASES.items()))


_OBJECT = ", ".join(f"`{n}` string" for names in ALIASES.values() for n in names)


def read_quads(spark: SparkSession, path: str, splits: tuple[str, ...] | None = None) -> DataFrame:
    """Canonical events of a file or a directory of splits, in the order of splits and lines."""
    if _is_dir(spark, path) and not path.endswith((".parquet", ".json", ".jsonl")):
        files = split_files(spark, path, splits or SPLITS)
        if not files:
            raise FileNotFoundError(f"no split of {', '.join(splits or SPLITS)} in {path}")
        maps = [f"{path}/{n}2id.txt" for n in ("entity", "relation")]
        encoded = all(exists(spark, m) for m in maps)
        tables = [read_mapping(spark, m) for m in maps] if encoded else []
        parts = []
        for n, (split, file) in enumerate(files.items()):
            rows = read_encoded(spark, file, *tables) if encoded else read_delimited(spark, file)
            parts.append(canonical(rows.withColumn("event_idx", F.col("event_idx") + F.lit(n << 56)), split))
        return reduce(DataFrame.unionByName, parts)
    if path.endswith(".parquet"):
        return canonical(spark.read.parquet(path))
    if path.endswith(".jsonl"):
        return canonical(from_objects(spark.read.schema(_OBJECT).json(path)))
    if path.endswith(".json"):
        if _opens_with(spark, path) != "[":
            raise ValueError(f"{path}: not an array of objects")
        return canonical(from_objects(spark.read.schema(_OBJECT).option("multiLine", True).json(path)))
    return canonical(read_delimited(spark, path))


def history_data(spark: SparkSession, data: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Events that a question may know: those given, else the training split of a folder."""
    if data is not None:
        return data
    if path is None:
        raise ValueError("neither events nor a folder")
    return read_quads(spark, path, ("train",)) if _is_dir(spark, path) else read_quads(spark, path)


def metric_lines(metrics: DataFrame) -> DataFrame:
    """Rows of a table of metrics as lines between commas: fractions with four digits, nulls as nothing."""
    kinds = dict(metrics.dtypes)
    cell = lambda c: F.format_string("%.4f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    return metrics.select(F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit("")).otherwise(cell(c)) for c in metrics.columns)).alias("value"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One text file with a header line: tables of metrics have a row for each setting."""
    header = metrics.sparkSession.createDataFrame([(0, ",".join(metrics.columns))], "n int, value string")
    header.unionByName(metric_lines(metrics).withColumn("n", F.lit(1))).coalesce(1).sortWithinPartitions("n", "value").select("value").write.mode("overwrite").text(path)


RECORD = (
    "index long, query struct<subject:string,relation:string,timestamp:string>, ground_truth string, predicted string, candidate_size long, candidate_set array<string>, in_oq boolean, skipped_reason string, used_second_order boolean, eval_filter string, "
    "raw struct<hit_at_1:boolean,hit_at_10:boolean,rank:long,ranked_candidates:array<string>,ranked_probs:array<double>,top10:array<string>,top10_probs:array<double>>, filtered struct<hit_at_1:boolean,hit_at_10:boolean,rank:long,top10:array<string>>"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


class ResponseCache:
    """Responses by key in a Parquet table; the newest answer of a key counts, by the time it was put there.

    Keys are digests of a namespace (what is asked of the model), the model and the
    payload, so that one folder serves several of each.
    """

    SCHEMA = "key string, value string, at long"

    def __init__(self, spark: SparkSession, path: str, namespace: str = "predict", model: str = ""):
        self.spark, self.path, self.namespace, self.model = spark, path, namespace, model

    def keyed(self, asked: DataFrame) -> DataFrame:
        """``asked`` (payload …) with its keys."""
        return asked.withColumn("key", digest(self.namespace, F.lit(self.model), F.col("payload")))

    def every(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def table(self) -> DataFrame:
        return self.every().groupBy("key").agg(F.max_by("value", "at").alias("value"))

    def put(self, rows: DataFrame) -> None:
        rows.select("key", "value", F.lit(time.time_ns()).alias("at")).write.mode("append").parquet(self.path)

    def fill(self, asked: DataFrame, compute) -> DataFrame:
        """``asked`` (key, or payload to make one of) with ``value``: cached ones joined, the misses computed once per key and kept."""
        asked = asked if "key" in asked.columns else self.keyed(asked)
        misses = asked.join(self.table(), "key", "left_anti").dropDuplicates(["key"])
        self.put(compute(misses))
        return asked.join(self.table(), "key")

    def clear(self) -> int:
        """Answers that were there."""
        n = self.every().count()
        fs, p = _fs(self.spark, self.path)
        fs.delete(p, True)
        return n
