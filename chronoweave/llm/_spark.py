"""Session helpers shared by the operators: shared storage, shipped code, row hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[2]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; an unset one gets a local default in local mode (tests) only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it again.

    The files outlive any executor, so a lost one costs a re-read, not a re-run.
    They are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _folder(spark, path, lambda fs, p: fs.deleteOnExit(p))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_stored", None):
            _folder(t.sparkSession, path, lambda fs, p: fs.delete(p, True))


def _folder(spark: SparkSession, path: str, use) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    use(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers where PYTHONPATH doesn't already do so."""
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_chronoweave_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="chronoweave-")) / "chronoweave_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((_ROOT / "chronoweave").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(target))
    sc._chronoweave_shipped = True


def lean() -> None:
    """Let a Python worker give back what earlier tasks have left: workers are used again, and glibc keeps what it freed."""
    gc.collect()
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # another C library
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # arrays of a megabyte and more are mapped, so freeing them frees memory
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers, which begin each task lean."""
    ship(df.sparkSession)

    def run(batches):
        lean()
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def named(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept(columns: tuple[str, ...] | list[str]) -> list[Column]:
    """The columns under the names kept_0, kept_1 …, which clash with nothing."""
    return [named(c).alias(f"kept_{k}") for k, c in enumerate(columns)]


def restored(columns: tuple[str, ...] | list[str]) -> list[Column]:
    """``kept`` undone."""
    return [F.col(f"kept_{k}").alias(c) for k, c in enumerate(columns)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hex_id(column: str) -> Column:
    """A 64-bit long as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
