"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, langid, licenses, lm, media_ts, mixing, neardup, packing, pii, quality
from ._spark import documents


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprint": _over_documents(fingerprints.op1_fingerprint),
        "op2_quality": op2_quality,
        "op3_pii": _over_documents(pii.op3_pii),
        "op4_mixing": _over_documents(mixing.op4_mixing),
        "op5_language": _over_documents(langid.op5_language),
        "op6_lm": _over_documents(lm.op6_lm),
        "op7_media": _over_documents(media_ts.op7_media),
        "op8_licenses": _over_documents(licenses.op8_licenses),
        "op9_packing": _over_documents(packing.op9_packing),
        "op10_simhash": _over_documents(neardup.op10_simhash),
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_licenses": licenses.oracle()}
