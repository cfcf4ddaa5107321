"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, ann, counts, infill, licenses, packing, pii, quality, mixing, simhash, tokenfile, urlrules, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(_table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": _on("documents", packing.op1_packing),
        "op2_license_scan": _on("documents", licenses.op2_license_scan),
        "op3_pii": _on("documents", pii.op3_pii),
        "op4_simhash": _on("documents", simhash.op4_simhash),
        "op5_url_filter": _on("pages", urlrules.op5_url_filter),
        "op6_token_files": _on("documents", tokenfile.op6_token_files),
        "op7_mixing": _on("documents", mixing.op7_mixing),
        "op8_warc": _on("pages", warc.op8_warc),
        "op9_neighbours": _on("embeddings", ann.op9_neighbours),
        "op10_quality": lambda spark, sf_dir: quality.op10_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
        "op11_infill": _on("documents", infill.op11_infill),
        "op12_alignment": _on("documents", align.op12_alignment),
        "op13_token_counts": _on("documents", counts.op13_token_counts),
    }


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; tests hold the others against brute force."""
    return {"op2_license_scan": licenses.op2_sql(), "op7_mixing": mixing.op7_sql(), "op8_warc": warc.op8_sql(), "op10_quality": quality.op10_sql(), "op11_infill": infill.op11_sql()}
