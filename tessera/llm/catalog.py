"""All queries of the subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import credentials, docpairs, handwritten, leakage, packing, reading, syntax
from tessera.sources.tables import spread, table


def _p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.find_not_handwritten(spread(table(spark, d, "files", "id", "path", "content")))


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1_reasons(spark, d).select("file_id")


def _p2_checked(spark: SparkSession, d: str, causes: bool = True) -> DataFrame:
    return syntax.check_files(spread(table(spark, d, "files", "id", "path", "language", "content")), causes)


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2_checked(spark, d, causes=False).where("not valid").select("file_id")


def _p2_failures(spark: SparkSession, d: str) -> DataFrame:
    return _p2_checked(spark, d).where("not valid")


def _p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(_p2_checked(spark, d))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(spread(table(spark, d, "files", "id", "path", "content"))).select("file_id", "line_no").distinct()


def _p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact_credentials(spread(table(spark, d, "files", "id", "path", "content")))


def _p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    columns = ("id", "file_id", "kind", "name", "qualified_name", "start_line", "signature", "docstring")
    return docpairs.pair_documentation(table(spark, d, "symbols", *columns))


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6_pairs(spark, d).select("symbol_id")


def _p8_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, d, "documents", "doc_id", "text")))


def _p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_fill(_p8_packs(spark, d))


def _p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "benchmark", "item_id", "text"))


def _p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _p9_leaks(spark, d).select("doc_id", "item_id")


def _p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_p9_leaks(spark, d))


def _p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "doc_levels", "doc_id", "grade"))


def _p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(_p10_levels(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": _p1_found, "p1_reasons": _p1_reasons, "p2_found": _p2_found, "p2_failures": _p2_failures, "p2_rates": _p2_rates, "p4_found": _p4_found, "p4_redacted": _p4_redacted, "p6_found": _p6_found, "p6_pairs": _p6_pairs, "p8_packs": _p8_packs, "p8_fill": _p8_fill, "p9_found": _p9_found, "p9_leaked_items": _p9_leaked_items, "p10_found": _p10_found, "p10_levels": _p10_levels}


def oracle_sql() -> dict[str, str]:
    return {}
