"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoframe.llm import clustering, fingerprints, lines, mixing, neardup, neighbours, packing, personal, pipeline, quality, resampling, suffixes, topk, urls

OPERATORS = (fingerprints, mixing, packing, quality, urls, personal, lines, neardup, suffixes, neighbours, clustering, topk, resampling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: function for module in OPERATORS for name, function in module.QUERIES.items()}
    return found | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in OPERATORS for name, sql in getattr(module, "SQL", {}).items()}
