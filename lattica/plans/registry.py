"""All registered queries of the package, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.plans import diagram_queries, evaluation_queries, homology_queries, learned_queries, pixel_queries, result_queries, selection_queries, source_queries, spatial_queries

ALL = {**pixel_queries.QUERIES, **diagram_queries.QUERIES, **result_queries.QUERIES, **selection_queries.QUERIES, **source_queries.QUERIES, **evaluation_queries.QUERIES, **learned_queries.QUERIES, **homology_queries.QUERIES, **spatial_queries.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram_queries.flagship(spark, sf_dir)


def queries() -> dict:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
