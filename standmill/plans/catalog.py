"""All queries over the point fixtures, by name, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standmill.operators import metrics
from standmill.plans import frame_queries, job_queries, mask_queries, registry, voxel_queries  # noqa: F401
from standmill.sources.fixtures import points


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How tall are the trees: predictions per tile, merged, measured, tallest first."""
    merged = frame_queries.merged(spark, sf_dir)
    measured = merged.join(points(spark, sf_dir).select("scene_id", "pid", "x", "y", "z"), ["scene_id", "pid"])
    return metrics.tree_metrics(measured).orderBy(F.desc("height_m"), "scene_id", "tree_id")


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
