"""Query over business positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orebody.operators.spatial import points_within
from orebody.sources.readers import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different businesses at most 50 m apart, the smaller id first."""
    b = table(spark, sf_dir, "business")
    near = points_within(b, b, 50.0, left_id="business_id", right_id="business_id", ordered=True)
    return near.selectExpr("left_id AS business_id_1", "right_id AS business_id_2")


P6_SQL = """
WITH p AS (SELECT DISTINCT business_id AS id, latitude AS la, longitude AS lo FROM business
           WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0) AND business_id IS NOT NULL)
SELECT DISTINCT a.id AS business_id_1, b.id AS business_id_2 FROM p a JOIN p b
  ON abs(a.la - b.la) <= 0.001 AND a.id < b.id
WHERE 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(b.la - a.la) / 2), 2)
  + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= 50
"""

QUERIES = {"p6_found": p6_found}
SQL = {"p6_found": P6_SQL}
