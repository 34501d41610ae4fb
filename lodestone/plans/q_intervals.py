"""Queries of interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.intervals import speaker_periods
from lodestone.plans.registry import query
from lodestone.session import table


@query(
    "p4_found",
    """
    WITH v AS (SELECT DISTINCT conv_id, speaker, CAST(round(start_time * 1000) AS BIGINT) AS s, CAST(round(end_time * 1000) AS BIGINT) AS e
               FROM diar_segments WHERE start_time IS NOT NULL AND end_time IS NOT NULL AND isfinite(start_time) AND isfinite(end_time)),
    r AS (SELECT *, max(e) OVER (PARTITION BY conv_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v WHERE e > s),
    i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r),
    p AS (SELECT conv_id, speaker, g, min(s) AS s, max(e) AS e FROM i GROUP BY ALL),
    l AS (SELECT *, lag(e) OVER (PARTITION BY conv_id, speaker ORDER BY s) AS pe FROM p)
    SELECT conv_id, speaker, 'period' AS kind, s AS start_ms, e AS end_ms FROM p
    UNION ALL SELECT conv_id, speaker, 'gap', pe, s FROM l WHERE pe IS NOT NULL""",
)
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_periods(table(spark, sf, "diar_segments"))
