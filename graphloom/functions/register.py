"""The column functions as temporary SQL functions, so that spark.sql can call them by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "graph_terms": ("t STRING", "ARRAY<STRING>", r"transform(regexp_extract_all(coalesce(t, ''), '[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+', 0), x -> lower(x))"),
    "graph_is_locator": ("t STRING", "BOOLEAN", r"t rlike '^(mem|int|task|plan|sym|file|module):' AND NOT t rlike '\\s'"),
    "graph_token_estimate": ("t STRING", "BIGINT", "cast(floor(length(t) / 3) as bigint)"),
    "graph_recency": ("last_seen BIGINT, now BIGINT, half_life_days DOUBLE", "DOUBLE", "CASE WHEN coalesce(last_seen, 0) = 0 THEN 0.0D ELSE pow(0.5D, greatest((now - last_seen) / 86400.0D, 0.0D) / half_life_days) END"),
    "graph_event_key": ("project STRING, id STRING, body STRING", "STRING", r"sha2(concat_ws('\0', project, id, body), 256)"),
    "graph_slug": ("t STRING", "STRING", "coalesce(nullif(trim(BOTH '-' FROM substring(array_join(slice(filter(split(lower(coalesce(t, '')), '[^a-z0-9]+'), x -> x <> ''), 1, 6), '-'), 1, 48)), ''), 'memory')"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes FUNCTIONS known to the session; returns their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
