"""Helper functions for SQL users, as temporary SQL functions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = (
    """wl_duration(ms BIGINT) RETURNS STRING RETURN
       CASE WHEN ms / 1000 < 60 THEN replace(format_number(ms / 1000, 1), ',', '') || 's'
            ELSE replace(format_number(ms / 1000 / 60, 1), ',', '') || 'm' END""",
    """wl_bytes(n BIGINT) RETURNS STRING RETURN
       CASE WHEN n / 1073741824 < 1 THEN replace(format_number(n / 1048576, 1), ',', '') || 'MB'
            ELSE replace(format_number(n / 1073741824, 2), ',', '') || 'GB' END""",
    r"""wl_memory_gb(t STRING) RETURNS DOUBLE RETURN
       CASE regexp_extract(upper(t), '^(\\d+\\.?\\d*)\\s*(GB|MB|TB)', 2)
            WHEN 'GB' THEN CAST(regexp_extract(upper(t), '^(\\d+\\.?\\d*)', 1) AS DOUBLE)
            WHEN 'MB' THEN CAST(regexp_extract(upper(t), '^(\\d+\\.?\\d*)', 1) AS DOUBLE) / 1024
            WHEN 'TB' THEN CAST(regexp_extract(upper(t), '^(\\d+\\.?\\d*)', 1) AS DOUBLE) * 1024 END""",
    r"""wl_table_name(t STRING) RETURNS STRING RETURN
       CASE size(split(t, '\\.')) WHEN 3 THEN t WHEN 2 THEN 'main.' || t WHEN 1 THEN 'main.default.' || t END""",
    r"""wl_strip_comments(t STRING) RETURNS STRING RETURN
       regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '--[^\\n]*', ''), '(?m)[ \\t]+$', ''),
         '(?s)/\\*.*?\\*/', ''), '^\\s+|\\s+$', '')""",
)


def register_sql_functions(spark: SparkSession) -> None:
    for definition in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
