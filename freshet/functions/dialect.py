"""Scalar functions whose meaning here differs from Spark's, as SQL temporary functions (inlined, no Python)."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "fx_concat(a STRING, b STRING) RETURNS STRING": "concat_ws('', a, b)",
    "fx_split_index(s STRING, d STRING, n INT) RETURNS STRING": "CASE WHEN n >= 0 THEN get(split(s, concat('\\\\Q', d, '\\\\E'), -1), n) END",
    "fx_split_part(s STRING, d STRING, n INT) RETURNS STRING": "CASE WHEN n = 0 AND s IS NOT NULL AND d IS NOT NULL THEN '' ELSE split_part(s, d, nullif(n, 0)) END",
    "fx_substring(s STRING, start INT, n INT) RETURNS STRING": "substring(s, greatest(start, 1), greatest(least(start + n, char_length(s) + 1) - greatest(start, 1), 0))",
    "fx_strpos(s STRING, p STRING) RETURNS INT": "locate(p, s)",
    "fx_regexp_replace(s STRING, p STRING, r STRING) RETURNS STRING": "regexp_replace(s, concat('^((?s:.*?))(', p, ')'), concat('$1', r))",
    "fx_ln(x DOUBLE) RETURNS DOUBLE": "CASE WHEN x > 0 THEN ln(x) WHEN x = 0 THEN double('-Infinity') WHEN x IS NULL THEN NULL ELSE double('NaN') END",
    "fx_log(x DOUBLE) RETURNS DOUBLE": "CASE WHEN x > 0 THEN log10(x) WHEN x = 0 THEN double('-Infinity') WHEN x IS NULL THEN NULL ELSE double('NaN') END",
    "fx_upper(s STRING) RETURNS STRING": "CASE WHEN contains(s, 'ß') THEN replace(upper(replace(s, 'ß', '\\uE0DF')), '\\uE0DF', 'ß') ELSE upper(s) END",
    "fx_sign(x DOUBLE) RETURNS INT": "CAST(sign(x) AS INT)",
    "fx_dow(t TIMESTAMP_NTZ) RETURNS BIGINT": "CAST(dayofweek(t) - 1 AS BIGINT)",
    "fx_epoch(t TIMESTAMP_NTZ) RETURNS DOUBLE": "unix_micros(CAST(t AS TIMESTAMP)) / 1e6",
    "fx_year_diff(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ) RETURNS BIGINT": "CAST(year(b) - year(a) AS BIGINT)",
    "fx_tumble(t TIMESTAMP_NTZ, micros BIGINT) RETURNS TIMESTAMP_NTZ": "CAST(timestamp_micros(unix_micros(CAST(t AS TIMESTAMP)) - pmod(unix_micros(CAST(t AS TIMESTAMP)), micros)) AS TIMESTAMP_NTZ)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; a session that has them is left alone."""
    if spark.catalog.functionExists("fx_concat") and spark.catalog.functionExists("fx_tumble"):
        return
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
