"""Queries over the tables of a folder, one for each operator, with SQL that gives the same results.

BOTH holds texts that Spark and DuckDB read alike; PAIRS holds (Spark, DuckDB) texts where the dialects differ. Spark plans
all of them with Catalyst; nothing is collected on the way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dialect import register
from .operators import recursion, zset
from .plans import auctions, incremental, program

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

BOTH: dict[str, str] = {
    "scan": "SELECT * FROM region",
    "cte_scan": "WITH t AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT a.k, a.n, b.n AS m FROM t a JOIN t b ON a.k = b.k",
    "project": "SELECT o_orderkey + 1 AS k, o_totalprice * 2 AS p FROM orders",
    "filter": "SELECT event_id, value FROM events WHERE value > 50 AND event_type = 'click'",
    "map_filter_map": "SELECT v * 2 AS w FROM (SELECT value + 1 AS v, event_type FROM events) t WHERE v > 20 AND event_type <> 'view'",
    "comparison": "SELECT event_id, value < 10 AS a, value <= 10 AS b, value <> 10 AS c, value >= 90 AS d FROM events",
    "three_valued_logic": "SELECT event_id, (nullif(event_type, 'click') = 'view' AND value > 5) AS a, (nullif(event_type, 'click') = 'view' OR value > 5) AS o, NOT (nullif(event_type, 'click') = 'view') AS n FROM events",
    "is_null": "SELECT event_id FROM events WHERE nullif(event_type, 'click') IS NULL",
    "is_distinct_from": "SELECT event_id, nullif(event_type, 'click') IS DISTINCT FROM 'view' AS d, nullif(event_type, 'click') IS NOT DISTINCT FROM NULL AS s FROM events",
    "is_true": "SELECT event_id, (nullif(event_type, 'click') = 'view') IS TRUE AS t, (nullif(event_type, 'click') = 'view') IS NOT FALSE AS f FROM events",
    "between": "SELECT event_id FROM events WHERE value BETWEEN 10 AND 20",
    "in_list": "SELECT event_id, nullif(event_type, 'click') IN ('view', 'purchase') AS i, event_type NOT IN ('view') AS n FROM events",
    "like": "SELECT c_custkey, c_name LIKE '%1_' AS l, c_name LIKE '%#%' ESCAPE '!' AS e FROM customer",
    "ilike": "SELECT c_custkey, c_name ILIKE 'CUSTOMER%' AS l FROM customer",
    "case": "SELECT event_id, CASE WHEN value > 50 THEN 'hi' WHEN value > 20 THEN 'mid' ELSE 'lo' END AS c, CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS s FROM events",
    "cast": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(o_totalprice AS DECIMAL(18, 2)) AS d, CAST(o_orderdate AS DATE) AS t FROM orders",
    "arithmetic": "SELECT o_orderkey, -o_orderkey AS n, o_orderkey % 7 AS m, o_totalprice * 1.5 - 2 AS p FROM orders",
    "typed_literals": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND CAST(o_orderdate AS DATE) < DATE '1995-01-01' + INTERVAL '90' DAY",
    "inner_join": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "computed_key_join": "SELECT a.n_name AS x, b.r_name AS y FROM nation a JOIN region b ON a.n_regionkey + 1 = b.r_regionkey + 1",
    "theta_join": "SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
    "cross_join": "SELECT a.r_name AS x, b.n_name AS y FROM region a CROSS JOIN nation b",
    "residual_join": "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_extendedprice > o.o_totalprice / 2",
    "left_join": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey",
    "right_join": "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey",
    "full_join": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN (SELECT * FROM customer WHERE c_custkey > 50) c ON s.s_suppkey = c.c_custkey",
    "outer_join_residual": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
    "full_join_filter": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey WHERE c.c_acctbal > 5000",
    "join_using": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x FULL JOIN (SELECT s_suppkey AS k, s_name AS b FROM supplier) y USING (k)",
    "semi_join_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "semi_join_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "anti_join_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "anti_join_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "correlated_scalar_subquery": "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS m FROM customer c",
    "count_star": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "count_column": "SELECT user_id, count(nullif(event_type, 'click')) AS n FROM events GROUP BY user_id",
    "count_distinct": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type",
    "sum": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "avg": "SELECT l_returnflag, avg(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY l_returnflag",
    "min_max": "SELECT o_custkey, min(o_totalprice) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_custkey",
    "filter_aggregate": "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY o_custkey",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "select_distinct": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
    "partitioned_top_k": "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS r FROM orders) t WHERE r <= 3",
    "ranks": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part",
    "window_partition": "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, max(value) OVER (PARTITION BY user_id) AS m FROM events",
    "window_running": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST) AS n FROM events",
    "window_range": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events",
    "lag_lead": "SELECT event_id, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, lead(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 5",
    "union_all": "SELECT n_name AS x FROM nation UNION ALL SELECT r_name AS x FROM region",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT nullif(s_nationkey, 3) AS k FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey AS k FROM supplier",
    "coalesce_nullif": "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS c FROM events",
    "greatest_least": "SELECT l_orderkey, l_linenumber, greatest(l_orderkey, l_partkey) AS g, least(l_orderkey, nullif(l_partkey, 5)) AS l FROM lineitem",
    "upper_lower_length": "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, length(c_name) AS n FROM customer",
    "md5": "SELECT c_custkey, md5(c_name) AS h FROM customer",
    "concat_ws": "SELECT c_custkey, concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING')) AS s, c_name || c_mktsegment AS b FROM customer",
    "replace": "SELECT c_custkey, replace(c_name, 'Customer', 'C') AS s FROM customer",
    "abs_round": "SELECT c_custkey, abs(c_acctbal) AS a, round(CAST(c_acctbal AS DECIMAL(12, 2)), 1) AS r FROM customer",
    "power_sqrt_exp": "SELECT p_partkey, power(p_size, 2) AS p, sqrt(p_size) AS q FROM part",
}

BOTH |= {
    "comma_join": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "two_key_join": "SELECT l.l_orderkey, l.l_linenumber, a.n FROM lineitem l JOIN (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey) a ON l.l_orderkey = a.l_orderkey AND l.l_suppkey = a.l_suppkey",
    "null_keys_never_match": "SELECT a.k, b.n FROM (SELECT nullif(n_regionkey, 2) AS k FROM nation) a LEFT JOIN (SELECT nullif(r_regionkey, 2) AS k, r_name AS n FROM region) b ON a.k = b.k",
    "left_join_keyless": "SELECT a.r_name AS x, b.n_name AS y FROM region a LEFT JOIN nation b ON b.n_nationkey > a.r_regionkey + 20",
    "exists_in_projection": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000) AS e FROM customer c",
    "having_subquery": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 1500 FROM orders)",
    "sum_decimal": "SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS s FROM lineitem GROUP BY l_suppkey",
    "sum_of_nothing": "SELECT event_type, CAST(sum(CASE WHEN event_type = 'click' THEN event_id END) AS BIGINT) AS s, avg(CASE WHEN event_type = 'click' THEN event_id END) AS a FROM events GROUP BY event_type",
    "min_max_strings": "SELECT c_nationkey, min(c_name) AS a, max(c_mktsegment) AS b FROM customer GROUP BY c_nationkey",
    "group_by_expression": "SELECT length(p_type) AS n, p_size % 3 AS m, count(*) AS c FROM part GROUP BY length(p_type), p_size % 3",
    "filter_many": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS a, count(DISTINCT user_id) FILTER (WHERE value <= 50) AS b, max(value) FILTER (WHERE user_id < 10) AS c FROM events GROUP BY event_type",
    "rank_top_k": "SELECT p_partkey, r FROM (SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS FIRST) AS r FROM part) t WHERE r < 4",
    "dense_rank_top_k": "SELECT p_partkey, r FROM (SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size NULLS LAST) AS r FROM part) t WHERE 3 >= r",
    "window_sums": "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id) AS BIGINT) AS s, avg(event_id) OVER (PARTITION BY user_id) AS a, min(value) OVER (PARTITION BY user_id) AS m FROM events",
    "window_running_sum": "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY event_type ORDER BY event_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events",
    "window_range_number": "SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part",
    "window_null_order_key": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY nullif(user_id, 3) NULLS FIRST) AS n FROM events",
    "order_by_hidden_key": "SELECT c_name FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 7",
    "union_types": "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT s_suppkey AS k FROM supplier",
    "set_precedence": "SELECT n_nationkey AS k FROM nation UNION (SELECT c_nationkey AS k FROM customer INTERSECT SELECT n_regionkey AS k FROM nation)",
    "several_ctes": "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE n > 10) SELECT c.c_name, a.n FROM customer c JOIN a ON a.k = c.c_custkey WHERE c.c_custkey IN (SELECT k FROM b)",
    "in_subquery_negated_null": "SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 1) FROM region) OR n_nationkey < 3",
    "qualified_star": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "window_stddev": "SELECT event_id, round(stddev_samp(value) OVER (PARTITION BY user_id), 6) AS s, round(var_pop(value) OVER (PARTITION BY user_id), 4) AS v FROM events",
    "limit_all": "SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT ALL",
    "nested_case_cast": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(o_orderkey AS DOUBLE) / 4 ELSE 0.0 END AS x, CAST(o_orderkey % 2 AS BOOLEAN) AS b FROM orders",
}

PAIRS: dict[str, tuple[str, str]] = {
    "stddev_variance": ("SELECT event_type, round(stddev_samp(value), 6) AS a, round(var_pop(value), 4) AS b FROM events GROUP BY event_type", "SELECT event_type, round(stddev_samp(value), 6) AS a, round(var_pop(value), 4) AS b FROM events GROUP BY event_type"),
    "median_percentile": ("SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS m, percentile_disc(0.25) WITHIN GROUP (ORDER BY value) AS d FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS m, quantile_disc(value, 0.25) AS d FROM events GROUP BY event_type"),
    "percentile_date": ("SELECT event_type, date_from_unix_date(CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_date(CAST(ts AS DATE))) AS INT)) AS m, date_from_unix_date(CAST(floor(percentile_cont(0.25) WITHIN GROUP (ORDER BY unix_date(CAST(ts AS DATE)))) AS INT)) AS c FROM events GROUP BY event_type", "SELECT event_type, quantile_disc(CAST(ts AS DATE), 0.5) AS m, CAST(quantile_cont(CAST(ts AS DATE), 0.25) AS DATE) AS c FROM events GROUP BY event_type"),
    "percentile_interval": ("SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY CAST(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000 AS BIGINT)) / 1e6D AS s FROM events GROUP BY event_type", "SELECT event_type, epoch(quantile_disc(ts - TIMESTAMP '2024-01-01 00:00:00', 0.5)) AS s FROM events GROUP BY event_type"),
    "percentile_timestamp": ("SELECT event_type, CAST(timestamp_micros(CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(CAST(ts AS TIMESTAMP))) AS BIGINT)) AS TIMESTAMP_NTZ) AS m FROM events GROUP BY event_type", "SELECT event_type, quantile_disc(ts, 0.5) AS m FROM events GROUP BY event_type"),
}

PAIRS |= {
    "full_join_keyless": ("SELECT a.r_name AS x, b.n_name AS y FROM region a FULL JOIN (SELECT * FROM nation WHERE n_nationkey < 3) b ON a.r_regionkey > b.n_nationkey + 2", "SELECT a.r_name AS x, b.n_name AS y FROM region a FULL JOIN (SELECT * FROM nation WHERE n_nationkey < 3) b ON a.r_regionkey > b.n_nationkey + 2"),
    "flat_map": ("SELECT c_custkey, explode(split(c_name, '#')) AS part FROM customer", "SELECT c_custkey, unnest(string_split(c_name, '#')) AS part FROM customer"),
    "rlike_negated": ("SELECT c_custkey FROM customer WHERE NOT c_name RLIKE '[02468]$'", "SELECT c_custkey FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')"),
    "timestamp_difference": ("SELECT o_orderkey, CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '1990-01-01 00:00:00', o_orderdate) AS BIGINT) AS s FROM orders", "SELECT o_orderkey, CAST(date_diff('second', TIMESTAMP '1990-01-01 00:00:00', o_orderdate) AS BIGINT) AS s FROM orders"),
    "variance_forms": ("SELECT user_id, round(stddev_pop(value), 6) AS a, round(var_samp(value), 4) AS b FROM events GROUP BY user_id HAVING count(*) > 1", "SELECT user_id, round(stddev_pop(value), 6) AS a, round(var_samp(value), 4) AS b FROM events GROUP BY user_id HAVING count(*) > 1"),
    "percentile_descending": ("SELECT event_type, percentile_disc(0.25) WITHIN GROUP (ORDER BY event_id DESC) AS d FROM events GROUP BY event_type", "SELECT event_type, CAST(quantile_disc(event_id, 0.25 ORDER BY event_id DESC) AS DOUBLE) AS d FROM events GROUP BY event_type"),
} | auctions.PAIRS
#: (text of the programs' dialect, DuckDB's): run as programs run them, so that the dialect's own meaning is what is compared.
DIALECT: dict[str, tuple[str, str]] = {
    "similar_to": (r"SELECT c_custkey, c_name SIMILAR TO 'Customer#0*[1-5]+' AS s, c_name SIMILAR TO 'Customer.%' AS d, c_name SIMILAR TO '(Customer|x)!#%' ESCAPE '!' AS e FROM customer", "SELECT c_custkey, regexp_full_match(c_name, 'Customer#0*[1-5]+') AS s, regexp_full_match(c_name, 'Customer\\..*') AS d, regexp_full_match(c_name, '(Customer|x)#.*') AS e FROM customer"),
    "regexp_like": ("SELECT c_custkey, REGEXP_LIKE(c_name, '[13579]$') AS s FROM customer", "SELECT c_custkey, regexp_matches(c_name, '[13579]$') AS s FROM customer"),
    "regexp_flags": ("SELECT c_custkey, REGEXP_LIKE(c_name, '^CUSTOMER', 'i') AS s, REGEXP_SUBSTR(c_name, 'CUST[a-z]+', 'i') AS t FROM customer", "SELECT c_custkey, regexp_matches(c_name, '^CUSTOMER', 'i') AS s, nullif(regexp_extract(c_name, 'CUST[a-z]+', 0, 'i'), '') AS t FROM customer"),
    "regexp_replace_first": (r"SELECT c_custkey, REGEXP_REPLACE(c_name, '0', 'x') AS s, REGEXP_REPLACE(c_name, '(0+)([1-9])', '[\2$1\1]') AS g FROM customer", r"SELECT c_custkey, regexp_replace(c_name, '0', 'x') AS s, regexp_replace(c_name, '(0+)([1-9])', '[\2$1\1]') AS g FROM customer"),
    "regexp_replace_all": (r"SELECT c_custkey, REGEXP_REPLACE(c_name, '0', 'x', 'g') AS s, REGEXP_REPLACE(c_name, '([0-9])', '<\1>', 'g') AS g FROM customer", r"SELECT c_custkey, regexp_replace(c_name, '0', 'x', 'g') AS s, regexp_replace(c_name, '([0-9])', '<\1>', 'g') AS g FROM customer"),
    "regexp_substr": ("SELECT c_custkey, REGEXP_SUBSTR(c_name, '[1-9][0-9]*') AS s FROM customer", "SELECT c_custkey, nullif(regexp_extract(c_name, '[1-9][0-9]*'), '') AS s FROM customer"),
    "integer_division": ("SELECT o_orderkey, o_orderkey / 7 AS d, -o_orderkey / 7 / 3 AS n, o_totalprice / 7 AS f, (o_orderkey + 1) / (o_custkey % 5 + 1) AS m FROM orders", "SELECT o_orderkey, CAST(trunc(o_orderkey / 7) AS BIGINT) AS d, CAST(trunc(CAST(trunc(-o_orderkey / 7) AS BIGINT) / 3) AS BIGINT) AS n, o_totalprice / 7 AS f, (o_orderkey + 1) // (o_custkey % 5 + 1) AS m FROM orders"),
    "iif_decode": ("SELECT event_id, IIF(value > 50, 'a', 'b') AS i, DECODE(event_type, 'click', 1, 'view', 2, 0) AS d FROM events", "SELECT event_id, CASE WHEN value > 50 THEN 'a' ELSE 'b' END AS i, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS d FROM events"),
    "concat_skips_nulls": ("SELECT c_custkey, CONCAT(nullif(c_mktsegment, 'BUILDING'), c_name) AS s FROM customer", "SELECT c_custkey, concat(nullif(c_mktsegment, 'BUILDING'), c_name) AS s FROM customer"),
    "substring": ("SELECT c_custkey, SUBSTRING(c_name, -1, 5) AS s, SUBSTR(c_name, 3) AS t FROM customer", "SELECT c_custkey, c_name[1:3] AS s, c_name[3:] AS t FROM customer"),
    "split_index": ("SELECT c_custkey, SPLIT_INDEX(c_name, '#', 1) AS s, SPLIT_INDEX(c_name, '#', 9) AS n FROM customer", "SELECT c_custkey, string_split(c_name, '#')[2] AS s, string_split(c_name, '#')[10] AS n FROM customer"),
    "split_part": ("SELECT c_custkey, SPLIT_PART(c_name, '#', 2) AS s, SPLIT_PART(c_name, '#', 0) AS z, SPLIT_PART(c_name, '0', -1) AS l FROM customer", "SELECT c_custkey, split_part(c_name, '#', 2) AS s, '' AS z, split_part(c_name, '0', -1) AS l FROM customer"),
    "strpos": ("SELECT c_custkey, CAST(STRPOS(c_name, '#') AS BIGINT) AS p FROM customer", "SELECT c_custkey, strpos(c_name, '#') AS p FROM customer"),
    "trim": ("SELECT c_custkey, TRIM(BOTH 'Cr' FROM c_name) AS t, LTRIM(c_name, 'Cu') AS l, RTRIM(c_name, '0123456789') AS r FROM customer", "SELECT c_custkey, trim(c_name, 'Cr') AS t, ltrim(c_name, 'Cu') AS l, rtrim(c_name, '0123456789') AS r FROM customer"),
    "log": ("SELECT p_partkey, round(LOG(CAST(p_size AS DOUBLE)), 9) AS l, LN(p_size - p_size) AS z FROM part", "SELECT p_partkey, round(log10(p_size), 9) AS l, CAST('-infinity' AS DOUBLE) AS z FROM part"),
    "ln_exp_log_base": ("SELECT p_partkey, round(LN(p_size), 9) AS l, round(EXP(p_size / 10.0D), 6) AS e, round(LOG(2.0D, p_size), 9) AS b FROM part", "SELECT p_partkey, round(ln(p_size), 9) AS l, round(exp(p_size / 10.0::DOUBLE), 6) AS e, round(log(2.0::DOUBLE, p_size), 9) AS b FROM part"),
    "sign": ("SELECT c_custkey, SIGN(c_acctbal) AS s FROM customer", "SELECT c_custkey, CAST(sign(c_acctbal) AS INTEGER) AS s FROM customer"),
    "floor_ceil": ("SELECT c_custkey, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, FLOOR(c_acctbal * 1e300) AS h, CEILING(c_custkey) AS k FROM customer", "SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, floor(c_acctbal * 1e300) AS h, c_custkey AS k FROM customer"),
    "extract": ("SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(WEEK FROM ts) AS w, EXTRACT(DOW FROM ts) AS d, EXTRACT(EPOCH FROM ts) AS e, EXTRACT(QUARTER FROM ts) AS q, EXTRACT(SECOND FROM ts) AS s, DATE_PART('HOUR', ts) AS h FROM events", "SELECT event_id, extract(year FROM ts) AS y, extract(week FROM ts) AS w, extract(dow FROM ts) AS d, epoch(ts) AS e, extract(quarter FROM ts) AS q, extract(microsecond FROM ts) / 1e6 AS s, extract(hour FROM ts) AS h FROM events"),
    "date_trunc": ("SELECT event_id, DATE_TRUNC('MONTH', ts) AS m, DATE_TRUNC('hour', ts) AS h FROM events", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, date_trunc('hour', ts) AS h FROM events"),
    "date_trunc_date": ("SELECT o_orderkey, DATE_TRUNC('WEEK', CAST(o_orderdate AS DATE)) AS w FROM orders", "SELECT o_orderkey, CAST(date_trunc('week', CAST(o_orderdate AS DATE)) AS DATE) AS w FROM orders"),
    "dateadd": ("SELECT event_id, DATEADD('MONTH', 1, ts) AS m, DATEADD('DAY', -3, CAST(ts AS DATE)) AS d FROM events", "SELECT event_id, ts + INTERVAL 1 MONTH AS m, CAST(CAST(ts AS DATE) - INTERVAL 3 DAY AS DATE) AS d FROM events"),
    "datediff_boundaries": ("SELECT o_orderkey, DATEDIFF('YEAR', o_orderdate, TIMESTAMP_NTZ '2000-01-01 00:00:00') AS y, DATEDIFF('MONTH', o_orderdate, TIMESTAMP_NTZ '2000-01-01 00:00:00') AS m, DATEDIFF('DAY', o_orderdate, TIMESTAMP_NTZ '2000-01-01 00:00:00') AS d FROM orders", "SELECT o_orderkey, date_diff('year', o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS y, date_diff('month', o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS m, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS d FROM orders"),
    "tumble": ("SELECT TUMBLE(ts, INTERVAL '1' HOUR) AS w, count(*) AS n FROM events GROUP BY TUMBLE(ts, INTERVAL '1' HOUR)", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY 1"),
    "tumble_start_end": ("SELECT TUMBLE_START(ts, INTERVAL '1' DAY) AS s, TUMBLE_END(ts, INTERVAL '1' DAY) AS e, count(*) AS n FROM events GROUP BY TUMBLE_START(ts, INTERVAL '1' DAY), TUMBLE_END(ts, INTERVAL '1' DAY)", "SELECT date_trunc('day', ts) AS s, date_trunc('day', ts) + INTERVAL 1 DAY AS e, count(*) AS n FROM events GROUP BY 1, 2"),
    "tumble_rows": ("SELECT event_id, window_start, window_end FROM TABLE(TUMBLE(TABLE events, DESCRIPTOR(ts), INTERVAL '1' HOUR))", "SELECT event_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end FROM events"),
    "hop": ("SELECT window_start AS s, event_type, count(*) AS n FROM TABLE(HOP(TABLE events, DESCRIPTOR(ts), INTERVAL '1' HOUR, INTERVAL '2' HOUR)) GROUP BY window_start, event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (k) HOUR AS s, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY 1, 2"),
    "hop_rows": ("SELECT event_id, window_start FROM TABLE(HOP(TABLE events, DESCRIPTOR(ts), INTERVAL '1' HOUR, INTERVAL '3' HOUR))", "SELECT event_id, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (k) HOUR AS window_start FROM events, range(3) r(k)"),
    "interval_arithmetic": ("SELECT event_id, ts + INTERVAL '36' HOUR AS a, ts - INTERVAL '2' DAY AS b, CAST(add_months(CAST(ts AS DATE), 13) AS DATE) AS c, ts + 3 * INTERVAL '1' DAY AS e FROM events", "SELECT event_id, ts + INTERVAL 36 HOUR AS a, ts - INTERVAL 2 DAY AS b, CAST(CAST(ts AS DATE) + INTERVAL 13 MONTH AS DATE) AS c, ts + INTERVAL 3 DAY AS e FROM events"),
    "in_projection_3vl": ("SELECT k, k IN (SELECT nullif(r_regionkey, 1) FROM region) AS i, k NOT IN (SELECT nullif(r_regionkey, 1) FROM region) AS n, k IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2) AS p FROM (SELECT nullif(n_regionkey, 0) AS k FROM nation) a", "SELECT k, k IN (SELECT nullif(r_regionkey, 1) FROM region) AS i, k NOT IN (SELECT nullif(r_regionkey, 1) FROM region) AS n, k IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2) AS p FROM (SELECT nullif(n_regionkey, 0) AS k FROM nation) a"),
    "first_last_value": ("SELECT event_id, FIRST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events", "SELECT event_id, first_value(value) OVER w AS a, last_value(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "limit_without_order": ("SELECT c_custkey, c_name FROM customer LIMIT 10", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey, c_name LIMIT 10"),
    "limit_ties": ("SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC LIMIT 7 OFFSET 2", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_mktsegment, c_custkey LIMIT 7 OFFSET 2"),
    "fetch_first": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 3 ROWS FETCH NEXT 5 ROWS ONLY", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 5 OFFSET 3"),
    "row_number_ties": ("SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_mktsegment) AS r FROM (SELECT c_custkey, c_mktsegment FROM customer) c) t WHERE r <= 2", "SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) t WHERE r <= 2"),
    "nulls_high": ("SELECT event_id, RANK() OVER (ORDER BY nullif(user_id, 3)) AS a, RANK() OVER (ORDER BY nullif(user_id, 3) DESC) AS d FROM events", "SELECT event_id, rank() OVER (ORDER BY nullif(user_id, 3) NULLS LAST) AS a, rank() OVER (ORDER BY nullif(user_id, 3) DESC NULLS FIRST) AS d FROM events"),
    "cast_matrix": (
        "SELECT event_id, CAST(CAST(event_id AS VARCHAR) AS BIGINT) AS a, CAST(event_id % 2 AS BOOLEAN) AS b, CAST(CAST(event_id % 2 AS BOOLEAN) AS INTEGER) AS c, CAST(event_id AS DOUBLE PRECISION) AS d, CAST(CAST(event_id AS DECIMAL(12, 2)) AS DOUBLE) AS e, CAST('2024-02-29' AS DATE) AS f, CAST(CAST(ts AS DATE) AS VARCHAR) AS g, CAST(NULL AS INTEGER) AS h, CAST(event_id % 100 AS SMALLINT) AS i FROM events",
        "SELECT event_id, CAST(CAST(event_id AS VARCHAR) AS BIGINT) AS a, CAST(event_id % 2 AS BOOLEAN) AS b, CAST(CAST(event_id % 2 AS BOOLEAN) AS INTEGER) AS c, CAST(event_id AS DOUBLE) AS d, CAST(CAST(event_id AS DECIMAL(12, 2)) AS DOUBLE) AS e, CAST('2024-02-29' AS DATE) AS f, CAST(CAST(ts AS DATE) AS VARCHAR) AS g, CAST(NULL AS INTEGER) AS h, CAST(event_id % 100 AS SMALLINT) AS i FROM events",
    ),
    "recursive_cycle": (
        "WITH RECURSIVE r(src, dst) AS (SELECT n_nationkey, n_nationkey * 3 % 25 FROM nation UNION ALL SELECT x.src, y.dst FROM r x JOIN r y ON x.dst = y.src) SELECT src, dst FROM r",
        "WITH RECURSIVE e AS (SELECT n_nationkey AS src, n_nationkey * 3 % 25 AS dst FROM nation), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r",
    ),
}

#: Estimates: no SQL gives the very same numbers.
ESTIMATES: dict[str, str] = {
    "approx_count_distinct": "SELECT event_type, approx_count_distinct(user_id, 0.016) AS n FROM events GROUP BY event_type",
    "approx_percentile": "SELECT event_type, approx_percentile(value, 0.9, 10000) AS p FROM events GROUP BY event_type",
}


def prepare(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """The dialect's functions if sql uses them, and views of the tables that it names."""
    if "fx_" in sql:
        register(spark)
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def run_sql(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark, sf_dir, sql)
    return spark.sql(sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and nation, grouped: the joined group-by of the headline."""
    return run_sql(FLAGSHIP, spark, sf_dir)


FLAGSHIP = """SELECT n.n_name, o.o_orderstatus, count(*) AS n_orders, max(o.o_totalprice) AS largest
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, o.o_orderstatus"""


def weighted_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events inserted, clicks deleted again: what is left, counted by type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    left = zset.minus(zset.weighted(e), zset.weighted(e.where("event_type = 'click'")))
    return left.groupBy("event_type").agg(F.sum(zset.W).alias("n"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events keyed by user, then projected to what is left of key and value; clicks are taken out again by weight."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    z = zset.plus(zset.weighted(e), zset.weighted(e.where("event_type = 'click'"), -1))
    by_user = zset.index_by(z, ["user_id"], ["event_type"])
    return zset.expand(zset.group_project(by_user, {"user_id": F.col("key.user_id"), "kind": F.col("value.event_type")}))


def run_dialect(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark, sf_dir, sql)
    return program.query(spark, sql)


def recursive_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which earlier orders each filled order leads back to, by way of its customer's order before it: the closure over an edge for each order."""
    return recursion.closure(run_sql(EDGES, spark, sf_dir))


EDGES = "SELECT src, dst FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders WHERE o_orderstatus = 'F') t WHERE dst IS NOT NULL"

QUERIES: dict[str, Callable] = {"flagship": flagship, "zset_difference": weighted_integral, "with_recursive": recursive_reach, "index_group_project": indexed}
QUERIES |= incremental.QUERIES | {k: partial(run_sql, v) for k, v in (BOTH | ESTIMATES).items()} | {k: partial(run_sql, v[0]) for k, v in PAIRS.items()} | {k: partial(run_dialect, v[0]) for k, v in DIALECT.items()}
ORACLE_SQL: dict[str, str] = BOTH | incremental.ORACLE_SQL | {k: v[1] for k, v in (PAIRS | DIALECT).items()} | {
    "flagship": FLAGSHIP,
    "zset_difference": "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY event_type",
    "index_group_project": "SELECT user_id, event_type AS kind FROM events WHERE event_type <> 'click'",
    "with_recursive": f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r",
}
