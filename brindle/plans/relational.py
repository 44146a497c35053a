"""Registered queries of the relational surface: scans, joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.relational import asof_join, groups_frame, range_join, top_per_key
from brindle.plans.registry import Query, text_query
from brindle.sources.tables import table

#: The same text runs on both sides.
BOTH: dict[str, str] = {
    "readme_sales_agg": """SELECT l_returnflag, CAST(sum(CAST(l_quantity AS decimal(18,2))) AS double) AS sum_qty, max(l_extendedprice) AS max_price, min(l_extendedprice) AS min_price,
      CAST(sum(CAST(l_quantity AS decimal(18,2)) * CAST(l_extendedprice AS decimal(18,2))) AS double) AS volume
      FROM lineitem GROUP BY l_returnflag ORDER BY max(l_extendedprice) DESC""",
    "scan_project": "SELECT o_orderkey AS k, o.o_orderstatus, o_totalprice FROM orders o",
    "scan_star": "SELECT n.* FROM nation n",
    "filter_predicates": """SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
      WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT (l_linestatus = 'F' AND l_discount < 0.05) AND l_shipdate >= timestamp '1996-01-01 00:00:00'""",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' OR p_name ILIKE 'S%' OR p_type LIKE '_E%'",
    "null_logic": """SELECT doc_id, lang IS NULL AS no_lang, lang IS DISTINCT FROM 'en' AS other, lang IS NOT DISTINCT FROM source AS same, (n_chars > 2000) IS TRUE AS big,
      (n_chars > 2000) IS NOT TRUE AS not_big, (lang = 'de') IS FALSE AS not_de FROM documents""",
    "case_cast": """SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_totalprice < 100000 THEN 'middle' ELSE 'large' END AS size,
      CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS code, CAST(o_orderkey AS text) AS key_text, o_custkey::bigint AS cust, TRY_CAST(o_orderpriority AS int) AS prio FROM orders""",
    "concat_op": "SELECT c_custkey, c_name || '/' || c_mktsegment AS label, c_name || NULL AS nothing FROM customer",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 100000",
    "join_full": "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey + 50",
    "join_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_theta": "SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey <> b.s_nationkey",
    "join_residual": "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "join_null_aware_anti": """SELECT 'none is null' AS k, count(*) AS n FROM documents WHERE source NOT IN (SELECT w.source FROM source_weights w WHERE w.max_repeats > 2)
      UNION ALL SELECT 'one is null', count(*) FROM documents WHERE source NOT IN (SELECT d.source FROM documents d WHERE d.n_columns = 4)
      UNION ALL SELECT 'none at all', count(*) FROM documents WHERE source NOT IN (SELECT d.source FROM documents d WHERE d.n_columns < 0)""",
    "join_using": "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)",
    "join_natural": "SELECT * FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y",
    "join_self": "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_star": """SELECT r_name, p_brand, count(*) AS n, CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double) AS revenue
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      JOIN part ON l_partkey = p_partkey GROUP BY r_name, p_brand""",
    "agg_group": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1, 2",
    "agg_group_alias": "SELECT event_type AS kind, count(value) AS n FROM events GROUP BY kind",
    "agg_global": "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, max(o_orderdate) AS latest FROM orders ORDER BY n",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, CAST(sum(DISTINCT user_id) AS bigint) AS id_sum FROM events GROUP BY event_type",
    "agg_filter": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, max(value) FILTER (WHERE value < 50) AS small FROM events GROUP BY user_id",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "distinct_on": "SELECT DISTINCT ON (user_id) user_id, event_id, value FROM events ORDER BY user_id, ts DESC, event_id",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS bigint) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS bigint) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_ordered_list": "SELECT user_id, array_agg(event_type ORDER BY ts, event_id) AS kinds FROM events GROUP BY user_id",
    "agg_string": "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "agg_bits_bools": "SELECT event_type, bit_and(user_id) AS a, bit_or(user_id) AS o, bit_xor(user_id) AS x, bool_and(value > 1) AS every, bool_or(value > 90) AS some_big FROM events GROUP BY event_type",
    "agg_stats": """SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd_pop, round(var_samp(l_quantity), 5) AS v, round(var_pop(l_quantity), 5) AS vp,
      round(covar_samp(l_quantity, l_tax), 6) AS cs, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(corr(l_quantity, l_extendedprice), 6) AS c, median(l_quantity) AS med FROM lineitem GROUP BY l_returnflag""",
    "agg_regr": """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icpt, regr_count(l_extendedprice, l_quantity) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
      round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_sxx(l_extendedprice, l_quantity) / 1e6, 5) AS sxx, round(regr_syy(l_extendedprice, l_quantity) / 1e15, 4) AS syy, round(regr_sxy(l_extendedprice, l_quantity) / 1e9, 4) AS sxy
      FROM lineitem GROUP BY l_returnflag""",
    "win_rank": """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS bigint) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS bigint) AS rk,
      CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS bigint) AS dr FROM orders""",
    "win_dist": "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 9) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 9) AS cd FROM orders",
    "win_ntile": "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS bigint) AS quarter FROM orders",
    "win_first_last_nth": """SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 3) OVER w AS third
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "win_rows": "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS m, count(*) OVER (PARTITION BY user_id) AS n FROM events",
    "win_range": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS in_a_day FROM events",
    "win_groups": "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (ORDER BY n_regionkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS bigint) AS s FROM nation",
    "sort_limit": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5",
    "sort_expression": "SELECT p_partkey FROM part ORDER BY p_size * 2 DESC, p_partkey FETCH FIRST 7 ROWS ONLY",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_distinct": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey",
    "cte_recursive": "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS bigint), CAST(1 AS bigint) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "values_join": "SELECT v.code, v.label, o.n FROM (VALUES ('O', 'open'), ('F', 'final'), ('P', 'partial')) AS v(code, label) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) o ON o.o_orderstatus = v.code",
    "subq_scalar": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT max(s_acctbal) * 0.9 FROM supplier)",
    "subq_in": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "subq_exists_corr": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_quantity > 45)",
    "subq_corr_scalar": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer",
    "lateral_top1": "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t",
}

#: PostgreSQL text for us, DuckDB's own form for the oracle.
PAIRS: dict[str, tuple[str, str]] = {
    "filter_regex": (
        "SELECT p_partkey, p_name ~ '^[a-m]' AS low, p_name ~* '^[A-M]' AS low_any, p_name !~ 'e' AS no_e, p_name !~* 'E' AS no_e_any, p_type SIMILAR TO '%(IN|ON)%' AS sim FROM part",
        "SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS low, regexp_matches(p_name, '(?i)^[A-M]') AS low_any, NOT regexp_matches(p_name, 'e') AS no_e, NOT regexp_matches(p_name, '(?i)e') AS no_e_any, regexp_matches(p_type, '(IN|ON)') AS sim FROM part",
    ),
    "arith_int_div": (
        "SELECT n_nationkey, (n_nationkey - 12) / 5 AS d, n_nationkey % 4 AS m, n_nationkey & 6 AS a, n_nationkey | 9 AS o, n_nationkey # 5 AS x, n_nationkey << 2 AS l, n_nationkey >> 1 AS r, n_nationkey / 2.0 AS f, n_nationkey ^ 2 AS p, 3 * 2 ^ 2 + n_nationkey AS q, 2 ^ 3 ^ 2 AS left_first FROM nation",
        "SELECT n_nationkey, CAST((n_nationkey - 12) // 5 AS bigint) AS d, n_nationkey % 4 AS m, n_nationkey & 6 AS a, n_nationkey | 9 AS o, xor(n_nationkey, 5) AS x, n_nationkey << 2 AS l, n_nationkey >> 1 AS r, n_nationkey / 2.0 AS f, pow(n_nationkey, 2) AS p, 3 * pow(2, 2) + n_nationkey AS q, pow(pow(2, 3), 2) AS left_first FROM nation",
    ),
    "subscript_extract": (
        """SELECT event_id, CAST(EXTRACT(hour FROM ts) AS bigint) AS h, CAST(EXTRACT(dow FROM ts) AS bigint) AS dow, CAST(EXTRACT(isodow FROM ts) AS bigint) AS isodow, round(EXTRACT(epoch FROM ts), 3) AS ep, SUBSTRING(event_type FROM 2 FOR 3) AS part, POSITION('i' IN event_type) AS at,
           (ARRAY[event_type, 'x'])[1] AS first, (ARRAY[user_id, 7, 8])[2:3] AS tail, array_append(ARRAY[user_id], 5)[3] AS outside, (ARRAY[[user_id, 1], [2, 3]])[2][1] AS deep FROM events""",
        """SELECT event_id, EXTRACT(hour FROM ts) AS h, EXTRACT(dow FROM ts) AS dow, EXTRACT(isodow FROM ts) AS isodow, round(epoch(ts), 3) AS ep, SUBSTRING(event_type FROM 2 FOR 3) AS part, POSITION('i' IN event_type) AS at,
           event_type AS first, [7, 8] AS tail, CAST(NULL AS bigint) AS outside, 2 AS deep FROM events""",
    ),
    "any_all": (
        """SELECT p_partkey, p_size = ANY(ARRAY[1, 7, 30]) AS some, p_size + 1 > ALL (ARRAY[3, p_size - 5]) AS every, p_size <> ALL(ARRAY[2, NULL]) AS unsure, p_brand = ANY (SELECT p_brand FROM part WHERE p_size = 50) AS listed FROM part WHERE NOT p_size = ANY(ARRAY[9, 10])""",
        """SELECT p_partkey, p_size IN (1, 7, 30) AS some, p_size + 1 > 3 AND p_size + 1 > p_size - 5 AS every, CASE WHEN p_size = 2 THEN false END AS unsure, p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) AS listed FROM part WHERE p_size NOT IN (9, 10)""",
    ),
    "win_lag_lead": (
        """SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after2, lag(CASE WHEN value > 50 THEN value END) IGNORE NULLS OVER w AS last_big
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
        """SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after2, lag(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER w AS last_big
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    ),
    "win_qualify": (
        """SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 1000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2 AND count(*) OVER (PARTITION BY o_custkey) > 3 ORDER BY o_orderkey""",
        """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_totalprice > 1000) WHERE rn <= 2 AND n > 3""",
    ),
    "sort_nulls": (
        "SELECT doc_id, lang FROM documents ORDER BY lang DESC, doc_id LIMIT 40",
        "SELECT doc_id, lang FROM documents ORDER BY lang DESC NULLS FIRST, doc_id LIMIT 40",
    ),
    "gen_series": (
        "SELECT g.x, s FROM generate_series(1, 20, 3) AS g(x), range(5) AS r(s) WHERE s < 2",
        "SELECT g.x, s FROM generate_series(1, 20, 3) AS g(x), range(5) AS r(s) WHERE s < 2",
    ),
    "unnest_list": (
        "SELECT doc_id, unnest(make_array(page_no, n_columns)) AS v FROM documents",
        "SELECT doc_id, unnest([page_no, n_columns]) AS v FROM documents",
    ),
    "agg_approx": (
        """SELECT event_type, abs(approx_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS near, abs(approx_percentile_cont(value, 0.5) - median(value)) < 2 AS mid,
           approx_percentile_cont_with_weight(value, user_id + 1, 0.5) IS NOT NULL AS weighted, abs(approx_median(value) - median(value)) < 2 AS med FROM events GROUP BY event_type""",
        "SELECT DISTINCT event_type, true AS near, true AS mid, true AS weighted, true AS med FROM events",
    ),
}


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the hours that purchases opened: a range join on bins of an hour."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = e.where("event_type = 'purchase' AND value > 95").select(F.col("event_id").alias("purchase_id"), F.col("at").alias("s"), (F.col("at") + 3_600_000_000).alias("e"))
    return range_join(e.select("event_id", "at"), spans, "at", "s", "e", 3_600_000_000).select("event_id", "purchase_id")


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest click before it."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'click')")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return asof_join(left, right, "ts", "click_ts", ["user_id"], ["click_id"]).select("event_id", "click_id")


def join_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join by hint: sort-merge instead of what the optimiser would choose."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.hint("merge").join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def win_groups_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GROUPS frame through the DataFrame operator."""
    n = table(spark, sf_dir, "nation")
    return groups_frame(n, [], F.col("n_regionkey"), F.count(F.lit(1)), 1, 1).select("n_nationkey", "value")


def topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer."""
    return top_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


_OPS = (join_range, join_asof, join_hints, win_groups_api, topk_per_key)
QUERIES: dict[str, Query] = {n: text_query(s) for n, s in BOTH.items()} | {n: text_query(p) for n, (p, _) in PAIRS.items()} | {f.__name__: f for f in _OPS}
ORACLE: dict[str, str] = dict(BOTH) | {n: o for n, (_, o) in PAIRS.items()} | {
    "join_range": "SELECT a.event_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.ts >= b.ts AND a.ts < b.ts + INTERVAL 1 HOUR WHERE b.event_type = 'purchase' AND b.value > 95",
    "join_asof": "SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts",
    "join_hints": "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "win_groups_api": "SELECT n_nationkey, count(*) OVER (ORDER BY n_regionkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS value FROM nation",
    "topk_per_key": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3",
}
