"""Registered queries of the function surface, one a category or more."""

from __future__ import annotations

from brindle.plans.registry import Query, text_query

#: PostgreSQL-flavoured text for us, DuckDB's form for the oracle.
PAIRS: dict[str, tuple[str, str]] = {
    "fn_math": (
        """SELECT p_partkey, abs(p_size - 25) AS f1, round(acos(p_size / 100.0), 9) AS f2, round(acosh(p_size + 1.0), 9) AS f3, round(asin(p_size / 100.0), 9) AS f4, round(asinh(p_size + 0.5), 9) AS f5, round(atan(p_size + 0.0), 9) AS f6,
           round(atan2(p_size + 0.0, 3.0), 9) AS f7, round(atanh(p_size / 100.0), 9) AS f8, round(cbrt(p_size + 0.0), 9) AS f9, ceil(p_retailprice) AS f10, round(cos(p_size + 0.0), 9) AS f11, round(cot(p_size + 0.0), 7) AS f12, round(degrees(p_size + 0.0), 8) AS f13,
           round(exp(p_size / 10.0), 8) AS f14, factorial(p_size % 10) AS f15, floor(p_retailprice) AS f16, gcd(p_size, 12) AS f17, lcm(p_size, 12) AS f18, isnan(p_retailprice) AS f19, round(ln(p_size + 1.0), 9) AS f20, round(log(2.0, p_size + 1.0), 9) AS f21,
           round(log(p_size + 1.0), 9) AS f22, round(log10(p_size + 1.0), 9) AS f23, round(log2(p_size + 1.0), 9) AS f24, round(pi(), 9) AS f25, round(power(p_size + 0.0, 2), 6) AS f26, round(radians(p_size + 0.0), 9) AS f27, random() < 1 AS f28,
           round(p_retailprice, 1) AS f29, signum(p_size - 25.0) AS f30, round(sin(p_size + 0.0), 9) AS f31, round(sqrt(p_size + 0.0), 9) AS f32, round(tan(p_size / 100.0), 9) AS f33, round(tanh(p_size + 0.0), 9) AS f34, trunc(p_retailprice - 1200) AS f35,
           iszero(p_size - 25) AS f36, nanvl(p_retailprice, 1.0) AS f37, round(sinh(p_size / 10.0), 7) AS f38, round(cosh(p_size / 10.0), 7) AS f39, trunc(p_size * 1e300) AS f40, ceil(p_size * 1e19) AS f41, floor(p_size * -1e19) AS f42, trunc(p_retailprice, 1) AS f43, ceil(p_size / -3.0) AS f44 FROM part""",
        """SELECT p_partkey, abs(p_size - 25) AS f1, round(acos(p_size / 100.0), 9) AS f2, round(acosh(p_size + 1.0), 9) AS f3, round(asin(p_size / 100.0), 9) AS f4, round(asinh(p_size + 0.5), 9) AS f5, round(atan(p_size + 0.0), 9) AS f6,
           round(atan2(p_size + 0.0, 3.0), 9) AS f7, round(atanh(p_size / 100.0), 9) AS f8, round(cbrt(p_size + 0.0), 9) AS f9, ceil(p_retailprice) AS f10, round(cos(p_size + 0.0), 9) AS f11, round(cot(p_size + 0.0), 7) AS f12, round(degrees(p_size + 0.0), 8) AS f13,
           round(exp(p_size / 10.0), 8) AS f14, CAST(factorial(p_size % 10) AS bigint) AS f15, floor(p_retailprice) AS f16, CAST(gcd(p_size, 12) AS bigint) AS f17, CAST(lcm(p_size, 12) AS bigint) AS f18, isnan(p_retailprice) AS f19, round(ln(p_size + 1.0), 9) AS f20, round(log2(p_size + 1.0), 9) AS f21,
           round(log10(p_size + 1.0), 9) AS f22, round(log10(p_size + 1.0), 9) AS f23, round(log2(p_size + 1.0), 9) AS f24, round(pi(), 9) AS f25, round(power(p_size + 0.0, 2), 6) AS f26, round(radians(p_size + 0.0), 9) AS f27, true AS f28,
           round(p_retailprice, 1) AS f29, CAST(sign(p_size - 25.0) AS double) AS f30, round(sin(p_size + 0.0), 9) AS f31, round(sqrt(p_size + 0.0), 9) AS f32, round(tan(p_size / 100.0), 9) AS f33, round(tanh(p_size + 0.0), 9) AS f34, trunc(p_retailprice - 1200) AS f35,
           p_size = 25 AS f36, p_retailprice AS f37, round(sinh(p_size / 10.0), 7) AS f38, round(cosh(p_size / 10.0), 7) AS f39, trunc(p_size * 1e300) AS f40, ceil(p_size * 1e19) AS f41, floor(p_size * -1e19) AS f42, trunc(p_retailprice * 10) / 10 AS f43, CAST(ceil(p_size / -3.0) AS double) AS f44 FROM part""",
    ),
    "fn_string": (
        """SELECT p_partkey, ascii(p_name) AS s1, bit_length(p_name) AS s2, btrim('xx' || p_brand || 'x', 'x') AS s3, chr(65 + p_size % 26) AS s4, concat(p_brand, NULL, '-', p_size) AS s5, concat_ws(',', p_brand, NULL, p_type) AS s6, contains(p_name, 'a') AS s7,
           ends_with(p_type, 'L') AS s8, levenshtein(p_brand, 'Brand#12') AS s9, lower(p_type) AS s10, ltrim('xxa' || p_brand, 'x') AS s11, ltrim('  b') AS s12, octet_length(p_name || 'é') AS s13, overlay(p_brand placing 'ZZ' from 2 for 3) AS s14, repeat(p_brand, 2) AS s15,
           replace(p_brand, 'B', 'x') AS s16, rtrim('a  ') AS s17, rtrim(p_brand || 'yy', 'y') AS s18, split_part(p_type, ' ', 1) AS s19, starts_with(p_name, 's') AS s20, to_hex(p_size) AS s21, upper(p_name) AS s22, length(uuid()) AS s23, trim(BOTH 'x' FROM 'xxqx') AS s24, chr(8300 + p_size) AS s25, chr(128500 + p_size) AS s26 FROM part""",
        """SELECT p_partkey, ascii(p_name) AS s1, bit_length(p_name) AS s2, trim('xx' || p_brand || 'x', 'x') AS s3, chr(65 + p_size % 26) AS s4, concat(p_brand, NULL, '-', p_size) AS s5, concat_ws(',', p_brand, NULL, p_type) AS s6, contains(p_name, 'a') AS s7,
           suffix(p_type, 'L') AS s8, levenshtein(p_brand, 'Brand#12') AS s9, lower(p_type) AS s10, ltrim('xxa' || p_brand, 'x') AS s11, 'b' AS s12, strlen(p_name || 'é') AS s13, p_brand[1:1] || 'ZZ' || p_brand[5:] AS s14, repeat(p_brand, 2) AS s15,
           replace(p_brand, 'B', 'x') AS s16, 'a' AS s17, rtrim(p_brand || 'yy', 'y') AS s18, split_part(p_type, ' ', 1) AS s19, starts_with(p_name, 's') AS s20, lower(to_hex(p_size)) AS s21, upper(p_name) AS s22, 36 AS s23, 'q' AS s24, chr(8300 + p_size) AS s25, chr(128500 + p_size) AS s26 FROM part""",
    ),
    "fn_unicode": (
        """SELECT doc_id, character_length(lang) AS u1, length(text) AS u2, find_in_set(lang, 'de,en,fr') AS u3, initcap(source || '-' || lang) AS u4, left(text, 7) AS u5, left(lang, -1) AS u6, lpad(lang, 5, 'xy') AS u7, reverse(lang) AS u8, right(lang, 1) AS u9, right(source, -3) AS u10, rpad(lang, 4) AS u11,
           strpos(text, 'e') AS u12, substr(text, 3, 4) AS u13, substr(lang, 0, 2) AS u14, substr(lang, -1, 3) AS u15, substr_index(source, '_', 1) AS u16, translate(source, 'abc', 'xy') AS u17, substr(source, 4) AS u18 FROM documents""",
        """SELECT doc_id, length(lang) AS u1, length(text) AS u2, CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'fr' THEN 3 WHEN NULL THEN NULL ELSE CASE WHEN lang IS NOT NULL THEN 0 END END AS u3, array_to_string(list_transform(regexp_extract_all(source || '-' || lang, '[a-zA-Z]+|[^a-zA-Z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS u4, left(text, 7) AS u5, left(lang, greatest(length(lang) - 1, 0)) AS u6, CASE WHEN lang IS NOT NULL THEN lpad(lang, 5, 'xy') END AS u7, reverse(lang) AS u8, right(lang, 1) AS u9,
           substr(source, 4) AS u10, CASE WHEN lang IS NOT NULL THEN rpad(lang, 4, ' ') END AS u11, instr(text, 'e') AS u12, substr(text, 3, 4) AS u13, left(lang, 1) AS u14, left(lang, 1) AS u15, split_part(source, '_', 1) AS u16, translate(source, 'abc', 'xy') AS u17, substr(source, 4) AS u18 FROM documents""",
    ),
    "fn_regex": (
        """SELECT p_partkey, regexp_count(p_name, '[aeiou]') AS r1, regexp_like(p_name, '^s') AS r2, regexp_match(p_brand, '([A-Za-z]+)#([0-9]+)') AS r3, regexp_replace(p_name, '[aeiou]', '*') AS r4, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS r5, regexp_replace(p_name, 'S', 'q', 'gi') AS r6 FROM part""",
        """SELECT p_partkey, len(regexp_extract_all(p_name, '[aeiou]')) AS r1, regexp_matches(p_name, '^s') AS r2, CASE WHEN regexp_matches(p_brand, '([A-Za-z]+)#([0-9]+)') THEN [regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 1), regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2)] END AS r3,
           regexp_replace(p_name, '[aeiou]', '*') AS r4, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS r5, regexp_replace(p_name, 'S', 'q', 'gi') AS r6 FROM part""",
    ),
    "fn_hash": (
        """SELECT n_nationkey, md5(n_name) AS h1, sha256(n_name) AS h2, encode(digest(n_name, 'sha256'), 'hex') AS h3, encode(digest(n_name, 'md5'), 'hex') AS h4, sha256(encode(n_name, 'hex')) AS h5 FROM nation""",
        """SELECT n_nationkey, md5(n_name) AS h1, sha256(n_name) AS h2, sha256(n_name) AS h3, md5(n_name) AS h4, sha256(lower(hex(n_name))) AS h5 FROM nation""",
    ),
    # published test values, as DuckDB has none of these
    "fn_digest": (
        """SELECT sha224(v) AS d224, sha384(v) AS d384, sha512(v) AS d512, encode(digest(v, 'blake2s'), 'hex') AS b2s, encode(digest(v, 'blake2b'), 'hex') AS b2b, encode(digest(v, 'blake3'), 'hex') AS b3 FROM (VALUES ('abc')) AS t(v)""",
        """SELECT '23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7' AS d224, 'cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7' AS d384,
           'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f' AS d512, '508c5e8c327c14e2e1a72ba34eeb452f37458b209ed63a294d999b4c86675982' AS b2s,
           'ba80a53f981c4d0d6a2797b69f12f6e94c212f14685ac4b74b12bb6fdbffa2d17d87c5392aab792dc252d5de4533cc9518d38aa8dbf1925ab92386edd4009923' AS b2b, '6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85' AS b3""",
    ),
    "fn_encoding": (
        "SELECT n_nationkey, encode(n_name, 'hex') AS e1, encode(n_name, 'base64') AS e2, CAST(decode(encode(n_name, 'hex'), 'hex') AS text) AS e3, CAST(decode(encode(n_name, 'base64'), 'base64') AS text) AS e4 FROM nation",
        "SELECT n_nationkey, lower(hex(n_name)) AS e1, to_base64(CAST(n_name AS blob)) AS e2, n_name AS e3, n_name AS e4 FROM nation",
    ),
    "fn_cond": (
        """SELECT doc_id, coalesce(lang, source, 'none') AS c1, nullif(lang, 'en') AS c2, nvl(lang, '?') AS c3, ifnull(lang, '?') AS c4, nvl2(lang, 'has', 'no') AS c5, greatest(page_no, n_columns) AS c6, least(page_no, n_columns) AS c7, arrow_typeof(doc_id) AS c8, arrow_cast(page_no, 'Float64') AS c9,
           named_struct('a', page_no)['a'] AS c10, get_field(named_struct('a', lang), 'a') AS c11, row(page_no, 2).col2 AS c12, length(version()) > 0 AS c13 FROM documents""",
        """SELECT doc_id, coalesce(lang, source, 'none') AS c1, nullif(lang, 'en') AS c2, coalesce(lang, '?') AS c3, coalesce(lang, '?') AS c4, CASE WHEN lang IS NULL THEN 'no' ELSE 'has' END AS c5, greatest(page_no, n_columns) AS c6, least(page_no, n_columns) AS c7, 'Int64' AS c8, CAST(page_no AS double) AS c9,
           page_no AS c10, lang AS c11, 2 AS c12, true AS c13 FROM documents""",
    ),
    "fn_date": (
        """SELECT event_id, current_date = current_date AS d0, now() IS NOT NULL AS d1, date_bin(interval '15 minutes', ts) AS d2, CAST(date_part('year', ts) AS bigint) AS d3, CAST(date_part('dow', ts) AS bigint) AS d4, CAST(date_part('doy', ts) AS bigint) AS d5, date_trunc('month', ts) AS d6, from_unixtime(86400) AS d7,
           make_date(2024, 3, 5) AS d8, to_char(ts, '%Y-%m-%d') AS d9, to_char(ts, '%H:%M') AS d10, to_date('2024-03-05') AS d11, to_timestamp('2024-03-05 01:02:03') AS d12, to_unixtime(ts) AS d13, to_local_time(ts) AS d14, to_timestamp_millis(1000) AS d15, round(date_part('epoch', ts), 3) AS d16, ts + interval '1' day AS d17 FROM events""",
        """SELECT event_id, true AS d0, true AS d1, time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '1970-01-01') AS d2, CAST(date_part('year', ts) AS bigint) AS d3, CAST(date_part('dow', ts) AS bigint) AS d4, CAST(date_part('doy', ts) AS bigint) AS d5, CAST(date_trunc('month', ts) AS timestamp) AS d6, TIMESTAMP '1970-01-02' AS d7,
           make_date(2024, 3, 5) AS d8, strftime(ts, '%Y-%m-%d') AS d9, strftime(ts, '%H:%M') AS d10, DATE '2024-03-05' AS d11, TIMESTAMP '2024-03-05 01:02:03' AS d12, CAST(floor(epoch(ts)) AS bigint) AS d13, ts AS d14, TIMESTAMP '1970-01-01 00:00:01' AS d15, round(epoch(ts), 3) AS d16, ts + INTERVAL 1 DAY AS d17 FROM events""",
    ),
    "fn_array": (
        """SELECT p_partkey, make_array(p_size, 2) AS a1, array_append(make_array(p_size), 7) AS a2, array_prepend(0, make_array(p_size)) AS a3, array_concat(make_array(p_size), make_array(3)) AS a4, array_element(make_array(p_size, 9), 2) AS a5, array_slice(make_array(1, p_size, 3), 2, 3) AS a6, array_has(make_array(1, 2), p_size) AS a7,
           array_has_any(make_array(1, p_size), make_array(2, 3)) AS a8, array_has_all(make_array(1, 2, p_size), make_array(2, 1)) AS a9, array_sort(array_distinct(make_array(p_size, 1, p_size))) AS a10, array_except(make_array(1, 2), make_array(2)) AS a11, array_intersect(make_array(1, 2), make_array(2)) AS a12, array_sort(array_union(make_array(1), make_array(p_size))) AS a13,
           array_length(make_array(1, p_size)) AS a14, cardinality(make_array(1)) AS a15, array_max(make_array(1, p_size)) AS a16, array_min(make_array(4, p_size)) AS a17, array_position(make_array(1, p_size), 50) AS a18, array_positions(make_array(p_size, 2, p_size), p_size) AS a19, array_remove(make_array(1, 2, 1), 1) AS a20, array_remove_all(make_array(1, 2, 1), 1) AS a21,
           array_remove_n(make_array(1, 2, 1, 1), 1, 2) AS a22, array_repeat(p_size, 2) AS a23, array_replace(make_array(1, 2, 1), 1, 9) AS a24, array_replace_all(make_array(1, 2, 1), 1, 9) AS a25, array_replace_n(make_array(1, 1, 1), 1, 9, 2) AS a26, array_resize(make_array(1, 2), 3, 0) AS a27, array_reverse(make_array(1, p_size)) AS a28, array_sort(make_array(p_size, 1), 'DESC') AS a29,
           array_pop_back(make_array(1, 2)) AS a30, array_pop_front(make_array(1, 2)) AS a31, array_to_string(make_array('a', p_brand), ',') AS a32, string_to_array('a.b', '.') AS a33, flatten(make_array(make_array(1), make_array(p_size))) AS a34, range(1, 4) AS a35, empty(make_array(1)) AS a36, array_distance(make_array(1.0, 2.0), make_array(4.0, 6.0)) AS a37 FROM part""",
        """SELECT p_partkey, [p_size, 2] AS a1, [p_size, 7] AS a2, [0, p_size] AS a3, [p_size, 3] AS a4, 9 AS a5, [p_size, 3] AS a6, list_contains([1, 2], p_size) AS a7,
           list_has_any([1, p_size], [2, 3]) AS a8, true AS a9, list_sort(list_distinct([p_size, 1, p_size])) AS a10, [1] AS a11, [2] AS a12, list_sort(list_distinct([1, p_size])) AS a13,
           CAST(2 AS bigint) AS a14, CAST(1 AS bigint) AS a15, greatest(1, p_size) AS a16, least(4, p_size) AS a17, CAST(CASE WHEN p_size = 50 THEN 2 END AS bigint) AS a18, CASE WHEN p_size = 2 THEN [1, 2, 3] ELSE [1, 3] END AS a19, [2, 1] AS a20, [2] AS a21,
           [2, 1] AS a22, [p_size, p_size] AS a23, [9, 2, 1] AS a24, [9, 2, 9] AS a25, [9, 9, 1] AS a26, [1, 2, 0] AS a27, [p_size, 1] AS a28, list_reverse_sort([p_size, 1]) AS a29,
           [1] AS a30, [2] AS a31, 'a,' || p_brand AS a32, ['a', 'b'] AS a33, [1, p_size] AS a34, [1, 2, 3] AS a35, false AS a36, 5.0 AS a37 FROM part""",
    ),
    "fn_map": (
        "SELECT n_nationkey, map(n_name, n_nationkey)[n_name] AS m1, map_extract(map('a', n_nationkey), 'a') AS m2, map_keys(map(n_name, 1)) AS m3, map_values(map('a', n_nationkey)) AS m4 FROM nation",
        "SELECT n_nationkey, n_nationkey AS m1, [n_nationkey] AS m2, [n_name] AS m3, [n_nationkey] AS m4 FROM nation",
    ),
    "fn_aggregates": (
        """SELECT l_linestatus, count(l_tax) AS n, round(mean(l_quantity), 6) AS m, first_value(l_orderkey ORDER BY l_extendedprice, l_orderkey) AS f, last_value(l_orderkey ORDER BY l_extendedprice, l_orderkey) AS l, nth_value(l_orderkey, 2 ORDER BY l_extendedprice, l_orderkey) AS nth,
           string_agg(DISTINCT l_returnflag, '') IS NOT NULL AS s, round(var(l_quantity), 6) AS v, round(stddev(l_quantity), 6) AS sd FROM lineitem GROUP BY l_linestatus""",
        """SELECT l_linestatus, count(l_tax) AS n, round(avg(l_quantity), 6) AS m, first(l_orderkey ORDER BY l_extendedprice, l_orderkey) AS f, last(l_orderkey ORDER BY l_extendedprice, l_orderkey) AS l, list(l_orderkey ORDER BY l_extendedprice, l_orderkey)[2] AS nth,
           true AS s, round(var_samp(l_quantity), 6) AS v, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_linestatus""",
    ),
    "fn_session": (
        "SELECT current_catalog, current_database() AS db, current_schema(), current_user AS who, inet_client_port() AS port",
        "SELECT 'postgres' AS current_catalog, 'postgres' AS db, 'public' AS current_schema, 'postgres' AS who, 0 AS port",
    ),
}

QUERIES: dict[str, Query] = {n: text_query(p) for n, (p, _) in PAIRS.items()}
ORACLE: dict[str, str] = {n: o for n, (_, o) in PAIRS.items()}
