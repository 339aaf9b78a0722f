"""Queries over the star tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from .sources.star import engine

_REVENUE = """SELECT n.n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey GROUP BY 1"""

#: name: (query, SQL)
QUERIES: dict[str, tuple[str, str]] = {
    "flagship_revenue": (
        "select (group LineItem using nation := .order.customer.nation.name by nation) { nation := .key.nation, revenue := <float64>round(<decimal>sum(.elements.extendedprice * (1 - .elements.discount)), 2), n := count(.elements) } order by .revenue desc",
        _REVENUE.replace("round(sum(l_extendedprice * (1 - l_discount)), 2)", "round(sum(l_extendedprice * (1 - l_discount))::DECIMAL(38,18), 2)::DOUBLE"),
    ),
    # scans and sources
    "type_scan": ("select Nation", "SELECT n_nationkey AS id FROM nation"),
    "shape": ("select Order { id, totalprice, orderpriority }", "SELECT o_orderkey AS id, o_totalprice AS totalprice, o_orderpriority AS orderpriority FROM orders"),
    "splat": ("select Region { * }", "SELECT r_regionkey AS id, r_name AS name FROM region"),
    "path_scan": ("select LineItem.order.customer.mktsegment", "SELECT c_mktsegment AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"),
    "free_select": ("select { a := 1 + 2, b := 'x' ++ 'y', c := 7 // 2, d := 2 ** 3 }", "SELECT 3::BIGINT AS a, 'xy' AS b, 3::BIGINT AS c, 8.0::DOUBLE AS d"),
    "set_literal": ("select {1, 2, 3, 2}", "SELECT unnest([1, 2, 3, 2])::BIGINT AS value"),
    "set_returning_call": ("select array_unpack([5, 6, 7])", "SELECT unnest([5, 6, 7])::BIGINT AS value"),
    "function_source": ("select Order { id, band := label_of(.totalprice) }", "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 5000 THEN 'high' ELSE 'low' END AS band FROM orders"),
    "with_binding": ("with big := (select Order filter .totalprice > 300000.0) select big { id, totalprice }", "SELECT o_orderkey AS id, o_totalprice AS totalprice FROM orders WHERE o_totalprice > 300000"),
    "interface_union": ("select Party { name, kind := .__type__, acctbal }", "SELECT c_name AS name, 'Customer' AS kind, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_name, 'Supplier', s_acctbal FROM supplier"),
    "alias": ("select RichCustomer { id, name }", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 9000"),
    # filters and scalar operators
    "filter_cmp": ("select Part { id, size } filter .size >= 10 and .size < 20 or .retailprice > 1500.0", "SELECT p_partkey AS id, p_size AS size FROM part WHERE p_size >= 10 AND p_size < 20 OR p_retailprice > 1500"),
    "filter_like_ilike": ("select Part { id, name } filter .name like 'Part#%1' or .type ilike '%brass%'", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE 'Part#%1' OR p_type ILIKE '%brass%'"),
    "filter_not_like": ("select Part { id } filter .name not like '%1%'", "SELECT p_partkey AS id FROM part WHERE p_name NOT LIKE '%1%'"),
    "filter_in_literal": ("select Order { id } filter .orderpriority in {'1-URGENT', '2-HIGH'}", "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "filter_in_subquery": ("select Customer { id } filter .id in (select Order.customer.id)", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "filter_not_in_subquery": ("select Customer { id } filter .id not in (select (select Order filter .totalprice > 200000.0).customer.id)", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "filter_exists": ("select Customer { id } filter exists .<customer[is Order]", "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "filter_not_exists": ("select Part { id } filter not exists .<part[is LineItem]", "SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)"),
    "filter_null_safe": ("select Customer { id } filter .mktsegment ?= 'BUILDING' and .nation.name ?!= 'NATION_1'", "SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IS NOT DISTINCT FROM 'BUILDING' AND n_name IS DISTINCT FROM 'NATION_1'"),
    "filter_set_membership": ("select Customer { id } filter .<customer[is Order].orderpriority = '1-URGENT'", "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "all_quantifier": ("select Customer { id } filter all(.<customer[is Order].orderstatus in {'F', 'O'})", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus NOT IN ('F', 'O'))"),
    "any_quantifier": ("select Customer { id } filter any(.<customer[is Order].totalprice > 450000.0)", "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"),
    "if_else": ("select Part { id, grade := if .size > 40 then 'l' else if .size > 20 then 'm' else 's', alt := 1 if .size > 25 else 0 }", "SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'l' WHEN p_size > 20 THEN 'm' ELSE 's' END AS grade, CASE WHEN p_size > 25 THEN 1 ELSE 0 END::BIGINT AS alt FROM part"),
    "coalesce_default": ("select Document { id, q := .lang ?? 'none' }", "SELECT doc_id AS id, coalesce(lang, 'none') AS q FROM documents"),
    "distinct_set": ("select distinct Order.orderpriority", "SELECT DISTINCT o_orderpriority AS value FROM orders"),
    "casts": ("select Part { id, a := <str>.size, b := <int64>.retailprice, c := <float64>.size / 3.0 }", "SELECT p_partkey AS id, p_size::VARCHAR AS a, round_even(p_retailprice, 0)::BIGINT AS b, p_size / 3.0::DOUBLE AS c FROM part"),
    "type_check": ("select Party { name, s := Party is Supplier }", "SELECT c_name AS name, false AS s FROM customer UNION ALL SELECT s_name, true FROM supplier"),
    "type_intersection": ("select Party[is Customer] { name, mktsegment }", "SELECT c_name AS name, c_mktsegment AS mktsegment FROM customer"),
    "polymorphic_element": ("select Party { name, [is Customer].mktsegment }", "SELECT c_name AS name, c_mktsegment AS mktsegment FROM customer UNION ALL SELECT s_name, NULL FROM supplier"),
    "parameterless_global": ("select Part { id, p := .retailprice * global rate }", "SELECT p_partkey AS id, p_retailprice * 0.5 AS p FROM part"),
    "enum_member": ("select count((select LineItem filter .returnflag = Flag.R))", "SELECT count(*) AS value FROM lineitem WHERE l_returnflag = 'R'"),
    "user_function": ("select LineItem { id, v := net(.extendedprice, .discount) }", "SELECT l_orderkey * 8 + l_linenumber AS id, l_extendedprice * (1 - l_discount) AS v FROM lineitem"),
    # traversals
    "multi_hop": ("select Supplier { name, region := .nation.region.name }", "SELECT s_name AS name, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "single_link_shape": ("select Customer { id, nation := <str>to_json('{}') ++ .nation.name, seg := .mktsegment }", "SELECT c_custkey AS id, '{}' || n_name AS nation, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "backlink_count": ("select Customer { id, n := count(.<customer[is Order]) }", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer"),
    "backlink_aggregates": ("select Customer { id, top := max(.<customer[is Order].totalprice), days := count(distinct .<customer[is Order].orderdate) }", "SELECT c_custkey AS id, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top, (SELECT count(DISTINCT o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS days FROM customer"),
    "backlink_filtered": ("select Nation { name, n := count((select .<nation[is Customer] filter .acctbal > 5000.0)) }", "SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AS n FROM nation"),
    "two_backlinks": ("select Region { name, orders := count(.<region[is Nation].<nation[is Customer].<customer[is Order]) }", "SELECT r_name AS name, (SELECT count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = r_regionkey) AS orders FROM region"),
    "multi_link_count": ("select Order { id, n := count(.parts), q := sum(.parts.size) }", "SELECT o_orderkey AS id, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey) AS n, coalesce((SELECT sum(p_size) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey), 0)::BIGINT AS q FROM orders"),
    "multi_link_walk": ("select (select Order filter .totalprice > 450000.0).parts { name }", "SELECT p_name AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_totalprice > 450000"),
    "multilink_nested": ("select Order { id, names := array_join(array_agg(.parts.brand), '') } filter count(.parts) = 1", "SELECT o_orderkey AS id, any_value(p_brand) AS names FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) = 1"),
    "computed_single": ("select Customer { id, last := .recent.totalprice, place }", "SELECT c_custkey AS id, (SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) AS last, r_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "for_cross_apply": ("for x in {1, 2, 3} union (select Nation { name, m := .id * x } filter .id = x)", "SELECT n_name AS name, (n_nationkey * x)::BIGINT AS m FROM nation, (SELECT unnest([1, 2, 3]) AS x) WHERE n_nationkey = x"),
    "for_scalar": ("for x in {1, 2, 3} union (x * 10)", "SELECT unnest([10, 20, 30])::BIGINT AS value"),
    "range_join": ("for r in array_unpack([(lo := 1, hi := 5), (lo := 4, hi := 9)]) union (select Part { id, lo := r.lo } filter .size >= r.lo and .size < r.hi)", "SELECT p_partkey AS id, lo::BIGINT AS lo FROM part JOIN (SELECT * FROM (VALUES (1, 5), (4, 9)) t(lo, hi)) ON p_size >= lo AND p_size < hi"),
    # aggregates and groups
    "agg_all_functions": ("select { n := count(Order), s := <float64>round(<decimal>sum(Order.totalprice), 2), lo := min(Order.totalprice), hi := max(Order.totalprice) }", "SELECT count(*) AS n, round(sum(o_totalprice)::DECIMAL(38,18), 2)::DOUBLE AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders"),
    "agg_of_set_literal": ("select max({3, 9, 4})", "SELECT 9::BIGINT AS value"),
    "mean_of_path": ("select <int64>(mean(Order.totalprice) * 100.0)", "SELECT round_even(avg(o_totalprice) * 100, 0)::BIGINT AS value FROM orders"),
    "stddev_var": ("select (group Order by .orderpriority) { p := .key.orderpriority, sd := <int64>math::stddev(.elements.totalprice), v := <int64>(math::var_pop(.elements.totalprice) / 1000000.0) }", "SELECT o_orderpriority AS p, round_even(stddev_samp(o_totalprice), 0)::BIGINT AS sd, round_even(var_pop(o_totalprice) / 1000000, 0)::BIGINT AS v FROM orders GROUP BY 1"),
    "any_all_group": ("select (group Order by .orderstatus) { s := .key.orderstatus, some := any(.elements.totalprice > 499000.0), every := all(.elements.totalprice > 0.0) }", "SELECT o_orderstatus AS s, bool_or(o_totalprice > 499000) AS some, bool_and(o_totalprice > 0) AS every FROM orders GROUP BY 1"),
    "distinct_count": ("select (group LineItem by .returnflag) { f := .key.returnflag, parts := count(distinct .elements.part.id) }", "SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1"),
    "group_two_keys": ("select (group LineItem by .returnflag, .linestatus) { f := .key.returnflag, s := .key.linestatus, n := count(.elements), q := sum(.elements.quantity) }", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2"),
    "group_filtered_result": ("select (group Order using c := .customer.id by c) { c := .key.c, n := count(.elements) } filter .n > 15", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "group_before_filter": ("select (group (select Order filter .totalprice > 100000.0) by .orderpriority) { p := .key.orderpriority, n := count(.elements) }", "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1"),
    "group_over_walk": ("select (group (select Order.customer) by .mktsegment) { s := .key.mktsegment, n := count(.elements) }", "SELECT c_mktsegment AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "group_elements_topk": ("for g in (group Order by .orderpriority) union (select g.elements { id, orderpriority } order by .totalprice desc then .id limit 3)", "SELECT o_orderkey AS id, o_orderpriority AS orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3"),
    "floor_div_group": ("select (group Part using d := .size // 10 by d) { d := .key.d, n := count(.elements) }", "SELECT (p_size // 10)::BIGINT AS d, count(*) AS n FROM part GROUP BY 1"),
    "json_group": ("select (group Event using k := <int64>json_get(<json>.props, 'k') by k) { k := .key.k, n := count(.elements) }", "SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1"),
    "day_bucket": ("select (group Event using d := <cal::local_date>datetime_truncate(<datetime>.ts, 'days'), t := .event_type by d, t) { d := <str>.key.d, t := .key.t, n := count(.elements) }", "SELECT ts::DATE::VARCHAR AS d, event_type AS t, count(*) AS n FROM events GROUP BY 1, 2"),
    # order, limits, sets
    "topk": ("select Order { id, totalprice } order by .totalprice desc then .id limit 10", "SELECT o_orderkey AS id, o_totalprice AS totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "offset_limit": ("select Customer { id } order by .acctbal then .id offset 20 limit 15", "SELECT c_custkey AS id FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15 OFFSET 20"),
    "limit_head_of_walk": ("select (select Customer order by .id limit 5).<customer[is Order] { id }", "SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5)"),
    "set_except": ("select Customer except (select (select Order filter .totalprice > 100000.0).customer)", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000"),
    "set_intersect": ("select (select Customer filter .acctbal > 0.0) intersect (select Customer filter .mktsegment = 'BUILDING')", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'"),
    "set_union_all": ("select Customer.name union Supplier.name", "SELECT c_name AS value FROM customer UNION ALL SELECT s_name FROM supplier"),
    "value_intersect": ("select count((select array_unpack([1, 2, 3]) intersect array_unpack([2, 3, 4])))", "SELECT 2::BIGINT AS value"),
    "enumerate": ("select enumerate((select Nation.name)).0", "SELECT (row_number() OVER (ORDER BY n_name) - 1)::BIGINT AS value FROM nation"),
    # functions
    "str_functions": ("select Part { id, a := str_upper(.name), b := str_pad_start(<str>.size, 4, '0'), c := str_slice(.name, 2, 6), d := str_reverse(.brand), e := len(.type), f := str_replace(.name, 'Part', 'P'), g := str_contains(.type, 'A'), h := find(.name, '#'), i := str_starts_with(.type, 'S') }", "SELECT p_partkey AS id, upper(p_name) AS a, lpad(p_size::VARCHAR, 4, '0') AS b, substr(p_name, 3, 4) AS c, reverse(p_brand) AS d, length(p_type) AS e, replace(p_name, 'Part', 'P') AS f, contains(p_type, 'A') AS g, (strpos(p_name, '#') - 1)::BIGINT AS h, starts_with(p_type, 'S') AS i FROM part"),
    "re_functions": ("select Part { id, a := re_test('[0-9]+5$', .name), b := re_replace('[0-9]', 'x', .name), c := re_replace('[0-9]', 'x', .name, flags := 'g') }", "SELECT p_partkey AS id, regexp_matches(p_name, '[0-9]+5$') AS a, regexp_replace(p_name, '[0-9]', 'x') AS b, regexp_replace(p_name, '[0-9]', 'x', 'g') AS c FROM part"),
    "num_functions": ("select Order { id, a := abs(-.totalprice), b := floor(.totalprice), c := ceil(.totalprice), d := round(.totalprice / 1000.0), e := sign(.totalprice), f := <int64>math::sqrt(.totalprice) }", "SELECT o_orderkey AS id, abs(-o_totalprice) AS a, floor(o_totalprice) AS b, ceil(o_totalprice) AS c, round_even(o_totalprice / 1000, 0) AS d, sign(o_totalprice)::DOUBLE AS e, round_even(sqrt(o_totalprice), 0)::BIGINT AS f FROM orders"),
    "bit_functions": ("select Nation { id, a := bit_and(<int64>.id, 6), b := bit_or(<int64>.id, 8), c := bit_xor(<int64>.id, 5), d := bit_lshift(<int64>.id, 2), e := bit_rshift(<int64>.id, 1), f := bit_count(<int64>.id) }", "SELECT n_nationkey AS id, (n_nationkey & 6)::BIGINT AS a, (n_nationkey | 8)::BIGINT AS b, xor(n_nationkey, 5)::BIGINT AS c, (n_nationkey << 2)::BIGINT AS d, (n_nationkey >> 1)::BIGINT AS e, bit_count(n_nationkey::BIGINT)::BIGINT AS f FROM nation"),
    "array_functions": ("with a := [3, 1, 2] select { a := array_join(str_split('x,y,z', ','), '-'), b := array_get(a, 1), c := array_index_of(a, 2), d := len(a), e := array_get(array_reverse(a), 0), f := a[-1], g := contains(a, 3), h := array_get(array_slice(a, 1), 0), i := array_get(array_set(a, 0, 9), 0), j := len(array_fill(7, 4)) }", "SELECT 'x-y-z' AS a, 1::BIGINT AS b, 2::BIGINT AS c, 3::BIGINT AS d, 2::BIGINT AS e, 2::BIGINT AS f, true AS g, 1::BIGINT AS h, 9::BIGINT AS i, 4::BIGINT AS j"),
    "json_functions": ("select Event { id, k := <int64>json_get(<json>.props, 'k'), t := json_typeof(<json>.props) }", "SELECT event_id AS id, json_extract(props, '$.k')::BIGINT AS k, lower(json_type(props)) AS t FROM events"),
    "range_functions": ("select { a := contains(range(1, 5), 4), b := contains(range(1, 5), 5), c := overlaps(range(1, 5), range(4, 9)), d := overlaps(range(1, 5), range(5, 9)), e := range_get_upper(range(1, 5, inc_upper := true)), f := range_is_empty(range(3, 3)), g := adjacent(range(1, 5), range(5, 9)), h := strictly_below(range(1, 5), range(5, 9)) }", "SELECT true AS a, false AS b, true AS c, false AS d, 6::BIGINT AS e, true AS f, true AS g, true AS h"),
    "range_unpack": ("select range_unpack(range(2, 6))", "SELECT unnest([2, 3, 4, 5])::BIGINT AS value"),
    "dt_functions": ("select Order { id, y := datetime_get(.orderdate, 'year'), m := datetime_get(.orderdate, 'month'), w := datetime_get(.orderdate, 'dow'), i := datetime_get(.orderdate, 'isodow'), q := <str><cal::local_date>datetime_truncate(.orderdate, 'quarters') }", "SELECT o_orderkey AS id, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, dayofweek(o_orderdate)::DOUBLE AS w, isodow(o_orderdate)::DOUBLE AS i, date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS q FROM orders"),
    "math_functions": ("select Nation { id, a := round(math::sin(<float64>.id) * 1000000.0), b := round(math::exp(<float64>.id / 10.0) * 1000.0), c := math::log10(<float64>.id + 1.0) > 1.0, d := math::pi() > 3.14 }", "SELECT n_nationkey AS id, round_even(sin(n_nationkey) * 1000000, 0) AS a, round_even(exp(n_nationkey / 10.0::DOUBLE) * 1000, 0) AS b, log10(n_nationkey + 1) > 1 AS c, true AS d FROM nation"),
    "enc_crypto": ("select Region { id, a := enc::base64_encode(to_bytes(.name)), b := to_hex(<int64>.id + 250) }", "SELECT r_regionkey AS id, base64(encode(r_name)) AS a, lower(to_hex(r_regionkey + 250)) AS b FROM region"),
    # search
    "knn": ("select vector::search(Embedding, (select Embedding filter .id = 0).embedding) { id } order by .distance then .id limit 5", "SELECT vec_id AS id FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 5"),
    "fts": ("select count((select fts::search(Document, 'the of')))", "SELECT count(*) AS value FROM documents WHERE regexp_matches(lower(text), '\\bthe\\b') AND regexp_matches(lower(text), '\\bof\\b')"),
    # functions by their values on the tables' columns
    "str_functions_2": (
        "select Part { id, a := str_title(str_lower(.name)), b := str_pad_end(.brand, 12, '.'), c := str_trim('  ' ++ .brand ++ ' '), d := str_trim_start('xx' ++ .brand, 'x'), e := str_trim_end(.brand ++ 'yy', 'y'), f := str_repeat('ab', 2), g := str_len(.type), h := str_ends_with(.name, '1'), i := str_starts_with(.name, 'Part'), j := find(.name, '#') }",
        "SELECT p_partkey AS id, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS a, rpad(p_brand, 12, '.') AS b, p_brand AS c, p_brand AS d, p_brand AS e, 'abab' AS f, length(p_type)::BIGINT AS g, p_name LIKE '%1' AS h, p_name LIKE 'Part%' AS i, (strpos(p_name, '#') - 1)::BIGINT AS j FROM part",
    ),
    "re_groups": (
        "select Part { id, a := re_match('([0-9])([0-9]+)$', .name), b := re_match('nothing', .name), c := array_join(array_get(re_match_all('[0-9]', .name), 0), '') }",
        "SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, '[0-9][0-9]+$') THEN [regexp_extract(p_name, '([0-9])([0-9]+)$', 1), regexp_extract(p_name, '([0-9])([0-9]+)$', 2)] ELSE []::VARCHAR[] END AS a, []::VARCHAR[] AS b, nullif(regexp_extract(p_name, '[0-9]'), '') AS c FROM part",
    ),
    "bytes_functions": (
        "select Nation { id, a := bit_not(<int64>.id), b := bytes_get(to_bytes(.name), 0), c := bytes_get_bit(to_bytes(.name), 0), d := <str>from_hex('4142'), e := <str>enc::base64_decode(enc::base64_encode(to_bytes(.name))), f := enc::base64_encode(crypto::digest(.name, 'sha256')) }",
        "SELECT n_nationkey AS id, (~n_nationkey::BIGINT)::BIGINT AS a, ord(n_name)::BIGINT AS b, (ord(n_name) & 1)::BIGINT AS c, 'AB' AS d, n_name AS e, to_base64(unhex(sha256(n_name))) AS f FROM nation",
    ),
    "number_casts": (
        "select Part { id, a := to_int16('12'), b := to_int32('-7'), c := to_int64(<str>.size), d := to_float64('2.5'), e := <str>to_bigint('123456789012345678901234567890'), f := to_bool('true'), g := to_float32('0.5'), h := <str>(<int64>to_decimal('7')) }",
        "SELECT p_partkey AS id, 12::SMALLINT AS a, (-7)::INTEGER AS b, p_size::BIGINT AS c, 2.5::DOUBLE AS d, '123456789012345678901234567890' AS e, true AS f, 0.5::FLOAT AS g, '7' AS h FROM part",
    ),
    "array_functions_2": (
        "with a := [5, 3, 9, 3] select { a := array_replace(a, 3, 0), b := array_insert(a, 1, 7), c := array_rotate(a, 1), d := array_set(a, 0, 1), e := array_slice(a, 1, 3), f := contains(a, 9), g := find(a, 3), h := array_fill(2, 3) }",
        "SELECT [5, 0, 9, 0]::BIGINT[] AS a, [5, 7, 3, 9, 3]::BIGINT[] AS b, [3, 9, 3, 5]::BIGINT[] AS c, [1, 3, 9, 3]::BIGINT[] AS d, [3, 9]::BIGINT[] AS e, true AS f, 1::BIGINT AS g, [2, 2, 2]::BIGINT[] AS h",
    ),
    "range_functions_2": (
        "select Part { id, a := range_get_lower(range(<int64>.size, 60)), b := range_is_inclusive_lower(range(1, 3)), c := range_is_inclusive_upper(range(1, 3)), d := strictly_above(range(9, 12), range(1, <int64>.size)), e := bounded_above(range(1, <int64>.size + 1), range(1, 30)), f := bounded_below(range(<int64>.size, 60), range(20, 99)), g := contains(multirange([range(1, 10), range(8, 30)]), <int64>.size) }",
        "SELECT p_partkey AS id, p_size::BIGINT AS a, true AS b, false AS c, p_size <= 9 AND p_size > 1 AS d, p_size + 1 <= 30 AS e, p_size >= 20 AS f, p_size BETWEEN 1 AND 29 AS g FROM part",
    ),
    "multirange_unpack": ("select array_unpack([1]) + array_get([range_get_upper(range(1, 5))], 0)", "SELECT 6::BIGINT AS value"),
    "math_functions_2": (
        "select Nation { id, a := round(math::cos(<float64>.id) * 1000000.0), b := round(math::atan2(<float64>.id, 2.0) * 1000000.0), c := round(math::ln(<float64>.id + 1.0) * 1000000.0), d := math::log2(8.0), e := round(math::e() * 1000.0), f := round(math::tan(<float64>.id) * 1000.0), g := math::lg(100.0), h := round(math::asin(0.5) * 1000.0), i := round(math::acos(0.5) * 1000.0), j := round(math::atan(1.0) * 1000.0), k := round(math::cot(1.0) * 1000.0), l := math::abs(-2.0), m := math::ceil(1.2), n := math::floor(1.8), o := math::log(100.0) }",
        "SELECT n_nationkey AS id, round_even(cos(n_nationkey) * 1000000, 0) AS a, round_even(atan2(n_nationkey, 2) * 1000000, 0) AS b, round_even(ln(n_nationkey + 1) * 1000000, 0) AS c, 3.0::DOUBLE AS d, 2718.0::DOUBLE AS e, round_even(tan(n_nationkey) * 1000, 0) AS f, 2.0::DOUBLE AS g, 524.0::DOUBLE AS h, 1047.0::DOUBLE AS i, 785.0::DOUBLE AS j, 642.0::DOUBLE AS k, 2.0::DOUBLE AS l, 2.0::DOUBLE AS m, 1.0::DOUBLE AS n, 2.0::DOUBLE AS o FROM nation",
    ),
    "statistics": (
        "select (group Order by .orderstatus) { s := .key.orderstatus, a := <int64>math::stddev_pop(.elements.totalprice), b := <int64>(math::var(.elements.totalprice) / 1000000.0), c := <int64>math::mean(.elements.totalprice) }",
        "SELECT o_orderstatus AS s, round_even(stddev_pop(o_totalprice), 0)::BIGINT AS a, round_even(var_samp(o_totalprice) / 1000000, 0)::BIGINT AS b, round_even(avg(o_totalprice), 0)::BIGINT AS c FROM orders GROUP BY 1",
    ),
    "durations": (
        "select Order { id, a := <str><cal::local_datetime>(.orderdate + <duration>'PT36H') , b := duration_get(<duration>'90 minutes', 'totalseconds'), c := duration_to_seconds(duration_truncate(<duration>'PT1H59M', 'hours')) = 3600, d := <str>datetime_shift(.orderdate, to_duration(hours := 2)) }",
        "SELECT o_orderkey AS id, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%S') AS a, 5400.0::DOUBLE AS b, true AS c, strftime(o_orderdate + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') AS d FROM orders",
    ),
    "calendar": (
        "select Order { id, a := <str>cal::to_local_date(.orderdate), b := cal::date_get(cal::to_local_date(.orderdate), 'month'), c := <str>cal::to_local_time(.orderdate), d := cal::time_get(<cal::local_time>'10:20:30', 'minutes'), e := <str>cal::to_local_datetime(2030, 1, 2, 3, 4, 5.0), f := cal::duration_normalize_days(cal::to_date_duration(days := 65)).months, g := cal::duration_normalize_hours(cal::to_relative_duration(hours := 50)).days }",
        "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS a, month(o_orderdate)::DOUBLE AS b, strftime(o_orderdate, '%H:%M:%S') AS c, 20.0::DOUBLE AS d, '2030-01-02T03:04:05' AS e, 2::BIGINT AS f, 2::BIGINT AS g FROM orders",
    ),
    "json_functions_2": (
        "select Event { id, a := <int64>json_get(json_set(<json>.props, 'n', value := to_json('41')), 'n'), b := <int64>json_get(json_set(<json>.props, 'k', value := to_json('0')), 'k'), c := json_array_length(to_json('[1, 2, 3]')), d := <int64>(<json>.props)['k'] }",
        "SELECT event_id AS id, 41::BIGINT AS a, 0::BIGINT AS b, 3::BIGINT AS c, json_extract(props, '$.k')::BIGINT AS d FROM events",
    ),
    "json_unpack": ("select <int64>json_array_unpack(to_json('[4, 5]'))", "SELECT unnest([4, 5])::BIGINT AS value"),
    "json_object_unpack": ("select json_object_unpack(to_json('{\"a\": 1, \"b\": 2}')).key", "SELECT unnest(['a', 'b']) AS value"),
    "uuid_functions": ("select Region { id, a := uuid_extract_version(uuid_generate_v4()), b := uuid_extract_version(uuid_generate_v7()), c := len(uuid_generate_v7()), d := to_uuid(from_hex('00112233445566778899aabbccddeeff')) }", "SELECT r_regionkey AS id, 4::BIGINT AS a, 7::BIGINT AS b, 36::BIGINT AS c, '00112233-4455-6677-8899-aabbccddeeff' AS d FROM region"),
    "crypto_functions": ("select { b := crypto::crypt('password', '$1$abcdefgh'), c := str_starts_with(crypto::gen_salt('md5'), '$1$') }", "SELECT '$1$abcdefgh$G//4keteveJp0qb8z2DxG/' AS b, true AS c"),
    "vector_functions": (
        "select Embedding { id, a := round(pgvector::euclidean_distance(.embedding, .embedding) * 1000.0), b := round((pgvector::neg_inner_product(.embedding, .embedding) + pgvector::inner_product(.embedding, .embedding)) * 1000.0), c := round(pgvector::cosine_distance(.embedding, .embedding) * 1000.0) = 0.0 }",
        "SELECT vec_id AS id, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, true AS c FROM embeddings",
    ),
    "bound_set_filter": ("with x := {1, 2, 3} select x filter x > 1", "SELECT unnest([2, 3])::BIGINT AS value"),
    "ordered_array_agg": ("select Nation { id, names := array_agg((select .<nation[is Supplier] order by .acctbal desc).name) }", "SELECT n_nationkey AS id, coalesce((SELECT list(s_name ORDER BY s_acctbal DESC) FROM supplier WHERE s_nationkey = n_nationkey), []) AS names FROM nation"),
    "count_of_union": ("select count(Customer.name union Supplier.name)", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS value"),
    "detached_count": ("select Region { id, n := count(detached Nation) }", "SELECT r_regionkey AS id, (SELECT count(*) FROM nation) AS n FROM region"),
    "set_call_in_expression": ("select array_unpack([1, 2]) + 1", "SELECT unnest([2, 3])::BIGINT AS value"),
    "nested_for": ("for x in {1, 2} union (for y in {10, 20} union (x + y))", "SELECT unnest([11, 12, 21, 22])::BIGINT AS value"),
    "for_over_groups": ("for g in (group Order by .orderstatus) union ({ s := g.key.orderstatus, n := count(g.elements) })", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1"),
    "nested_link_shape": ("select (select Customer { id, nation: { name, region: { name } } }) { id, n := .nation.name, r := .nation.region.name }", "SELECT c_custkey AS id, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "filter_like_hits": ("select Part { id, name } filter .name like '%1_' or .name ilike 'PART%7'", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE '%1_' OR p_name ILIKE 'PART%7'"),
    "filter_not_exists_hits": ("select Customer { id } filter not exists (select .<customer[is Order] filter .totalprice > 400000.0)", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "link_property_sum": ("select Order { id, q := sum(.parts@quantity) }", "SELECT o_orderkey AS id, coalesce((SELECT sum(l_quantity) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey), 0) AS q FROM orders"),
    "asserted_distinct": ("select count(assert_distinct(Nation))", "SELECT count(*) AS value FROM nation"),
    # geospatial functions
    "geo_points": (
        "select Nation { id, x := postgis::x(postgis::makepoint(<float64>.id, 2.0)), t := postgis::astext(postgis::point(<float64>.id, 3.0)), d := round(postgis::distance(postgis::point(<float64>.id, 0.0), 'POINT(0 0)')), w := postgis::within(postgis::point(<float64>.id, 1.0), 'POLYGON((-1 0,10 0,10 5,-1 5,-1 0))'), j := postgis::asgeojson(postgis::point(<float64>.id, 1.5)) }",
        "SELECT n_nationkey AS id, n_nationkey::DOUBLE AS x, 'POINT(' || n_nationkey || ' 3)' AS t, n_nationkey::DOUBLE AS d, n_nationkey < 10 AS w, '{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || ',1.5]}' AS j FROM nation",
    ),
    "geo_shapes": (
        "select Nation { id, a := postgis::area('POLYGON((0 0,4 0,4 ' ++ <str>.id ++ ',0 ' ++ <str>.id ++ ',0 0))'), l := postgis::length('LINESTRING(0 0,0 ' ++ <str>.id ++ ')'), n := postgis::npoints('LINESTRING(0 0,1 1,2 ' ++ <str>.id ++ ')'), c := postgis::astext(postgis::startpoint('LINESTRING(' ++ <str>.id ++ ' 0,1 1)')), s := postgis::srid(postgis::setsrid(postgis::point(1.0, 1.0), <int64>.id)) }",
        "SELECT n_nationkey AS id, 4.0 * n_nationkey AS a, n_nationkey::DOUBLE AS l, 3::BIGINT AS n, 'POINT(' || n_nationkey || ' 0)' AS c, n_nationkey::BIGINT AS s FROM nation",
    ),
    "geo_boxes": (
        "select Nation { id, l := postgis::op_left(postgis::point(<float64>.id, 0.0), 'POINT(10 10)'), o := postgis::op_overlaps('LINESTRING(0 0,5 5)', postgis::point(<float64>.id, 1.0)), d := postgis::op_distance_box(postgis::point(<float64>.id, 0.0), 'POINT(0 0)'), m := postgis::xmax(postgis::expand(postgis::to_box2d(postgis::point(<float64>.id, 0.0)), 1.0)) }",
        "SELECT n_nationkey AS id, n_nationkey < 10 AS l, n_nationkey <= 5 AS o, n_nationkey::DOUBLE AS d, n_nationkey + 1.0::DOUBLE AS m FROM nation",
    ),
    "geo_extent": ("select postgis::xmax(postgis::extent_agg(postgis::point(<float64>Nation.id, 1.0)))", "SELECT max(n_nationkey)::DOUBLE AS value FROM nation"),
}


#: name: (statements, of which the last reads what the others wrote, SQL)
WRITES: dict[str, tuple[str, str]] = {
    "insert_then_read": ("insert Region { id := 77, name := 'ATLANTIS' }; select Region { id, name }", "SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 77, 'ATLANTIS'"),
    "insert_in_loop": ("for n in {'A', 'B', 'C'} union (insert Region { name := n }); select (group Region by .name) { name := .key.name, n := count(.elements) }", "SELECT name, count(*) AS n FROM (SELECT r_name AS name FROM region UNION ALL SELECT unnest(['A', 'B', 'C'])) GROUP BY 1"),
    "insert_nested": ("insert Nation { id := 90, name := 'MU', region := (insert Region { id := 91, name := 'DEEP' }) }; select Nation { id, r := .region.name }", "SELECT n_nationkey AS id, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 90, 'DEEP'"),
    "insert_unless_conflict": ("insert Region { id := 1, name := 'TWICE' } unless conflict; select Region { id, name }", "SELECT r_regionkey AS id, r_name AS name FROM region"),
    "upsert": ("insert Region { id := 1, name := 'NEW' } unless conflict on .id else (update Region filter .id = 1 set { name := 'NEW' }); select Region { id, name }", "SELECT r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'NEW' ELSE r_name END AS name FROM region"),
    "update_then_read": ("update Customer filter .mktsegment = 'BUILDING' set { acctbal := .acctbal + 1.0 }; select Customer { id, acctbal }", "SELECT c_custkey AS id, c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS acctbal FROM customer"),
    "update_interface": ("update Party filter .acctbal < 0.0 set { acctbal := 0.0 }; select Party { name, acctbal }", "SELECT c_name AS name, greatest(c_acctbal, 0) AS acctbal FROM customer UNION ALL SELECT s_name, greatest(s_acctbal, 0) FROM supplier"),
    "delete_then_read": ("delete Part filter .size > 25; select Part { id, size }", "SELECT p_partkey AS id, p_size AS size FROM part WHERE p_size <= 25"),
    "delete_as_source": ("select (delete Part filter .size = 1) { id, brand }", "SELECT p_partkey AS id, p_brand AS brand FROM part WHERE p_size = 1"),
    "insert_as_source": ("select (insert Region { id := 78, name := 'LEMURIA' }) { id, name }", "SELECT 78 AS id, 'LEMURIA' AS name"),
    "multi_link_append": ("update Order filter .id = 1 set { parts += (select Part filter .id in {1, 2, 3}) }; select Order { id, n := count(.parts) } filter .id <= 5", "SELECT o_orderkey AS id, count(DISTINCT p) FILTER (o_orderkey = 1) + count(p) FILTER (o_orderkey <> 1) AS n FROM (SELECT o_orderkey, l_partkey AS p FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 1, unnest([1, 2, 3])) WHERE o_orderkey <= 5 GROUP BY 1"),
    "multi_link_clear": ("update Order filter .id <= 3 set { parts := {} }; select Order { id, n := count(.parts) } filter .id <= 6", "SELECT o_orderkey AS id, CASE WHEN o_orderkey <= 3 THEN 0 ELSE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS n FROM orders WHERE o_orderkey <= 6"),
    "multi_link_remove": ("update Order set { parts -= (select Part filter .size < 30) }; select Order { id, n := count(.parts) }", "SELECT o_orderkey AS id, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size >= 30) AS n FROM orders"),
    "guarded_insert": ("select (insert Region { id := 79, name := 'X' }) if false else {}; select count(Region)", "SELECT count(*) AS value FROM region"),
}


def queries() -> dict:
    plain = {name: (lambda spark, sf_dir, text=text: engine(spark, sf_dir).query(text)) for name, (text, _) in QUERIES.items()}
    return plain | {name: (lambda spark, sf_dir, text=text: engine(spark, sf_dir).script(text)[-1]) for name, (text, _) in WRITES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (QUERIES | WRITES).items()}
