"""Registered queries over the star schema and the event table, one or more for each operator, with the same
query as plain SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .dataset import DatasetBuilder, create, open
from .session import dataset_session
from .sources.files import fresh_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def dataset(spark: SparkSession, sf_dir: str, table: str, folder: str = "") -> DatasetBuilder:
    return create(folder, spark=spark).attach(f"{sf_dir}/{table}.parquet")


def query(oracle: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def over(name: str, table: str, sql: str, oracle: str | None = None, params: list | None = None) -> None:
    """A query by select() over one table. oracle: only where the spelling differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dataset(spark, sf_dir, table).select(sql, params).dataframe

    QUERIES[name] = run
    text = oracle or sql
    for i, p in reversed(list(enumerate(params or [], 1))):
        text = text.replace(f"${i}", repr(p))
    ORACLES[name] = text.replace("FROM bundle", f"FROM {table}").replace("JOIN bundle", f"JOIN {table}")


# -- rows and columns

over("scan_parquet", "customer", "SELECT * FROM bundle")
over("project_computed", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, upper(l_returnflag) AS flag FROM bundle")
over("filter_in", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM bundle WHERE l_linenumber IN (1, 3) AND l_returnflag IN ('A', 'R')")
over("filter_between", "orders", "SELECT o_orderkey, o_totalprice FROM bundle WHERE o_totalprice BETWEEN $1 AND $2", params=[1000.0, 50000.0])
over("filter_like", "part", "SELECT p_partkey, p_name FROM bundle WHERE p_type LIKE '%A%' AND p_name NOT LIKE 'x%'")
over("filter_null", "events", "SELECT event_id, coalesce(value, -1.0) AS value FROM bundle WHERE props IS NOT NULL AND event_type IS DISTINCT FROM 'click'")
over("select_prefix", "region", "r_name, r_regionkey + 1 AS next_key", "SELECT r_name, r_regionkey + 1 AS next_key FROM region")
over("select_without_from", "nation", "SELECT n_name WHERE n_regionkey = $1", "SELECT n_name FROM nation WHERE n_regionkey = $1", [2])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 24.0 AND l_returnflag = 'R'")
def filter_param(spark, sf_dir):
    rows = dataset(spark, sf_dir, "lineitem").filter("l_quantity > $1 AND l_returnflag = $2", [24.0, "R"])
    return rows.select("l_orderkey, l_linenumber, l_quantity").dataframe


@query("SELECT p_partkey AS part_id, p_name, p_brand, p_type, p_size FROM part WHERE p_size > 10")
def rename_remove(spark, sf_dir):
    return dataset(spark, sf_dir, "part").rename_column("p_partkey", "part_id").remove_column("p_retailprice").remove_column("absent").filter("p_size > 10").dataframe


@query("SELECT * FROM orders UNION ALL SELECT * FROM orders")
def union_blocks(spark, sf_dir):
    return dataset(spark, sf_dir, "orders").attach(f"{sf_dir}/orders.parquet").dataframe


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def show_rows(spark, sf_dir):
    return dataset(spark, sf_dir, "customer").select("SELECT * FROM bundle ORDER BY c_custkey LIMIT 10").dataframe


@query("SELECT count(*) AS n FROM events")
def num_rows(spark, sf_dir):
    return dataset(spark, sf_dir, "events").ctx().sql("SELECT count(*) AS n FROM bundle")


@query("SELECT (SELECT count(*) FROM nation) AS base_rows, (SELECT count(*) FROM region) AS joined_rows")
def raw_tables(spark, sf_dir):
    made = dataset(spark, sf_dir, "nation").join("regions", f"{sf_dir}/region.parquet", "n_regionkey = r_regionkey")
    base, other = made._state.packs
    return made.ctx().sql(f"SELECT (SELECT count(*) FROM packs.__pack_{base}) AS base_rows, (SELECT count(*) FROM packs.__pack_{other}) AS joined_rows")


# -- joins

_NATIONS = "n_name, c_custkey, c_name, c_acctbal"


def _joined(spark, sf_dir, how):
    made = dataset(spark, sf_dir, "customer").filter("n_regionkey < 3 OR n_regionkey IS NULL OR c_custkey IS NULL")
    return made.join("nations", f"{sf_dir}/nation.parquet", "$base.c_nationkey = nations.n_nationkey AND c_acctbal > 0", how).select(f"SELECT {_NATIONS} FROM bundle").dataframe


for _how in ("inner", "left", "right", "full"):
    QUERIES[f"join_{_how}"] = lambda spark, sf_dir, how=_how: _joined(spark, sf_dir, how)
    ORACLES[f"join_{_how}"] = (
        f"SELECT {_NATIONS} FROM customer {_how} JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 0 WHERE n_regionkey < 3 OR n_regionkey IS NULL OR c_custkey IS NULL"
    )


@query("SELECT s_suppkey, r_name FROM supplier JOIN region ON s_nationkey % 5 >= r_regionkey AND s_acctbal > 100 * r_regionkey")
def join_theta(spark, sf_dir):
    return dataset(spark, sf_dir, "supplier").join("r", f"{sf_dir}/region.parquet", "s_nationkey % 5 >= r_regionkey AND s_acctbal > 100 * r.r_regionkey").select("s_suppkey, r_name").dataframe


@query("SELECT o_orderkey, c_name, l_linenumber, l_quantity FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def join_two(spark, sf_dir):
    made = dataset(spark, sf_dir, "orders").join("c", f"{sf_dir}/customer.parquet", "o_custkey = c_custkey").join("l", f"{sf_dir}/lineitem.parquet", "$base.o_orderkey = l.l_orderkey")
    return made.filter("l_quantity > 45").select("o_orderkey, c_name, l_linenumber, l_quantity").dataframe


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1 WHERE r_name IS NOT NULL")
def join_filter_before(spark, sf_dir):
    """A filter that is written before the join still comes after it."""
    return dataset(spark, sf_dir, "nation").filter("r_name IS NOT NULL").join("r", f"{sf_dir}/region.parquet", "n_regionkey = r_regionkey AND r_regionkey > 1", "left").select("n_name, r_name").dataframe


@query("SELECT c_custkey, n_name FROM customer JOIN (SELECT * FROM nation UNION ALL SELECT * FROM nation) ON c_nationkey = n_nationkey")
def join_attach_to_join(spark, sf_dir):
    made = dataset(spark, sf_dir, "customer").join("n", f"{sf_dir}/nation.parquet", "c_nationkey = n.n_nationkey")
    return made.attach_to_join("n", f"{sf_dir}/nation.parquet").select("c_custkey, n_name").dataframe


over("sql_semi", "orders", "SELECT a.o_orderkey FROM bundle a LEFT SEMI JOIN bundle b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey",
     "SELECT a.o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)")
over("sql_anti", "orders", "SELECT a.o_orderkey FROM bundle a LEFT ANTI JOIN bundle b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey",
     "SELECT a.o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)")
over("sql_cross", "region", "SELECT a.r_name AS a_name, b.r_name AS b_name FROM bundle a CROSS JOIN bundle b", "SELECT a.r_name AS a_name, b.r_name AS b_name FROM region a CROSS JOIN region b")
over("sql_self", "nation", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM bundle a JOIN bundle b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
over("sql_using", "nation", "SELECT n_regionkey, a.n_name AS a_name, b.n_name AS b_name FROM bundle a JOIN bundle b USING (n_regionkey)")
over("sql_lateral", "nation", "SELECT n_name, k FROM bundle, LATERAL (SELECT n_nationkey * 2 AS k) t", "SELECT n_name, n_nationkey * 2 AS k FROM nation")

# -- aggregation

over("agg_basic", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS low, max(l_tax) AS high FROM bundle GROUP BY l_returnflag, l_linestatus")
over("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM bundle GROUP BY l_returnflag")
over("agg_filter", "orders", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS large, round(sum(o_totalprice) FILTER (WHERE o_totalprice <= 100000), 2) AS small_sum FROM bundle GROUP BY o_orderstatus")
over("agg_having", "orders", "SELECT o_custkey, count(*) AS n FROM bundle GROUP BY o_custkey HAVING count(*) > 10")
over("agg_rollup", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS INT) AS g FROM bundle GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
over("agg_cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM bundle GROUP BY CUBE (o_orderstatus, o_orderpriority)")
over("agg_sets", "lineitem", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM bundle GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus, l_linenumber), ())")
over("agg_all", "orders", "SELECT o_orderstatus, count(*) AS n FROM bundle GROUP BY ALL")
over("agg_stats", "lineitem", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_discount), 8) AS vs, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM bundle GROUP BY l_returnflag")
over("agg_percentile", "orders", "SELECT o_orderstatus, round(median(o_totalprice), 4) AS mid, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90 FROM bundle GROUP BY o_orderstatus",
     "SELECT o_orderstatus, round(median(o_totalprice), 4) AS mid, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus")
over("agg_bits", "part", "SELECT p_brand, bool_and(p_size > 0) AS every, bool_or(p_size > 49) AS some, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx FROM bundle GROUP BY p_brand")
over("agg_collect", "nation", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name), '|') AS names, string_agg(n_name, ',' ORDER BY n_name) AS joined, nth_value(n_name, 2 ORDER BY n_name) AS second FROM bundle GROUP BY n_regionkey",
     "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name), '|') AS names, string_agg(n_name, ',' ORDER BY n_name) AS joined, list(n_name ORDER BY n_name)[2] AS second FROM nation GROUP BY n_regionkey")
over("agg_approx", "lineitem", "SELECT l_returnflag, abs(approx_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.2 * count(DISTINCT l_partkey) AS near FROM bundle GROUP BY l_returnflag", "SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag")
over("agg_approx_percentile", "orders", "SELECT o_orderstatus, abs(approx_percentile_cont(o_totalprice, 0.5) - median(o_totalprice)) <= 0.05 * median(o_totalprice) AS near FROM bundle GROUP BY o_orderstatus", "SELECT o_orderstatus, true AS near FROM orders GROUP BY o_orderstatus")
over("distinct_rows", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM bundle")
over("distinct_on", "orders", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM bundle ORDER BY o_custkey, o_totalprice DESC, o_orderkey")

# -- windows

over("win_rank", "orders", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM bundle WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
     "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
over("win_lag", "orders", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM bundle")
over("win_rows", "orders", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS near FROM bundle")
over("win_range", "events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM bundle")
over("win_groups", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, min(o_orderkey) OVER (ORDER BY o_custkey DESC GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS low, max(o_orderkey) OVER w AS high FROM bundle o WHERE o.o_totalprice > 1000 WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS UNBOUNDED PRECEDING)")
over("win_ntile", "orders", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS quarter FROM bundle", "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS INT) AS quarter FROM orders")
over("win_first_last", "events", "SELECT event_id, first_value(event_type) OVER w AS first_type, last_value(event_type) OVER w AS last_type, nth_value(event_type, 2) OVER w AS second_type FROM bundle WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
over("win_qualify", "orders", "SELECT o_custkey, o_orderkey FROM bundle QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")

# -- order, limits, sets, subqueries

over("sort_limit", "orders", "SELECT o_orderkey, o_totalprice FROM bundle ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
over("sort_nulls", "orders", "SELECT o_orderkey, v FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS v FROM bundle) t ORDER BY v, o_orderkey LIMIT 5000", "SELECT o_orderkey, v FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS v FROM orders) t ORDER BY v NULLS LAST, o_orderkey LIMIT 5000")
over("offset_rows", "customer", "SELECT c_custkey FROM bundle ORDER BY c_acctbal, c_custkey LIMIT 50 OFFSET 20")
over("set_union", "nation", "SELECT n_regionkey AS k FROM bundle UNION SELECT n_nationkey FROM bundle")
over("set_union_all", "nation", "SELECT n_regionkey AS k FROM bundle UNION ALL SELECT n_nationkey FROM bundle")
over("set_intersect", "nation", "SELECT n_regionkey AS k FROM bundle INTERSECT SELECT n_nationkey FROM bundle")
over("set_except", "nation", "SELECT n_nationkey AS k FROM bundle EXCEPT SELECT n_regionkey FROM bundle")
over("set_intersect_all", "nation", "SELECT n_regionkey AS k FROM bundle INTERSECT ALL SELECT n_nationkey FROM bundle")
over("set_except_all", "nation", "SELECT n_regionkey AS k FROM bundle EXCEPT ALL SELECT n_nationkey FROM bundle")
over("set_by_name", "nation", "SELECT n_name, n_nationkey FROM bundle UNION ALL BY NAME SELECT n_nationkey, n_name FROM bundle", "SELECT n_name, n_nationkey FROM nation UNION ALL SELECT n_name, n_nationkey FROM nation")
over("cte", "orders", "WITH big AS (SELECT o_custkey, o_totalprice FROM bundle WHERE o_totalprice > 100000), n AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT o_custkey, n FROM n WHERE n > 3")
over("cte_recursive", "region", "WITH RECURSIVE t(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM t WHERE k < 20) SELECT k FROM t")
over("subq_scalar", "orders", "SELECT o_orderkey FROM bundle WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM bundle)")
over("subq_in", "orders", "SELECT o_orderkey FROM bundle WHERE o_custkey IN (SELECT o_custkey FROM bundle WHERE o_totalprice > 200000)")
over("subq_exists", "lineitem", "SELECT l_orderkey, l_linenumber FROM bundle a WHERE EXISTS (SELECT 1 FROM bundle b WHERE b.l_orderkey = a.l_orderkey AND b.l_quantity > 48)")
over("subq_correlated", "lineitem", "SELECT a.l_orderkey, a.l_linenumber FROM bundle a WHERE a.l_quantity > (SELECT 1.5 * avg(b.l_quantity) FROM bundle b WHERE b.l_orderkey = a.l_orderkey)")
over("values_rows", "region", "SELECT col1 * 2 AS twice, col2 FROM VALUES (1, 'a'), (2, 'b')", "SELECT col0 * 2 AS twice, col1 AS col2 FROM (VALUES (1, 'a'), (2, 'b'))")
over("exclude_columns", "nation", "SELECT * EXCLUDE (n_name) FROM bundle")
over("series", "region", "SELECT value FROM generate_series(1, 50)", "SELECT CAST(generate_series AS INT) AS value FROM generate_series(1, 50)")
over("unnest_array", "embeddings", "SELECT vec_id, unnest(embedding) AS x FROM bundle")

# -- functions

over("fn_string", "part", "SELECT p_partkey, strpos(p_name, 'a') AS at, starts_with(p_brand, 'Brand') AS b, lpad(p_brand, 12, '*') AS padded, concat_ws('-', p_brand, p_type) AS joined, split_part(p_type, ' ', 1) AS first_word, substr(p_name, 2, 3) AS part_of, replace(p_name, 'e', '3') AS r, trim(p_name) AS t, initcap_like FROM (SELECT *, upper(left(p_name, 1)) AS initcap_like FROM bundle) x",
     "SELECT p_partkey, CAST(strpos(p_name, 'a') AS INT) AS at, starts_with(p_brand, 'Brand') AS b, lpad(p_brand, 12, '*') AS padded, concat_ws('-', p_brand, p_type) AS joined, split_part(p_type, ' ', 1) AS first_word, substr(p_name, 2, 3) AS part_of, replace(p_name, 'e', '3') AS r, trim(p_name) AS t, upper(left(p_name, 1)) AS initcap_like FROM part")
over("fn_regex", "part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '#') AS once, p_name ~ '^[a-m]' AS m, p_type SIMILAR TO '%A%' AS s FROM bundle",
     "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '#', 'g') AS once, regexp_matches(p_name, '^[a-m]') AS m, p_type LIKE '%A%' AS s FROM part")
over("fn_date", "orders", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(extract(year FROM o_orderdate) AS INT) AS year, CAST(date_part('doy', o_orderdate) AS INT) AS day, o_orderdate + INTERVAL '3' DAY AS later FROM bundle",
     "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(extract(year FROM o_orderdate) AS INT) AS year, CAST(date_part('doy', o_orderdate) AS INT) AS day, o_orderdate + INTERVAL '3' DAY AS later FROM orders")
over("fn_date_bin", "events", "SELECT event_id, date_bin(INTERVAL '15 minutes', ts) AS slot FROM bundle", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS slot FROM events")
over("fn_math", "lineitem", "SELECT l_orderkey, l_linenumber, round(power(l_quantity, 2), 4) AS sq, round(ln(l_extendedprice), 8) AS l, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, abs(l_discount - 0.05) AS a, CAST(floor(l_tax * 100) AS BIGINT) AS f, CAST(ceil(l_quantity / 3) AS BIGINT) AS c, l_orderkey % 7 AS m FROM bundle")
over("fn_cond", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' WHEN o_totalprice > 10000 THEN 'middle' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s, o_orderstatus IS DISTINCT FROM 'O' AS d, try_cast(o_orderpriority AS INT) AS i, greatest(o_orderkey, o_custkey) AS g FROM bundle")
over("fn_cast", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, CAST(l_orderkey AS VARCHAR(20)) AS s, CAST(l_shipdate AS DATE) AS d FROM bundle",
     "SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, CAST(l_orderkey AS VARCHAR) AS s, CAST(l_shipdate AS DATE) AS d FROM lineitem")
over("fn_array", "embeddings", "SELECT vec_id, array_length(embedding) AS n, round(embedding[0], 6) AS x0, array_has(make_array(1, 2, label), label) AS has, array_length([1, 2, 3]) AS three FROM bundle",
     "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(embedding[1], 6) AS x0, true AS has, 3 AS three FROM embeddings")
over("fn_json", "events", "SELECT event_id, get_json_object(props, '$.page') AS page, get_json_object(props, '$.k') AS k FROM bundle", "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events")
over("fn_hash", "customer", "SELECT c_custkey, md5(c_name) AS m, to_hex(sha256(c_name)) AS s FROM bundle", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")

# -- the log: functions, indexes, views, commits, archives


@query("SELECT CAST(range AS INT) AS page_num, CAST(range * 10 AS BIGINT) AS v FROM range(0, 4)")
def function_source(spark, sf_dir):
    def pages(page, schema):
        if page > 1:
            return None
        return pa.RecordBatch.from_pydict({"page_num": [2 * page, 2 * page + 1], "v": [20 * page, 20 * page + 10]}, schema=schema)

    return create(spark=spark).define_function("pages", {"page_num": "Int32", "v": "Int64"}, pages).attach("function://pages").dataframe


def _folder(spark: SparkSession) -> str:
    dataset_session(spark)
    return fresh_folder()


def _indexed(spark, sf_dir, column, clustered=False):
    """Two blocks, the first one of several files that are dealt by the column."""
    made, at = create(spark=spark), f"{_folder(spark)}/customer.parquet"
    made.spark.read.parquet(f"{sf_dir}/customer.parquet").repartitionByRange(8, column).write.parquet(at)
    return made.attach(at).attach(f"{sf_dir}/customer.parquet").index(column, clustered)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_eq(spark, sf_dir):
    return _indexed(spark, sf_dir, "c_mktsegment").filter("c_mktsegment = $1", ["BUILDING"]).select("c_custkey, c_name").dataframe


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (5, 7, 100000000) UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (5, 7, 100000000)")
def index_in(spark, sf_dir):
    return _indexed(spark, sf_dir, "c_custkey").filter("c_custkey IN (5, 7, 100000000)").select("c_custkey, c_name").dataframe


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 10 AND c_custkey < 20 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 10 AND c_custkey < 20")
def index_range(spark, sf_dir):
    return _indexed(spark, sf_dir, "c_custkey").filter("c_custkey >= 10 AND 20 > c_custkey").select("c_custkey, c_name").dataframe


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey > 100000000")
def index_miss(spark, sf_dir):
    return _indexed(spark, sf_dir, "c_custkey").filter("c_custkey > 100000000").select("c_custkey, c_acctbal").dataframe


@query("SELECT c_custkey AS id, c_name FROM customer WHERE c_acctbal > 500")
def reopen_query(spark, sf_dir):
    at = _folder(spark)
    dataset(spark, sf_dir, "customer", at).filter("c_acctbal > $1", [500]).rename_column("c_custkey", "id").commit("rows")
    return open(at, spark=spark).select("id, c_name").dataframe


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 500 AND c_mktsegment = 'BUILDING'")
def view_query(spark, sf_dir):
    at = _folder(spark)
    made = dataset(spark, sf_dir, "customer", at).commit("all")
    made.create_view("builders", made.select("SELECT * WHERE c_mktsegment = 'BUILDING'")).commit("view")
    # views see what their dataset gets later
    open(at, spark=spark).extend().filter("c_acctbal > 500").commit("rich")
    return open(at, spark=spark).view("builders").select("c_custkey, c_name").dataframe


@query("SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2")
def extend_query(spark, sf_dir):
    first, second = _folder(spark), _folder(spark)
    dataset(spark, sf_dir, "nation", first).filter("n_regionkey = 1").commit("region")
    open(first, spark=spark).extend(second).filter("n_nationkey > 2").commit("later")
    return open(second, spark=spark).select("n_name").dataframe


@query("SELECT count(*) AS n FROM nation")
def undo_query(spark, sf_dir):
    made = dataset(spark, sf_dir, "nation").filter("n_regionkey = 1").filter("n_nationkey > 2").undo().undo()
    return made.select("SELECT count(*) AS n FROM bundle").dataframe


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 0")
def tar_query(spark, sf_dir):
    at = f"{_folder(spark)}/data.tar"
    dataset(spark, sf_dir, "region", at).filter("r_regionkey <> 0").commit("in an archive")
    return open(at, spark=spark).dataframe


@query("SELECT n_name FROM nation WHERE n_regionkey = 3")
def command_query(spark, sf_dir):
    from .commands import execute

    made = create(spark=spark)
    execute(made, f"ATTACH '{sf_dir}/nation.parquet'")
    execute(made, "FILTER WHERE n_regionkey = 3")
    return execute(made, "SELECT n_name FROM bundle").dataframe


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 10 AND 20 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 10 AND 20")
def index_clustered(spark, sf_dir):
    return _indexed(spark, sf_dir, "c_custkey", True).filter("c_custkey BETWEEN $1 AND $2", [10, 20]).select("c_custkey, c_name").dataframe


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_rebuilt(spark, sf_dir):
    made = _indexed(spark, sf_dir, "c_custkey").drop_index("c_custkey").index("c_mktsegment").rebuild_index("c_mktsegment").reindex()
    return made.filter("c_mktsegment = 'BUILDING'").select("c_custkey, c_name").dataframe


def _text_table(spark, sf_dir, kind):
    """The nations, some with line ends, quotes and commas in their names, as CSV or JSON lines."""
    at = f"{_folder(spark)}/nations.{kind}"
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey", "CASE n_regionkey WHEN 0 THEN concat(n_name, char(10), 'second line') WHEN 1 THEN concat('\"', n_name, '\", x') WHEN 2 THEN NULL ELSE n_name END AS label", "n_regionkey + 0.5D AS half")
    out = rows.coalesce(1).write
    out.option("header", True).option("escape", '"').csv(at) if kind == "csv" else out.json(at)
    return create(spark=spark).attach(at)


_LABELLED = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_regionkey WHEN 0 THEN n_name || chr(10) || 'second line' WHEN 1 THEN '\"' || n_name || '\", x' WHEN 2 THEN NULL ELSE n_name END AS label, n_regionkey + 0.5::DOUBLE AS half FROM nation"


@query(_LABELLED)
def scan_csv(spark, sf_dir):
    return _text_table(spark, sf_dir, "csv").dataframe


@query(_LABELLED)
def scan_json(spark, sf_dir):
    return _text_table(spark, sf_dir, "json").dataframe


@query("SELECT (SELECT count(*) FROM nation) AS first_rows, (SELECT count(*) FROM region) AS second_rows")
def raw_blocks(spark, sf_dir):
    made = dataset(spark, sf_dir, "nation").join("r", f"{sf_dir}/region.parquet", "n_regionkey = r_regionkey")
    (first,), (second,) = made._state.packs.values()
    return made.ctx().sql(f"SELECT (SELECT count(*) FROM blocks.__block_{first.id}) AS first_rows, (SELECT count(*) FROM blocks.__block_{second.id}) AS second_rows")


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def reset_query(spark, sf_dir):
    made = dataset(spark, sf_dir, "nation", _folder(spark)).filter("n_regionkey = 1").commit("one region")
    return made.filter("n_nationkey > 5").remove_column("n_regionkey").reset().select("n_name").dataframe


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def view_renamed(spark, sf_dir):
    at = _folder(spark)
    made = dataset(spark, sf_dir, "customer", at).commit("all")
    made.create_view("first", made.select("SELECT * WHERE c_mktsegment = 'BUILDING'")).create_view("second", made.select("SELECT * WHERE c_acctbal > 0")).commit("views")
    made.rename_view("first", "builders").drop_view("second").commit("one view")
    found = open(at, spark=spark)
    assert list(found.views().values()) == ["builders"]
    return found.view("builders").select("c_custkey").dataframe


@query("SELECT 2 AS commits, 'two nations' AS last_message, 'nations' AS name, 'of region 1' AS description, true AS changed")
def log_query(spark, sf_dir):
    at = _folder(spark)
    made = dataset(spark, sf_dir, "nation", at).set_name("nations").set_description("of region 1").commit("all")
    before = made.version
    made.filter("n_nationkey < 2").commit("two nations")
    found = open(at, spark=spark)
    row = (len(found.history()), found.history()[-1].message, found.name, found.description, found.version not in (before, "empty") and len(found.operations()) == 5)
    return made.spark.createDataFrame([row], "commits int, last_message string, name string, description string, changed boolean")


@query("SELECT 25 AS by_property, 25 AS by_stream, 25 AS by_dict, 10 AS shown, true AS explained")
def results_query(spark, sf_dir):
    """The same rows by each way out of a dataset."""
    made = dataset(spark, sf_dir, "nation")
    row = (made.num_rows, sum(b.num_rows for b in made.as_pyarrow_stream()), len(made.to_dict()["n_name"]), len(made.show()), "Scan parquet" in made.explain())
    return made.spark.createDataFrame([row], "by_property int, by_stream int, by_dict int, shown int, explained boolean")


@query("SELECT n_name, r_name FROM nation JOIN (SELECT * FROM region UNION ALL SELECT * FROM region) r ON n_regionkey = r_regionkey WHERE n_nationkey > 3")
def command_joins(spark, sf_dir):
    from .commands import execute

    made = create(spark=spark)
    for line in (
        f"ATTACH '{sf_dir}/nation.parquet'",
        f"INNER JOIN '{sf_dir}/region.parquet' AS r ON n_regionkey = r.r_regionkey",
        f"ATTACH '{sf_dir}/region.parquet' TO JOIN 'r'",
        "INDEX n_nationkey",
        "REINDEX",
        "DROP INDEX n_nationkey",
        "FILTER WHERE n_nationkey > 3",
        "REMOVE COLUMN r_regionkey",
        "UNDO",
    ):
        execute(made, line)
    return execute(made, "SELECT n_name, r_name FROM bundle").dataframe


over("sql_natural", "nation", "SELECT n_nationkey, n_name, n_regionkey FROM bundle NATURAL JOIN (SELECT n_nationkey, n_regionkey FROM bundle WHERE n_nationkey > 3) t")
over("int_division", "nation", "SELECT n_nationkey, n_nationkey / 2 AS half FROM bundle")
over("quoted_names", "nation", "SELECT \"n_name\" AS \"Mixed Case\", 'it''s' AS text FROM bundle")
over("sql_pivot", "orders", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM bundle) PIVOT (count(o_totalprice) FOR o_orderstatus IN ('F' AS f, 'O' AS o))",
     "SELECT o_orderpriority, count(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, count(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority")
over("fn_map", "nation", "SELECT n_nationkey, element_at(map('k', n_name), 'k') AS name, named_struct('a', n_regionkey, 'b', n_name).a AS region, size(map_keys(map('x', 1, 'y', 2))) AS n FROM bundle",
     "SELECT n_nationkey, n_name AS name, n_regionkey AS region, 2 AS n FROM nation")

# -- TPC-H


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
    round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""
)
def tpch_q1(spark, sf_dir):
    made = dataset(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return made.select(
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
        round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM bundle GROUP BY l_returnflag, l_linestatus"""
    ).dataframe


@query(
    """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1997-03-15'
    GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10"""
)
def tpch_q3(spark, sf_dir):
    made = dataset(spark, sf_dir, "orders").join("c", f"{sf_dir}/customer.parquet", "c_custkey = o_custkey").join("l", f"{sf_dir}/lineitem.parquet", "l_orderkey = o_orderkey")
    made.filter("c_mktsegment = $1 AND o_orderdate < TIMESTAMP_NTZ '1997-03-15 00:00:00' AND l_shipdate > TIMESTAMP_NTZ '1997-03-15 00:00:00'", ["BUILDING"])
    return made.select("SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM bundle GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10").dataframe


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey JOIN nation ON n_nationkey = s_nationkey
    WHERE n_regionkey = 2 GROUP BY n_name"""
)
def tpch_q5(spark, sf_dir):
    """Each ON sees the base and one source, so the chain of keys is closed by the filter."""
    made = dataset(spark, sf_dir, "lineitem").join("o", f"{sf_dir}/orders.parquet", "l_orderkey = o_orderkey").join("s", f"{sf_dir}/supplier.parquet", "l_suppkey = s_suppkey")
    rows = made.select("l_extendedprice, l_discount, o_custkey, s_nationkey")
    spark = rows.spark
    customers, nations = (create(spark=spark).attach(f"{sf_dir}/{t}.parquet").dataframe for t in ("customer", "nation"))
    return spark.sql(
        """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {supplied} JOIN {customers} ON c_custkey = o_custkey AND c_nationkey = s_nationkey
        JOIN {nations} ON n_nationkey = s_nationkey WHERE n_regionkey = 2 GROUP BY n_name""",
        supplied=rows.dataframe, customers=customers, nations=nations,
    )


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6(spark, sf_dir):
    made = dataset(spark, sf_dir, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'")
    return made.filter("l_discount BETWEEN $1 AND $2 AND l_quantity < $3", [0.05, 0.07, 24]).select("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM bundle").dataframe
