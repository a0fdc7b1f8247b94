"""The engine's registered queries and the DuckDB SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import compat as C
from tidemark.operators import asof, constraints, dml, entity, state
from tidemark.plans import synthetic as S
from tidemark.streaming import tail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query given as SQL; {table} stands for a table. The oracle is the same text unless given."""
    used = [t for t in TABLES if f"{{{t}}}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: _read(spark, sf_dir, t) for t in used})

    run.__name__ = name
    QUERIES[name] = run
    text_oracle = oracle or text
    for t in TABLES:
        text_oracle = text_oracle.replace(f"{{{t}}}", t)
    ORACLE_SQL[name] = text_oracle


def _query(oracle: str | None):
    """Register a function of (spark, sf_dir) under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


@_query("""
    SELECT n.n_name, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS revenue
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE o.o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY n.n_name HAVING COUNT(*) > 5""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and revenue of each nation since 1996, nations with more than five orders."""
    return spark.sql(
        """
        SELECT n.n_name, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS revenue
        FROM {o} o JOIN {c} c ON o.o_custkey = c.c_custkey JOIN {n} n ON c.c_nationkey = n.n_nationkey
        WHERE o.o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' GROUP BY n.n_name HAVING COUNT(*) > 5
        """,
        o=_read(spark, sf_dir, "orders"), c=_read(spark, sf_dir, "customer"), n=_read(spark, sf_dir, "nation"),
    )


# Projection and filter
_sql("scan_filter_project", "SELECT o_orderkey, o_totalprice AS price FROM {orders} WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'")
_sql("filter_boolean_3vl", """
    SELECT o_orderkey FROM {orders} WHERE NOT (NULLIF(o_orderstatus, 'F') = 'O' AND o_totalprice > 50000)
       OR (NULLIF(o_orderstatus, 'F') IS NULL AND o_custkey < 50)""")
_sql("filter_comparisons", "SELECT o_orderkey FROM {orders} WHERE o_custkey >= 10 AND o_custkey <= 90 AND o_orderkey <> 7 AND o_totalprice < 90000")
_sql("filter_in_list", "SELECT c_custkey FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
_sql("filter_in_list_null", "SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (1, NULL) OR c_custkey < 3")
_sql("filter_between", "SELECT p_partkey, p_size FROM {part} WHERE p_size BETWEEN 5 AND 10 AND p_retailprice NOT BETWEEN 1000 AND 1500")
_sql("filter_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%1_' AND p_type NOT LIKE '%BRASS%'")
_sql("filter_ilike", "SELECT c_custkey FROM {customer} WHERE c_mktsegment ILIKE 'build%' OR c_name NOT ILIKE 'CUSTOMER%'")
_sql("filter_null", "SELECT d.doc_id FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
_sql("filter_not_null", "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
_sql("filter_arithmetic", "SELECT o_orderkey FROM {orders} WHERE o_orderkey % 7 + 2 * o_custkey > 100 AND o_orderkey div 10 < 40",
     "SELECT o_orderkey FROM {orders} WHERE o_orderkey % 7 + 2 * o_custkey > 100 AND o_orderkey // 10 < 40")
_sql("filter_timestamp_arithmetic", """
    SELECT a.event_id, CAST(unix_micros(CAST(b.ts AS TIMESTAMP)) - unix_micros(CAST(a.ts AS TIMESTAMP)) AS BIGINT) AS gap_us
    FROM {events} a JOIN {events} b ON a.event_id + 1 = b.event_id
    WHERE b.ts > timestampadd(MICROSECOND, 1000000, a.ts)""", """
    SELECT a.event_id, CAST(epoch_us(b.ts) - epoch_us(a.ts) AS BIGINT) AS gap_us
    FROM {events} a JOIN {events} b ON a.event_id + 1 = b.event_id WHERE b.ts > a.ts + INTERVAL 1 SECOND""")
_sql("filter_json", "SELECT event_id FROM {events} WHERE CAST(get_json_object(props, '$.k') AS BIGINT) > 50",
     "SELECT event_id FROM {events} WHERE CAST(props::JSON->>'k' AS BIGINT) > 50")
_sql("qualified_star", "SELECT n.* FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'")
_sql("star", "SELECT * FROM {supplier} WHERE s_acctbal > 0")
_sql("arithmetic_projection", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net FROM {lineitem} WHERE l_quantity > 45")
_sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
_sql("distinct_before_limit", "SELECT DISTINCT c_mktsegment FROM {customer} ORDER BY c_mktsegment LIMIT 3")

# Subqueries
_sql("subq_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)")
_sql("subq_not_in", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})")
_sql("subq_not_in_null", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 1) FROM {orders})")
_sql("subq_exists_corr", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 30)")
_sql("subq_not_exists", "SELECT s_suppkey FROM {supplier} s WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
_sql("subq_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM {orders})")
_sql("subq_scalar_corr", "SELECT o.o_orderkey FROM {orders} o WHERE o.o_totalprice = (SELECT MAX(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
_sql("subq_nested", "SELECT n_name FROM {nation} WHERE n_nationkey IN (SELECT c_nationkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderkey < 20))")
_sql("subq_json_scalar", "SELECT event_id FROM {events} WHERE CAST(get_json_object(props, '$.k') AS BIGINT) = (SELECT MAX(CAST(get_json_object(props, '$.k') AS BIGINT)) FROM {events})",
     "SELECT event_id FROM {events} WHERE CAST(props::JSON->>'k' AS BIGINT) = (SELECT MAX(CAST(props::JSON->>'k' AS BIGINT)) FROM {events})")

# Joins
_sql("join_inner", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0")
_sql("join_left_null", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000")
_sql("join_right", "SELECT o.o_orderkey, c.c_custkey FROM {orders} o RIGHT JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey < 5")
_sql("join_right_filter_all", "SELECT o.o_orderkey, l.l_linenumber FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity > 40")
_sql("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
_sql("join_multiway", """
    SELECT r.r_name, COUNT(*) AS n FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
    JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""")
_sql("join_derived", """
    SELECT c.c_custkey, t.n FROM {customer} c JOIN (SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey) t ON c.c_custkey = t.o_custkey""")
_sql("join_null_keys", "SELECT a.doc_id FROM {labels} a JOIN {labels} b ON NULLIF(a.quality, 0) = NULLIF(b.toxic, 0) AND a.doc_id = b.doc_id")
_sql("cte_multi", """
    WITH big AS (SELECT o_orderkey, o_custkey FROM {orders} WHERE o_totalprice > 200000),
         per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey)
    SELECT c.c_name, per.n FROM per JOIN {customer} c ON per.o_custkey = c.c_custkey WHERE per.n > 1""")


@_query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def cross_domain_import_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cross_domain_import over all orders."""
    from tidemark.plans.names import Domains

    names = Domains({"sales": {"orders": _read(spark, sf_dir, "orders")}, "crm": {"customer": _read(spark, sf_dir, "customer")}})
    return names.sql(spark, "IMPORT crm.customer AS c2; SELECT o.o_orderkey, c.c_name FROM orders o JOIN c2 c ON o.o_custkey = c.c_custkey", ["sales"])


# Aggregation
_sql("agg_basic", """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(l_discount) AS n_discount, ROUND(SUM(l_quantity), 2) AS qty,
           ROUND(AVG(l_extendedprice), 4) AS avg_price, MIN(l_shipdate) AS first_ship, MAX(l_tax) AS max_tax
    FROM {lineitem} GROUP BY l_returnflag, l_linestatus""")
_sql("agg_distinct", """
    SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n_customers, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS s, MIN(DISTINCT o_custkey) AS lo, MAX(DISTINCT o_custkey) AS hi
    FROM {orders} GROUP BY o_orderstatus""")
_sql("agg_avg_distinct", "SELECT p_brand, ROUND(AVG(DISTINCT p_retailprice), 6) AS a FROM {part} GROUP BY p_brand")
_sql("agg_sum_null", "SELECT CAST(SUM(NULLIF(quality, quality)) AS BIGINT) AS s, COUNT(NULLIF(quality, quality)) AS n FROM {labels}")
_sql("agg_having", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING COUNT(*) >= 15 AND SUM(o_totalprice) > 1000000")
_sql("agg_alias_group", "SELECT upper(c_mktsegment) AS seg, COUNT(*) AS n FROM {customer} GROUP BY upper(c_mktsegment)")
_sql("agg_arithmetic_group", "SELECT o_orderkey % 10 AS b, COUNT(*) AS n FROM {orders} GROUP BY o_orderkey % 10")
_sql("agg_arith", "SELECT l_returnflag, ROUND(SUM(l_quantity) / 100.0, 4) AS q, COUNT(*) * 2 + 1 AS m FROM {lineitem} GROUP BY l_returnflag")
_sql("agg_global", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS hi FROM {orders} WHERE o_orderkey < 0")
_sql("agg_order_by_aggregate", "SELECT o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 3")


@_query("SELECT p_brand, CAST(trunc(SUM(p_size) / COUNT(p_size)) AS BIGINT) AS avg_size FROM part GROUP BY p_brand")
def agg_int_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of an integer column are truncated."""
    return _read(spark, sf_dir, "part").groupBy("p_brand").agg(C.avg_int("p_size").alias("avg_size"))


# Windows
_sql("win_row_number", "SELECT conv_id, turn, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role) AS BIGINT) AS rn FROM {conversations}")
_sql("win_rank", "SELECT c_custkey, CAST(RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS r FROM {customer}")
_sql("win_lag", "SELECT event_id, user_id, LAG(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {events}")
_sql("win_lead", "SELECT event_id, user_id, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM {events}")
_sql("win_over_agg", "SELECT o_custkey, n, CAST(RANK() OVER (ORDER BY n DESC) AS BIGINT) AS r FROM (SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey) t")

# Sort, limit, set operations
_sql("order_nulls_all", "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id ORDER BY l.quality, d.doc_id",
     "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id")
_sql("order_nulls_desc_all", "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id ORDER BY l.quality DESC, d.doc_id DESC",
     "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS LAST, d.doc_id DESC")
_sql("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
_sql("range_order_limit", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey >= 900 ORDER BY o_orderkey LIMIT 100")
_sql("limit_offset", "SELECT c_custkey FROM {customer} ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 20")
_sql("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
_sql("set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}")
_sql("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier} WHERE s_nationkey < 12")
_sql("set_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey AS k FROM {supplier} WHERE s_suppkey < 8")


# Scalar functions
@_query("""
    SELECT doc_id, upper(lang) AS u, lower(source) AS lo, CAST(strlen(text) AS BIGINT) AS bytes, lang || '-' || source AS both_, trim(' ' || lang || ' ') AS t,
           replace(source, 'src', 's') AS r, left(text, 3) AS l3, left(text, 0) AS l0, right(text, 2) AS r2, substring(text, 1, 4) AS s4, substring(text, 5, 6) AS s5
    FROM documents""")
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.upper("lang").alias("u"), F.lower("source").alias("lo"), C.length_bytes("text").alias("bytes"), C.concat_all("lang", F.lit("-"), "source").alias("both_"),
        C.trim_all(F.concat(F.lit(" "), "lang", F.lit(" "))).alias("t"), F.replace("source", F.lit("src"), F.lit("s")).alias("r"), C.left_n("text", 3).alias("l3"),
        C.left_n("text", -1).alias("l0"), C.right_n("text", 2).alias("r2"), C.substring_clamped("text", -2, 4).alias("s4"), C.substring_clamped("text", 5, 6).alias("s5"),
    )


@_query("""
    SELECT c_custkey, CAST(abs(c_nationkey - 12) AS BIGINT) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal) AS r,
           round(sqrt(abs(c_acctbal)), 6) AS s, pow(c_nationkey, 2.0) AS p, CASE WHEN c_nationkey = 0 THEN NULL ELSE c_custkey % c_nationkey END AS m
    FROM customer""")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    return _read(spark, sf_dir, "customer").select(
        "c_custkey", C.keep_kind(F.abs, F.col("c_nationkey") - 12, True).alias("a"), C.keep_kind(F.ceil, b, False).alias("c"), C.keep_kind(F.floor, b, False).alias("f"),
        C.keep_kind(F.round, b, False).alias("r"), F.round(F.sqrt(F.abs(b)), 6).alias("s"), F.pow("c_nationkey", F.lit(2.0)).alias("p"), C.mod_or_null("c_custkey", "c_nationkey").alias("m"),
    )


@_query("""
    SELECT event_id, extract(year FROM ts) AS y, extract(month FROM ts) AS mo, extract(day FROM ts) AS d, extract(hour FROM ts) AS h, extract(minute FROM ts) AS mi,
           CAST(extract(second FROM ts) AS BIGINT) AS s, extract(dow FROM ts) AS dow, extract(doy FROM ts) AS doy, epoch_us(ts) / 1e6 AS ep,
           date_trunc('week', ts)::TIMESTAMP AS wk, date_trunc('month', ts)::TIMESTAMP AS mon, date_trunc('hour', ts)::TIMESTAMP AS hr FROM events""")
def fn_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"y": "year", "mo": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second", "dow": "dow", "doy": "doy", "ep": "epoch"}
    trunc = {"wk": "week", "mon": "month", "hr": "hour"}
    return _read(spark, sf_dir, "events").select(
        "event_id", *[C.extract_part(p, "ts").alias(a) for a, p in parts.items()], *[C.date_trunc_ntz(p, "ts").alias(a) for a, p in trunc.items()]
    )


@_query("""
    SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS DOUBLE) AS f, CAST(o_orderkey AS VARCHAR) AS t, NULL::BIGINT AS bad,
           o_orderstatus = '1' AS b, date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders""")
def fn_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    cast = C.cast_or_null
    return _read(spark, sf_dir, "orders").select(
        "o_orderkey", cast(F.col("o_totalprice").cast("string"), "int").alias("i"), cast("o_orderkey", "float").alias("f"), cast("o_orderkey", "text").alias("t"),
        cast("o_orderpriority", "int").alias("bad"), cast("o_orderstatus", "bool").alias("b"), cast("o_orderdate", "date").alias("d"),
    )


_sql("fn_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE o_orderstatus END AS band FROM {orders}")
_sql("fn_coalesce_nullif", "SELECT d.doc_id, COALESCE(l.quality, l.toxic, -1) AS q, NULLIF(d.lang, 'en') AS lang FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")


@_query("SELECT event_id, props::JSON->>'k' AS k, props::JSON->>'missing' AS missing FROM events")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", C.json_path("props", "k").alias("k"), C.json_path("props", "missing").alias("missing"))


# Time travel over the synthetic log of orders: closed forms in SQL
def _as_of_oracle(lsn: int) -> str:
    return f"""
        SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 AND 1000000 + o_orderkey <= {lsn} THEN o_orderstatus ELSE 'N' END AS o_orderstatus,
               CASE WHEN o_orderkey % 3 = 0 AND 1000000 + o_orderkey <= {lsn} THEN 1000000 + o_orderkey ELSE o_orderkey + 1 END AS _lsn
        FROM orders WHERE o_orderkey + 1 <= {lsn} AND NOT (o_orderkey % 10 = 0 AND 2000000 + o_orderkey <= {lsn})"""


def _as_of(name: str, lsn: int | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return state.state_at(S.orders_log(_read(spark, sf_dir, "orders")), lsn)

    run.__name__ = name
    _query(_as_of_oracle(lsn if lsn is not None else 1 << 60))(run)


for _name, _lsn in (("asof_lsn_early", 500), ("asof_lsn", 1_000_500), ("asof_lsn_deletes", 2_000_500), ("asof_head", None)):
    _as_of(_name, _lsn)


@_query(_as_of_oracle(1_000_500))
def asof_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of a time: the last commit not after it is looked up first, so that its LSN is a literal in the plan."""
    log = S.orders_log(_read(spark, sf_dir, "orders"))
    commits = log.select("commit_lsn", S.commit_time("commit_lsn").alias("commit_timestamp"))
    at = state.lsn_at(commits, F.lit("2024-01-12 13:55:00.5").cast("timestamp_ntz")).first()[0]
    return state.state_at(log, at)


@_query("""
    SELECT 'INSERT' AS __operation, o_orderkey + 1 AS __commit_lsn, o_orderkey, o_custkey, 'N' AS o_orderstatus FROM orders UNION ALL
    SELECT 'UPDATE', 1000000 + o_orderkey, o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
    SELECT 'DELETE', 2000000 + o_orderkey, o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'N' END FROM orders WHERE o_orderkey % 10 = 0""")
def row_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.history(S.orders_log(_read(spark, sf_dir, "orders")))


@_query("""
    SELECT commit_lsn, 'orders' AS table_name, op AS operation, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT o_orderkey + 1 AS commit_lsn, 'INSERT' AS op FROM orders UNION ALL SELECT 1000000 + o_orderkey, 'UPDATE' FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT 2000000 + o_orderkey, 'DELETE' FROM orders WHERE o_orderkey % 10 = 0) GROUP BY ALL""")
def timeline_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = state.timeline({"orders": S.orders_log(_read(spark, sf_dir, "orders"))})
    return made.select("commit_lsn", F.explode("changes").alias("c")).select("commit_lsn", "c.table_name", "c.operation", "c.n")


# Entities: users with their events, a commit for each event
_VERSIONS = "SELECT user_id AS root_pk, event_id + 1 AS commit_lsn, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.event_id <= a.event_id) AS version FROM events a"


@_query(f"SELECT root_pk, CAST(version AS BIGINT) AS version, commit_lsn, 'events,users' AS tables FROM ({_VERSIONS})")
def entity_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.user_versions(_read(spark, sf_dir, "events")).withColumn("tables", F.array_join("tables", ","))


@_query("SELECT user_id AS root_pk, CAST(count(*) AS BIGINT) AS version, max(event_id) + 1 AS head_lsn FROM events GROUP BY user_id")
def entity_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.heads(S.user_versions(_read(spark, sf_dir, "events")))


@_query(f"SELECT commit_lsn FROM ({_VERSIONS}) WHERE root_pk = 3 AND version = 5")
def entity_version_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.version_lsn(S.user_versions(_read(spark, sf_dir, "events")), 3, 5)


@_query(f"""SELECT commit_lsn, 'app' AS domain, 'user' AS entity, root_pk, CAST(version AS BIGINT) AS entity_version, '["events","users"]' AS tables
            FROM ({_VERSIONS}) WHERE commit_lsn BETWEEN 100 AND 700""")
def entity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.change_feed(S.user_versions(_read(spark, sf_dir, "events")), "app", "user", 100, 700)


@_query("SELECT user_id AS root_pk, CAST(count(*) AS BIGINT) AS token FROM events GROUP BY user_id")
def resolve_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a versioned reference to each root would capture now: its latest version."""
    return entity.heads(S.user_versions(_read(spark, sf_dir, "events"))).select("root_pk", F.col("version").alias("token"))


# As-of joins by versioned foreign keys
@_query("""
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, CASE WHEN l.l_linenumber % 4 = 0 THEN NULL WHEN l.l_linenumber % 4 = 1 THEN l.l_orderkey + 1 ELSE 1000000 + l.l_orderkey END AS ref,
           CASE WHEN l.l_linenumber % 4 <> 1 AND o.o_orderkey % 3 = 0 THEN o.o_orderstatus ELSE 'N' END AS o_orderstatus
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE NOT (l.l_linenumber % 4 = 0 AND o.o_orderkey % 10 = 0)""")
def vfk_join_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with its order as of the commit the line refers to; a line without one sees the order as it is now."""
    versions = state.intervals(S.orders_log(_read(spark, sf_dir, "orders")))
    met = asof.as_of_join(S.lines_with_reference(_read(spark, sf_dir, "lineitem")), versions, F.col("l_orderkey"), F.col("ref"))
    return met.select("l_orderkey", "l_linenumber", "l_partkey", "ref", "version.row.o_orderstatus")


@_query("""
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, CASE WHEN l.l_linenumber % 4 <> 1 THEN CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_orderstatus ELSE 'N' END END AS o_orderstatus,
           CASE WHEN l.l_linenumber % 4 = 1 THEN 'N' END AS first_status
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_linenumber % 4 = 1 OR o.o_orderkey % 3 = 0 OR o.o_orderkey % 10 <> 0""")
def vfk_join_version_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vfk_join_version over all lines: an order without a second version is as it is now, one deleted by it isn't there."""
    return _lines_at_version(spark, sf_dir, _read(spark, sf_dir, "lineitem"))


def _lines_at_version(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    log = S.orders_log(_read(spark, sf_dir, "orders"))
    numbers = entity.versions(entity.touches(log, "orders"))
    wanted = F.when(F.col("l_linenumber") % 4 == 1, 1).otherwise(2)
    at = asof.with_entity_lsn(lines.select("l_orderkey", "l_linenumber", "l_partkey"), numbers, F.col("l_orderkey"), wanted)
    status = asof.as_of_join(at, state.intervals(log), F.col("l_orderkey"), F.col("__as_of_lsn")).withColumn("s", F.col("version.row.o_orderstatus"))
    first = F.col("l_linenumber") % 4 == 1
    return status.select("l_orderkey", "l_linenumber", "l_partkey", F.when(~first, F.col("s")).alias("o_orderstatus"), F.when(first, F.col("s")).alias("first_status"))


@_query("""
    SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 3 = 0 THEN 1000000 + o.o_orderkey END AS as_of, CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_orderstatus ELSE 'N' END AS o_orderstatus,
           c.c_name || CASE WHEN o.o_orderkey % 3 <> 0 OR c.c_custkey <= o.o_orderkey THEN '*' ELSE '' END AS c_name
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey % 3 = 0 OR o.o_orderkey % 10 <> 0""")
def vfk_join_cascade_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vfk_join_cascade over all orders: without a second version, order and customer are as they are now."""
    return _orders_at_version(spark, sf_dir, _read(spark, sf_dir, "orders"))


def _orders_at_version(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    log = S.orders_log(_read(spark, sf_dir, "orders"))
    at = asof.with_entity_lsn(orders.select("o_orderkey"), entity.versions(entity.touches(log, "orders")), F.col("o_orderkey"), F.lit(2))
    order = asof.as_of_join(at, state.intervals(log), F.col("o_orderkey"), F.col("__as_of_lsn")).select("o_orderkey", "__as_of_lsn", "version.row.o_orderstatus", "version.row.o_custkey")
    customers = state.intervals(S.customers_log(_read(spark, sf_dir, "customer")))
    both = asof.as_of_join(order, customers, F.col("o_custkey"), F.col("__as_of_lsn"))
    return both.select("o_orderkey", F.col("__as_of_lsn").alias("as_of"), "o_orderstatus", "version.row.c_name")


# Writes, as the state after one commit
def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(1).cast("long").alias("_lsn"))


@_query("SELECT o_orderkey, CASE WHEN o_custkey < 40 THEN o_custkey + 1000 ELSE o_custkey END AS o_custkey, CASE WHEN o_custkey < 40 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, "
        "CAST(CASE WHEN o_custkey < 40 THEN 2 ELSE 1 END AS BIGINT) AS _lsn FROM orders")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _orders(spark, sf_dir)
    return dml.apply(now, dml.update(now, "o_orderkey", {"o_custkey": F.col("o_custkey") + 1000, "o_orderstatus": F.lit("X")}, F.col("o_custkey") < 40), "o_orderkey", 2)


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(1 AS BIGINT) AS _lsn FROM orders WHERE o_orderstatus <> 'F'")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _orders(spark, sf_dir)
    return dml.apply(now, dml.delete(now, "o_orderkey", F.col("o_orderstatus") == "F"), "o_orderkey", 2)


_STAGED = "SELECT o_orderkey + 3 AS o_orderkey, o_custkey + 7 AS o_custkey, 'S' AS o_orderstatus FROM orders"


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select((F.col("o_orderkey") + 3).alias("o_orderkey"), (F.col("o_custkey") + 7).alias("o_custkey"), F.lit("S").alias("o_orderstatus"))


@_query(f"SELECT o_orderkey, o_custkey, o_orderstatus, CAST(1 AS BIGINT) AS _lsn FROM orders UNION ALL SELECT s.*, CAST(2 AS BIGINT) FROM ({_STAGED}) s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def upsert_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _orders(spark, sf_dir)
    return dml.apply(now, dml.upsert(now, _staged(spark, sf_dir), "o_orderkey"), "o_orderkey", 2)


@_query(f"""
    SELECT coalesce(o.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL OR s.o_orderkey IS NOT NULL THEN s.o_custkey ELSE o.o_custkey END AS o_custkey,
           CASE WHEN o.o_orderkey IS NULL THEN s.o_orderstatus WHEN s.o_orderkey IS NOT NULL THEN 'U' ELSE o.o_orderstatus END AS o_orderstatus,
           CAST(CASE WHEN s.o_orderkey IS NULL THEN 1 ELSE 2 END AS BIGINT) AS _lsn
    FROM orders o FULL JOIN ({_STAGED}) s ON o.o_orderkey = s.o_orderkey""")
def upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _orders(spark, sf_dir)
    changes = dml.upsert(now, _staged(spark, sf_dir), "o_orderkey", {"o_custkey": "EXCLUDED.o_custkey", "o_orderstatus": F.lit("U")})
    return dml.apply(now, changes, "o_orderkey", 2)


@_query("SELECT 'DELETE' AS op, o_orderkey AS pk FROM orders")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.truncate(_orders(spark, sf_dir), "o_orderkey").select("op", "pk")


# Constraints over a staged batch with faults
_BATCH = """
    SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_orderkey END AS k,
           CASE WHEN o_orderkey % 13 = 0 THEN 999999999 WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS c,
           CASE WHEN o_orderkey % 19 = 0 THEN -1.0 WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END AS price FROM {orders}"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_BATCH, orders=_read(spark, sf_dir, "orders"))


_B = f"({_BATCH.format(orders='orders')})"


@_query(f"SELECT DISTINCT k, CASE WHEN k IS NULL THEN '23502' ELSE '23505' END AS sqlstate FROM (SELECT k, count(*) OVER (PARTITION BY k) AS n FROM {_B}) WHERE k IS NULL OR n > 1")
def check_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.primary_key_violations(_batch(spark, sf_dir), "k")


@_query(f"SELECT k, '23505' AS sqlstate FROM (SELECT k, count(*) AS n FROM {_B} WHERE k IS NOT NULL GROUP BY k) WHERE n > 1 OR k IN (SELECT o_orderkey FROM orders)")
def check_unique_state_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check_unique_state against all orders."""
    return constraints.unique_violations(_batch(spark, sf_dir), "k", _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))


@_query(f"SELECT k, c, price, '23503' AS sqlstate FROM {_B} WHERE c = 999999999")
def check_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.foreign_key_violations(_batch(spark, sf_dir), "c", _read(spark, sf_dir, "customer").unionByName(_read(spark, sf_dir, "orders").selectExpr("o_custkey AS c_custkey", "'' AS c_name", "0 AS c_nationkey", "0D AS c_acctbal", "'' AS c_mktsegment")), "c_custkey")


@_query(f"SELECT k, c, price, '23502' AS sqlstate FROM {_B} WHERE c IS NULL")
def check_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.null_violations(_batch(spark, sf_dir), "c")


@_query(f"SELECT k, c, price, '23514' AS sqlstate FROM {_B} WHERE price < 0")
def check_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.check_violations(_batch(spark, sf_dir), "price >= 0")


@_query("SELECT r_regionkey + 100 AS r_regionkey, CAST((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_regionkey) AS BIGINT) AS id FROM region")
def default_autoincrement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUTOINCREMENT: the table's maximum, and the staged rows numbered after it without a global sort."""
    from tidemark.operators.defaults import autoincrement

    staged = _read(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("r_regionkey"))
    return autoincrement(staged, _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), "id", "r_regionkey")


# Streams
@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: counts by hour and type over the stream of events."""
    counted = S.stream_of_events(spark, sf_dir).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return tail.drain(spark, counted.select(F.col("w.start").alias("start"), "event_type", "n"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


from tidemark.plans import session_queries  # noqa: E402

QUERIES |= session_queries.QUERIES
ORACLE_SQL |= session_queries.ORACLE_SQL
