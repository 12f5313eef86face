"""Registered queries of the SQL engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import estimate, hll, sample
from ..operators import dml
from ..sources.parquet import read
from ..types import SqlType

#: SELECTs that engine and oracle run from the same text, with the output names where relations are aliased.
SELECTS: dict[str, tuple[str, str | None]] = {
    "scan_star": ("SELECT * FROM region", None),
    "project_columns": ("SELECT n_name, n_nationkey FROM nation", None),
    "filter_eq_int": ("SELECT * FROM orders WHERE o_custkey = 7", None),
    "filter_eq_string": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", None),
    "filter_lt": ("SELECT p_partkey, p_size FROM part WHERE p_size < 5", None),
    "filter_le": ("SELECT p_partkey, p_size FROM part WHERE p_size <= 5", None),
    "filter_gt": ("SELECT p_partkey, p_size FROM part WHERE p_size > 45", None),
    "filter_ge": ("SELECT p_partkey, p_size FROM part WHERE p_size >= 45", None),
    "filter_ne": ("SELECT p_partkey, p_size FROM part WHERE p_size <> 7", None),
    "filter_or": ("SELECT p_partkey, p_size FROM part WHERE p_size = 7 OR p_size > 48 AND p_partkey < 1000", None),
    "filter_and_chain": ("SELECT p_partkey, p_size FROM part WHERE (p_size >= 10 AND p_size < 20) AND p_partkey <= 1000", None),
    "filter_literal_left": ("SELECT p_partkey, p_size FROM part WHERE 45 < p_size", None),
    "filter_string_range": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'C'", None),
    "filter_column_eq_same_table": ("SELECT n_name, n_nationkey FROM nation WHERE n_nationkey = n_regionkey", None),
    "filter_constant": ("SELECT n_name FROM nation WHERE 1 = 1", None),
    "join_two_way": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_filter_pushdown": ("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND c_nationkey < 5", None),
    "join_three": ("SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey", None),
    "join_clique_three": ("SELECT c_custkey, s_suppkey, n_name FROM customer, supplier, nation WHERE c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND c_nationkey = n_nationkey", None),
    "join_many_to_many": ("SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey", None),
    "join_self": ("SELECT a.n_name, b.n_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey", "left_name,right_name"),
    "join_composite": ("SELECT a.l_orderkey, a.l_partkey, b.l_suppkey FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", "orderkey,partkey,suppkey"),
    "join_mixed_width": ("SELECT event_id, n_name FROM events, nation WHERE user_id = n_nationkey", None),
    "join_flagship": ("SELECT c_custkey, c_name, n_name FROM customer c, nation n, region r WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA'", "c_custkey,c_name,n_name"),
}


def _select(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql, names = SELECTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine.over(spark, sf_dir, [t for t in _TABLES if f" {t}" in sql]).query(sql, names.split(",") if names else None)

    return run


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _select(name) for name in SELECTS}
ORACLE_SQL: dict[str, str] = {}
for _name, (_sql, _names) in SELECTS.items():
    if _names:
        _head, _, _tail = _sql.partition(" FROM ")
        _cols = _head.removeprefix("SELECT ").split(", ")
        _sql = "SELECT " + ", ".join(f"{c} AS {n}" for c, n in zip(_cols, _names.split(","), strict=True)) + " FROM " + _tail
    ORACLE_SQL[_name] = _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["join_flagship"](spark, sf_dir)


def _registered(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_HASHED = "SELECT ('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 12))::BIGINT AS h, o_orderkey FROM orders"


def _counters(where: str = "") -> str:
    return f"SELECT (h >> 42)::INT AS bucket, (42 - CASE WHEN h % 4398046511104 = 0 THEN 0 ELSE length(ltrim(bin(h % 4398046511104), '0')) END)::INT AS lz, count(*) AS cnt FROM ({_HASHED}) {where} GROUP BY ALL"


def _estimate(counters: str) -> str:
    return f"""SELECT round(CASE WHEN e <= 160 AND used < 64 THEN 64 * ln(64.0 / (64 - used)) ELSE e END, 6) AS estimate
FROM (SELECT count(*) AS used, 0.709 * 4096 / (coalesce(sum(power(2.0, -top)), 0) + 64 - count(*)) AS e FROM (SELECT bucket, max(lz) + 1 AS top FROM ({counters}) GROUP BY bucket))"""


@_registered(_counters())
def hll_counters(spark, sf_dir):
    return hll.counters(read(spark, sf_dir, "orders"), "o_custkey")


@_registered(_estimate(_counters()))
def hll_estimate(spark, sf_dir):
    return hll.estimate(hll.counters(read(spark, sf_dir, "orders"), "o_custkey")).select(F.round("estimate", 6).alias("estimate"))


@_registered(_counters("WHERE o_orderkey > 1000"))
def hll_delete(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return hll.delete(hll.counters(o, "o_custkey"), hll.counters(o.where("o_orderkey <= 1000"), "o_custkey"))


@_registered(_counters())
def hll_merge(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return hll.merge(hll.counters(o.where("o_orderkey <= 1000"), "o_custkey"), hll.counters(o.where("o_orderkey > 1000"), "o_custkey"))


@_registered(_counters().replace("o_custkey AS VARCHAR", "CASE WHEN o_orderkey <= 1000 THEN o_custkey + 100000 ELSE o_custkey END AS VARCHAR"))
def hll_update(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    some = o.where("o_orderkey <= 1000")
    return hll.update(hll.counters(o, "o_custkey"), hll.counters(some, "o_custkey"), hll.counters(some.withColumn("o_custkey", F.col("o_custkey") + 100000), "o_custkey"))


@_registered(_counters("WHERE o_orderkey % 7 <> 0"))
def hll_skips_null(spark, sf_dir):
    return hll.counters(read(spark, sf_dir, "orders").withColumn("o_custkey", F.expr("if(o_orderkey % 7 = 0, NULL, o_custkey)")), "o_custkey")


@_registered("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1024")
def sample_bottom_k(spark, sf_dir):
    return sample.bottom_k(read(spark, sf_dir, "orders"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@_registered("""SELECT greatest(count(*) FILTER (WHERE o_custkey < 500) * (SELECT count(*) FROM orders) // count(*), (SELECT count(*) FROM orders) // 2048, 1)::BIGINT AS estimate
FROM (SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1024)""")
def cardinality_estimate(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    n = estimate.estimate(sample.bottom_k(o, ["o_orderkey"]), F.col("o_custkey") < 500, o.count())
    return spark.createDataFrame([(n,)], "estimate long")


@_registered("SELECT count(*) AS cardinality FROM lineitem")
def table_cardinality(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("cardinality"))


_INLINE = [(1, "a", 1), (2, None, 3), (3, "c", None), (4, "d", 4)]
_KINDS = [("a", SqlType("INT")), ("b", SqlType("VARCHAR", 5)), ("c", SqlType("BIGINT"))]
_VALUES = "(VALUES (1, 'a', 1::BIGINT), (2, NULL, 3), (3, 'c', NULL), (4, 'd', 4)) AS v(a, b, c)"


def _inline(spark: SparkSession, sql: str) -> DataFrame:
    engine = Engine(spark)
    engine.values("v", _KINDS, _INLINE)
    return engine.query(sql)


@_registered(f"SELECT * FROM {_VALUES}")
def inline_values(spark, sf_dir):
    return _inline(spark, "SELECT * FROM v")


@_registered(f"SELECT a, b FROM {_VALUES} WHERE a = c")
def filter_null_equality(spark, sf_dir):
    return _inline(spark, "SELECT a, b FROM v WHERE a = c")


@_registered(f"SELECT a FROM {_VALUES} WHERE b <> 'a' OR c < 4")
def filter_null_or(spark, sf_dir):
    return _inline(spark, "SELECT a FROM v WHERE b <> 'a' OR c < 4")


def _copy(spark: SparkSession, sf_dir: str, name: str, source: str, columns: str) -> Engine:
    """An engine with a new table ``name``, filled from a Parquet table."""
    engine = Engine(spark, "marlstone_tables")
    spark.sql(f"DROP TABLE IF EXISTS marlstone_tables.{name}")
    engine.query(f"CREATE TABLE {name} ({columns})")
    dml.append(engine.catalog, name, read(spark, sf_dir, source))
    return engine


_NATION = "n_nationkey INT, n_name VARCHAR(40), n_regionkey INT"


@_registered("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def insert_roundtrip(spark, sf_dir):
    engine = _copy(spark, sf_dir, "region_copy", "region", "r_regionkey INT, r_name VARCHAR(40), PRIMARY KEY (r_regionkey)")
    engine.query("INSERT INTO region_copy VALUES (99, 'ATLANTIS')")
    return engine.query("SELECT * FROM region_copy")


@_registered("SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf_dir):
    return dml.lookup(read(spark, sf_dir, "customer"), F.col("c_custkey") == 42)


@_registered("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'NOWHERE' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_by_key(spark, sf_dir):
    engine = _copy(spark, sf_dir, "nation_updated", "nation", _NATION)
    dml.update(engine.catalog, "nation_updated", F.col("n_nationkey") == 3, {"n_name": F.lit("NOWHERE")})
    return engine.query("SELECT * FROM nation_updated")


@_registered("SELECT * FROM nation WHERE NOT (n_nationkey = 3)")
def delete_by_key(spark, sf_dir):
    engine = _copy(spark, sf_dir, "nation_deleted", "nation", _NATION)
    dml.delete(engine.catalog, "nation_deleted", F.col("n_nationkey") == 3)
    return engine.query("SELECT * FROM nation_deleted")


_WRITTEN = """SELECT ('0x' || substr(md5(v), 1, 12))::BIGINT AS h FROM (
  SELECT CASE WHEN n_nationkey BETWEEN 5 AND 9 THEN NULL ELSE n_name END AS v FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'LEMURIA') WHERE v IS NOT NULL"""


@_registered(_counters().replace(_HASHED, _WRITTEN))
def statistics_after_writes(spark, sf_dir):
    """The sketch that bulk insert, delete, update to NULL and INSERT leave of a column, as another engine finds it saved."""
    engine = _copy(spark, sf_dir, "nation_written", "nation", _NATION)
    dml.delete(engine.catalog, "nation_written", F.col("n_nationkey") == 3)
    dml.update(engine.catalog, "nation_written", F.col("n_nationkey").between(5, 9), {"n_name": F.lit(None)})
    engine.query("INSERT INTO nation_written VALUES (77, 'LEMURIA', 1)")
    other = Engine(spark, "marlstone_tables").catalog
    other.statistics("nation_written")
    return other.sketch("nation_written", "n_name")


@_registered("SELECT count(*) AS cardinality FROM nation WHERE n_nationkey <> 3")
def cardinality_after_writes(spark, sf_dir):
    engine = _copy(spark, sf_dir, "nation_counted", "nation", _NATION)
    dml.delete(engine.catalog, "nation_counted", F.col("n_nationkey") == 3)
    return spark.createDataFrame([(engine.catalog.statistics("nation_counted")["cardinality"],)], "cardinality long")


@_registered("SELECT c_custkey, n_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND c_custkey < 700")
def join_ordered_by_statistics(spark, sf_dir):
    """All relations have statistics, so dynamic programming orders the joins."""
    engine = Engine.over(spark, sf_dir, ["customer", "nation", "region"])
    for name, key in (("customer", "c_custkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        engine.catalog.analyze(name, [key])
    return engine.query("SELECT c_custkey, n_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND c_custkey < 700")
