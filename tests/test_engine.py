import io

import pytest
from pyspark.sql import functions as F

from marlstone import errors as E
from marlstone.engine import Engine
from marlstone.functions import estimate, hll, sample
from marlstone.operators import dml, writers
from marlstone.plans import fanout
from marlstone.plans.joinorder import best_tree
from marlstone.plans.parser import Bool, Comparison, CreateTable, Insert, Literal, Name, Select, parse
from marlstone.types import SqlType, convert


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    views = {
        "l": ("k int, v string", [(1, "a"), (1, "b"), (2, "c"), (None, "d")]), "r": ("k bigint, w string", [(1, "x"), (1, "y"), (None, "z")]),
        "t": ("c int, d int", [(-5, -5), (0, 1), (5, 5), (9, None), (None, None)]), "s": ("x string", [("",), ("a b",), ("it's",), ("(,)",)]),
    }
    for name, (schema, rows) in views.items():
        e.catalog.register(name, spark.createDataFrame(rows, schema))
    return e


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_parser():
    assert parse("sElEcT a, x.b FROM t x wHeRe a >= 5") == Select((Name("a"), Name("b", "x")), (("t", "x"),), Comparison(">=", Name("a"), Literal(5)))
    assert parse("SELECT * FROM t WHERE a=1 AND b=2 OR c<>'x';").where == Bool("OR", (Bool("AND", (Comparison("=", Name("a"), Literal(1)), Comparison("=", Name("b"), Literal(2)))), Comparison("<>", Name("c"), Literal("x"))))
    assert parse("INSERT INTO t VALUES ((1, 'it''s', NULL, -3))") == Insert("t", (1, "it's", None, -3))
    assert parse("CREATE TABLE t(a INT PRIMARY KEY, b VARCHAR(5), PRIMARY KEY (a))") == CreateTable("t", (("a", "INT", None), ("b", "VARCHAR", 5)))
    for bad in ("gibberish", "SELECT FROM t", "SELECT * FROM t LIMIT", "SELECT * FROM t WHERE a = '", "SELECT * FROM t; x", "INSERT INTO t VALUES (a)"):
        with pytest.raises(E.ParseError):
            parse(bad)


def test_joins_keep_all_matches_and_no_nulls(engine):
    assert rows(engine.query("SELECT v, w FROM l, r WHERE l.k = r.k")) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    assert len(rows(engine.query("SELECT a.v, b.v FROM l a, l b WHERE a.k = b.k AND a.v = b.v"))) == 3


def test_filters(engine):
    assert rows(engine.query("SELECT c FROM t WHERE 5 < c")) == [(9,)]
    assert rows(engine.query("SELECT c FROM t WHERE 5 > c")) == [(-5,), (0,)]
    assert rows(engine.query("SELECT c FROM t WHERE c != 5 AND c > -6")) == [(-5,), (0,), (9,)]
    assert rows(engine.query("SELECT c FROM t WHERE c = d")) == [(-5,), (5,)]
    assert set(rows(engine.query("SELECT x FROM s WHERE x = 'it''s' OR x = '(,)' OR x = ''"))) == {("",), ("(,)",), ("it's",)}
    assert len(rows(engine.query("SELECT * FROM t WHERE 1 = 2"))) == 0


@pytest.mark.parametrize(("sql", "error"), [
    ("SELECT * FROM nope", E.RelationNotFound), ("SELECT q FROM t", E.AttributeNotFound), ("SELECT k FROM l, r WHERE l.k = r.k", E.AmbiguousAttribute),
    ("SELECT z.c FROM t", E.UnboundBinding), ("SELECT * FROM t, t", E.DuplicateBinding), ("SELECT * FROM l, t", E.CrossProduct),
    ("SELECT * FROM s WHERE x < 5", E.UncomparableDataTypes), ("SELECT * FROM l, r WHERE l.k < r.k", E.Unimplemented),
])
def test_binding_errors(engine, sql, error):
    with pytest.raises(error):
        engine.query(sql)


def test_conversion():
    assert convert(-32768, SqlType("SMALLINT")) == -32768
    for value, to, error in ((32768, SqlType("SMALLINT"), E.ValueOverflow), ("ééé", SqlType("VARCHAR", 5), E.TooLarge), (1, SqlType("VARCHAR", 9), E.TypeNotConvertible), ("1", SqlType("INT"), E.TypeNotConvertible)):
        with pytest.raises(error):
            convert(value, to)


def test_tables(spark):
    e = Engine(spark, "marlstone_test")
    e.query("CREATE TABLE people (id INT, name VARCHAR(5), age SMALLINT)")
    for error in (E.RelationExists,):
        with pytest.raises(error):
            e.query("CREATE TABLE people (id INT)")
    e.query("INSERT INTO people VALUES (1, 'John', 42)")
    e.query("INSERT INTO people VALUES (2, '', NULL)")
    for sql, error in (("(1, 'J')", E.MissingValues), ("(1, 'J', 2, 3)", E.TooManyValues), ("(1, 2, 42)", E.DataTypeNotConvertible), ("(1, 'ééé', 42)", E.DataTypeNotConvertible)):
        with pytest.raises(error):
            e.query("INSERT INTO people VALUES " + sql)
    assert e.catalog.statistics("people")["cardinality"] == 2
    e.catalog.analyze("people", ["id"])
    dml.append(e.catalog, "people", spark.createDataFrame([(i, "x", 1) for i in range(3, 13)], "id int, name string, age int"))
    assert e.catalog.stats["people"]["cardinality"] == 12
    assert dml.delete(e.catalog, "people", F.col("id") > 10) == 2
    dml.update(e.catalog, "people", F.col("id") == 2, {"name": F.lit("Ann")})
    assert rows(e.query("SELECT name FROM people WHERE id = 2")) == [("Ann",)]
    assert e.catalog.stats["people"]["cardinality"] == 10
    assert rows(e.query("SELECT a.name FROM people a, people b WHERE a.id = b.id AND b.id <= 2")) == [("Ann",), ("John",)]
    again = Engine(spark, "marlstone_test").catalog
    assert again.statistics("people")["cardinality"] == 10 and rows(again.stats["people"]["sample"].select("name").where("id = 2")) == [("Ann",)]
    for c in ("id", "name", "age"):
        assert rows(again.sketch("people", c)) == rows(hll.counters(e.catalog.table("people"), c))
    assert e.catalog.attributes("people")[1] == ("name", SqlType("VARCHAR", 5)) and e.catalog.attribute("people", "age") == SqlType("SMALLINT")
    with pytest.raises(E.AttributeNotFound):
        e.catalog.attribute("people", "nope")
    before = rows(e.query("SELECT * FROM people"))
    with pytest.raises(Exception, match="broken"):
        dml.rewrite(e.catalog, "people", e.catalog.table("people").withColumn("name", F.raise_error(F.lit("broken")).cast("string")))
    assert rows(e.query("SELECT * FROM people")) == before and e.catalog.tables() == ["people"]
    e.catalog.drop_statistics("people")
    spark.sql("DROP DATABASE marlstone_test CASCADE")


def test_joins_follow_statistics(spark):
    """With statistics the smallest relations are joined first, and the build side is hinted; rows are the same."""
    e = Engine(spark)
    e.catalog.register("big", spark.range(5000).selectExpr("id AS k", "id % 50 AS m"))
    e.catalog.register("mid", spark.range(50).selectExpr("id AS m", "id % 5 AS s"))
    e.catalog.register("small", spark.range(5).selectExpr("id AS s", "id AS w"))
    sql = "SELECT k, w FROM big, mid, small WHERE big.m = mid.m AND mid.s = small.s AND w = 3"
    plain = rows(e.query(sql))
    for t, k in (("big", "k"), ("mid", "m"), ("small", "s")):
        e.catalog.analyze(t, [k])
    df = e.query(sql)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert rows(df) == plain and len(plain) == 1000 and "strategy=shuffle_hash" in plan


@pytest.mark.parametrize("third", ["", ", n"])
def test_rows_that_joins_multiply_are_dealt_out(spark, third):
    """Two tables of one split each make 40 million pairs of five keys: no task makes most of them."""
    e = Engine(spark)
    e.catalog.register("l", spark.range(20_000).selectExpr("id AS a", "int(id % 5) AS k").coalesce(1))
    e.catalog.register("r", spark.range(10_000).selectExpr("id AS b", "id % 5 AS m").coalesce(1))
    e.catalog.register("n", spark.range(5).selectExpr("int(id) AS j", "concat('n', id) AS name"))
    df = e.query(f"SELECT a, b{', name' if third else ''} FROM l, r{third} WHERE k = m" + (" AND m = j AND k = j" if third else ""))
    found = df.groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum("a"), F.sum("b")).collect()
    assert [sum(x[i] for x in found) for i in (1, 2, 3)] == [20_000 * 2_000, 2_000 * sum(range(20_000)), 4_000 * sum(range(10_000))]
    assert max(x[1] for x in found) < 0.4 * 20_000 * 2_000


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ROWS": 2, "SLICE_ROWS": 5}, {"SHARED_BYTES": -1, "BLOCK_ROWS": 4, "SLICE_ROWS": 12}])
def test_joins_that_multiply_rows_keep_all_matches(spark, monkeypatch, limits):
    e = Engine(spark)
    e.catalog.register("l", spark.range(60).selectExpr("id AS a", "if(id % 7 = 0, NULL, int(id % 3)) AS k", "concat('v', id % 4) AS v"))
    e.catalog.register("r", spark.range(90).selectExpr("if(id % 5 = 0, NULL, id % 2) AS b", "if(id % 11 = 0, NULL, id % 3) AS m", "concat('v', id % 8) AS w", "id AS c"))
    e.catalog.register("n", spark.range(3).selectExpr("id AS j", "concat('n', id) AS name"))
    queries = [
        "SELECT a FROM r, l WHERE k = m", "SELECT * FROM n, r, l WHERE k = m AND m = j AND k = j AND c < 70", "SELECT a, c FROM l, r WHERE k = m AND v = w",
        "SELECT x.b, y.c, name FROM r x, r y, n WHERE x.m = y.m AND y.m = j AND x.c < 20",
    ]
    plain = [rows(e.query(q)) for q in queries]
    for name, value in {"SMALL_BYTES": -1, "FACTOR": 0, "DEALT_ROWS": 9, **limits}.items():
        monkeypatch.setattr(fanout, name, value)
    for q, want in zip(queries, plain, strict=True):
        df = e.query(q)
        assert rows(df) == want and "posexplode" in df._jdf.queryExecution().analyzed().toString()


def test_inline_and_shell(spark, monkeypatch, capsys):
    e = Engine(spark)
    e.values("v", [("a", SqlType("SMALLINT")), ("b", SqlType("VARCHAR", 3))], [(1, "x"), (2, None)])
    assert rows(e.query("SELECT b FROM v WHERE a > 0")) == [("x",), (None,)]
    for bad, error in (((1,), E.MissingValues), ((1, "x", 2), E.TooManyValues), ((1, "éé"), E.TooLarge)):
        with pytest.raises(error):
            e.values("w", [("a", SqlType("INT")), ("b", SqlType("VARCHAR", 3))], [bad])
    from marlstone import __main__ as shell

    monkeypatch.setattr(shell.Engine, "over", classmethod(lambda cls, s, folder: e))
    lines = iter(["", "SELECT a FROM v", "nonsense", "\\q"])
    monkeypatch.setattr("builtins.input", lambda prompt: next(lines))
    shell.main(["folder"])
    out = capsys.readouterr().out
    assert "1" in out and "ParseError" in out


def test_hll(spark):
    sketch = hll.counters(spark.range(200_000), "id")
    assert 140_000 < hll.estimate(sketch).head()[0] < 260_000
    assert hll.estimate(hll.delete(sketch, sketch)).head()[0] == 0
    a, b = hll.counters(spark.range(500), "id"), hll.counters(spark.range(500, 1000), "id")
    assert rows(hll.merge(a, b)) == rows(hll.counters(spark.range(1000), "id"))
    assert rows(hll.delete(hll.merge(a, b), b)) == rows(a)


def test_sample_and_estimate(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "k")
    assert estimate.estimate(sample.bottom_k(df, ["k"]), F.col("k") < 5, 10) == 4
    assert estimate.filtered(0, 1024, 10_000) == 4
    a, b = sample.bottom_k(df.where("k <= 5"), ["k"], 4), sample.bottom_k(df.where("k > 5"), ["k"], 4)
    assert rows(sample.merge(a, b, ["k"], 4)) == rows(sample.bottom_k(df, ["k"], 4))


def test_join_order():
    t = best_tree({"a": 100, "b": 1}, [("a", "b")], {("a", "b"): 0.01})
    assert (t.cost, t.order) == (1.0, ("b", "a"))
    chain = best_tree({"a": 1000, "b": 10, "c": 10}, [("a", "b"), ("b", "c")])
    # b and c make 10 rows, and with a 1,000; a first would make 1,000 twice.
    assert chain.cost == 10 + 1000 and {chain.left.relations, chain.right.relations} == {frozenset("a"), frozenset("bc")}


def test_writer(spark):
    out = io.StringIO()
    writers.show(spark.createDataFrame([(1, 'a"b', None)], "x int, y string, z binary"), out)
    assert out.getvalue() == 'x | y | z\n1 | "a\\"b" | [null]\n'
    assert writers.show(spark.range(0), out) == 0
