"""The programmatic API: parse, bind, plan, and hand back a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import errors
from .functions import estimate
from .operators import dml
from .plans import planner
from .plans.binder import Binder, BoundSelect
from .plans.parser import CreateTable, Insert, Select, parse
from .sources import parquet
from .sources.catalog import Catalog
from .sources.inline import inline
from .types import SqlType


class Engine:
    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.catalog = spark, Catalog(spark, database)
        self.binder = Binder(self.catalog.schema)

    @classmethod
    def over(cls, spark: SparkSession, folder: str, tables: list[str] | None = None) -> Engine:
        """An engine over the Parquet tables of a folder."""
        out = cls(spark)
        for t in tables or parquet.TABLES:
            out.catalog.register(t, parquet.read(spark, folder, t))
        return out

    def query(self, sql: str, names: list[str] | None = None) -> DataFrame:
        """SELECT gives its rows (``names`` renames the columns); other statements run and give none."""
        q = parse(sql)
        if isinstance(q, Select):
            return planner.to_dataframe(self.binder.select(q), self.catalog.table, self.sizes, names)
        if isinstance(q, Insert):
            columns, row = self.binder.insert(q)
            schema = ", ".join(f"`{n}` {t.spark().simpleString()}" for n, t in columns)
            dml.append(self.catalog, q.table, self.spark.createDataFrame([row], schema).coalesce(1))
        elif isinstance(q, CreateTable):
            self.catalog.create(q.table, [(n, SqlType(t, k)) for n, t, k in q.columns])
        return self.spark.createDataFrame([], "ok boolean")

    def values(self, name: str, columns: list[tuple[str, SqlType]], rows: list[tuple]) -> DataFrame:
        """An inline table: checked and converted rows, to be queried by ``name``."""
        df = inline(self.spark, columns, rows)
        self.catalog.register(name, df)
        return df

    def sizes(self, q: BoundSelect) -> dict[str, float] | None:
        """Estimated rows of each filtered relation, if all have statistics."""
        own = {t: self.catalog.statistics(t) for t in q.tables.values()}
        if None in own.values():
            return None
        out = {}
        for binding, table in q.tables.items():
            conditions = [planner.condition(x) for x in q.filters.get(binding, ())]
            whole = None
            for c in conditions:
                whole = c if whole is None else whole & c
            out[binding] = float(estimate.estimate(own[table]["sample"].alias(binding), whole, own[table]["cardinality"]))
        return out

    def demo(self) -> None:
        """Two small tables to try the shell with."""
        for sql in (
            "CREATE TABLE river (name VARCHAR(40), km INT, mouth VARCHAR(40))", "CREATE TABLE bridge (title VARCHAR(60), river VARCHAR(40), opened SMALLINT, metres INT)",
            "INSERT INTO river VALUES ('Elbe', 1094, 'North Sea')", "INSERT INTO river VALUES ('Tajo', 1007, 'Atlantic')", "INSERT INTO river VALUES ('Inn', 517, NULL)", "INSERT INTO river VALUES ('Loire', 1006, 'Atlantic')",
            "INSERT INTO bridge VALUES ('Blaues Wunder', 'Elbe', 1893, 280)", "INSERT INTO bridge VALUES ('25 de Abril', 'Tajo', 1966, 2277)", "INSERT INTO bridge VALUES ('Saint-Nazaire', 'Loire', 1975, 3356)", "INSERT INTO bridge VALUES ('Vasco da Gama', 'Tajo', 1998, 12345)",
        ):
            self.query(sql)


__all__ = ["Engine", "errors"]
