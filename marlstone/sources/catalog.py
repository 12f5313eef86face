"""Catalog of the engine's tables on Spark's session catalog, with statistics side tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import errors as E
from ..functions import hll, sample
from ..types import SqlType, from_spark

#: What a table's statistics are saved under, after its name.
SUFFIX = "__statistics"


class Catalog:
    """Tables of one database, and read-only views registered on top of them.

    Declared types are kept as column comments, since Parquet knows no VARCHAR
    bounds in bytes.  Names are case-sensitive here, whatever Spark folds.
    """

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database
        if database != "default":
            spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        self.views: dict[str, DataFrame] = {}
        self.stats: dict[str, dict] = {}

    def path(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def register(self, name: str, df: DataFrame) -> None:
        self.views[name] = df

    def tables(self) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary and not t.name.endswith(SUFFIX)] + list(self.views)

    def exists(self, name: str) -> bool:
        return name in self.views or name == name.lower() and self.spark.catalog.tableExists(f"{self.database}.{name}")

    def table(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise E.RelationNotFound(name)
        return self.views[name] if name in self.views else self.spark.table(self.path(name))

    def schema(self, name: str) -> list[tuple[str, SqlType]] | None:
        if not self.exists(name):
            return None
        return [(f.name, from_spark(f.dataType, (f.metadata or {}).get("comment"))) for f in self.table(name).schema.fields]

    def create(self, name: str, columns: list[tuple[str, SqlType]]) -> None:
        if name != name.lower():
            raise E.Unimplemented(f"table names are lower case: {name}")
        if self.exists(name):
            raise E.RelationExists(name)
        seen: set[str] = set()
        for n, _ in columns:
            if n.lower() in seen:
                raise E.DuplicateAttribute(n)
            seen.add(n.lower())
        body = ", ".join(f"`{n}` {t.spark().simpleString()} COMMENT '{t}'" for n, t in columns)
        self.spark.sql(f"CREATE TABLE {self.path(name)} ({body}) USING parquet")
        self.drop_statistics(name)  # of an older table of this name
        self.analyze(name)
        self.save_statistics(name)

    def attributes(self, table: str) -> list[tuple[str, SqlType]]:
        """Names and types of a table's columns, in order."""
        own = self.schema(table)
        if own is None:
            raise E.RelationNotFound(table)
        return own

    def attribute(self, table: str, name: str) -> SqlType:
        for n, kind in self.attributes(table):
            if n == name:
                return kind
        raise E.AttributeNotFound(f"{table}.{name}")

    # Statistics: cardinality, the columns' sketches and a sample.  Tables have them from their creation on; the writers in
    # operators.dml keep them up to date and save them, so another session finds them.  Views have them once analysed.

    def statistics(self, name: str) -> dict | None:
        """A table's statistics, from this session or as they were saved; None if there are none."""
        if name not in self.stats and name not in self.views and self.spark.catalog.tableExists(f"{self.database}.{name}{SUFFIX}"):
            self.load_statistics(name)
        return self.stats.get(name)

    def analyze(self, name: str, keys: list[str] | None = None, columns: list[str] | None = None, size: int = sample.SIZE) -> dict:
        """Take statistics anew: one pass counts rows and all columns' values, one more draws the sample.

        ``keys`` name the rows of the sample (all simple columns if not given).
        """
        df = self.table(name)
        simple = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
        columns, keys = columns or simple, keys or simple
        return self.keep(name, keys, columns, hll.table_counters(df, columns), sample.bottom_k(df, keys, size))

    def keep(self, name: str, keys: list[str], columns: list[str], sketches: DataFrame, drawn: DataFrame) -> dict:
        """Hold statistics as small tables without a past: a sketch has some 2,750 rows a column at most, a sample its size."""
        rows = sketches.collect()
        self.stats[name] = {
            "keys": keys, "columns": columns, "cardinality": next((r.cnt for r in rows if r.attribute is None), 0),
            "sketches": self.spark.createDataFrame([tuple(r) for r in rows], "attribute string, bucket int, lz int, cnt long").coalesce(1),
            "sample": self.spark.createDataFrame(drawn.collect(), drawn.schema).coalesce(1),
        }
        return self.stats[name]

    def sketch(self, name: str, column: str) -> DataFrame:
        """(bucket, lz, cnt) of one column."""
        return self.stats[name]["sketches"].where(F.col("attribute") == column).drop("attribute")

    def save_statistics(self, name: str) -> None:
        """Persist a table's statistics beside it, as one row."""
        s = self.stats[name]
        drawn = [r.x for r in s["sample"].select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("x")).collect()]
        body = json.dumps({"keys": s["keys"], "columns": s["columns"], "sketches": [list(r) for r in s["sketches"].collect()], "sample": drawn})
        self.spark.createDataFrame([(body,)], "body string").coalesce(1).write.mode("overwrite").saveAsTable(self.path(name + SUFFIX))

    def load_statistics(self, name: str) -> dict:
        s = json.loads(self.spark.table(self.path(name + SUFFIX)).head().body)
        kinds = StructType([*self.table(name).schema.fields, StructField("__hash__", StringType())])
        drawn = self.spark.createDataFrame([(x,) for x in s["sample"]], "x string").select(F.from_json("x", kinds).alias("x")).select("x.*")
        sketches = self.spark.createDataFrame([tuple(r) for r in s["sketches"]], "attribute string, bucket int, lz int, cnt long")
        return self.keep(name, s["keys"], s["columns"], sketches, drawn)

    def drop_statistics(self, name: str) -> None:
        self.stats.pop(name, None)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.path(name + SUFFIX)}")
