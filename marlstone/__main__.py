"""A small shell: ``python -m marlstone [folder of Parquet tables]``; \\q or end of input leaves."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import SqlError
from .operators.writers import show


def main(argv: list[str]) -> None:
    spark = SparkSession.builder.appName("marlstone").config("spark.ui.enabled", "false").getOrCreate()
    engine = Engine.over(spark, argv[0]) if argv else Engine(spark)
    if not argv and not engine.catalog.tables():
        engine.demo()
    try:
        import readline  # noqa: F401  history and editing, where there is a terminal
    except ImportError:
        pass
    while True:
        try:
            line = input("> ").strip()
        except (EOFError, KeyboardInterrupt):
            return
        if line == "\\q":
            return
        if not line:
            continue
        try:
            show(engine.query(line))
        except SqlError as e:
            print(f"{type(e).__name__}: {e}")


if __name__ == "__main__":
    main(sys.argv[1:])
