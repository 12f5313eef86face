"""Sinks for result rows: any callback, and the printer of the shell."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame


def text(v) -> str:
    """[null], numbers plain, strings quoted and escaped, binary as 0x and hex."""
    if v is None:
        return "[null]"
    if isinstance(v, (bytes, bytearray)):
        return "0x" + bytes(v).hex()
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
    return str(v)


def write(df: DataFrame, writer: Callable[[tuple], None]) -> int:
    """Hand every row to ``writer``, one partition at a time on the driver."""
    n = 0
    for row in df.toLocalIterator():
        writer(tuple(row))
        n += 1
    return n


def show(df: DataFrame, out=None) -> int:
    """A header before the first row, none for empty results."""
    out = out or sys.stdout
    state = {"header": True}

    def line(row: tuple) -> None:
        if state.pop("header", False):
            print(" | ".join(df.columns), file=out)
        print(" | ".join(map(text, row)), file=out)

    return write(df, line)
