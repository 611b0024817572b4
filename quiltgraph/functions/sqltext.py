"""Tables that SQL texts read and write."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shipped

NAME = r"(?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])"
TABLE = rf"({NAME}(?:\s*\.\s*{NAME})*)"
WRITES = [rf"\binsert\s+(?:or\s+\w+\s+|ignore\s+)?into\s+{TABLE}", rf"\bupdate\s+(?:only\s+)?{TABLE}\s+(?:as\s+)?(?:\w+\s+)?set\b", rf"\bdelete\s+from\s+(?:only\s+)?{TABLE}", rf"\breplace\s+into\s+{TABLE}", rf"\btruncate\s+(?:table\s+)?{TABLE}", rf"\bmerge\s+into\s+{TABLE}"]
READS = [rf"(?<!delete )\bfrom\s+(?:only\s+)?{TABLE}", rf"\bjoin\s+(?:lateral\s+)?{TABLE}", rf"\busing\s+{TABLE}"]


def accesses(sql: str) -> list[tuple[str, str]]:
    """(table, read or write), sorted; comments and strings aside; names of WITH parts aren't tables."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql or "", flags=re.S)
    text = re.sub(r"'(?:[^']|'')*'", "''", text)
    text = re.sub(r"\s+", " ", text)
    own = {m.lower() for m in re.findall(rf"(?:\bwith\s+(?:recursive\s+)?|,\s*)({NAME})\s*(?:\([^)]*\)\s*)?as\s*(?:not\s+materialized\s*|materialized\s*)?\(", text, re.I)}

    def clean(t: str) -> str:
        return ".".join(p.strip().strip('"`[]') for p in t.split("."))

    out = set()
    for kind, patterns in (("write", WRITES), ("read", READS)):
        for p in patterns:
            for m in re.finditer(p, text, re.I):
                t = clean(m[1])
                if t.lower() not in own and t.lower() not in ("select", "set", "values", "lateral", "unnest") and text[m.end() : m.end() + 1] != "(":
                    out.add((t, kind))
    return sorted(out)


def table_accesses(sql: Column) -> Column:
    """array<struct<table, access>> of each text, by an Arrow-batched function."""
    shipped(SparkSession.active())

    @F.pandas_udf("array<struct<`table`: string, access: string>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: [{"table": a, "access": b} for a, b in accesses(t)])

    return run(sql)
