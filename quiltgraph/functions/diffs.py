"""Unified diffs as tables, and what their changed lines touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END = 9_223_372_036_854_775_807


def changed_ranges(lines: DataFrame) -> DataFrame:
    """(diff, n, line) in order -> (diff, file, start, end): ranges of lines in the new files, by the unified format.

    A hunk's header gives the first new line and how many follow (1 if left out). With 0, nothing new is
    there, and the header names the line before: that line (the first, at least) stands for the change.
    Where the new file is /dev/null, every line of the old one has changed.
    """
    w = Window.partitionBy("diff").orderBy("n")
    old = F.when(F.col("line").startswith("--- "), F.when(F.col("line") == "--- /dev/null", "").otherwise(F.expr("substring(line, 7)")))
    new = F.when(F.col("line").startswith("+++ "), F.when(F.col("line") == "+++ /dev/null", "").otherwise(F.expr("substring(line, 7)")))
    d = lines.withColumn("old", F.last(old, ignorenulls=True).over(w)).withColumn("is_new", new).withColumn("new", F.last(new, ignorenulls=True).over(w))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start = F.regexp_extract("line", hunk, 1).try_cast("long")
    size = F.coalesce(F.regexp_extract("line", hunk, 2).try_cast("long"), F.lit(1))
    gone = d.filter("is_new = '' and old <> ''").select("diff", F.col("old").alias("file"), F.lit(1).cast("long").alias("start"), F.lit(END).alias("end"))
    hit = d.filter(F.col("line").rlike(hunk) & (F.col("new") != "")).select("diff", F.col("new").alias("file"), start.alias("s"), size.alias("n"))
    some = hit.select("diff", "file", F.when(F.col("n") == 0, F.greatest("s", F.lit(1))).otherwise(F.col("s")).alias("start"), F.when(F.col("n") == 0, F.greatest("s", F.lit(1))).otherwise(F.col("s") + F.col("n") - 1).alias("end"))
    return some.unionByName(gone)


def touched(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols (file, line, end_line, ...) whose span overlaps a range of their file; each once."""
    r = ranges.select(F.col("file").alias("r_file"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    cond = (F.col("file") == F.col("r_file")) & (F.col("r_start") <= F.coalesce("end_line", "line")) & (F.col("line") <= F.col("r_end"))
    return symbols.join(r, cond, "left_semi")
