"""Analyses on top of traversals, and how results are cut for a caller: paging, budgets, verdicts."""

from __future__ import annotations

import base64
import csv
import hashlib
import io
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traverse import bfs

MOST_ROWS = 1_000
BUDGET_CHARS = 24_000


def merged(df: DataFrame, fixed: list[str], varying: list[str], name: str) -> DataFrame:
    """Rows that are equal but for ``varying`` become one, with the varying parts in a sorted list."""
    return df.groupBy(*fixed).agg(F.array_sort(F.collect_set(F.struct(*varying) if len(varying) > 1 else F.col(varying[0]))).alias(name))


def best_without_tie(df: DataFrame, group: list[str], score: Column) -> DataFrame:
    """The row of the highest score of each group; groups whose highest score is shared give none."""
    d = df.withColumn("__score", score)
    top = d.groupBy(*group).agg(F.max("__score").alias("__top"))
    alone = d.join(top, group).filter("__score = __top")
    one = alone.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*df.columns)).alias("__r"))
    return one.filter("__n = 1").select("__r.*")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds unique_name: repeats of a name in ``order`` get #2, #3 and so on."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("unique_name", F.concat(F.col(name), F.when(k > 1, F.concat(F.lit("#"), k.cast("string"))).otherwise("")))


def impact(calls: DataFrame, seeds: DataFrame, depth: int, dependents: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a change of ``seeds`` reaches: callers by depth, and for each named edge table (src uses dst)
    the users of any of them with the least depth."""
    callers = bfs(calls, seeds, depth, up=True)
    out = {"callers": callers.filter("depth > 0")}
    for name, edges in dependents.items():
        hit = edges.join(callers.select(F.col("id").alias("dst"), "depth"), "dst")
        out[name] = hit.groupBy(F.col("src").alias("id")).agg(F.min("depth").alias("depth"))
    return out


def unused(nodes: DataFrame, edges: list[DataFrame], but: DataFrame | None = None) -> DataFrame:
    """Nodes in no edge table, at either end, and not among ``but``."""
    out = nodes
    for e in edges:
        out = out.join(e.select(F.col("src").alias("id")), "id", "left_anti").join(e.select(F.col("dst").alias("id")), "id", "left_anti")
    return out if but is None else out.join(but.select("id"), "id", "left_anti")


def references(wanted: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, ref): everything that points at wanted ids, by kind of edge table, each once."""
    out = None
    for kind, e in kinds.items():
        d = e.join(wanted.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.lit(kind).alias("kind"), F.col("src").alias("id"), F.col("dst").alias("ref"))
        out = d if out is None else out.unionByName(d)
    return out.distinct()


def verdict(found: DataFrame, most: int) -> dict:
    """Whether a count stays within a limit: for checks in continuous integration."""
    n = found.limit(most + 1).count() if most < MOST_ROWS else found.count()
    return {"count": n, "max": most, "ok": n <= most}


@dataclass(frozen=True)
class Page:
    offset: int = 0
    limit: int = 50


def _digest(tool: str, args: dict) -> str:
    told = json.dumps([tool, {k: v for k, v in sorted(args.items()) if k not in ("cursor", "limit")}])
    return hashlib.sha256(told.encode()).hexdigest()[:16]


def cursor(tool: str, args: dict, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"offset": offset, "of": _digest(tool, args)}).encode()).decode().rstrip("=")


def page_of(tool: str, args: dict, limit: int = 50) -> Page:
    """The page that args' cursor asks for; a cursor of other arguments is an error."""
    c = args.get("cursor")
    if c is None:
        return Page(0, limit)
    try:
        told = json.loads(base64.urlsafe_b64decode(c + "=" * (-len(c) % 4)))
        offset, of = int(told["offset"]), told["of"]
    except Exception as e:
        raise ValueError("not a cursor") from e
    if of != _digest(tool, args) or offset < 0:
        raise ValueError("the cursor belongs to another call")
    return Page(offset, limit)


def window(df: DataFrame, order: list[str], page: Page) -> DataFrame:
    """A page's rows and one more, by a total order."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).offset(page.offset).limit(page.limit + 1)


def paged(tool: str, args: dict, df: DataFrame, order: list[str], limit: int = 50) -> dict:
    page = page_of(tool, args, limit)
    rows = [r.asDict(True) for r in window(df, order, page).collect()]
    more = len(rows) > page.limit
    return {"rows": rows[: page.limit], "nextCursor": cursor(tool, args, page.offset + page.limit) if more else None}


def within_budget(result: dict, chars: int = BUDGET_CHARS) -> dict:
    """Halves the longest list of a result until its JSON fits."""
    result = dict(result)
    while len(json.dumps(result, default=str)) > chars:
        lists = {k: v for k, v in result.items() if isinstance(v, list) and len(v) > 1}
        if not lists:
            break
        k = max(lists, key=lambda k: len(json.dumps(lists[k], default=str)))
        result[k] = lists[k][: len(lists[k]) // 2]
        result["truncated"] = True
    return result


def raw_rows(df: DataFrame, most: int = MOST_ROWS) -> dict:
    """Up to ``most`` rows of a query and whether there were more."""
    rows = [r.asDict(True) for r in df.limit(most + 1).collect()]
    return {"rows": rows[:most], "truncated": len(rows) > most}


def parameters(told: list[str]) -> dict:
    """Query parameters from name=json texts; what isn't JSON is a string."""
    out = {}
    for t in told:
        name, sep, value = t.partition("=")
        if not sep or not name:
            raise ValueError(f"not name=value: {t}")
        try:
            out[name] = json.loads(value)
        except ValueError:
            out[name] = value
    return out


def rendered(df: DataFrame, form: str = "json", most: int = MOST_ROWS) -> str:
    """Up to ``most`` rows for a terminal: json (a list), csv or an aligned table. Whole results are written by Spark."""
    rows = raw_rows(df, most)["rows"]
    if form == "json":
        return json.dumps(rows, default=str, ensure_ascii=False)
    cells = [["" if v is None else v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False) for v in r.values()] for r in rows]
    if form == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([df.columns, *cells])
        return out.getvalue()
    if form != "table":
        raise ValueError(f"unknown form {form}")
    widths = [max(len(c), *(len(r[k]) for r in cells), 0) for k, c in enumerate(df.columns)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in [df.columns, *cells])
