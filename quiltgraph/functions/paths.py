"""Paths: argument matching, globs, ignore rules, folders, owners by longest prefix."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned(wanted: str) -> str:
    return re.sub(r"^\./", "", wanted.replace("\\", "/"))


def matches_file(path: Column, wanted: str) -> Column:
    """The path itself, or one that ends with it after a slash."""
    w = cleaned(wanted)
    return F.coalesce((path == w) | path.endswith("/" + w), F.lit(False))


def matches_file_or_directory(path: Column, wanted: str) -> Column:
    w = cleaned(wanted).rstrip("/")
    if not w:
        return F.coalesce(path != "", F.lit(False))
    return F.coalesce((path == w) | path.endswith("/" + w) | path.startswith(w + "/") | path.contains("/" + w + "/"), F.lit(False))


def glob_regex(pattern: str, braces: bool = True) -> str:
    """A Java and Python regular expression for a whole relative path.

    ``*`` and ``?`` stay within a folder, ``**`` as a whole part takes any number of folders, ``[..]``
    and ``[!..]`` are classes, ``{a,b}`` alternatives; a backslash takes the next character as it is.
    """
    parts = re.findall(r"\\.|\*+|\?|\[(?:!|\^)?\]?[^\]]*\]|.", pattern, re.S)
    out, depth, at = [], 0, 0
    k = 0
    while k < len(parts):
        p = parts[k]
        after = pattern[at + len(p) :]
        whole = (at == 0 or pattern[at - 1] == "/") and p == "**"
        if whole and not after:
            out.append(".*")
        elif whole and after.startswith("/"):
            out.append("(?:[^/]*/)*")
            at += 1
            k += 1
        elif p.startswith("*"):
            out.append("[^/]*")
        elif p == "?":
            out.append("[^/]")
        elif len(p) > 1 and p[0] == "[":
            negated = p[1] in "!^"
            body = re.sub(r"\\(.)", r"\1", p[2 if negated else 1 : -1])
            body = re.sub(r"([\\\]\[^&])", r"\\\1", body)
            out.append(f"[^/{body}]" if negated else f"[{body}]")
        elif len(p) > 1 and p[0] == "\\":
            out.append(re.escape(p[1]))
        elif braces and p == "{" and "}" in after:
            depth += 1
            out.append("(?:")
        elif depth and p == "}":
            depth -= 1
            out.append(")")
        elif depth and p == ",":
            out.append("|")
        else:
            out.append(re.escape(p))
        at += len(p)
        k += 1
    return "^(?:" + "".join(out) + ")$"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, bool, bool]]:
    """(regex, negated, folders only) of an ignore file in ``folder``; regexes are for paths from the root."""
    out = []
    base = re.escape(folder.rstrip("/") + "/") if folder else ""
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = glob_regex(line.lstrip("/"), braces=False)[4:-2]
        out.append((f"^{base}{'' if anchored else '(?:.*/)?'}(?:{body})", negated, only))
    return out


def ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether a file's path is ignored: the last rule that takes it, or a folder it is in, decides."""
    out = F.lit(False)
    for regex, negated, only in rules:
        hit = path.rlike(regex + ("/" if only else "(?:/|$)"))
        out = F.when(hit, F.lit(not negated)).otherwise(out)
    return out


def directory_chain(path: Column) -> Column:
    """All folders above a path, from the top; none for a path without a slash."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def folder_at(path: Column, depth: int) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.greatest(F.size(parts) - 1, F.lit(1)))), "/")


def longest_owner(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(path), (owner) folders -> (path, owner): the deepest owner a path is in; null for none.

    An equi-join of each path's folders with the owners, so no path meets an owner that isn't above it.
    """
    above = files.select("path", F.explode_outer(directory_chain(F.col("path"))).alias("owner"))
    hit = above.join(owners.select("owner").distinct(), "owner").groupBy(F.col("path").alias("p")).agg(F.max_by("owner", F.char_length("owner")).alias("owner"))
    return files.select("path").distinct().join(hit, F.col("path") == F.col("p"), "left").select("path", "owner")
