"""Changed ranges from diffs, and owners from owner files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def diff_ranges(diff: str) -> list[tuple[str, int, int]]:
    """(path, first line, last line) of the new side of a unified diff; hunks that only delete, and deleted files, have none."""
    out, path = [], None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            name = line[4:].split("\t")[0].strip().strip('"')
            path = None if name == "/dev/null" else re.sub(r"^b/", "", name)
        elif path and (m := _HUNK.match(line)):
            count = int(m[2]) if m[2] is not None else 1
            if count:
                out.append((path, int(m[1]), int(m[1]) + count - 1))
    return out


def owner_rules(text: str) -> list[tuple[int, str, str]]:
    """(number, regular expression, owners) of an owner file's lines, in order."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        parts = line.split("#")[0].split()
        if parts:
            out.append((n, _pattern(parts[0]), " ".join(parts[1:])))
    return out


def _pattern(glob: str) -> str:
    """A path pattern as a regular expression: without an inner slash it fits at any depth, a folder fits what is in it."""
    anchored = "/" in glob.rstrip("/")
    body = re.escape(glob.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(?:^|.*/)") + body + ("/.*$" if glob.endswith("/") else "(?:/.*)?$")


def owned(spark: SparkSession, files: DataFrame, text: str) -> DataFrame:
    """``files`` (path) with ``owners`` of the last rule that fits, empty if that names none; null without a rule."""
    rules = owner_rules(text)
    if not rules:
        return files.select("path").withColumn("owners", F.lit(None).cast("string"))
    table = spark.createDataFrame(rules, "n int, pattern string, owners string")
    hits = files.select("path").join(F.broadcast(table), F.expr("path RLIKE pattern"))  # one owner file's rules
    last = hits.groupBy("path").agg(F.max_by("owners", "n").alias("owners"))
    return files.select("path").join(last, "path", "left")
