"""Exports: CSV with fixed columns, JSON lines, reports, and a policy file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One CSV line for each row: the given columns in order, missing ones and nulls empty, others left out; quoted where needed."""

    def cell(c: str):
        if c not in rows.columns:
            return F.lit("")
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return rows.select(F.concat_ws(",", *[cell(c) for c in columns]).alias("line"))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    own = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows.select(*own).write.option("header", True).option("emptyValue", "").csv(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append to a log of JSON lines; a chain of hashes wants one writer at a time."""
    rows.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines as a batch: its rows with their place (`line`: file by file, in a file's order); blank lines go, broken ones raise."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    own = lines.select("file", "at", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x"))
    return own.select(F.struct("file", "at").alias("line"), "x.*")


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document as one row; Spark keeps no copy, so a changed file is read anew."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def document(rows: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """One row: a JSON document with the rows as the array `name`. For summaries that fit one file."""
    rows = rows.select(F.struct(F.col(order).alias("o"), F.struct(*rows.columns).alias("r")).alias("x")) if order else rows.select(F.struct(F.lit(0).alias("o"), F.struct(*rows.columns).alias("r")).alias("x"))
    every = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"])
    return rows.agg(F.to_json(F.struct(every.alias(name))).alias("json"))


def write_document(rows: DataFrame, name: str, path: str, order: str | None = None) -> None:
    document(rows, name, order).coalesce(1).write.text(path)


def read_tile_index(spark: SparkSession, path: str, location: str, box: tuple[float, float, float, float], zoom: int = 9) -> DataFrame:
    """Rows of a CSV index of map tiles (Location, QuadKey, Url, ...) for one location, of the tiles that hold a corner of the box (west, south, east, north)."""
    from landlace.functions.projection import quadkey

    w, s, e, n = box
    rows = spark.read.option("header", True).csv(path).where(F.col("Location") == location).withColumn("QuadKey", F.lpad("QuadKey", zoom, "0"))
    return rows.where(F.col("QuadKey").isin([quadkey(F.lit(lat), F.lit(lon), zoom) for lat in (s, n) for lon in (w, e)]))


def closed_once(elements: DataFrame, key: str = "id") -> DataFrame:
    """Fetched ways (key, line: array of x, y), each once, if they close: four points at least, the last the first."""
    once = elements.dropDuplicates([key])
    return once.where((F.size("line") >= 4) & (F.element_at("line", 1) == F.element_at("line", -1))).withColumn("geom", F.array(F.slice("line", 1, F.size("line") - 1)))


def markdown(metrics: dict[str, dict], labels: dict[str, str]) -> str:
    """A table with a row for each metric and a column for each set of results."""
    names = list(metrics)
    rows = [f"| {text} | " + " | ".join(f"{metrics[n][key]:.1%}" for n in names) + " |" for key, text in labels.items()]
    return "\n".join(["| Metric | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|", *rows])


def policy(text: str) -> dict:
    """A policy from JSON or from the plain part of YAML: nested maps by indent, lists in brackets, maps in braces, comments."""
    if text.lstrip().startswith("{"):
        return json.loads(text)

    def value(s: str):
        s = s.strip()
        if s.startswith("["):
            return [value(x) for x in s[1:-1].split(",") if x.strip()]
        if s.startswith("{"):
            return {k.strip(): value(v) for k, v in (x.split(":", 1) for x in s[1:-1].split(",") if x.strip())}
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return {"true": True, "false": False, "null": None, "": None}.get(s.lower(), s.strip("'\""))

    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        key, _, rest = line.strip().partition(":")
        while stack[-1][0] >= indent:
            stack.pop()
        if rest.strip():
            stack[-1][1][key] = value(rest)
        else:
            stack[-1][1][key] = {}
            stack.append((indent, stack[-1][1][key]))
    return root
