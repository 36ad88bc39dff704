"""Profiles of tables: all of a table's column statistics in one aggregation."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = ("quick", "standard", "full")
STATISTICS = ("n_rows", "n_nulls", "null_percent", "n_distinct", "low", "high", "mean", "deviation", "n_true", "n_false", "sample")


def kind_of(data_type: T.DataType) -> str:
    """numeric, temporal, boolean, text or other."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "text" if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)) else "other"


def _statistics(name: str, kind: str, level: str, exact: bool) -> dict[str, Column]:
    c, text, double = F.col(f"`{name}`"), F.lit(None).cast("string"), F.lit(None).cast("double")
    whole = F.lit(None).cast("long")
    nulls = F.count("*") - F.count(c)
    out = {
        "n_rows": F.count("*"),
        "n_nulls": nulls,
        "null_percent": F.round(F.when(F.count("*") > 0, 100.0 * nulls / F.count("*")), 3),
        "n_distinct": whole, "low": text, "high": text, "mean": double, "deviation": double, "n_true": whole, "n_false": whole, "sample": text,
    }
    if level == "quick":
        return out
    if kind != "other":
        out["n_distinct"] = F.countDistinct(c) if exact else F.approx_count_distinct(c)
    if kind in ("numeric", "temporal"):
        out |= {"low": F.min(c).cast("string"), "high": F.max(c).cast("string")}
    if kind == "numeric":
        out["mean"] = F.avg(c.cast("double"))
        if level == "full":
            out["deviation"] = F.stddev_samp(c.cast("double"))
    elif kind == "boolean":
        out |= {"n_true": F.count_if(c), "n_false": F.count_if(~c)}
    elif kind == "text":
        n = F.char_length(c)
        out |= {"low": F.min(n).cast("string"), "high": F.max(n).cast("string"), "mean": F.avg(n.cast("double"))}
        if level == "full":
            out["sample"] = F.substring(F.min(c), 1, 200)
    return out


#: log2 of a sketch's buckets: a relative standard error of 0.83 / sqrt(4096) = 1.3 %.
SKETCH_BITS = 12


def distinct_sketches(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """A sketch of the distinct values of each column for each value of ``by``: kept, they stand for the rows.

    Sketches of parts can be united in any order and number, so only new parts, such as days, are read again.
    """
    return rows.groupBy(by).agg(*(F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(c) for c in columns))


def united_distinct(sketches: DataFrame, *columns: str, by: str | None = None) -> DataFrame:
    """About how many distinct values the sketched columns have over all parts, or for each value of ``by``."""
    made = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("long").alias(c) for c in columns]
    return sketches.groupBy(by).agg(*made) if by else sketches.agg(*made)


def refreshed_sketches(sketches: DataFrame, rows: DataFrame, by: str, parts: Sequence, *columns: str) -> DataFrame:
    """``sketches`` with those of some parts made anew from ``rows``, of which no other part is read."""
    new = distinct_sketches(rows.filter(F.col(by).isin(list(parts))), by, *columns)
    return sketches.filter(~F.col(by).isin(list(parts))).unionByName(new)


def profile_table(rows: DataFrame, level: str = "standard", limit: int | None = None, most_columns: int = 200, exact: bool = False) -> DataFrame:
    """A row of statistics for each column. Text columns give the lengths of their values as low, high and mean.

    ``limit`` profiles a sample of so many rows.
    """
    if level not in LEVELS:
        raise ValueError(f"no such level: {level}")
    rows = rows if limit is None else rows.limit(limit)
    fields = rows.schema.fields[:most_columns]
    made = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(kind_of(f.dataType)).alias("kind"),
            *(v.alias(k) for k, v in _statistics(f.name, kind_of(f.dataType), level, exact).items()),
        )
        for f in fields
    ]
    return rows.agg(F.array(*made).alias("columns")).select(F.inline("columns"))


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """The number of rows of each table; null, and the flag ``missing``, for those that aren't there."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    out = None
    for name, rows in tables.items():
        if rows is None:
            part = spark.createDataFrame([(name, None, True)], "table_name string, n_rows long, missing boolean")
        else:
            part = rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(False).alias("missing"))
        out = part if out is None else out.unionByName(part)
    return out


def value_counts(rows: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Values by frequency, ties by value."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), F.asc_nulls_last(column))
    return counted if most is None else counted.limit(most)


def report(tables: dict[str, DataFrame], at: datetime, level: str = "standard") -> dict:
    """Profiles of several tables as plain values: each with its rows and columns, or with the error that it gave.

    A column that can't be profiled has an ``error`` in place of statistics; the others of its table have theirs.
    """
    out = []
    for name, rows in tables.items():
        entry: dict = {"table": name, "n_columns": len(rows.columns), "n_rows": None, "columns": [], "error": None}
        out.append(entry)
        try:
            entry["columns"] = [r.asDict() for r in profile_table(rows, level).collect()]
        except PySparkException:
            for column in rows.columns:
                try:
                    entry["columns"].append(profile_table(rows.select(f"`{column}`"), level).first().asDict())
                except PySparkException as failed:
                    entry["columns"].append({"column_name": column, "error": str(failed).splitlines()[0][:300]})
        counts = [c["n_rows"] for c in entry["columns"] if "n_rows" in c]
        entry["n_rows"] = counts[0] if counts else None
        if entry["columns"] and not counts:
            entry["error"] = "no column could be profiled"
    return {"generated_at": at.isoformat(sep=" "), "level": level, "tables": out}


def as_markdown(found: dict) -> str:
    """A report as Markdown: a line for each table and column, with the statistics that there are."""
    lines = ["# Profile", "", f"- generated (UTC): {found['generated_at']}", f"- level: {found['level']}", ""]
    for t in found["tables"]:
        lines.append(f"## {t['table']}: {'?' if t['n_rows'] is None else t['n_rows']} rows, {t['n_columns']} columns")
        lines += [f"- error: {t['error']}"] if t["error"] else []
        for c in t["columns"]:
            if c.get("error"):
                lines.append(f"- `{c['column_name']}`: error: {c['error']}")
                continue
            shown = ("null_percent", "n_distinct", "low", "high", "mean", "deviation", "n_true", "n_false", "sample")
            parts = [f"{k} {c[k]}" for k in shown if c.get(k) is not None]
            lines.append(f"- `{c['column_name']}` ({c['data_type']})" + (": " + ", ".join(parts) if parts else ""))
        lines.append("")
    if not found["tables"]:
        lines.append("No tables.")
    return "\n".join(lines).rstrip() + "\n"


def write_report(spark: SparkSession, found: dict, folder: str) -> None:
    """A report as ``json`` and ``markdown`` text under a folder that Spark writes to; two small files."""
    for kind, text in (("json", json.dumps(found, default=str)), ("markdown", as_markdown(found))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{kind}")
