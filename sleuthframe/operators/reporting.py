"""Reports of diagnostics: nested JSON, plain text, exit status.

A null flag counts as false. Repeated rows are reported as often as they occur;
findings with equal places keep the order of their rules and messages. No findings
give an empty report, counts of zero and status 0. Other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flag(found: DataFrame, name: str):
    return F.coalesce(F.col(name), F.lit(False)) if name in found.columns else F.lit(False)


def json_report(found: DataFrame) -> DataFrame:
    """(path, json): each file with findings as a JSON object of its path and
    offenses, in order of place and rule."""
    place = F.struct(F.col("line").alias("start_line"), F.col("column").alias("start_column"), "last_line", "last_column", "length", "line", "column")
    item = F.struct("severity", "message", F.col("rule").alias("cop_name"), _flag(found, "corrected").alias("corrected"), _flag(found, "correctable").alias("correctable"), place.alias("location"))
    keyed = F.struct("line", "column", "rule", "message", "last_line", "last_column", "length", item.alias("item"))
    listed = found.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["item"]).alias("offenses"))
    return listed.select("path", F.to_json(F.struct("path", "offenses")).alias("json"))


def json_document(found: DataFrame, files: DataFrame) -> DataFrame:
    """(part, path, json): the pieces of one JSON document, a row for each file,
    with or without findings, and one for the summary. Both file counts are the
    number of files. Rows stay distributed; document() puts a bounded report together."""
    one = found.agg(F.count("*").alias("offense_count")).crossJoin(files.agg(F.count("*").alias("target_file_count"))).withColumn("inspected_file_count", F.col("target_file_count"))
    none = F.to_json(F.struct("path", F.array().cast("array<string>").alias("offenses")))
    each = files.select("path").distinct().join(json_report(found), "path", "left").select(F.lit("file").alias("part"), "path", F.coalesce("json", none).alias("json"))
    return one.select(F.lit("summary").alias("part"), F.lit(None).cast("string").alias("path"), F.to_json(F.struct("*")).alias("json")).unionByName(each)


def document(found: DataFrame, files: DataFrame, metadata: dict[str, str] | None = None) -> str:
    """The whole JSON document as a string on the driver, for reports that fit there."""
    rows = json_document(found, files).orderBy("path").collect()
    summary = next(r["json"] for r in rows if r["part"] == "summary")
    return f'{{"metadata":{json.dumps(metadata or {})},"files":[{",".join(r["json"] for r in rows if r["part"] == "file")}],"summary":{summary}}}'


def simple_report(found: DataFrame) -> DataFrame:
    """(path, line, column, text): a line of text for each finding."""
    label = F.when(_flag(found, "corrected"), " [Corrected]").when(_flag(found, "correctable"), " [Correctable]").otherwise("")
    text = F.concat(F.format_string("C:%3d:%3d:", "line", "column"), label, F.lit(" "), "rule", F.lit(": "), "message")
    return found.select("path", "line", "column", text.alias("text"))


def totals(found: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files inspected, offenses, how many are corrected and how many could be."""
    corrected, correctable = _flag(found, "corrected"), _flag(found, "correctable")
    n = found.agg(F.count("*").alias("offenses"), F.count(F.when(corrected, 1)).alias("corrected"), F.count(F.when(correctable & ~corrected, 1)).alias("correctable"))
    return files.agg(F.count("*").alias("inspected")).crossJoin(n)


def exit_status(found: DataFrame) -> int:
    """0 if every finding is corrected, or there is none; else 1."""
    return int(found.filter(~_flag(found, "corrected")).limit(1).count() > 0)
