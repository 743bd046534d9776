"""Tables of texts read as source files: files(path, content)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.sources.decode import decode

#: How a table's rows become files; each is SQL that both engines run.
PATHS = {
    "documents": ("concat('documents/', cast(doc_id AS STRING))", "text"),
    "conversations": ("concat('conversations/', cast(conv_id AS STRING), '/', cast(turn AS STRING))", "text"),
    "pages": ("concat('pages/', cast(page_id AS STRING))", "html"),
    "benchmark": ("concat('benchmark/', cast(item_id AS STRING))", "text"),
}


#: Rows that one task makes into files of few different contents. These are parsed once a
#: batch, so what a task costs whatever its rows are must not come too often.
FEW_CONTENTS = 50_000


def spread(rows: DataFrame, per_task: int) -> DataFrame:
    """rows of a stored table, dealt out to tasks of about so many: tables come in few
    large pieces, while the work that a row makes can take long. Their number is in the
    files' footers, so counting reads no rows."""
    n = rows.count()
    few = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 100))
    return rows.repartition(max(1, few, -(-n // per_task)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table as files; null texts are empty files."""
    path, content = PATHS[name]
    return table(spark, sf_dir, name).select(F.expr(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))


#: Names of Ruby sources, and names of folders and files that are left out.
NAMES = "{*.rb,*.rake,*.gemspec,Gemfile,Rakefile,Guardfile,Dangerfile,config.ru}"
LEFT_OUT = r"(^|/)(\.[^/]*|node_modules|target|tmp)(/|$)|vendor/(gems|bundle)"


def _qualified(spark: SparkSession, folder: str) -> tuple[str, bool]:
    """The full address of a path, and whether it is a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(path)
    return full.toString(), fs.getFileStatus(full).isDirectory()


def source_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Ruby sources below a folder as files(path, content, marker, invalid), paths
    relative to it. Dot files, build and vendored folders below it are left out;
    the folder's own name doesn't matter. Bytes that aren't UTF-8 are kept (see
    decode). Only files of matching names are read. No such files: no rows."""
    root, _ = _qualified(spark, folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).load(root)
    path = F.substr("path", F.lit(len(root.rstrip("/")) + 2))
    return decode(found.select(path.alias("path"), F.col("content").alias("raw")).filter(~F.rlike("path", F.lit(LEFT_OUT))))


def targets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """files(path, content, marker, invalid) of a list of files and folders: files
    whatever their name, folders as by source_tree() with their own path in front.
    A path that doesn't exist raises an error."""
    parts = []
    for p in paths:
        root, folder = _qualified(spark, p)
        if folder:
            parts.append(source_tree(spark, p).withColumn("path", F.concat(F.lit(p.rstrip("/") + "/"), "path")))
        else:
            raw = spark.read.format("binaryFile").load(root).select(F.lit(p).alias("path"), F.col("content").alias("raw"))
            parts.append(decode(raw))
    return functools.reduce(DataFrame.unionByName, parts)


def stdin_file(spark: SparkSession, name: str, raw: bytes) -> DataFrame:
    """One virtual file of these bytes."""
    return decode(spark.createDataFrame([(name, bytearray(raw))], "path string, raw binary"))
