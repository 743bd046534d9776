"""The command line: files and folders in, a report and an exit status out.

    python -m sleuthframe.cli [options] PATH...

Status 0: nothing found, or all of it corrected; 1: findings; 2: an error, such as
an unknown option or a path that doesn't exist.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.operators.analysis import analyze, one_of_each_path, rule_names
from sleuthframe.operators.autocorrect import autocorrect
from sleuthframe.operators.config import parse_config
from sleuthframe.operators.file_rules import FILE_RULES
from sleuthframe.operators.line_rules import RULES as LINE_RULES
from sleuthframe.operators.line_rules import selected
from sleuthframe.operators.reporting import document, exit_status, simple_report, totals
from sleuthframe.rules import RULES as NODE_RULES
from sleuthframe.rules.engine import from_line_rule
from sleuthframe.sources.decode import restored
from sleuthframe.sources.tables import stdin_file, targets

VERSION = "0.2.0"


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ValueError(message)


def parse_args(args: list[str]) -> argparse.Namespace:
    """Options; raises ValueError for what isn't understood."""
    p = Parser(prog="sleuthframe", add_help=False, allow_abbrev=False)
    p.add_argument("--version", action="store_true")
    p.add_argument("-V", dest="verbose_version", action="store_true")
    p.add_argument("--show-cops", action="store_true")
    p.add_argument("-a", "-A", "--autocorrect", "--autocorrect-all", "--auto-correct", "--auto-correct-all", dest="autocorrect", action="store_true")
    p.add_argument("-f", "--format", default="simple", choices=["json", "simple"])
    p.add_argument("--only", type=lambda v: [n.strip() for n in v.split(",") if n.strip()])
    p.add_argument("--stdin")
    p.add_argument("-c", "--config")
    p.add_argument("--jobs", type=int)
    for ignored in ("--parallel", "--no-parallel", "--force-exclusion", "--no-server", "--display-cop-names", "--extra-details"):
        p.add_argument(ignored, action="store_true")
    p.add_argument("--cache", nargs="?")
    p.add_argument("paths", nargs="*")
    found = p.parse_args(args)
    if found.jobs is not None and found.jobs < 1:
        raise ValueError("--jobs needs a positive number")
    return found


def write_back(after: DataFrame, files: DataFrame) -> None:
    """Write files whose text changed to where they were read, with their own
    bytes. What is to be written is a table first, so that a task that runs again
    never reads a file that was written; all must run on this machine, for the
    paths are its own. Each file is put in its place whole."""
    spark = after.sparkSession
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("files are corrected in place by a local master only")
    changed = after.alias("a").join(files.alias("f"), "path").filter("a.content <> f.content").select("path", F.col("a.content").alias("content"), "f.marker", "f.invalid")
    with tempfile.TemporaryDirectory() as folder:
        changed.write.parquet(f"file://{folder}/changed")
        _put(spark.read.parquet(f"file://{folder}/changed"))


def _put(changed: DataFrame) -> None:

    def run(rows: Iterable) -> None:
        for r in rows:
            made = f"{r['path']}.{os.getpid()}.corrected"
            with open(made, "wb") as out:
                out.write(restored(r["content"], r["marker"], bytes(r["invalid"] or b"")))
            os.replace(made, r["path"])

    changed.foreachPartition(run)


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None, stdin=None) -> int:
    out = out or sys.stdout
    try:
        options = parse_args(sys.argv[1:] if args is None else args)
        if options.version or options.verbose_version:
            print(VERSION if options.version else f"{VERSION} (pyarrow {pa.__version__}, python {sys.version.split()[0]})", file=out)
            return 0
        if options.show_cops:
            print("\n".join(rule_names()), file=out)
            return 0
        config = {}
        if options.config:
            with open(options.config, encoding="utf-8") as f:
                config = parse_config(f.read())
        missing = [p for p in options.paths if not os.path.exists(p)]
        if missing:
            raise ValueError(f"no such file: {missing[0]}")
        spark = spark or SparkSession.builder.getOrCreate()
        if options.stdin is not None:
            files = stdin_file(spark, options.stdin, (stdin or sys.stdin.buffer).read())
        else:
            files = targets(spark, options.paths or ["."])
        if options.autocorrect and options.stdin is None:
            rest = [c for c in files.columns if c != "path"]
            files = files.groupBy("path").agg(F.min_by(F.struct(*rest), F.struct(F.xxhash64("content"), "content")).alias("r")).select("path", "r.*")
            rules = (*selected(options.only, NODE_RULES), *map(from_line_rule, selected(options.only, LINE_RULES)))
            found, after = autocorrect(files, rules, config=config, file_rules=selected(options.only, FILE_RULES))
            found, after = found.persist(), after.persist()
            found.count()
            write_back(after, files)
        else:
            found = analyze(one_of_each_path(files.select("path", "content")), options.only, config)
        if options.format == "json":
            print(document(found, files), file=out)
        else:
            for r in simple_report(found).orderBy("path", "line", "column", "text").collect():
                print(f"{r['path']}: {r['text']}", file=out)
            t = totals(found, files).first()
            print(f"{t['inspected']} files inspected, {t['offenses']} offenses detected, {t['corrected']} corrected, {t['correctable']} correctable", file=out)
        return exit_status(found)
    except (ValueError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
