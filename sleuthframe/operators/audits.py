"""Audits of whole rule sets: crashes isolated, configurations compared in one
pass, results of batches put together.

Rule names are unique within a set, bar rules of several declarations, which stay
together. Empty files, rules, configurations or results give empty tables (with no
rules nothing is run). Null paths are files like others; repeated rows count as
often as they occur; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from py4j.protocol import Py4JJavaError

from sleuthframe.operators.config import Value
from sleuthframe.operators.settings import settings
from sleuthframe.parser.nodes import shared_nodes
from sleuthframe.rules.engine import NodeRule, asked_of, node_findings

#: Configurations that one pass compares: a bit of a 64-bit number each.
MOST_CONFIGS = 62


def isolated(files: DataFrame, rules: Iterable, find: Callable[[DataFrame, list], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(what find(files, rules) gives for the rules that don't fail, failed(rule,
    error)). A set that fails is halved, and its halves run again, until a failure
    is one rule's alone: k failing ones of n take about k log n runs, none of
    which takes down the others."""
    spark = files.sparkSession
    by_name: dict[str, list] = {}
    for r in rules:
        by_name.setdefault(r.name, []).append(r)
    todo, good, failed = [sorted(by_name)] if by_name else [], [], []
    while todo:
        names = todo.pop()
        try:
            find(files, [r for n in names for r in by_name[n]]).write.format("noop").mode("overwrite").save()
            good += names
        except (PySparkException, Py4JJavaError) as e:
            if len(names) == 1:
                failed.append((names[0], type(e).__name__))
            else:
                todo += [names[: len(names) // 2], names[len(names) // 2 :]]
    return find(files, [r for n in sorted(good) for r in by_name[n]]), spark.createDataFrame(failed, "rule string, error string")


def under_configurations(files: DataFrame, rules: Iterable[NodeRule], configs: Sequence[Mapping[str, Mapping[str, Value]]]) -> DataFrame:
    """(path, line, column, last_line, last_column, rule, message, n, configs):
    every finding with the set of configurations under which it is made, bit k for
    configs[k], and how often under each. The files are parsed once and each row is
    looked at under all configurations."""
    if len(configs) > MOST_CONFIGS:
        raise ValueError(f"at most {MOST_CONFIGS} configurations")
    rules = list(rules)
    rows = None
    for k, config in enumerate(configs):
        one = settings(files.sparkSession, rules, config).withColumn("bit", F.lit(1 << k).cast("long"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        rows = settings(files.sparkSession, rules, {}).withColumn("bit", F.lit(0).cast("long")).filter("false")
    found = node_findings(shared_nodes(files, asked_of(rules)), rules, settings_rows=rows)
    key = ["path", "at.line", "at.column", "at.last_line", "at.last_column", "rule", "message"]
    # a finding's rows under all configurations are of one task, which adds them up before they are shuffled, once
    place = ["path", "line", "column", "last_line", "last_column", "rule", "message"]
    times = [f"n_{k}" for k in range(max(1, len(configs)))]
    each = found.select(*key, "bit").groupBy(*place).agg(*(F.count_if(F.col("bit") == 1 << k).alias(n) for k, n in enumerate(times)))
    each = each.select("*", F.explode(F.array_distinct(F.filter(F.array(*times), lambda n: n > 0))).alias("n"))
    return each.select(*place, "n", F.expr(" | ".join(f"if({n} = n, {1 << k}L, 0L)" for k, n in enumerate(times))).alias("configs"))


def mutations(found: DataFrame, n: int) -> DataFrame:
    """(rule, config, kept, lost, gained) of under_configurations(): what each
    configuration but the first keeps of the first one's findings, loses and adds."""
    each = found.select("rule", "configs", "n", F.explode(F.sequence(F.lit(1), F.lit(max(1, n - 1)))).alias("config"))
    first, mine = F.col("configs").bitwiseAND(F.lit(1)) != 0, F.expr("shiftright(configs, config) & 1") != 0
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for c, a in ((first & mine, "kept"), (first & ~mine, "lost"), (~first & mine, "gained"))]
    return each.groupBy("rule", "config").agg(*sums)


def islands(results: DataFrame) -> DataFrame:
    """(run, first, last): the ranges of positions without gaps that each run's results cover."""
    each = results.select("run", "position").distinct()
    step = F.col("position") - F.row_number().over(W.partitionBy("run").orderBy("position"))
    return each.withColumn("island", step).groupBy("run", "island").agg(F.min("position").alias("first"), F.max("position").alias("last")).drop("island")


def batches(results: DataFrame) -> DataFrame:
    """One row per run of results(run, batch, revision, version, position,
    classification, left, right, exact, left_seconds, right_seconds): status, where
    it begins and ends, how many positions and islands, sums and a map of its
    classifications. A run whose batches are of several revisions or versions,
    that has a position twice or leaves one out is rejected; its sums are null."""
    # all windows lie within a run's, so results are shuffled once
    place, before = W.partitionBy("run").orderBy("position"), F.lag("position").over(W.partitionBy("run").orderBy("position"))
    told = results.withColumn("classification", F.coalesce("classification", F.lit("none"))).withColumn("batch", F.coalesce(F.col("batch").cast("string"), F.lit("")))
    told = told.withColumn("begins", F.col("position").isNotNull() & (before.isNull() | (before != F.col("position"))))
    told = told.withColumn("island", (F.row_number().over(place) == 1) | F.col("begins") & (before.isNull() | (F.col("position") - before > 1)))
    kind = W.partitionBy("run", "classification")
    told = told.withColumn("k", F.count("*").over(kind)).withColumn("first_kind", F.row_number().over(kind.orderBy("position")) == 1)
    told = told.withColumn("first_batch", F.row_number().over(W.partitionBy("run", "batch").orderBy("position")) == 1)
    several = [(F.min(c) != F.max(c)).alias(f"n_{n}") for n in ("revision", "version") for c in (F.coalesce(F.col(n).cast("string"), F.lit("")),)]
    out = told.groupBy("run").agg(
        *several, F.count_if("first_batch").alias("n_batch"), F.count("*").alias("n"), F.count_if("begins").alias("positions"), F.count_if("island").alias("islands"),
        F.min("position").alias("first"), F.max("position").alias("last"), *(F.sum(c).alias(c) for c in ("left", "right", "exact", "left_seconds", "right_seconds")),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("first_kind"), F.struct("classification", "k"))))).alias("classifications"),
    )
    status = F.when(F.col("n_revision"), "several revisions").when(F.col("n_version"), "several versions").when(F.col("n") > F.col("positions"), "repeated positions").when(F.col("last") - F.col("first") + 1 > F.col("positions"), "missing positions").otherwise("complete")
    out = out.withColumn("status", status)
    kept = [F.when(F.col("status") == "complete", F.col(c)).alias(c) for c in ("left", "right", "exact", "left_seconds", "right_seconds")]
    return out.select("run", "status", F.col("n_batch").alias("batches"), "first", "last", "positions", "islands", *kept, "classifications")
