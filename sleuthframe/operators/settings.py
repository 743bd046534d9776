"""Configuration as data: one row that holds every setting that rules look up.

The row is broadcast to the rows that rules look at, so a condition reads a
setting as it reads a column and the plan and its code are the same whatever the
configuration says. Each setting is a list of strings: that of a list, the one
value of a scalar, `key=value` of each pair of a map. A rule that isn't configured
has its defaults; a setting that no rule knows is not read; where a number is due,
anything else leaves the default.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sleuthframe.operators.config import Value


def listed(value: Value | tuple) -> list[str]:
    """A setting as a list of strings."""
    if isinstance(value, Mapping):
        return [f"{k}={v}" for k, v in value.items()]
    return [str(v) for v in value] if isinstance(value, list | tuple) else [str(value)]


def field(rule: str, key: str) -> str:
    return f"{rule}.{key}"


def setting(rule: str, key: str) -> str:
    """SQL of a rule's list of values."""
    return f"cfg.`{field(rule, key)}`"


def settings(spark: SparkSession, rules: Iterable, config: Mapping[str, Mapping[str, Value]] | None = None) -> DataFrame:
    """One row, cfg: a struct with the list of each rule's each setting."""
    held: dict[str, list[str]] = {}
    for r in rules:
        for key, default in (r.options or {}).items():
            told = (config or {}).get(r.name, {}).get(key)
            number = isinstance(default, str) and default.isdecimal()
            usable = told is not None and (not number or isinstance(told, str) and told.isdecimal())
            held[field(r.name, key)] = listed(told if usable else default)
    names = sorted(held) or ["none"]
    kind = StructType([StructField("cfg", StructType([StructField(n, ArrayType(StringType())) for n in names]))])
    return spark.createDataFrame([(tuple(held.get(n, []) for n in names),)], kind)
