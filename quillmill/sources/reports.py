"""Reports of an external validator: lines to messages, messages to counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Levels of messages; those of the first two are errors.
LEVELS = ("FATAL", "ERROR", "WARNING", "USAGE", "INFO")
_LINE = r"^([A-Za-z]+)\(([^)]*)\): (.*?)\((-?[0-9]+),(-?[0-9]+)\): (.*)$"


def messages(lines: DataFrame, key: str) -> DataFrame:
    """lines(key, line) -> (key, level, code, path, line, message): `LEVEL(CODE): path(line,column): message`; an unknown level counts as INFO, other lines give no message."""
    part = lambda k: F.regexp_extract("line", _LINE, k)
    level = F.upper(part(1))
    return lines.where(F.col("line").rlike(_LINE)).select(
        key, F.when(level.isin(*LEVELS), level).otherwise("INFO").alias("level"), part(2).alias("code"), part(3).alias("path"), part(4).cast("int").alias("line"), part(6).alias("message"))


def summary(found: DataFrame, key: str) -> DataFrame:
    """(key, errors, warnings, status): passed where there is neither."""
    error, warning = F.count_if(F.col("level").isin(*LEVELS[:2])), F.count_if(F.col("level") == "WARNING")
    return found.groupBy(key).agg(error.alias("errors"), warning.alias("warnings"), F.when(error + warning > 0, "failed").otherwise("passed").alias("status"))
