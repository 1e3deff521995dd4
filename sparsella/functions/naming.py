"""Name patterns, natural order, and renaming of duplicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def name_matches(name: Column, pattern: str) -> Column:
    """A pattern from ^ on is a regular expression, case-insensitive and partial; any other is an upper-case prefix in LIKE's terms."""
    return name.rlike("(?i)" + pattern) if pattern.startswith("^") else F.upper(name).like(pattern.upper() + "%")


def natural_key(label):
    """Digit runs compare as numbers; labels that stand for a missing value come last."""
    if label is None or str(label).strip().lower() in ("", "nan", "none", "na", "<na>", "null", "unknown"):
        return (1, [])
    return (0, [(0, int(x), "") if x.isdigit() else (1, 0, x.lower()) for x in re.split(r"(\d+)", str(label)) if x])


def number_then_text(label: Column) -> list[Column]:
    """An order of labels: those that are integers by value, then the rest by text."""
    number = label.try_cast("int")
    return [number.asc_nulls_last(), label.asc_nulls_last()]


def rename_duplicates(df: DataFrame, name: str, key: str) -> DataFrame:
    """The k-th row of a name, by key, gets the suffix _{k-1}; the first stays."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(key)) - 1
    return df.withColumn(name, F.when(n > 0, F.concat(F.col(name), F.lit("_"), n.cast("string"))).otherwise(F.col(name)))
