"""Set expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets; an empty set equals nothing."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def ordered_union(*parts: Column) -> Column:
    """Distinct elements in the order of their first occurrence, nulls left out."""
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull()))


def entity_set(names: Column) -> Column:
    """Trimmed, sorted and distinct, as JSON."""
    return F.to_json(F.array_sort(F.array_distinct(F.transform(names, lambda x: F.trim(x)))))


def worlds(df: DataFrame, unknown: str, *, most: int = 16) -> DataFrame:
    """The rows of df once for each way in which its unknown facts (an array of names) can turn out: world (a number from
    0) and facts (map of name to boolean). A row of more than `most` unknown facts is an error."""
    names = F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.col(unknown)))), F.array().cast("array<string>"))
    n = F.when(F.size(names) <= most, F.size(names)).otherwise(F.raise_error(F.lit("too many unknown facts")).cast("int"))
    out = df.withColumn("_names", names).withColumn("world", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), n).cast("int") - 1)))
    facts = F.map_from_arrays("_names", F.transform("_names", lambda x, i: F.col("world").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0))
    return out.withColumn("facts", facts).drop("_names")
