"""The queries registered with the driver, gathered from the modules of this package.

Registered results are digests that compare alike in any engine: decimals become doubles, dates become text, and null
whole numbers become -1. The operators themselves keep their types and nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.plans import admissions, decisions, discovery, documents, evidence, exchange, gates, retrieval, structure, tabular

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (retrieval, tabular, decisions, documents, gates, discovery, structure, exchange, admissions, evidence)


def digest(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "date":
            c = c.cast("string")
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            c = F.coalesce(c.cast("bigint"), F.lit(-1).cast("bigint"))
        out.append(c.alias(name))
    return df.select(*out)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_top20(spark, sf_dir)


def _registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return digest(query(spark, sf_dir))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {name: _registered(query) for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
