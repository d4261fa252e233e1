"""Files: binary ingest with quarantine, content-addressed vaults, rule packs, typed CSV, reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrid.functions.text import csv_safe

MOST_BYTES, MOST_PAGES = 104_857_600, 300


def quarantined(spark: SparkSession, path: str, *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Every file with its size, hash and the first check that it fails; contents of refused files are not read on."""
    files = spark.read.format("binaryFile").load(path)
    head = F.substring(F.col("content"), 1, 5).cast("string")
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large").when(head != "%PDF-", "not_a_pdf").when(F.regexp_count(F.col("content").cast("string"), F.lit(r"/Type\s*/Page[^s]")) > MOST_PAGES, "too_many_pages")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.coalesce(reason, F.lit("verified")).alias("verdict"))


def promote(new: DataFrame, vault: DataFrame) -> DataFrame:
    """Verified files that the vault, addressed by content, does not hold yet; each content once."""
    return new.filter("verdict = 'verified'").dropDuplicates(["sha256"]).join(vault.select("sha256"), "sha256", "left_anti")


def rule_pack(spark: SparkSession, branches: list[Mapping[str, object]]) -> tuple[DataFrame, str]:
    """A pack's branches as a table, and its content hash (canonical JSON: sorted keys, ASCII, no spaces, no NaN)."""
    for b in branches:
        if not {"id", "grade"} <= set(b) or not ({"when", "require_all"} & set(b)):
            raise ValueError(f"incomplete branch: {b}")
    text = canonical_json(branches)
    rows = [(str(b["id"]), str(b["grade"]), json.dumps(b.get("when") or {n: True for n in b["require_all"]}, sort_keys=True), bool(b.get("cap"))) for b in branches]
    return spark.createDataFrame(rows, "id string, grade string, conditions string, cap boolean"), hashlib.sha256(text.encode("ascii")).hexdigest()


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def checked_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """The parsed column, with `malformed` where it does not follow the schema."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    return df.withColumn("parsed", parsed).withColumn("malformed", F.col("parsed").isNull() | F.forall(F.array(*[F.col("parsed")[f.name].isNull() for f in schema.fields]), lambda x: x))


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_report(df: DataFrame, path: str, form: str) -> None:
    """JSON lines or CSV; in CSV no cell can start a formula."""
    if form == "csv":
        safe = [csv_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields]
        df.select(*safe).write.mode("overwrite").option("header", True).csv(path)
    elif form == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no such report form: {form}")


def request_signature(*parts: Column) -> Column:
    """A hash over all inputs that a response depends on."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
