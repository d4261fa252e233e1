"""Write-once snapshots, and lists that many rows share stored once.

A snapshot is its data and, written last, a manifest. Readers go by the manifest alone, so what a lost driver leaves behind
is never seen. The manifest's hash depends on the rows only, not on how they were dealt out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a row's hash that name its leaf, and of a leaf's that name its branch.
LEAF, BRANCH = 5, 2


def content_hash(df: DataFrame) -> tuple[int, str]:
    """(rows, hash) of a table: hashes of rows as JSON (columns by name) are sorted and hashed in leaves, these in branches,
    these in one. Rows that are there twice count twice."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    up = lambda rows, n: rows.groupBy(F.left("h", F.lit(n)).alias("k")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("own"))
    leaves = up(df.select(row.alias("h"), F.lit(1).alias("n")), LEAF)
    # a leaf's key leads its hash, so that branches hold neighbouring leaves in order
    branches = up(leaves.select(F.concat("k", "own").alias("h"), "n"), BRANCH)
    last = branches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("k", "own"))), ""), 256).alias("own")).first()
    return last["n"], last["own"]


class Snapshots:
    """Snapshots by name in one folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, name: str) -> str:
        return f"{self.folder}/{name}/manifest.json"

    def manifest(self, name: str) -> dict | None:
        if not self._fs.exists(self._path(self._manifest(name))):
            return None
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(self._manifest(name)).collect()))

    def capture(self, df: DataFrame, name: str) -> dict:
        """Freeze df under a name; its manifest (rows, sha256, schema, data). The same content again gives the manifest that
        is there; other content is an error. The rows are hashed as they were written, not as they were asked for."""
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"no name of a snapshot: {name}")
        data = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}/{data}")
        written = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}/{data}")
        rows, own = content_hash(written)
        known = self.manifest(name)
        made = {"rows": rows, "sha256": own, "schema": df.schema.jsonValue(), "data": data}
        if known is None and not self._publish(name, made):
            known = self.manifest(name)
        if known is not None:
            self._fs.delete(self._path(f"{self.folder}/{name}/{data}"), True)
            if (known["rows"], known["sha256"]) != (rows, own):
                raise ValueError(f"snapshot {name} is frozen with other content")
            return known
        return made

    def _publish(self, name: str, made: dict) -> bool:
        """Write the manifest beside its place and move it there; False if another one was first."""
        draft = self._path(f"{self.folder}/{name}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(made, sort_keys=True, separators=(",", ":")).encode()))
        out.close()
        if not self._fs.exists(self._path(self._manifest(name))) and self._fs.rename(draft, self._path(self._manifest(name))):
            return True
        self._fs.delete(draft, False)
        return False

    def read(self, name: str, *, check: bool = False) -> DataFrame:
        """The rows of a snapshot; check: hash them again first."""
        known = self.manifest(name)
        if known is None:
            raise ValueError(f"no snapshot {name}")
        out = self.spark.read.parquet(f"{self.folder}/{name}/{known['data']}")
        if check and content_hash(out) != (known["rows"], known["sha256"]):
            raise ValueError(f"snapshot {name} is not what was frozen")
        return out

    def names(self) -> list[str]:
        """The snapshots that are whole."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder)) if x.isDirectory()]
        return sorted(n for n in found if self._fs.exists(self._path(self._manifest(n))))


def shared(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(df with `<column>_ref` for each of the columns, shared: ref, column, value): equal values are stored once, as JSON
    under its hash. A null value has a null ref."""
    out, values = df, None
    for c in columns:
        text = F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}))
        out = out.withColumn(f"{c}_ref", F.sha2(text, 256))
        one = df.select(F.sha2(text, 256).alias("ref"), F.lit(c).alias("column"), text.alias("value")).filter("value is not null").dropDuplicates(["ref"])
        values = one if values is None else values.unionAll(one)
    return out.drop(*columns), values


def resolved(compact: DataFrame, values: DataFrame, schema: dict[str, str]) -> DataFrame:
    """What shared() was given. schema: the type of each shared column. A ref that is not in `values`, or whose value has
    another hash, is an error. Spark sends `values` to the rows as long as it is small."""
    out = compact
    for c, kind in schema.items():
        own = values.filter(F.col("column") == c).select(F.col("ref").alias(f"{c}_ref"), F.col("value").alias("_value"))
        out = out.join(own, f"{c}_ref", "left")
        broken = F.col(f"{c}_ref").isNotNull() & ~F.sha2("_value", 256).eqNullSafe(F.col(f"{c}_ref"))
        text = F.when(broken, F.raise_error(F.concat(F.lit(f"no such value of {c}: "), F.col(f"{c}_ref"))).cast("string")).otherwise(F.col("_value"))
        out = out.withColumn(c, F.from_json(text, f"v {kind}")["v"]).drop("_value", f"{c}_ref")
    return out
