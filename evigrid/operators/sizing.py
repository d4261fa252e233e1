"""Numbers of blocks that follow the size of the input, and tables and rounds in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: list[tuple[SparkSession, str, int]] = []


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; for a file scan, the bytes of its files. Where Catalyst has none (rows made by
    the driver), the bytes of the text columns are summed."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 60:
        return size
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    return int(df.select(F.sum(sum(texts, F.lit(0)).cast("long"))).first()[0] or 0)


def blocks(df: DataFrame, each: int, least: int = 8) -> int:
    """Blocks of about `each` input bytes, so that a block stays as small when the input grows."""
    return int(min(1 << 20, max(least, -(-input_bytes(df) // each))))


#: Inputs of fewer bytes are dealt out anew for work that is bound by the processor: they can be one split.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df; a small one over all cores, as its files may be fewer than these."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if input_bytes(df) <= SPREAD_BYTES else df


def dealt(df: DataFrame, *keys: str, each: int = 1 << 20) -> DataFrame:
    """df shuffled once by the keys, for all grouping, windows and joins by them (and more) that follow, in a number of
    partitions that follows its input. Adaptive execution goes by packed bytes when it joins partitions, and rows of few
    different values pack so well that a task gets many millions of them."""
    return df.repartition(blocks(df, each), *keys)


def in_parts(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df shuffled once by the keys into this number of partitions, or one more: never into Spark's own number, for which it
    may take a union of coalesced sides as dealt already."""
    return df.repartition(parts + (parts == int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where it is unset on one machine (local tests) a temporary one is
    made and set; on a cluster an unset folder is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors,
    gives later readers column pruning, and pins values (such as row numbers) that a recomputation could change."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(clear_staged)
    _staged.append((spark, path, threading.get_ident()))
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(keep: set[str] | None = None) -> None:
    """Remove the staged tables, all of them at the driver's exit. With `keep`: those of this thread whose path is not in
    it, for a caller whose results of the others are written."""
    own = [x for x in _staged if keep is None or (x[1] not in keep and x[2] == threading.get_ident())]
    for spark, path, _ in own:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            break
    _staged[:] = [x for x in _staged if x not in own]


def staged_paths() -> list[str]:
    """The paths of the tables that are staged now, the newest last."""
    return [path for _, path, _ in _staged]


def unsent(df: DataFrame) -> DataFrame:
    """df as a side of a join that is not broadcast. Spark's size check goes by the bytes of files, and staged rows of few
    different values pack so well that millions of them pass it and then do not fit the driver."""
    return df.hint("merge")


def together(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all, by name. Spark 4.1 lets a union keep the partitioning of its children, and where adaptive execution
    has coalesced these differently, what is grouped or windowed after it by their key is wrong. A narrow coalesce that
    never joins partitions makes the result's partitioning unknown, so that Spark shuffles it where it must."""
    out = first
    for x in others:
        out = out.unionByName(x)
    return out.coalesce(1 << 20)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the staged tables, removed with them."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(clear_staged)
    _staged.append((spark, path, threading.get_ident()))
    return path
