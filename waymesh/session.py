"""Session defaults, lineage cuts and table access shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark.  A cluster brings its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("waymesh")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, local mode takes a temporary folder and a cluster one
    beside its warehouse, never a machine-local temporary folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "waymesh-checkpoints"))
    else:
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written to the shared folder in columns, a fraction of what ``cut`` takes, and what removes it again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), remove


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *cols: str, rows_per_task: int | None = None) -> DataFrame:
    """Repartition to the session's shuffle width, by ``cols`` if given.

    A number is named on purpose: it keeps adaptive execution from merging
    the partitions of a CPU-heavy Python stage into a few long tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(c) for c in cols])


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores if it has fewer partitions than there are cores; rows are not moved otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


#: Sides up to this size are sent to all executors by ``join_small``.
SMALL_BYTES = 8 << 20


def join_small(left: DataFrame, right: DataFrame, on, how: str = "left", most_bytes: int = SMALL_BYTES, made: bool = False) -> DataFrame:  # noqa: ANN001
    """Join with a side that is expected to be small: its rows are made, measured and broadcast if they fit.

    Beyond ``most_bytes`` it is a plain join, which Spark plans and splits.
    The large side is not shuffled in the first case.  ``made`` says that
    ``right`` is a checkpoint already.
    """
    right = right if made else cut(right)
    wide = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(0)) + 24 for c, t in right.dtypes)
    size = right.agg(F.coalesce(F.sum(wide), F.lit(0))).head()[0]
    return left.join(F.broadcast(right) if size <= most_bytes else right, on, how)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor, also those that join later, this package for its Python workers."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="waymesh-")) / "waymesh_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
