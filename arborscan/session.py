"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "arborscan", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.warehouse.dir": tempfile.gettempdir() + "/arborscan-warehouse",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: elsewhere the files have to
    outlive the executor that wrote them.
    """
    context = spark.sparkContext
    folder = (context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
              or context.getCheckpointDir())
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="arborscan-checkpoint-"))
    return context.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder, for tables and streaming checkpoints of one run."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def wider_shuffles(spark: SparkSession, partitions: int) -> Iterator[None]:
    """At least ``partitions`` shuffle partitions for what is materialised inside; adaptive execution still merges small ones and splits skewed ones."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    spark.conf.set("spark.sql.shuffle.partitions", str(max(partitions, int(before))))
    if initial is not None:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(partitions, int(initial))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        if initial is not None:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", initial)
