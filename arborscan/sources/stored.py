"""Tables that a job reads back from its own earlier runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The Parquet table at ``path``, or None if nothing has been written there.

    Only a missing path counts as "not there": a file that cannot be read stops the job when it is
    read, it never passes for an empty table.
    """
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
