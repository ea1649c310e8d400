"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only on one machine, as in tests, a temporary folder takes its place; a cluster without the setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="tables-")
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as a table to the shared folder and read back: lineage is cut, and any executor can be lost after that.

    Size estimates come from the files, so they don't grow from one round of an iteration to the next as those of a checkpoint do. Row groups are small, as
    several tasks of an executor write at once.
    """
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
