"""Rows that several parts of a query use, written once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the folder that spark.checkpoint.dir names, read back: they are worked out once, and survive
    lost executors. The table stays until its folder is cleared. Where the setting is missing, as in tests in one local
    process, a new folder is taken; on a cluster its lack is an error."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        folder = _own[0]
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
