"""Cutting lineage: write a table to the cluster's checkpoint folder and read it back.

A written table survives the loss of any executor, keeps column pruning and pushdown for the
steps that follow, and has a known size, so that Spark's own broadcast choice stays sound.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where it is unset, a temporary one for a master in this process only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[0-9*]+(,[0-9]+)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="winnow-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written to the checkpoint folder."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/winnow/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
