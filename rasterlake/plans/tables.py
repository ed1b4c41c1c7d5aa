"""Where intermediate tables of iterative operators go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from ..operators.checkpoints import plain


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the folder of spark.checkpoint.dir; a local session without one gets its own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="rasterlake-")
        sc.setCheckpointDir(at)
    return plain(df.checkpoint())
