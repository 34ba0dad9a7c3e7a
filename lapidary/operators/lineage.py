"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Write the rows to the session's checkpoint folder and go on from there.

    The folder is ``spark.checkpoint.dir``; where nothing sets it, a local session makes a temporary
    one, and a cluster's is refused.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lapidary-"))
    return rows.checkpoint()
