"""Results of iterated operators, kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def kept(rows: DataFrame) -> DataFrame:
    """The rows, computed once, with the partitions that they have. The folder is that of ``spark.checkpoint.dir``; one of
    our own only where none is set, as on one machine."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
    return rows.checkpoint()
