"""Cutting lineage between the rounds of an iterative operator."""

import tempfile


def shared_folder(spark):
    """The folder in ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tickerloom-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def checkpointed(df):
    """Eagerly checkpointed frame; lost executors find it in the shared folder."""
    folder, context = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()
