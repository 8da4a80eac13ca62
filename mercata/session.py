"""Session defaults and the shared folder for checkpoints and tables."""

import gc
import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_session(app="mercata", master=None, **conf):
    """A session with adaptive execution; joins broadcast only measured sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL = []


def shared_dir(spark, name):
    """`name` inside the folder the cluster names in spark.checkpoint.dir.

    A temporary folder is made only for a local master with nothing set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="mercata-"))
        root = _LOCAL[0]
    return os.path.join(root, name)


def cut_lineage(df):
    """Reliable checkpoint in the shared folder; survives lost executors.

    For what several branches of a job read again; its size is the caller's to weigh.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))
    return df.checkpoint()


def release(spark):
    """Let Spark remove the shuffle files and checkpoints that nothing refers to any more.

    They go when the driver collects its garbage, which by itself may be after the job.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED = set()
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
LARGEST_BATCH = 4 << 20


def ship(spark):
    """Send this package to the workers, once per application.

    Functions that run in workers refer to it by module; the workers of a cluster
    do not share the driver's path. Batches to workers are bounded: an executor and its
    workers hold several at a time, outside the heap.
    """
    context = spark.sparkContext
    if int(spark.conf.get(BATCH_BYTES, str(64 << 20)).rstrip("b")) > LARGEST_BATCH:
        spark.conf.set(BATCH_BYTES, str(LARGEST_BATCH))
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="mercata-code-"), "mercata-code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
