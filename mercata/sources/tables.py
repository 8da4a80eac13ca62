"""Tables by explicit column list, event logs, and all-or-nothing refresh."""

from pyspark.sql import functions as F

from .. import schemas


def read_table(spark, path, columns):
    """Reads the named columns; there is no way to ask for all of them."""
    if not columns:
        raise ValueError("name the columns")
    return spark.read.parquet(path).select(*columns)


def read_event_log(spark, path):
    return spark.read.schema(schemas.RAW_EVENTS).json(path)


def stream_event_log(spark, path):
    return spark.readStream.schema(schemas.RAW_EVENTS).json(path)


def append_events(events, path):
    events.write.mode("append").json(path)


def _versions(spark, path):
    """Numbers of the finished versions under `path`."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        marker = jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(marker):
            done.append(int(name.split("=")[1]))
    return sorted(done)


def refresh(spark, df, path):
    """Writes a whole new version; readers see it only once it is complete."""
    number = (_versions(spark, path) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def read_current(spark, path):
    done = _versions(spark, path)
    if not done:
        raise ValueError(f"no finished version under {path}")
    return spark.read.parquet(f"{path}/version={done[-1]}").drop("version")


def write_inbox(notifications, path, spread=8):
    """Appends each shop's notifications to its own folder.

    The rows of a shop are spread over a few writers, so that a shop with a
    third of all notifications does not wait for one task.
    """
    part = F.pmod(F.xxhash64("qid"), F.lit(spread))
    (notifications.repartition(F.col("shop_id"), part)
     .write.mode("append").partitionBy("shop_id").json(path))
