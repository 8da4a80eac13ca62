"""Weekly signals kept fresh from a stream of snapshots or points."""

from pyspark.sql import DataFrame, functions as F

from ..functions import num
from ..operators import signals as sig, upsert
from ..sources import keyed
from .stock import run_available


def weekly_means(points: DataFrame, key, lateness="7 days") -> DataFrame:
    """Mean per key and Monday-based week of `ts, value`, once a week is closed."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    means = (points.withWatermark("ts", lateness).groupBy(week.alias("w"), key)
             .agg(num.exact_mean("value").alias("_mean"), F.count("value").alias("points")))
    return means.select(
        key, F.col("w.start").cast("date").alias("window_start"),
        num.half_even("_mean").alias("interest_avg"), "points")


def write_weekly_means(points, key, path, checkpoint, lateness="7 days"):
    out = weekly_means(points, key, lateness)
    return run_available(out.writeStream.format("parquet").option("path", path)
                         .outputMode("append"), checkpoint)


SNAPSHOT_PARTS, SERIES_PARTS = "snapshots", "series"


def _series_schema(snapshots):
    """Schema of the stored series: what `with_movement` makes of snapshots."""
    return sig.with_movement(sig.weekly_interest(sig.explode_snapshots(snapshots))).schema


def write_signals(snapshots, path, checkpoint, parts=keyed.PARTS):
    """Stores each batch of snapshots and recomputes the series it touches.

    Snapshots and series lie in partitions by a hash of the series; a batch reads and
    rewrites only the partitions it touches. A snapshot replaces the one with its id, so a
    repeated batch writes the same.
    """
    spark = snapshots.sparkSession
    columns = snapshots.schema
    series = _series_schema(spark.createDataFrame([], columns))
    where = {"parts": parts, "part_keys": sig.SERIES}

    def refresh(batch, batch_id):
        batch.persist()
        touched = keyed.upsert(batch, f"{path}/{SNAPSHOT_PARTS}", ["id"], lambda old, new: upsert.replace_upsert(
            old, new, ["id"], order="captured_at"), columns, **where)
        if touched:
            changed = batch.select(*sig.SERIES).distinct()
            stored = keyed.read(spark, f"{path}/{SNAPSHOT_PARTS}", columns, touched).drop(keyed.PART)
            mine = stored.join(changed, sig.SERIES, "left_semi")
            moved = sig.with_movement(sig.weekly_interest(sig.explode_snapshots(mine)))

            def replaced(old, new):
                return old.join(changed, sig.SERIES, "left_anti").unionByName(new)
            keyed.upsert(moved, f"{path}/{SERIES_PARTS}", sig.SERIES, replaced, series, **where)
        batch.unpersist()
    return run_available(snapshots.writeStream.foreachBatch(refresh), checkpoint)


def current_signals(spark, path, categories, computed_at=None):
    """Signals over the stored series."""
    stored = spark.read.parquet(f"{path}/{SERIES_PARTS}").drop(keyed.PART)
    return sig.finish_signals(stored, categories, computed_at)
