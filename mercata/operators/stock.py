"""Stock levels from an event log, never below zero.

With running sum S and running minimum M of the deltas since some point where
the level was q, the clamped level is S + max(q, -M). A `new_item` event sets
the level. That form composes, so a key's log is cut into time buckets which
are scanned in parallel; only one row per bucket is scanned in sequence.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

KEY = ["shop_id", "sku"]


def _in_buckets(events, bucket):
    """Running sums inside (key, bucket, run); a run starts at each reset."""
    e = events.withColumn("_bucket", F.date_trunc(bucket, F.col("ts")))
    scan = W.partitionBy(*KEY, "_bucket").orderBy("ts", "event_id")
    e = e.withColumn("_run", F.sum(F.when(F.col("type") == "new_item", 1)
                                   .otherwise(0)).over(scan))
    run = (W.partitionBy(*KEY, "_bucket", "_run").orderBy("ts", "event_id")
           .rowsBetween(W.unboundedPreceding, 0))
    e = e.withColumn("_s", F.sum("delta").over(run))
    return e.withColumn("_m", F.min("_s").over(run))


def _carried_in(scanned, opening):
    """Level of every (key, bucket) before its first event."""
    last = scanned.groupBy(*KEY, "_bucket").agg(
        F.max(F.struct("ts", "event_id", "_run", "_s", "_m")).alias("_l"))
    b = last.select(*KEY, "_bucket", (F.col("_l._run") > 0).alias("_reset"),
                    F.col("_l._s").alias("_s"), F.col("_l._m").alias("_m"))
    if opening is None:
        b = b.withColumn("_open", F.lit(None).cast("long"))
    else:
        b = b.join(opening.select(*KEY, F.col("qty").cast("long").alias("_open")),
                   KEY, "left")
    # an era starts with a bucket that resets, hence with a known closing level
    key = W.partitionBy(*KEY).orderBy("_bucket")
    b = b.withColumn("_era", F.sum(F.col("_reset").cast("int")).over(key))
    known = F.col("_s") + F.greatest(F.lit(0), -F.col("_m"))
    era = W.partitionBy(*KEY, "_era").orderBy("_bucket").rowsBetween(
        W.unboundedPreceding, 0)
    b = b.withColumn("_known", F.first(F.when(F.col("_reset"), known)).over(era))
    b = b.withColumn("_step", F.when(F.col("_reset"), F.lit(0)).otherwise(F.col("_s")))
    b = b.withColumn("_sum", F.sum("_step").over(era))
    low = F.when(~F.col("_reset"), F.col("_sum") - F.col("_step") + F.col("_m"))
    b = b.withColumn("_low", low).withColumn("_low", F.min("_low").over(era))
    start = F.when(F.col("_era") > 0, F.col("_known")).otherwise(F.col("_open"))
    b = b.withColumn("_close", F.col("_sum") + F.when(
        start.isNotNull(), F.greatest(start, -F.col("_low"))))
    return b.select(*KEY, "_bucket", F.coalesce(
        F.lag("_close").over(key), F.col("_open")).alias("_in"))


def running_levels(events: DataFrame, opening=None, bucket="day") -> DataFrame:
    """`qty_now` after every event of `shop_id, sku, ts, event_id, type, delta`.

    `opening` holds earlier levels (`shop_id, sku, qty`). Events of a key that neither
    has one nor was put in stock before change nothing and are left out.
    """
    e = events.select(*KEY, "ts", "event_id", "type", F.col("delta").cast("long")
                      .alias("delta"))
    scanned = _in_buckets(e, bucket)
    carried = _carried_in(scanned, opening)
    start = F.when(F.col("_run") == 0, F.col("_in")).otherwise(F.lit(0))
    return (scanned.join(carried, [*KEY, "_bucket"]).filter(start.isNotNull())
            .withColumn("qty_now", F.col("_s") + F.greatest(start, -F.col("_m")))
            .drop("_bucket", "_run", "_s", "_m", "_in"))


def closing_levels(events, opening=None, bucket="day"):
    """Level of every touched (shop, sku) after its last event."""
    levels = running_levels(events, opening, bucket)
    return levels.groupBy(*KEY).agg(
        F.max(F.struct("ts", "event_id", "qty_now")).alias("_l")).select(
        *KEY, F.col("_l.qty_now").alias("qty"))


def shape_events(events, shops, keep=()):
    """Raw events in published form with the region of their shop, and columns to `keep`."""
    regions = shops.select("shop_id", "region_id")
    return events.join(regions, "shop_id", "left").select(
        "type", "shop_id", F.col("shop").alias("shop_name"), "region_id", "sku",
        "name", "qty_now", F.col("ts"), "sold", "added", *keep)
