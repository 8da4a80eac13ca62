"""Stock events as a stream: shaped, checked, scoped, and kept as levels."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators import contracts, filters, stock, upsert
from ..operators.numbering import numbered
from ..session import ship
from ..sources import keyed

LEVELS = "shop_id string, sku string, qty long"


def run_available(writer, checkpoint):
    """Process what is there and stop; a rerun continues from the checkpoint."""
    query = (writer.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def feed(events: DataFrame, shops: DataFrame, region=None, keep=()) -> DataFrame:
    """Published events with the region of their shop; invalid ones dropped.

    `keep` names further columns of the log to carry along.
    """
    shaped = stock.shape_events(events, shops, keep)
    return filters.region_scope(
        contracts.valid_rows(shaped, contracts.stock_event()), region)


def write_feed(events, path, checkpoint):
    return run_available(events.writeStream.format("parquet")
                         .option("path", path).outputMode("append"), checkpoint)


def write_log_and_feed(events, log, feed_path, checkpoint, order=None):
    """The same events in both sinks; a repeated batch overwrites itself.

    With `order`, both carry each event's `place` in its batch by those columns.
    """
    def both(batch, batch_id):
        if order is not None:
            batch = numbered(batch, *([order] if isinstance(order, str) else order), name="place")[0]
        batch.persist()
        batch.write.mode("overwrite").json(f"{log}/batch={batch_id}")
        batch.write.mode("overwrite").parquet(f"{feed_path}/batch={batch_id}")
        batch.unpersist()
    return run_available(events.writeStream.foreachBatch(both), checkpoint)


class LevelProcessor(StatefulProcessor):
    """Keeps one number per (shop, sku): the level after the last event, floored at zero.

    A key's events of one batch meet in one task, as columns; `maxFilesPerTrigger` bounds them.

    Events of a batch are taken in (ts, event_id) order at once: with running sum S and its
    minimum M since the last `new_item`, or since the level q before the batch, the level is
    S + max(q, -M). A key that was never put in stock has no state and gives no row.
    """

    def init(self, handle):
        self.level = handle.getValueState("level", "qty long")

    def handleInitialState(self, key, initialState, timerValues):
        self.level.update((int(initialState["qty"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues):
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        delta = events["delta"].to_numpy(np.int64)
        resets = np.flatnonzero(events["type"].to_numpy() == "new_item")
        if len(resets):
            delta, start = delta[resets[-1]:], 0
        elif self.level.exists():
            start = int(self.level.get()[0])
        else:
            return
        sums = np.cumsum(delta)
        qty = int(sums[-1] + max(start, -int(sums.min())))
        self.level.update((qty,))
        yield pd.DataFrame({"shop_id": [key[0]], "sku": [key[1]], "qty": [qty]})

    def close(self):
        pass


def track_levels(events, opening=None):
    """A stream of the new levels of the keys each batch touches.

    `opening` (shop_id, sku, qty) seeds the state of a new checkpoint. A batch costs its own
    events: the levels live in the state store.
    """
    e = events.select(*stock.KEY, "ts", "event_id", "type", F.col("delta").cast("long").alias("delta"))
    seed = None if opening is None else opening.select(*stock.KEY, F.col("qty").cast("long").alias("qty")).groupBy(*stock.KEY)
    return e.groupBy(*stock.KEY).transformWithStateInPandas(
        LevelProcessor(), outputStructType=LEVELS, outputMode="Update", timeMode="None", initialState=seed)


def current_levels(spark, path):
    """Level of every (shop, sku)."""
    return keyed.read(spark, path, StructType.fromDDL(LEVELS)).drop(keyed.PART)


def write_levels(events, path, checkpoint, parts=keyed.PARTS):
    """Keeps the table of levels at `path` up to date, batch by batch.

    New levels replace those of their keys in the partitions they touch; as they are levels
    and not changes, repeating a batch writes the same. A new checkpoint starts from the
    levels that the table holds.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    opening = current_levels(spark, path) if keyed.exists(spark, path) else None
    schema = StructType.fromDDL(LEVELS)

    def apply(batch, number):
        # computed once: the touched partitions are collected from it before it is merged
        batch.persist()
        keyed.upsert(batch, path, stock.KEY, lambda old, new: upsert.replace_upsert(old, new, stock.KEY), schema, parts)
        batch.unpersist()
    levels = track_levels(events, opening)
    return run_available(levels.writeStream.outputMode("update").foreachBatch(apply), checkpoint)
