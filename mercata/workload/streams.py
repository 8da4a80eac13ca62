"""Streaming queries over the event and interest tables, run to their end.

A run reads the table as a stream, writes to the shared folder and returns
what was written. Most have the SQL of their batch twin.
"""

import uuid

from pyspark.sql import functions as F

from ..operators import contracts, numbering
from ..session import shared_dir
from ..streaming import signals as signal_stream, stock as stock_stream
from . import demand, views as v
from .registry import half_even_sql, mean_sql, query, with_
from .supply import LEVELS


def fresh(spark, name):
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def stream(spark, sf, name):
    schema = v.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


def raw_stream(spark, sf):
    """Stock events as the log publishes them, without running levels."""
    e = v.as_movements(stream(spark, sf, "events"))
    sale = F.col("type") == "sale"
    return e.select(
        "event_id", "type", "shop_id", F.concat(F.lit("shop "), "shop_id").alias("shop"), "sku",
        F.concat(F.lit("item "), "sku").alias("name"),
        F.when(sale, F.lit(0)).otherwise(F.col("delta")).cast("long").alias("qty_now"),
        F.when(sale, -F.col("delta")).alias("sold"),
        F.when(F.col("type") == "restock", F.col("delta")).alias("added"), "ts")


FEED = """v_feed AS (
  SELECT type, shop_id, 'shop ' || shop_id AS shop_name, s_nationkey::VARCHAR AS region_id, sku,
    CASE WHEN type = 'sale' THEN 0 ELSE delta END::BIGINT AS qty_now,
    CASE WHEN type = 'sale' THEN -delta END::BIGINT AS sold,
    CASE WHEN type = 'restock' THEN delta END::BIGINT AS added
  FROM v_events JOIN supplier ON shop_id = 'osm:node:' || s_suppkey::VARCHAR)"""
_FEED = ["type", "shop_id", "shop_name", "region_id", "sku", "qty_now", "sold", "added"]


@query("live_stock_feed", with_(v.EVENTS, FEED, select="SELECT * FROM v_feed"))
def live_stock_feed(spark, sf):
    out = fresh(spark, "feed")
    events = stock_stream.feed(raw_stream(spark, sf), v.known_shops(spark, sf))
    stock_stream.write_feed(events.select(_FEED), f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data").select(_FEED)


@query("live_region_feed", with_(v.EVENTS, FEED, select="""
SELECT * FROM v_feed WHERE region_id = (SELECT s_nationkey::VARCHAR FROM supplier
  WHERE s_suppkey = 3)"""))
def live_region_feed(spark, sf):
    shops = v.known_shops(spark, sf)
    region = shops.filter("shop_id = 'osm:node:3'").first()["region_id"]
    out = fresh(spark, "region-feed")
    events = stock_stream.feed(raw_stream(spark, sf), shops, region)
    stock_stream.write_feed(events.select(_FEED), f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data").select(_FEED)


@query("live_stock_levels", with_(v.EVENTS, LEVELS, select="""
SELECT shop_id, sku, arg_max(qty_now, (ts, event_id)) AS qty FROM v_levels GROUP BY 1, 2"""))
def live_stock_levels(spark, sf):
    out = fresh(spark, "levels")
    events = v.as_movements(stream(spark, sf, "events"))
    stock_stream.write_levels(events, f"{out}/data", f"{out}/state")
    return stock_stream.current_levels(spark, f"{out}/data")


@query("log_and_feed", with_(v.EVENTS, FEED.replace("SELECT type,", "SELECT event_id, type,"), select="""
SELECT place, sink, event_id, type, shop_id, region_id, sku, qty_now, sold, added
FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS place FROM v_feed), (VALUES ('log'), ('feed')) s(sink)"""))
def log_and_feed(spark, sf):
    """Every event of both sinks, with its place in that sink's order."""
    out = fresh(spark, "parity")
    columns = ["event_id", *[c for c in _FEED if c != "shop_name"]]
    raw = raw_stream(spark, sf)
    shaped = stock_stream.feed(raw, v.known_shops(spark, sf), keep=["event_id"])
    stock_stream.write_log_and_feed(shaped.select(columns), f"{out}/log", f"{out}/feed", f"{out}/state", order="event_id")
    schema = spark.read.parquet(f"{out}/feed").schema
    rows = {"log": spark.read.schema(schema).json(f"{out}/log"), "feed": spark.read.parquet(f"{out}/feed")}
    placed = [numbering.numbered(r, "batch", "place", name="_n")[0].select(
        (F.col("_n") + 1).alias("place"), F.lit(name).alias("sink"), *columns) for name, r in rows.items()]
    return placed[0].unionByName(placed[1])


@query("live_weekly_means", f"""
WITH w AS (
  SELECT event_type, date_trunc('week', ts)::DATE AS window_start,
    {half_even_sql(mean_sql('value'))} AS interest_avg,
    count(*) AS points FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE window_start + 7 <= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def live_weekly_means(spark, sf):
    """Weeks are written once they are a week past: the last ones stay open."""
    out = fresh(spark, "weeks")
    events = stream(spark, sf, "events").select(
        "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    signal_stream.write_weekly_means(events, "event_type", f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data").select(
        "event_type", "window_start", "interest_avg", "points")


SNAPSHOT_POINTS = f"""v_points AS (
  SELECT keyword, geo, timeframe, capture_id, captured_at, d,
    {half_even_sql(mean_sql('value'))} AS value FROM v_points0 GROUP BY ALL)"""


@query("live_signals", with_(
    v.POINTS.replace("v_points AS", "v_points0 AS"), SNAPSHOT_POINTS, demand.WEEKLY, demand.MOVED,
    select="""
SELECT keyword, geo, window_start, interest_avg, delta_pct, direction, rank, confidence
FROM v_signals"""))
def live_signals(spark, sf):
    """Snapshots are stored as files, then streamed into signals."""
    out = fresh(spark, "signals")
    snaps = contracts.valid_rows(demand.snapshots(spark, sf), contracts.snapshot())
    snaps.write.mode("overwrite").parquet(f"{out}/captures")
    arriving = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 4).parquet(
        f"{out}/captures")
    signal_stream.write_signals(arriving, f"{out}/data", f"{out}/state")
    categories = v.table(spark, sf, "part").select(v.category().alias("category"))
    rows = signal_stream.current_signals(spark, f"{out}/data", categories, v.COMPUTED_AT)
    return rows.select("keyword", "geo", "window_start", "interest_avg", "delta_pct",
                       "direction", F.col("rank").cast("long").alias("rank"), "confidence")


