import datetime as dt
import random

from pyspark.sql import functions as F

from mercata.operators import signals as sig, stock
from mercata.streaming import signals as signal_stream, stock as stock_stream

FIELDS = "shop_id string, sku string, ts timestamp, event_id long, type string, delta long"


def events(n, seed, day):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choices(["sale", "restock", "new_item"], [6, 3, 1])[0]
        delta = {"sale": -rng.randint(1, 5), "restock": rng.randint(5, 9), "new_item": 8}[kind]
        ts = dt.datetime(2024, 1, day) + dt.timedelta(seconds=rng.randint(0, 80000))
        out.append((f"s{rng.randint(1, 2)}", "k", ts, day * 1000 + i, kind, delta))
    return out


def test_levels_survive_a_restart_and_equal_the_batch(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows = []
    for day in (1, 2, 3):
        new = events(60, day, day)
        rows += new
        spark.createDataFrame(new, FIELDS).coalesce(1).write.mode("append").parquet(src)
        # a new query on the same checkpoint, as after a restart
        stock_stream.write_levels(spark.readStream.schema(FIELDS).parquet(src), out, state, parts=4)
    live = {(r[0], r[1]): r[2] for r in stock_stream.current_levels(spark, out).collect()}
    batch = stock.closing_levels(spark.createDataFrame(rows, FIELDS))
    assert live == {(r["shop_id"], r["sku"]): r["qty"] for r in batch.collect()}

    # a new checkpoint over the table that is there
    later = str(tmp_path / "later")
    new = events(60, 9, 9)
    spark.createDataFrame(new, FIELDS).coalesce(1).write.parquet(later)
    stock_stream.write_levels(spark.readStream.schema(FIELDS).parquet(later), out, str(tmp_path / "other"), parts=4)
    live = {(r[0], r[1]): r[2] for r in stock_stream.current_levels(spark, out).collect()}
    batch = stock.closing_levels(spark.createDataFrame(rows + new, FIELDS))
    assert live == {(r["shop_id"], r["sku"]): r["qty"] for r in batch.collect()}


def test_log_and_feed_hold_the_same_events(spark, tmp_path):
    src = str(tmp_path / "src")
    raw = spark.createDataFrame(
        [("sale", "osm:node:1", "S", "PHA-0001", "n", 3, 1, None, 1.0),
         ("sale", "bad", "S", "PHA-0001", "n", 3, 1, None, 2.0),
         ("restock", "osm:node:2", "S", "PHA-0002", "n", 3, None, 4, 3.0),
         ("sale", "osm:node:1", "S", "PHA-0001", "n", 3, 0, None, 4.0)],
        "type string, shop_id string, shop string, sku string, name string, qty_now bigint, "
        "sold bigint, added bigint, ts double")
    raw.write.json(src)
    shops = spark.createDataFrame([("osm:node:1", "r1")], ["shop_id", "region_id"])
    from mercata.sources import tables
    live = stock_stream.feed(tables.stream_event_log(spark, src), shops)
    log, feed = str(tmp_path / "log"), str(tmp_path / "feed")
    stock_stream.write_log_and_feed(live, log, feed, str(tmp_path / "state"))
    a = sorted(tuple(r) for r in spark.read.json(log).select("ts", "shop_id").collect())
    b = sorted(tuple(r) for r in spark.read.parquet(feed).select("ts", "shop_id").collect())
    assert a == b == [(1.0, "osm:node:1"), (3.0, "osm:node:2")]
    scoped = stock_stream.feed(raw, shops, "r1")
    assert [r["ts"] for r in scoped.collect()] == [1.0]


def snapshots(spark, at, ident, values, geo="ES-MD"):
    series = [((dt.date(2024, 1, 1) + dt.timedelta(weeks=i)).isoformat(), float(x))
              for i, x in enumerate(values)]
    return spark.createDataFrame(
        [(ident, "pan", geo, "t", "p", at, series, None)],
        "id string, keyword string, geo string, timeframe string, provider string, "
        "captured_at string, series array<struct<date:string,value:double>>, "
        "region_breakdown array<struct<region:string,value:double>>")


def test_signals_refresh_only_what_changed(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    cats = spark.createDataFrame([("Pan",)], ["category"])
    first = [snapshots(spark, "2024-02-01T00:00:00Z", "a", [10, 20]),
             snapshots(spark, "2024-02-01T00:00:00Z", "b", [5, 5], "ES-CT")]
    again = snapshots(spark, "2024-02-08T00:00:00Z", "c", [11, 22, 33])
    schema = again.schema
    for group in (first, [again]):
        for s in group:
            s.coalesce(1).write.mode("append").parquet(src)
        signal_stream.write_signals(spark.readStream.schema(schema).parquet(src), out, state, parts=4)
    live = signal_stream.current_signals(spark, out, cats, "t")
    every = first[0].union(first[1]).union(again)
    batch = sig.compute_signals(sig.explode_snapshots(every), cats, "t")
    assert sorted(map(str, live.select(batch.columns).collect())) == sorted(
        map(str, batch.collect()))
    assert live.filter("geo = 'ES-MD'").agg(F.max("interest_avg")).first()[0] == 33.0


def test_weekly_means_close_with_the_watermark(spark, tmp_path):
    src = str(tmp_path / "src")
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    spark.createDataFrame([("k", d, float(i)) for i, d in enumerate(days)],
                          "keyword string, ts timestamp, value double").write.parquet(src)
    live = spark.readStream.schema("keyword string, ts timestamp, value double").parquet(src)
    out = str(tmp_path / "out")
    signal_stream.write_weekly_means(live, "keyword", out, str(tmp_path / "state"))
    got = {str(r["window_start"]): (r["interest_avg"], r["points"])
           for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01": (3.0, 7), "2024-01-08": (10.0, 7), "2024-01-15": (17.0, 7)}
