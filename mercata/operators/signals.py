"""Weekly demand signals from captured interest points.

Points: `keyword, geo, timeframe, capture_id, captured_at, d, value`.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import ids, num, text, vocab

SERIES = ["keyword", "geo", "timeframe"]


def week_of(d):
    start = F.date_trunc("week", text.col(d)).cast("date")
    return start, F.date_add(start, 6)


def explode_snapshots(snapshots):
    """One row per captured point; an empty series gives none."""
    return (snapshots.select("keyword", "geo", "timeframe",
                             F.col("id").alias("capture_id"), "captured_at",
                             F.explode("series").alias("_p"))
            .select("*", F.col("_p.date").cast("date").alias("d"),
                    F.col("_p.value").alias("value")).drop("_p"))


def weekly_interest(points: DataFrame) -> DataFrame:
    """Mean interest per ISO week, from the most recent capture of that week.

    Captures are on different scales and are never averaged together. Both
    steps are aggregations with a map-side half, so a keyword that holds most
    of the points is already reduced to weeks before the shuffle.
    """
    start, end = week_of("d")
    per_capture = points.groupBy(
        *SERIES, start.alias("window_start"), "capture_id", "captured_at"
    ).agg(num.exact_mean("value").alias("_mean"))
    # unparseable timestamps rank lowest: nulls sort first in a struct
    newest = F.struct(F.col("captured_at").try_cast("timestamp").alias("t"),
                      F.col("captured_at").alias("raw"), "capture_id", "_mean")
    won = per_capture.groupBy(*SERIES, "window_start").agg(
        F.max(newest).alias("_w"))
    return won.select(
        *SERIES, "window_start", F.date_add("window_start", 6).alias("window_end"),
        num.half_even("_w._mean").alias("interest_avg"),
        F.array("_w.capture_id").alias("snapshot_ids"))


def delta_pct(now, before):
    change = (now - before) / before * F.lit(100.0)
    return (F.when(before > 0, num.half_even(change))
            .when(before.isNotNull() & (now > 0), F.lit(100.0))
            .otherwise(F.lit(0.0)))


def direction(delta):
    return (F.when(delta >= vocab.DIRECTION_PCT, "rising")
            .when(delta <= -vocab.DIRECTION_PCT, "falling").otherwise("flat"))


def with_movement(weekly):
    """Delta, direction, gap flag and confidence; a series has one row a week."""
    series = W.partitionBy(*SERIES)
    weeks = series.orderBy("window_start")
    last = weeks.rowsBetween(-(vocab.STABLE_WEEKS - 1), 0)
    w = weekly.withColumn("delta_pct", delta_pct(
        F.col("interest_avg"), F.lag("interest_avg").over(weeks)))
    w = w.withColumn("direction", direction(F.col("delta_pct")))
    w = w.withColumn("_gap", F.datediff(
        "window_start", F.lag("window_end").over(weeks)) > 1)
    w = w.withColumn("_weeks", F.row_number().over(weeks))
    w = w.withColumn("_stable", (F.min("direction").over(last)
                                 == F.max("direction").over(last))
                     & (F.col("_weeks") >= vocab.STABLE_WEEKS))
    w = w.withColumn("_gap", F.coalesce(F.max("_gap").over(series), F.lit(False)))
    high = ((F.col("_weeks") >= vocab.HIGH_WEEKS) & F.col("_stable")
            & (F.col("interest_avg") >= vocab.HIGH_INTEREST))
    medium = ((F.col("_weeks") >= vocab.MEDIUM_WEEKS)
              & (F.col("interest_avg") >= vocab.MEDIUM_INTEREST))
    return w.withColumn("confidence", F.when(F.col("_gap"), "low").when(high, "high")
                        .when(medium, "medium").otherwise("low")
                        ).drop("_gap", "_weeks", "_stable")


def with_rank(moved):
    """Dense rank inside a window; one row per keyword of the universe."""
    peers = W.partitionBy("window_start", "window_end", "geo", "timeframe").orderBy(
        F.col("interest_avg").desc())
    return moved.withColumn("rank", F.dense_rank().over(peers))


def with_category(signals, categories):
    """Category whose key equals the keyword's; the first by name wins."""
    lookup = (categories.filter(F.col("category").isNotNull())
              .select("category").distinct()
              .groupBy(text.keyword_key("category").alias("_k"))
              .agg(F.min("category").alias("category")))
    s = signals.withColumn("_k", text.keyword_key("keyword"))
    return s.join(lookup, "_k", "left").drop("_k")


def finish_signals(moved, categories, computed_at=None) -> DataFrame:
    """Rank, category and id on top of the movement of every series."""
    s = with_category(with_rank(moved), categories)
    at = F.current_timestamp() if computed_at is None else F.lit(computed_at)
    return s.select(
        ids.signal_id("keyword", "geo", "timeframe", "window_start", "window_end")
        .alias("id"), "keyword", "category", "geo", "timeframe", "window_start",
        "window_end", "interest_avg", "delta_pct", "direction", "rank",
        "confidence", "snapshot_ids", at.alias("computed_at"))


def compute_signals(points, categories, computed_at=None) -> DataFrame:
    moved = with_movement(weekly_interest(points))
    return finish_signals(moved, categories, computed_at)


def latest_window(signals):
    """Rows of the newest window of each timeframe."""
    newest = signals.groupBy("timeframe").agg(
        F.max("window_start").alias("window_start"))
    return signals.join(newest, ["timeframe", "window_start"], "left_semi")


def discovery_parents(signals, as_of, top_n=vocab.DISCOVERY_TOP_N,
                      min_interest=vocab.DISCOVERY_MIN_INTEREST):
    """Keywords worth a discovery request: the movers of the newest closed week."""
    from .filters import closed_windows
    eligible = closed_windows(signals, as_of)
    newest = eligible.agg(F.max("window_start")).scalar()
    best = (eligible.filter((F.col("window_start") == newest)
                            & (F.col("interest_avg") >= min_interest))
            .groupBy("keyword").agg(F.max("delta_pct").alias("delta_pct")))
    return best.orderBy(F.col("delta_pct").desc(), "keyword").limit(max(top_n, 0))


def list_signals(signals, order="rank", limit=None, after=None, **filters):
    """Filtered signals in a total order; `after` holds the order values of the last
    row of the page before (`order`, window_start, geo, keyword, id)."""
    from .filters import equal_where_given
    if order not in ("rank", "window_start"):
        raise ValueError(f"unsupported order: {order}")
    rows = equal_where_given(signals, **filters)
    keys = list(dict.fromkeys([order, "window_start", "geo", "keyword", "id"]))
    if after is not None:
        rows = rows.filter(F.struct(*keys) > F.struct(*[
            F.lit(x).cast(rows.schema[k].dataType).alias(k) for k, x in zip(keys, after, strict=True)]))
    rows = rows.orderBy(*keys)
    return rows if limit is None else rows.limit(limit)


def newest_captures(snapshots, timeframe, limit=None, before=None):
    """Newest first; `before` is (captured_at, id) of the last row of the page before."""
    rows = snapshots.filter(F.col("timeframe") == timeframe)
    if before is not None:
        at, last = before
        rows = rows.filter((F.col("captured_at") < at) | ((F.col("captured_at") == at) & (F.col("id") > last)))
    rows = rows.orderBy(F.col("captured_at").desc(), "id")
    return rows if limit is None else rows.limit(limit)
