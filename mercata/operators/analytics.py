"""The three dashboard segments and their confidence labels."""

from pyspark.sql import DataFrame, functions as F

from ..functions import num, text, vocab
from .signals import latest_window


def top_movers(signals: DataFrame, limit=vocab.TOP_MOVERS) -> DataFrame:
    """Best-ranked row per keyword, newest window on a tie, unranked last."""
    tie = ["geo"] if "geo" in signals.columns else []
    order = F.struct(F.col("rank").isNull().alias("a"), F.col("rank").alias("b"),
                     (-F.unix_date("window_end")).alias("c"), *tie)
    fields = ["keyword", "category", "interest_avg", "delta_pct", "direction",
              "confidence", "window_end", "rank"]
    rows = signals.groupBy("keyword").agg(
        F.min_by(F.struct(*fields), order).alias("_r"))
    return (rows.select("_r.*")
            .orderBy(F.col("rank").asc_nulls_last(), F.col("window_end").desc(), "keyword")
            .limit(limit))


def weakest(confidence):
    """Aggregate: the lowest label; no rows or an unknown label give `low`."""
    order = {label: i for i, label in enumerate(vocab.CONFIDENCE_ORDER)}
    level = F.coalesce(text.pick(order, text.col(confidence)), F.lit(0))
    low = F.coalesce(F.min(level), F.lit(0))
    return F.get(text.words(vocab.CONFIDENCE_ORDER), low)


def census(rows_read, cap=None):
    """`low` if a capped read came back full, so rows may be missing; else `high`."""
    if cap is None:
        return F.lit("high")
    return F.when(rows_read < cap, "high").otherwise("low")


def category_mix(products):
    """Products and share per category."""
    named = products.withColumn("category", text.strip("category")).filter(
        F.col("category") != "")
    counts = named.groupBy("category").agg(F.count(F.lit(1)).alias("product_count"))
    total = named.agg(F.count(F.lit(1)).cast("double")).scalar()
    share = num.half_even(F.col("product_count") / total * F.lit(100.0))
    return counts.select("category", share.alias("share_pct"), "product_count")


def stock_out_risk(products):
    """Share of readable SKUs at or under the threshold, per category."""
    qty = num.whole_number("qty")
    rows = (products.select(text.strip("category").alias("category"), qty.alias("_q"))
            .filter((F.col("category") != "") & F.col("_q").isNotNull()))
    out = rows.groupBy("category").agg(
        F.count_if(F.col("_q") <= vocab.STOCK_OUT_QTY).alias("at_risk_count"),
        F.count(F.lit(1)).alias("total_count"))
    pct = F.col("at_risk_count") / F.col("total_count") * F.lit(100.0)
    return out.withColumn("risk_pct", num.half_even(pct))


def _document_points(points, order, fields):
    """One row: the points as an ordered array, empty when there are none.

    The segments are bounded: at most 20 movers, one point per category.
    """
    one = F.struct(*order, F.struct(*fields).alias("p"))
    return points.agg(F.transform(F.array_sort(F.collect_list(one)),
                                  lambda x: x["p"]).alias("points"))


def dashboard(signals, products, timeframe, generated_at, cap=None):
    """One JSON document with the three labelled segments.

    `cap` is the row limit under which `products` was read, if there was one.
    """
    current = latest_window(signals.filter(F.col("timeframe") == timeframe))
    movers = top_movers(current)
    read = census(products.agg(F.count(F.lit(1))).scalar() if cap else None, cap)
    m = (movers.agg(weakest("confidence").alias("mc")))
    mp = _document_points(
        movers, ["rank", (-F.unix_date("window_end")).alias("o"), "keyword"],
        ["keyword", "category", "interest_avg", "delta_pct", "direction"])
    cp = _document_points(category_mix(products), ["category"],
                          ["category", "share_pct", "product_count"])
    sp = _document_points(stock_out_risk(products), ["category"],
                          ["category", "at_risk_count", "total_count", "risk_pct"])

    def segment(label, points):
        return F.struct(label.alias("confidence"), points.alias("points"))
    body = F.struct(
        F.lit("convenience_store").alias("inventory_type"),
        F.lit("live").alias("generated_from"),
        F.lit(generated_at).alias("generated_at"),
        F.lit(vocab.CAVEAT).alias("caveat"),
        F.struct(segment(m.scalar(), mp.scalar()).alias("top_movers"),
                 segment(read, F.col("points")).alias("category_mix"),
                 segment(read, sp.scalar()).alias("stock_out_risk")).alias("segments"))
    return cp.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
