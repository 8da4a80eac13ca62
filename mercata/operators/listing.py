"""Joined listings, counts and pages."""

from pyspark.sql import DataFrame, Window as W, functions as F

from .filters import equal_where_given, in_stock


def inventory_listing(inventory, shops, region=None, in_stock_only=False):
    rows = in_stock(inventory) if in_stock_only else inventory
    names = equal_where_given(shops, region_id=region).select(
        "shop_id", F.col("name").alias("shop_name"), "region_id")
    return rows.join(names, "shop_id")


def page(df: DataFrame, keys, number, size) -> DataFrame:
    """One page of a total order. Tasks keep only the first number*size rows."""
    return df.orderBy(*keys).offset((number - 1) * size).limit(size)


def stores_by_rating(stores, group="neighbourhood", limit=None):
    """Stores with their `place` in a group, best rated first, unrated last."""
    order = W.partitionBy(group).orderBy(F.col("rating").desc_nulls_last(), "shop_id")
    rows = stores.withColumn("place", F.row_number().over(order))
    return rows if limit is None else rows.filter(F.col("place") <= limit)


def page_after(df, keys, last, size):
    """The page that follows the key `last`: no depth cost, filter pushed down."""
    cond = F.lit(False)
    for i, k in enumerate(keys):
        tie = F.lit(True)
        for same, value in zip(keys[:i], last):
            tie &= F.col(same) == F.lit(value)
        cond |= tie & (F.col(k) > F.lit(last[i]))
    return df.filter(cond).orderBy(*keys).limit(size)


def page_totals(df, size):
    n = F.count(F.lit(1))
    return df.agg(n.alias("total_items"),
                  F.ceil(n / F.lit(size)).cast("long").alias("total_pages"))


def region_counts(shops):
    return (shops.filter(F.col("region_id").isNotNull())
            .groupBy("region_id").agg(F.count(F.lit(1)).alias("shop_count")))


def regions_with_counts(regions, shops):
    joined = regions.join(region_counts(shops), "region_id", "left")
    return joined.withColumn("shop_count", F.coalesce("shop_count", F.lit(0)))


def totals(**tables):
    """One row with the row count of each table."""
    rows = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(name))
            for name, df in tables.items()]
    stacked = rows[0]
    for r in rows[1:]:
        stacked = stacked.unionByName(r)
    return stacked.agg(*[
        F.max(F.when(F.col("t") == name, F.col("n"))).alias(name) for name in tables])


def with_store_facts(hits, stores, facts=("store_name", "store_rating")):
    """Left join of store columns; stores nobody refers to are cut first."""
    needed = stores.join(hits.select("store_id").distinct(), "store_id", "left_semi")
    return hits.join(needed.select("store_id", *facts), "store_id", "left")


def with_rating(products, stores):
    ratings = stores.select("store_id", "rating")
    return (products.join(ratings, "store_id", "left")
            .withColumn("rating", F.coalesce("rating", F.lit(0.0))))
