"""OSM elements to shop records."""

from pyspark.sql import DataFrame, functions as F

from ..functions import text, vocab
from . import contracts
from .filters import inside_city


def categories_of(tags):
    """Every category whose selectors the tags meet, in the fixed order."""
    def met(category):
        cond = F.lit(False)
        for key, value in vocab.CATEGORY_TAGS[category]:
            cond |= F.coalesce(F.element_at(tags, key) == value, F.lit(False))
        return F.when(cond, F.lit(category))
    return F.array_compact(F.array(*[met(c) for c in vocab.CATEGORIES]))


def address_of(tags):
    """`street number, postcode city`; null when nothing is known."""
    def tag(name):
        return F.nullif(F.element_at(tags, f"addr:{name}"), F.lit(""))
    street = F.when(tag("street").isNotNull(), text.strip(
        F.concat_ws(" ", tag("street"), tag("housenumber"))))
    town = F.nullif(F.concat_ws(" ", tag("postcode"), tag("city")), F.lit(""))
    return F.nullif(F.concat_ws(", ", street, town), F.lit(""))


def shop_records(elements: DataFrame, source, fetched_at=None) -> DataFrame:
    """Named, categorised elements inside the city, as shop records."""
    tags = F.col("tags")
    paired = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") \
        if fetched_at is None else F.lit(fetched_at)
    rows = elements.select(
        F.concat(F.lit("osm:"), "type", F.lit(":"), F.col("id").cast("string"))
        .alias("shop_id"), F.col("id").alias("osm_id"),
        F.element_at(tags, "name").alias("name"),
        categories_of(tags).alias("categories"),
        F.when(paired, F.col("lat")).otherwise(F.col("center.lat")).alias("lat"),
        F.when(paired, F.col("lon")).otherwise(F.col("center.lon")).alias("lng"),
        address_of(tags).alias("address"), F.lit(source).alias("source"),
        at.alias("fetched_at"))
    named = rows.filter((F.length("name") > 0) & (F.size("categories") > 0))
    return inside_city(named)


def valid_shops(records):
    return contracts.valid_rows(records, contracts.shop())


def new_shops(records, known):
    return records.join(known.select("shop_id"), "shop_id", "left_anti")


def region_records(gazetteer, created_at):
    """Regions from gazetteer places: slug id, title-case name."""
    return gazetteer.select(
        text.slug("name").alias("region_id"), F.initcap("name").alias("name"),
        "lat", "lng", F.lit("gazetteer").alias("source"),
        F.lit(created_at).cast("timestamp").alias("created_at"))
