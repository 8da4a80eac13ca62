"""Shop ingest and region listings."""

from pyspark.sql import DataFrame

from ..operators import ingest, listing, places, upsert


def ingest_shops(elements: DataFrame, known: DataFrame, source, fetched_at=None):
    """(shop table after the upsert, shops seen for the first time)."""
    records = ingest.valid_shops(ingest.shop_records(elements, source, fetched_at))
    table = upsert.replace_upsert(known, records, ["shop_id"], order="fetched_at")
    return table, ingest.new_shops(records, known)


def regions(shops, region_table):
    """(shops with region, regions with shop counts by name)."""
    assigned = places.nearest_region(shops, region_table)
    counted = listing.regions_with_counts(region_table, assigned).orderBy("name")
    return assigned, counted
